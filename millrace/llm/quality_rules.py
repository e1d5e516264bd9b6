"""Quality rules from the repeated substrings of a text, found in a suffix array over its words.

The suffixes of all documents of a block are sorted together by prefix doubling
(ranks start with the document, so no repeat crosses documents). Each suffix's
longest common prefix with its neighbours is the value of the deepest LCP interval
that holds it, that is, the longest repeat starting there. The union of the spans of
all intervals of a length or more equals the union of the spans of the maximal
repeats of that length or more, since extending a repeat to the left only widens it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, with_columns

#: Fixed limits of the base rules.
LEAST_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Limits of the method: repeats of at least MIN_REPEAT words count; they may cover this
#: percentage of the words, and the longest may hold so many words.
MIN_REPEAT = 5
MOST_COVERED = 40
MOST_REPEAT = 100

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[i for i in range(256) if i & 0xC0 != 0x80 and i != 0x20 and not 9 <= i <= 13]] = 1
_CLASS[list(SYMBOLS)] |= 2


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and LCP with the suffix before, over the words of documents laid end to end.

    words: ids from 0; doc: the document of each word, not decreasing. Prefix doubling
    re-sorts only suffixes that still share their rank with others.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")
    _, rank = np.unique(doc.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)
    order = np.argsort(rank, kind="stable")

    def starts(keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the first place of each one's run."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    place = starts(rank[order])
    rank = np.empty(n, np.int64)
    rank[order] = place
    levels, h = [rank.astype(np.int32 if n < 2**31 else np.int64)], 1
    while True:
        shared = (place == np.append(place[1:], -1)) | (place == np.concatenate(([-1], place[:-1])))
        at = np.flatnonzero(shared)
        if not len(at):
            break
        s = order[at]
        ahead = s + h
        second = np.where(ahead < end[s], rank[np.minimum(ahead, n - 1)], -1)
        key = rank[s] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[at] = s[by]
        run = starts(key[by])
        place[at] = at[run]
        rank = rank.copy()
        rank[order[at]] = place[at]
        levels.append(rank.astype(levels[0].dtype))
        h *= 2
    # LCP of neighbours, from the highest power of two down: equal ranks share that many words.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(doc[a] == doc[b])
    a, b, ea, eb = a[live], b[live], end[a[live]], end[b[live]]
    got = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        r = levels[k]
        inside = (a < ea) & (b < eb)
        equal = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        step = equal.astype(np.int64) << k
        a, b, got = a + step, b + step, got + step
    lcp[live + 1] = got
    return order, lcp


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat that starts there (0: none)."""
    order, lcp = suffix_array(words, doc)
    longest = np.zeros(len(words), np.int64)
    if len(words):
        longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least so many words."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters, symbols, repeated lines and repeated words."""
    size = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    kind = _CLASS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    ids: dict[bytes, int] = {}
    known = ids.setdefault
    codes, counts, dup = [], [], []
    for t in texts:
        ws = t.split()
        counts.append(len(ws))
        codes += [known(w, len(ids)) for w in ws]
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    n = np.asarray(counts, dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(n)))
    longest = repeats(np.asarray(codes, dtype=np.int64), np.repeat(np.arange(len(texts)), n))
    peak = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        peak[some] = np.maximum.reduceat(longest, bounds[some])
    return {
        "n_words": n,
        "word_chars": _per_doc(kind & 1, size),
        "n_symbols": _per_doc(kind >> 1, size),
        "n_dup_lines": np.asarray(dup, dtype=np.int64),
        "n_repeat_words": _per_doc(covered(longest, BASE_WINDOW), bounds),
        "covered_words": _per_doc(covered(longest, min_repeat), bounds),
        "longest_repeat": peak,
    }


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_covered: int = MOST_COVERED, most_repeat: int = MOST_REPEAT) -> DataFrame:
    """All columns of docs, then the measures and base_failed and kept in one struct `rules`.

    A text is kept if it passes the base rules, repeats of min_repeat words or more
    cover at most most_covered percent of its words, and no repeat is longer than
    most_repeat words. Null and empty texts have no words and fail. Rows are judged
    one by one: repeated rows and ids do not matter. An empty table gives no rows.
    """
    keep = list(docs.columns)
    name = "__mr_rules"

    def judge(batches):
        for batch, texts in blocks(batches):
            m = measure(texts, min_repeat)
            arrays = {k: pa.array(v, type=pa.int64()) for k, v in m.items()}
            struct = pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays))
            yield with_columns(batch, keep, {name: struct})

    fields = ", ".join(f"{m}: bigint" for m in _MEASURES)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"{name} struct<{fields}>"])
    r = F.col(name)
    failed = (r["n_words"] < LEAST_WORDS) | (100 * r["n_repeat_words"] > BASE_PERCENT * r["n_words"])
    fine = (100 * r["covered_words"] <= most_covered * r["n_words"]) & (r["longest_repeat"] <= most_repeat)
    measured = docs.mapInArrow(judge, schema)
    return measured.select(*[F.col(f"`{c}`") for c in keep], F.struct(*[r[m] for m in _MEASURES], failed.alias("base_failed"), (~failed & fine).alias("kept")).alias(name))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns.

    Null and empty texts go. Rows are judged one by one, so equal texts, repeated and
    null ids get the same answer. A text of any length is judged whole, in one task; an
    empty table gives none.
    """
    return quality_rules(docs).filter("__mr_rules.kept").drop("__mr_rules")
