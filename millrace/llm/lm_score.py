"""Scores of texts under word-unigram counts and under a causal self-attention model of subwords.

Words of the whole table are counted first. From the counts come the base score (the
most frequent words, a bounded number, are broadcast; the others meet their counts in
an ordinary join), the pieces that words are spelled with (byte pairs merged in the
training counts of the broadcast words) and the frequencies of subword ids in all
training words. The most frequent ids and all single bytes (with learnt pieces, those that
any word holds) become the model's slots; other ids, which only a vocabulary from outside
has, are spelled in bytes. Pairs of slots are counted over all training texts; the model starts from them. Training and scoring
cut each text into the same overlapping windows, in which every slot is a target
once. Training goes over every window once, dealt over ROUNDS rounds: in each, learners
go over that round's windows of their own partitions, a bounded number in memory at a
time, and their weights are averaged.
"""

from __future__ import annotations

import base64
import hashlib
import math
import sys
import types
from collections import Counter
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as net
from .blocks import blocks, with_columns
from .common import id_remainder, stored
from .tokens import CACHE_WORDS

#: The ranks of the byte-level vocabulary where no word is known to learn pieces from, and the pattern that goes with them.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A word goes through learnt pieces in stretches of so many characters, so that no word takes long.
STRETCH = r" [^ ]{0,63}|[^ ]{1,64}"
FOLDS, HELD_OUT = 10, 0
#: Most frequent words that are broadcast, at most.
FREQUENT = 200_000
#: Training texts are dealt to the learners in runs of so many windows.
WINDOWS_PER_RUN = 64
#: Windows dealt to one learner's partition, windows that a learner holds at a time, and those of one step.
WINDOWS_PER_LEARNER, HELD, BATCH = 65_536, 32_768, 192
#: A table of fewer windows than two learners' share is gone over more than once, so many times at most.
MOST_PASSES = 8
#: The learning rate of each round.
RATES = (0.016, 0.012, 0.008, 0.005, 0.002)
SCORE_BATCH = 256
#: Bytes of text whose words are counted, and spelled, at a time, and bytes of runs that a scoring task windows at a time.
COUNT_BYTES, SPELL_BYTES = 8_000_000, 3_000_000
FLUSH = 400_000
#: Rows of runs that are taken out of an Arrow batch at a time.
PIECE = 512


#: A file of ranks, or the pieces learnt, in the order in which they were merged.
Vocabulary = str | tuple[bytes, ...]


def encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    return _encoding(vocabulary)[0]


def _encoding(vocabulary: Vocabulary) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of this Python process, and which ids begin with a space; of learnt pieces, it keeps those met last."""
    kept = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept"))
    table = kept.__dict__.setdefault("encodings", {})
    if vocabulary not in table:
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = public_tokenizers.PATTERN
        else:
            for old in [k for k in table if not isinstance(k, str)]:
                del table[old]
            ranks = {x: i for i, x in enumerate([*(bytes([b]) for b in range(256)), *vocabulary])}
            pattern = STRETCH
        opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        opens[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        table[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), opens
    return table[vocabulary]


def learnt_pieces(words: dict[bytes, int], most: int) -> tuple[bytes, ...]:
    """Up to `most` pieces, by merging the pair of neighbours that occurs most often, again and again.

    Words stand behind a space and count as often as they occur; of pairs that occur
    equally often, the one of earlier pieces goes first, so the order of words is nothing.
    """
    table = sorted((w, c) for w, c in words.items() if c > 0)
    pieces, number, cap = [bytes([b]) for b in range(256)], {bytes([b]): b for b in range(256)}, 257 + most
    stop = cap - 1  # stands between words
    s = np.concatenate([np.frombuffer(b" " + w, np.uint8) for w, _ in table] or [np.zeros(0, np.uint8)]).astype(np.int32)
    sizes = np.array([len(w) + 1 for w, _ in table], dtype=np.int64)
    s = np.insert(s, np.cumsum(sizes), stop)
    times = np.repeat(np.array([c for _, c in table], dtype=np.float64), sizes + 1)
    n = np.bincount(s[:-1] * cap + s[1:], weights=times[:-1], minlength=cap * cap)

    def add(at: np.ndarray, sign: int) -> None:
        """Counts the pairs at these places in or out."""
        at = np.unique(at)
        at = at[(at >= 0) & (at < len(s) - 1)]
        np.add.at(n, s[at] * cap + s[at + 1], sign * times[at])
        n.reshape(cap, cap)[stop], n.reshape(cap, cap)[:, stop] = 0, 0

    add(np.zeros(0, np.int64), 1)
    while len(pieces) < 256 + most and len(s) > 1:
        best = int(n.argmax())
        if n[best] < 2:
            break
        a, b = divmod(best, cap)
        at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
        if a == b:  # in a row of equal pieces, every other pair
            first = np.concatenate(([True], np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
        piece = pieces[a] + pieces[b]
        if piece not in number:
            number[piece] = len(pieces)
            pieces.append(piece)
        add(np.concatenate((at - 1, at, at + 1)), -1)
        s[at] = number[piece]
        keep = np.ones(len(s), dtype=bool)
        keep[at + 1] = False
        s, times = s[keep], times[keep]
        at -= np.arange(len(at))
        add(np.concatenate((at - 1, at)), 1)
    return tuple(pieces[256:])


def subwords(t: tiktoken.Encoding, word: bytes) -> list[int]:
    return t.encode_ordinary(" " + word.decode("utf-8", "replace"))


def all_subwords(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of the words (with the space before each) end to end, and where each word's begin; their number is last.

    Learnt pieces have a space at their beginning only, and words have none inside, so
    many words are read in one call.
    """
    t, opens = _encoding(vocabulary)
    if isinstance(vocabulary, str):
        found = [subwords(t, w) for w in words]
        return np.array([i for ids in found for i in ids], dtype=np.int64), np.cumsum([0, *map(len, found)])
    ids = np.array(t.encode_ordinary(b" ".join([b"", *words]).decode("utf-8", "replace")), dtype=np.int64)
    return ids, np.append(np.flatnonzero(opens[ids]), len(ids))


class Slots:
    """Which slot each subword id has; ids without one are spelled by single bytes, of which `used` have a slot (without it, all)."""

    def __init__(self, path: Vocabulary, counts: dict[int, int], used: Iterable[int] | None = None):
        t = encoding(path)
        self.path, self.used = path, sorted(range(256) if used is None else used)
        letters = {t.encode_single_token(bytes([b])) for b in self.used}
        others = sorted((i for i in counts if i not in letters), key=lambda i: (-counts[i], i))[: net.SLOTS - net.CLASS_SIZE - len(letters)]
        kept, spelled = letters | set(others), {}
        total: Counter = Counter()
        for i, n in counts.items():
            if i not in kept:
                spelled[i] = bytes_of(t, i)
            for j in spelled.get(i, [i]):
                total[j] += n
        # Slots that begin a word (their bytes begin with its space), then, from a class edge on, those that go on in it.
        order = sorted(kept, key=lambda i: (not begins(t, i), -total[i], i))
        n_begin = sum(begins(t, i) for i in kept)
        gap = -(1 + n_begin) % net.CLASS_SIZE
        slot = {i: s + (gap if s > n_begin else 0) for s, i in enumerate(order, 1)}
        self.table = {i: [slot[j] for j in spelled[i]] if i in spelled else [slot[i]] for i in kept | set(spelled)}
        self.slot = slot
        self.n_slots = sum(n * len(self.table[i]) for i, n in counts.items())
        self.key = hashlib.md5(repr(order).encode()).hexdigest()

    def reader(self) -> SlotReader:
        """The words met so far by this process with these slots; another table's words are dropped."""
        kept = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept"))
        if getattr(kept, "slots_key", None) != self.key:
            kept.slots_key, kept.slots = self.key, SlotReader(self)
        return kept.slots


def begins(t: tiktoken.Encoding, i: int) -> bool:
    return t.decode_single_token_bytes(i)[:1] == b" "


def bytes_of(t: tiktoken.Encoding, i: int) -> list[int]:
    return [t.encode_single_token(bytes([b])) for b in t.decode_single_token_bytes(i)]


class SlotReader:
    def __init__(self, slots: Slots):
        self.slots, self.words = slots, {}
        t = encoding(slots.path)
        letters = {b: slots.slot[t.encode_single_token(bytes([b]))] for b in slots.used}
        # The slots of every subword id, end to end, with their number and where they begin; none of ids with bytes that have no slot.
        spelled = {i: slots.table.get(i) or ([letters[b] for b in x] if letters.keys() >= set(x) else []) for x in t.token_byte_values() for i in [t.encode_single_token(x)]}
        self.sizes = np.zeros(max(spelled) + 1, np.int64)
        self.sizes[list(spelled)] = [len(x) for x in spelled.values()]
        self.first = np.zeros_like(self.sizes)
        self.first[list(spelled)] = np.cumsum([0, *map(len, spelled.values())])[:-1]
        self.flat = np.array([j for x in spelled.values() for j in x], dtype="<u2")

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words (with the space before each) end to end, and where each word's begin; their number is last."""
        ids, cut = all_subwords(self.slots.path, words)
        n = self.sizes[ids]
        if not n.all():
            raise ValueError("a word holds a byte that was in none of the counted words")
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.flat[np.repeat(self.first[ids] - ends[:-1], n) + np.arange(ends[-1])], ends[cut]

    def _spell(self, words: list[bytes]) -> list[bytes]:
        slots, ends = self.spelled(words)
        whole, at = slots.tobytes(), (2 * ends).tolist()
        return [whole[i:j] for i, j in zip(at, at[1:])]

    def of(self, words: list[bytes], among: Container[bytes] | None = None) -> list[bytes]:
        """Slots of each word (with the space before it), as 16-bit numbers; with `among`, only words of it are remembered."""
        known = self.words
        found = list(map(known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self._spell([words[k] for k in new]), strict=True):
            found[k] = x
            if len(known) < CACHE_WORDS and (among is None or words[k] in among):
                known[words[k]] = x
        return found


def forget() -> None:
    """Drops the words that this process remembers for slots, and gives free memory back, before a pass that spells none."""
    kept = sys.modules.get("_millrace_kept")
    if kept is not None:
        kept.__dict__.pop("slots", None)
        kept.__dict__.pop("slots_key", None)
    net.release_memory()


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PIECE rows; when they end, free memory is given back for the executor's other tasks."""
    for batch in batches:
        for i in range(0, len(batch), PIECE):
            yield batch.slice(i, PIECE)
    net.release_memory()


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, rid, train and text: what every pass over the texts reads."""
    train = id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), train.alias("train"), "text")


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of a block (an empty one may be among them), the place there of each word of the texts, and its text."""
    lower = pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    lists = pc.ascii_split_whitespace(lower)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.view(pa.large_binary()), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    nothing = pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()  # before and after outer white space
    if nothing >= 0:
        real = codes != nothing
        codes, text = codes[real], text[real]
    return words, codes, text


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): occurrences of each word in training texts and in all texts. Blocks of texts sum up their own first."""

    def scan(batches):
        forget()
        for batch, texts in blocks(batches, most=COUNT_BYTES):
            words, codes, text = split_words(texts)
            n = np.bincount(codes, minlength=len(words))
            c = np.bincount(codes[np.array(_column(batch, "train").to_pylist(), dtype=bool)[text]], minlength=len(words))
            out = pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])
            yield out.filter(pa.array(n > 0))
        net.release_memory()

    found = rows.select("train", "text").mapInArrow(scan, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words whose count in all texts reaches a bound, chosen so that they are `most` at most."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect()
    total, bound = 0, None
    for r in bins:
        total += r["k"]
        if total > most:
            break
        bound = r["bin"]
    if bound is None:
        return counts.limit(0)
    return counts.filter(step >= bound)


def subword_counts(counts: DataFrame, path: Vocabulary) -> dict[int, int]:
    """Occurrences of each subword id in the training texts; the vocabulary bounds the result."""

    def scan(batches):
        total = np.zeros(encoding(path).n_vocab, np.int64)
        for batch in pieces(batches):
            ids, cut = all_subwords(path, batch.column(0).to_pylist())
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), np.diff(cut)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "c"])

    found = counts.filter("c > 0").select("word", "c").mapInArrow(scan, "id long, c long")
    return {r["id"]: r["c"] for r in found.groupBy("id").agg(F.sum("c").alias("c")).collect()}


def bytes_in(counts: DataFrame) -> list[int]:
    """The bytes of all counted words as they are spelled, and the space before them."""

    def scan(batches):
        total = np.zeros(256, np.int64)
        for batch in pieces(batches):
            words = b" ".join([b"", *batch.column(0).to_pylist()]).decode("utf-8", "replace").encode()
            total += np.bincount(np.frombuffer(words, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64())], names=["b"])

    return sorted({32} | {r["b"] for r in counts.select("word").mapInArrow(scan, "b long").distinct().collect()})


def slot_runs(rows: DataFrame, slots: Slots, known: dict[bytes, int], n: int, v: int, n_ends: int) -> DataFrame:
    """All slots of every text and its end, in runs of WINDOWS_PER_RUN windows at most: rid, train, slots, part and turn.

    A run of part 0 begins its text, and carries what is known of the text as a whole:
    doc_id, n_tokens, the base score and n_known as far as `known` words go, and the
    other words with their counts. A run of part 1 goes on in the text, and repeats the
    slots of the window before as context. turn is the round in which a run is learnt.
    """
    window = 2 * net.STRIDE  # bytes
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((known, slots))
    end_log = log10_share(n_ends, n, v)

    def scan(batches):
        known, slots = shared.value
        reader = slots.reader()
        frequent = list(known)
        # What is known of each frequent word; behind them come, block by block, its other words and an end.
        spelled = pa.array(reader.of(frequent, known), pa.large_binary())
        among = pa.array(frequent, pa.large_binary())
        times = np.array(list(known.values()), dtype=np.int64)
        logs = np.log10((times + 0.1) / (n + 0.1 * (v + 1)))
        end = np.array([net.END], dtype="<u2").tobytes()
        made = 0
        for batch, texts in blocks(batches, most=SPELL_BYTES):
            words, codes, text = split_words(texts)
            place = pc.fill_null(pc.index_in(words, among), -1).to_numpy().astype(np.int32)
            other = np.flatnonzero(place < 0)
            place[other] = len(frequent) + np.arange(len(other))
            others = words.take(pa.array(other))
            at = place[codes]
            is_known = at < len(frequent)
            sizes = np.bincount(text, minlength=len(texts))
            n_known = np.bincount(text[is_known], weights=times[at[is_known]] > 0, minlength=len(texts)).astype(np.int64) + int(n_ends > 0)
            base = np.bincount(text[is_known], weights=logs[at[is_known]], minlength=len(texts)) + end_log
            pairs, m = np.unique(text[~is_known].astype(np.int64) * (len(others) + 1) + at[~is_known] - len(frequent), return_counts=True)
            rare = others.take(pa.array(pairs % (len(others) + 1))).cast(pa.binary())
            n_rare = np.diff(np.searchsorted(pairs, np.arange(len(texts) + 1) * (len(others) + 1)))
            # All slots of the block end to end: every word's, and an end behind each text. Other words are met once a block.
            letters, cut = reader.spelled(others.to_pylist())
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(others), [None, pa.py_buffer(2 * cut), pa.py_buffer(letters)])
            every = pa.concat_arrays([spelled, own, pa.array([end], pa.large_binary())])
            laid = every.take(pa.array(np.insert(at, np.cumsum(sizes), len(every) - 1)))
            edges = np.frombuffer(laid.buffers()[1], np.int64)[np.concatenate(([0], np.cumsum(sizes + 1)))].tolist()
            whole = memoryview(laid.buffers()[2])
            out: dict[str, list] = {name: [] for name in ("row", "slots", "part", "n_tokens", "n_known", "base")}
            for row, (first, last) in enumerate(zip(edges, edges[1:])):
                for i in range(first, last, WINDOWS_PER_RUN * window):
                    begin = i == first
                    out["row"].append(row)
                    out["slots"].append(bytes(whole[max(first, i - window) : min(last, i + WINDOWS_PER_RUN * window)]))
                    out["part"].append(int(not begin))
                    out["n_tokens"].append(int(sizes[row]) + 1 if begin else None)
                    out["n_known"].append(int(n_known[row]) if begin else None)
                    out["base"].append(float(base[row]) if begin else None)
            turn = (made + np.arange(len(out["row"]))) % len(RATES)
            made += len(turn)
            types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64()}
            arrays = {"slots": pa.array(out["slots"], pa.binary()), "part": pa.array(out["part"], pa.int32()), "turn": pa.array(turn, pa.int32())}
            arrays |= {name: pa.array(out[name], t) for name, t in types.items()}
            # A text's first run holds its other words, runs of part 1 hold none.
            goes_on = np.array(out["part"]) == 1
            ends = pa.array(np.concatenate(([0], np.cumsum(np.where(goes_on, 0, n_rare[out["row"]])))), pa.int32())
            arrays |= {name: pa.ListArray.from_arrays(ends, values, mask=pa.array(goes_on)) for name, values in (("rare", rare), ("times", pa.array(m, pa.int64())))}
            laid = every = own = whole = None
            net.release_memory()
            yield with_columns(batch.take(pa.array(out["row"], pa.int64())), ["doc_id", "rid", "train"], arrays)
        net.release_memory()

    schema = f"doc_id {kind}, rid long, train boolean, slots binary, part int, turn int, n_tokens long, n_known long, base double, rare array<binary>, times array<long>"
    return rows.mapInArrow(scan, schema)


def pair_counts(runs: DataFrame) -> np.ndarray:
    """How often each slot follows each other one in the training texts; every slot counts once."""

    def scan(batches):
        forget()
        total = np.zeros(net.SLOTS * net.SLOTS, np.int64)
        for b in pieces(batches):
            runs, part = b.column(0).to_pylist(), b.column(1).to_numpy()
            s = np.frombuffer(b"".join(runs), "<u2").astype(np.int32)
            first = np.cumsum([0, *(len(r) // 2 for r in runs)])[:-1]
            cells = s.copy()
            cells[1:] += s[:-1] * net.SLOTS
            cells[first] = net.END * net.SLOTS + s[first]
            own = np.ones(len(s), dtype=bool)
            own[(first[part == 1][:, None] + np.arange(net.STRIDE)).ravel()] = False
            total += np.bincount(cells[own], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["cell", "n"])

    found = runs.select("slots", "part").mapInArrow(scan, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(net.SLOTS * net.SLOTS)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(net.SLOTS, net.SLOTS)


def window_rows(runs: list[bytes], part: np.ndarray) -> tuple[np.ndarray, ...]:
    """All windows of the runs: inputs, hidden inputs, targets and their run (-1: none). The first of a run of part 1 is another run's."""
    lengths = np.array([len(r) // 2 for r in runs], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    inputs, hidden, targets, run = net.windows(np.frombuffer(b"".join(runs), "<u2"), bounds)
    per = -(-lengths // net.STRIDE)
    own = np.ones(len(inputs), dtype=bool)
    own[(np.cumsum(per) - per)[np.asarray(part) == 1]] = False
    return inputs[own], hidden[own], targets[own], run[own]


def _learnt(runs: list[bytes], part: list[int]) -> tuple[np.ndarray, ...]:
    inputs, hidden, targets, run = window_rows(runs, np.array(part))
    return inputs, hidden, targets, run >= 0


def window_chunks(batches, most: int):
    """The windows of all runs, in chunks of about `most`."""
    runs, part, size = [], [], 0
    for b in pieces(batches):
        for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            runs.append(r)
            part.append(p)
            size += -(-len(r) // (2 * net.STRIDE)) - p
            if size >= most:
                yield _learnt(runs, part)
                runs, part, size = [], [], 0
    if runs:
        yield _learnt(runs, part)


def windows_in(slots: Slots, n_texts: int) -> int:
    """About how many windows the training texts make."""
    return -(-(slots.n_slots + n_texts) // net.STRIDE)


def train(runs: DataFrame, n: int) -> dict[str, np.ndarray]:
    """The model after all rounds over the training runs, which hold about n windows.

    A learner takes one partition of runs; averages are weighted by windows seen.
    """
    spark = runs.sparkSession
    runs = runs.filter("train")
    tables = net.pair_tables(pair_counts(runs))
    if not n:
        return net.initial() | tables
    passes = max(1, min(MOST_PASSES, 2 * WINDOWS_PER_LEARNER // n))  # a small table is gone over again
    weights = net.flat(net.initial())
    for turn, rate in enumerate(RATES):
        given = spark.sparkContext.broadcast((weights, tables))

        def scan(batches, given=given, rate=rate):
            net.keep_memory()
            weights, tables = given.value

            def steps():
                for k, whole in enumerate(window_chunks(batches, HELD)):
                    size = len(whole[0])
                    rng = np.random.default_rng((size, k))
                    for _ in range(passes):
                        order = rng.permutation(size)
                        for i in range(0, size, BATCH):
                            inputs, hidden, targets, real = (x[order[i : i + BATCH]] for x in whole)
                            yield inputs.astype(np.int64), hidden, targets.astype(np.int64), real

            learnt, seen = net.learn(net.unflat(weights) | tables, steps(), rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([net.flat(learnt)], pa.list_(pa.float32())), pa.array([seen], pa.int64())], names=["w", "seen"])

        mine = runs.filter(F.col("turn") == turn).select("slots", "part")
        found = mine.mapInArrow(scan, "w array<float>, seen long").select("seen", F.posexplode("w").alias("i", "w"))
        mean = found.groupBy("i").agg((F.sum(F.col("w").cast("double") * F.col("seen")) / F.sum("seen")).alias("w")).toArrow()
        if mean.num_rows:
            weights = weights.copy()
            weights[mean.column("i").to_numpy()] = np.round(mean.column("w").to_numpy(), 6)
        given.unpersist()
    return net.unflat(weights) | tables


def log10_share(c: Column | int, n: int, v: int):
    if isinstance(c, Column):
        return F.log10((c + 0.1) / F.lit(n + 0.1 * (v + 1)))
    return math.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def run_scores(runs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(rid, score): the log10 probability of each text under the model, summed over its runs."""
    shared = runs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        net.keep_memory()
        w = shared.value
        for batch in pieces(batches):
            rid, raw, part = (_column(batch, c) for c in ("rid", "slots", "part"))
            own, part = raw.to_pylist(), part.to_numpy()
            out = np.zeros(len(own))
            # Runs are windowed a bounded number at a time.
            cut = np.searchsorted(np.cumsum([len(r) for r in own]), np.arange(0, sum(map(len, own)), FLUSH) + FLUSH)
            for i, j in zip([0, *cut], [*cut, len(own)]):
                inputs, hidden, targets, run = window_rows(own[i:j], part[i:j])
                for k in range(0, len(inputs), SCORE_BATCH):
                    few = slice(k, k + SCORE_BATCH)
                    lp = net.log_probabilities(w, inputs[few].astype(np.int64), hidden[few], targets[few].astype(np.int64)).ravel()
                    at = run[k : k + SCORE_BATCH].ravel()
                    out[i:j] += np.bincount(at[at >= 0], weights=lp[at >= 0], minlength=j - i)
            yield pa.RecordBatch.from_arrays([rid, pa.array(out / math.log(10))], names=["rid", "score"])

    scored = runs.select("rid", "slots", "part").mapInArrow(scan, "rid long, score double")
    return scored.groupBy("rid").agg(F.sum("score").alias("score"))


def score_texts(docs: DataFrame, vocabulary: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Texts are lower-cased (A-Z) and read as words joined by one space; an end follows
    the last word. Null and empty texts are the end alone. Rows that repeat a doc_id
    are counted and scored one by one. Without training rows, counts are zero and the
    model knows no frequencies. An empty table gives no rows; columns besides doc_id
    and text are not read. vocabulary is a file of ranks on every executor; without one,
    pieces are learnt from the training counts of the frequent words.
    """
    rows = prepared(docs)
    counts = stored(word_counts(rows))
    n_ends = rows.filter("train").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n, v = sums[0] + n_ends, sums[1] + int(n_ends > 0)
    known = {bytes(r["word"]): r["c"] for r in frequent_words(counts, frequent).collect()}
    # Bytes that are in no text take no slot from the pieces.
    used = None if vocabulary else bytes_in(counts)
    path = vocabulary or learnt_pieces(known, net.SLOTS - net.CLASS_SIZE - len(used)) or public_tokenizers.path(VOCABULARY)
    slots = Slots(path, subword_counts(counts, path), None if isinstance(path, str) else used)
    n_windows = windows_in(slots, n_ends)
    runs = slot_runs(rows, slots, known, n, v, n_ends)
    # Dealt in turn, so that copies of a text do not gather in one learner and a long text is no single task.
    runs = stored(runs.repartition(max(1, -(-n_windows // WINDOWS_PER_LEARNER))))
    scored = run_scores(runs, train(runs, n_windows if n_ends else 0))
    texts = runs.filter("part = 0")
    each = texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    others = each.join(counts.select("word", "c"), "word").groupBy("rid").agg(
        F.sum(F.col("m") * log10_share(F.col("c"), n, v)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known")
    )
    whole = texts.drop("slots", "rare", "times").join(scored, "rid").join(others, "rid", "left")
    return whole.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
