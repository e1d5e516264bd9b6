"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word is its letters in lower case and its shape (case pattern and punctuation).
Features are hashes of word and shape unigrams and bigrams, and of two events: a word
repeats the one before, and a word trigram was met earlier in the text. A feature's
value is its share of the text's n-grams, so a score is one sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, with_columns
from .common import id_hash, id_remainder, same, stored

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows that are learnt from, at most; the smallest salted digests of doc_id.
SAMPLE = 8_000
BITS = 18
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
SCALE = 8.0
_CORE = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def _word(word: bytes) -> tuple[int, int]:
    """Hashes of a word's letters and of its shape."""
    w = word.decode("utf-8", "replace")
    core = "".join(_CORE.findall(w))
    kind = "9" if core.isdigit() else "A" if len(core) > 1 and core.isupper() else "Aa" if core[:1].isupper() else "a" if core else ""
    marks = re.sub(r"(.)\1+", r"\1+", _CORE.sub("w" if core else "", w))
    return zlib.crc32(b"w" + core.lower().encode()), zlib.crc32(f"s{kind}{marks[:12]}".encode())


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x51ED27, dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _P
        h ^= h >> np.uint64(29)
    return h


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, 1/n-grams of the document) of every n-gram of the texts."""
    ids: dict[bytes, int] = {}
    known = ids.setdefault
    codes: list[int] = []
    counts = []
    for t in texts:
        ws = t.split()
        counts.append(len(ws))
        codes += [known(w, len(ids)) for w in ws]
    n = np.asarray(counts, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    table = np.array([_word(w) for w in ids], dtype=np.uint64).reshape(-1, 2)
    c = np.asarray(codes, dtype=np.int64)
    core, shape = table[c, 0], table[c, 1]
    pair = doc[1:] == doc[:-1]
    two = np.flatnonzero(pair)
    three = np.flatnonzero(pair[1:] & pair[:-1]) if len(pair) > 1 else np.zeros(0, np.int64)
    gram = _mix(core[three], core[three + 1], core[three + 2], doc[three])
    again = np.ones(len(gram), bool)
    again[np.unique(gram, return_index=True)[1]] = False
    repeat = two[core[two] == core[two + 1]]
    found = [
        (doc, _mix(core)),
        (doc, _mix(shape)),
        (doc[two], _mix(core[two], core[two + 1])),
        (doc[two], _mix(shape[two], shape[two + 1])),
        (doc[repeat], np.full(len(repeat), 11, np.uint64)),
        (doc[three[again]], np.full(int(again.sum()), 12, np.uint64)),
    ]
    at = np.concatenate([d for d, _ in found])
    feature = np.concatenate([h for _, h in found])
    feature = (feature ^ (feature >> np.uint64(32))) & np.uint64((1 << bits) - 1)
    return at, feature.astype(np.int64), SCALE / np.maximum(n, 1)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias, by FTRL-proximal over (label, features, values), in the order given."""
    dim = (1 << bits) + 1
    z, n = np.zeros(dim), np.zeros(dim)
    for _ in range(epochs):
        for label, at, x in rows:
            w = _weights(z[at], n[at])
            bias = float(_weights(z[-1:], n[-1:])[0])
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            gb = p - label
            z[-1] += gb - (np.sqrt(n[-1] + gb * gb) - np.sqrt(n[-1])) / ALPHA * bias
            n[-1] += gb * gb
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def scores(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    at, feature, unit = features(texts, bits)
    dot = np.bincount(at, weights=weights[feature], minlength=len(texts)) * unit
    return 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, salt: str) -> DataFrame:
    """doc_id, text and label of at most `most` rows outside the held-out fold, by salted digest of doc_id."""
    known = labels.filter(F.col(label).isNotNull() & (id_remainder(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("label"))
    chosen = stored(known.withColumn("digest", id_hash(F.col("_id"), salt)).orderBy("digest", "_id").limit(most))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), same([F.col("doc_id")], [F.col("_id")]))
    return texts.select("doc_id", "label", "digest", "text")


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from a bounded labelled sample: features are made where the texts are, one task learns."""

    def extract(batches):
        for batch, texts in blocks(batches):
            at, feature, unit = features(texts, bits)
            key, count = np.unique(at * (1 << bits) + feature, return_counts=True)
            d, f = key >> bits, (key & ((1 << bits) - 1)).astype("<i4")
            x = (count * unit[d]).astype("<f4")
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            at_ = pa.array([f[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            xs = pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            yield with_columns(batch, ["digest", "label"], {"features": at_, "counts": xs})

    def learn(batches):
        rows = []
        for batch in batches:
            rows += batch.to_pylist()
        rows.sort(key=lambda r: (r["digest"], r["label"], r["features"], r["counts"]))
        data = [(int(r["label"]), np.frombuffer(r["features"], "<i4"), np.frombuffer(r["counts"], "<f4").astype(float)) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(data, bits, epochs).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    extracted = sample.select("digest", F.col("label").cast("int").alias("label"), "text").mapInArrow(
        extract, "digest string, label int, features binary, counts binary"
    )
    found = extracted.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0]["weights"]), "<f4").astype(np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Only labelled rows outside the held-out fold are learnt from. Null and empty texts
    get the score of the bias; so does every text if there is no labelled row. A text
    of any length is read whole. Rows that repeat a doc_id are scored one by one, and
    equal texts get equal scores; of contradicting labels of one doc_id the larger
    holds. Other columns are not read.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, sample, "quality-")))

    def scan(batches):
        for batch, texts in blocks(batches):
            yield with_columns(batch, ["doc_id"], {"score": pa.array(scores(texts, weights.value))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
