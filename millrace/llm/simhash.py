"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints at RADIUS or fewer differing bits agree in all but RADIUS of BLOCKS
byte-wide blocks, so every distinct fingerprint goes to one bucket for each choice of
blocks left out (28 for radius 2). Members of a bucket differ in the left-out bits
only, so no bucket can hold more than 2**16 of them, whatever the data. In a bucket
the free bits are stored as vertical bit planes, 64 fingerprints to a machine word;
row i is compared with row i+s for all i at once, carry-save counters add up the
differing bits, and words in which every lane has passed the radius are abandoned.
Links are closed to components by repeated hooking to the smallest neighbour, on
tables in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, with_columns
from .common import heavy_keys, identified, only_kept, split_join, stored, with_rid

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 8
#: Rows of whole buckets that one comparison takes at a time.
BATCH_ROWS = 100_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half the hashes of the word shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        ws = t.lower().split()
        if not ws:
            continue
        grams = map(b" ".join, zip(*[ws[i:] for i in range(width)])) if len(ws) >= width else [b" ".join(ws)]
        h = np.array([digest(g, SEED) for g in grams], dtype=np.uint64).astype(">u8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            part = h[at : at + 65_536]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    return out


def _planes(values: np.ndarray, bits: int, pad: int) -> np.ndarray:
    """values' bits as rows of a matrix of 64-lane words, with spare words at the end."""
    words = -(-len(values) // 64)
    out = np.zeros((bits, words + pad), dtype=np.uint64)
    for b in range(bits):
        raw = np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
        out[b, :words] = np.pad(raw, (0, 8 * words - len(raw))).view("<u8")
    return out


def _lanes(flags: np.ndarray) -> np.ndarray:
    raw = np.packbits(flags, bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view("<u8")


def compare(values: np.ndarray, bucket: np.ndarray, bits: int, radius: int = RADIUS):
    """Yields pairs (i, j) of rows of one bucket whose values differ in at most `radius` bits.

    bucket is sorted; values use their lowest `bits` bits.
    """
    n = len(values)
    if n < 2:
        return
    after = np.searchsorted(bucket, bucket, side="right") - np.arange(n)
    longest = int(after.max())
    planes = _planes(values, bits, longest // 64 + 2)
    counters = (radius + 1).bit_length()
    for s in range(1, longest):
        valid = _lanes(after > s)
        at = np.flatnonzero(valid)
        if not len(at):
            break
        q, r = divmod(s, 64)
        left, right = np.uint64(r), np.uint64(64 - r)
        over = ~valid[at]
        count = [np.zeros(len(at), np.uint64) for _ in range(counters)]
        for b in range(bits):
            other = planes[b, at + q] >> left
            if r:
                other |= planes[b, at + q + 1] << right
            carry = planes[b, at] ^ other
            for c in count:  # carry-save: one bit more for the lanes that differ
                c ^= carry
                carry = carry & ~c
            full = _ALL
            for i, c in enumerate(count):
                full = full & (c if (radius + 1) >> i & 1 else ~c)
            over |= full
            if b % 4 == 3:
                live = over != _ALL
                if not live.all():
                    at, over, count = at[live], over[live], [c[live] for c in count]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(len(at), 64)
            w, lane = np.nonzero(hit)
            i = at[w] * 64 + lane
            yield i, i + s


def roots(n: int, pairs) -> np.ndarray:
    """The smallest row of each row's component, from batches of pairs."""
    root = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def close(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up

    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size > 1_000_000:
            close(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        close(*map(np.concatenate, zip(*held)))
    return root


def links(fingerprint_rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, linked): enough links between distinct fingerprints to join each bucket's components."""
    width = 64 // BLOCKS
    left_out = list(combinations(range(BLOCKS), radius))
    masks = []
    for out in left_out:
        m = (1 << 64) - 1
        for b in out:
            m &= ~(((1 << width) - 1) << (b * width))
        masks.append(m - (1 << 64) if m >> 63 else m)
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("part") + 1)
    dealt = fingerprint_rows.select("fp", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("part"))
    dealt = dealt.withColumn("shared", F.col("fp").bitwiseAND(mask))
    sorted_ = dealt.repartition("part", "shared").sortWithinPartitions("part", "shared")

    def find(fp: np.ndarray, part: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (shared[1:] != shared[:-1])))
        bucket = np.cumsum(new)
        u = fp.view(np.uint64)
        # Rows alone in their bucket have nothing to compare with.
        alone = new & np.append(new[1:], True)
        some = np.flatnonzero(~alone)
        u, bucket, part = u[some], bucket[some], part[some]
        low = (1 << width) - 1
        free = np.zeros(len(u), np.uint64)
        for i, out in enumerate(left_out):
            mine = part == i
            for place, b in enumerate(out):
                free[mine] |= ((u[mine] >> np.uint64(b * width)) & np.uint64(low)) << np.uint64(place * width)
        root = roots(len(u), compare(free, bucket, radius * width, radius))
        from_ = np.flatnonzero(root != np.arange(len(u)))
        own = u.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[from_]), pa.array(own[root[from_]])], names=["fp", "linked"])

    def scan(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append(rows)
            size += len(rows[0])
            if size < BATCH_ROWS:
                continue
            fp, part, shared = map(np.concatenate, zip(*held))
            same_as_last = (part == part[-1]) & (shared == shared[-1])
            cut = int(np.argmax(same_as_last))
            if cut:
                yield find(fp[:cut], part[:cut], shared[:cut])
            held, size = [(fp[cut:], part[cut:], shared[cut:])], len(fp) - cut
        if size:
            yield find(*map(np.concatenate, zip(*held)))

    found = sorted_.select("fp", "part", "shared").mapInArrow(scan, "fp long, linked long")
    return found.distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges, root being one node of its component.

    Each round hooks every node to its smallest neighbour, halves the paths, and
    keeps only edges between different roots; edges run out after a number of rounds
    logarithmic in the nodes. Every table is written before the next is built.
    """
    edges = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v"))
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("root"))
        hook = stored(hook)
        for _ in range(2):
            up = hook.select(F.col("node").alias("at"), F.col("root").alias("above"))
            hook = stored(hook.join(up, F.col("root") == F.col("at")).select("node", F.col("above").alias("root")))
        if label is None:
            label = hook
        else:
            up = hook.select(F.col("node").alias("at"), F.col("root").alias("above"))
            label = label.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("above", "root").alias("root"))
            label = stored(label)
        x = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        y = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = stored(edges.join(x, "u").join(y, "v").filter("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    if label is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return label


def simhash_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id, root and rid for every row of docs.

    component_id is the smallest doc_id that can be reached over links of at most
    `radius` differing bits, itself included; root is a fingerprint that names the
    component whatever its ids, rid the row. Null and empty texts have fingerprint
    zero, which links like any other. Null doc_ids are passed over when the smallest
    is sought; a component of such rows only has a null id. Repeated rows get the
    same answer. A text of any length is one fingerprint, made from all its shingles.
    An empty table gives no rows; other columns are not read.
    """

    def scan(batches):
        for batch, texts in blocks(batches):
            fp = pa.array(fingerprints(texts, width).view(np.int64))
            yield with_columns(batch, ["doc_id", "rid"], {"fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", with_rid(docs), "text")
    id_kind = rows.schema["rid"].dataType.simpleString()
    rows = stored(rows.mapInArrow(scan, f"doc_id {kind}, rid {id_kind}, fp long"))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    label = stored(components(links(nodes.select("fp"), radius), "fp", "linked").select(F.col("node").alias("fp"), "root"))
    # A root may name most fingerprints, and a fingerprint most rows: both meet their one row by split joins.
    sizes = stored(label.join(nodes, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    n_linked = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = split_join(label, sizes.drop("n"), ["root"], heavy_keys(sizes, ["root"], n_linked))
    answer = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    answer = stored(answer)
    n_rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(rows, answer, ["fp"], heavy_keys(nodes, ["fp"], n_rows)).select("doc_id", "fp", "component_id", "root", "rid")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each component, whatever its ids: the one of the smallest doc_id (none comes last), then place in the table.

    Null and empty texts are one component. Rows are known by their place, so that
    components whose rows have null or repeated ids keep a row each. An empty table gives none.
    """
    docs = identified(docs)
    # Order of the choice: rows with an id first, by id, then by place.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    one = simhash_groups(docs).groupBy("root").agg(best.alias("best"))
    return only_kept(docs, one.select(F.col("best.rid").alias("rid")))
