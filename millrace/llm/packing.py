"""Packing token ids into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids (and an end id) give whole windows first; what is left over is cut
into pieces of PIECE ids at most. Pieces gather until they nearly fill WINDOWS
windows; the differencing method then merges partial partitions, the ones with the
largest imbalance first, laying the large parts of one on the small parts of the
other, which leaves windows of nearly equal length. If the fullest exceeds the
capacity, the batch is divided into one window more, until it fits. Each partition of
the table is packed where it is read: no shuffle.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .blocks import blocks
from .tokens import word_tokenizer

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
WINDOWS = 256
PIECE = 256
#: Ids a window that a batch leaves free for the last imbalance.
SLACK = 6
END_ID = 0


def differencing(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp: the part (0 to k-1) of each size, with near-equal sums.

    A partial partition is held as its parts in falling order, without the common
    least sum and, while there are fewer than k parts, without the empty ones.
    """
    n = len(sizes)
    # A part is a tree: leaves are the sizes, an inner node joins two parts.
    left, right = [-1] * n, [-1] * n
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sa, pa_ = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        over = len(sa) + len(sb) - k
        if over <= 0:
            sums, parts = np.concatenate((sa, sb)), np.concatenate((pa_, pb))
        else:
            # The smallest parts of one meet the largest of the other, in opposite order.
            long, lp, short, sp = (sa, pa_, sb, pb) if len(sa) >= len(sb) else (sb, pb, sa, pa_)
            a, ap = long[len(long) - over :], lp[len(lp) - over :]
            b, bp = short[len(short) - over :][::-1], sp[len(sp) - over :][::-1]
            first = len(left)
            left.extend(ap.tolist())
            right.extend(bp.tolist())
            sums = np.concatenate((long[: len(long) - over], short[: len(short) - over], a + b))
            parts = np.concatenate((lp[: len(lp) - over], sp[: len(sp) - over], np.arange(first, first + over)))
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], parts[order]
        gap = int(sums[0])
        if len(sums) == k:
            sums = sums - sums[-1]
            gap = int(sums[0])
        heapq.heappush(heap, (-gap, serial, sums, parts))
        serial += 1
    out = [0] * n
    if heap:
        for w, root in enumerate(heap[0][3].tolist()):
            todo = [root]
            while todo:
                x = todo.pop()
                if x < n:
                    out[x] = w
                else:
                    todo += [left[x], right[x]]
    return out


def windows(sizes: list[int], capacity: int) -> list[int]:
    """The window of each piece: as few near-equal windows as differencing can fill without going over."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        part = differencing(sizes, k)
        if np.bincount(part, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return part
        k += 1


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) ids.

    ids are little-endian unsigned 32-bit. A null text is empty: its document is the
    end id alone. Rows that repeat a doc_id are packed as separate documents. An
    empty table gives no pieces; columns besides doc_id and text are not read.
    vocabulary is the path of a tokenizer file on every executor.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    piece_most, room, batch_windows = min(PIECE, capacity), SLACK, WINDOWS
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def scan(batches):
        from pyspark import TaskContext

        tokenizer = word_tokenizer(vocabulary)
        end = np.array([END_ID], dtype="<u4").tobytes()
        fill = batch_windows * (capacity - room)
        next_sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        size = 0
        rows: list[tuple] = []

        def put(piece: tuple, sequence: int, offset: int) -> None:
            doc, start, ids, tokens = piece
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset)
            rows.append((*row, ids) if with_ids else row)

        def divide(pieces: list[tuple]) -> None:
            nonlocal next_sequence
            part = windows([len(p[2]) // 4 for p in pieces], capacity)
            at: dict[int, list[int]] = {}
            for p, w in zip(pieces, part, strict=True):
                place = at.setdefault(w, [next_sequence + len(at), 0])
                put(p, *place)
                place[1] += len(p[2]) // 4
            next_sequence += len(at)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)
            rows.clear()
            return made

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        arrow = None
        for batch, texts in blocks(batches):
            id_type = batch.schema.field("doc_id").type
            arrow = pa.schema([(names[0], id_type), *[(n, pa.int64()) for n in names[1:7]], *[("ids", pa.binary())] * with_ids])
            ids_of = tokenizer.ids([t.decode("utf-8", "replace") for t in texts])
            for doc, ids in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), ids_of, strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                while n - start >= capacity:
                    put((doc, start, ids[4 * start : 4 * (start + capacity)], n), next_sequence, 0)
                    next_sequence += 1
                    start += capacity
                while start < n:
                    length = min(piece_most, n - start, fill - size)
                    held.append((doc, start, ids[4 * start : 4 * (start + length)], n))
                    size += length
                    start += length
                    if size == fill:
                        divide(held)
                        held, size = [], 0
            if rows:
                yield out()
        if held:
            divide(held)
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids.

    A null or empty text is its end id alone. Repeated rows and ids are packed as
    separate documents. A long text is cut into whole windows first; an empty table
    gives no pieces.
    """
    return pack(docs)
