"""Arrow batches of documents as blocks of bounded size, for the operators written in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

BLOCK_BYTES = 2_000_000


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8; null counts as empty.

    A slice holds about `most` bytes of text, or one longer text, so that memory does
    not depend on how many rows Spark puts into a batch.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        first, held, texts = 0, 0, []
        for i, x in enumerate(raw):
            b = x.as_py() or b""
            if texts and held + len(b) > most:
                yield batch.slice(first, i - first), texts
                first, held, texts = i, 0, []
            texts.append(b)
            held += len(b)
        if texts:
            yield batch.slice(first), texts


def with_columns(batch: pa.RecordBatch, keep: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch and new ones."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*keep, *made])
