"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's frequent-items aggregate, which holds
at most 1/support counters a task) yields every digest that more than `support` of
the rows carry. Those candidates are counted exactly with map-side partial
aggregates; their winners, 1/support rows at most, are broadcast, so copies of a
frequent text are settled where they are read. All other digests are aggregated to
their winners with map-side partial aggregates, and rows meet their winner in an
ordinary shuffle in which no digest exceeds `support` of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, identified, only_kept, stored, text_or_empty, with_rid

SUPPORT = 0.001


def without_white(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, text)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the row id rid for every row of docs.

    Texts are equal when identical after all white space is deleted; of equal texts
    the row with the most code points, then the smallest doc_id, stays. A null text
    counts as empty; a null doc_id as smaller than any other. Rows that repeat both
    doc_id and text stay as one of them. Texts of any length are read whole, by one
    digest each. An empty table gives an empty result, and columns besides doc_id and
    text are not read.
    """
    text = text_or_empty()
    rows = stored(
        docs.select(
            "doc_id",
            F.sha2(without_white(text), 256).alias("text_sha256"),
            F.char_length(text).cast("long").alias("n_chars"),
            with_rid(docs),
        )
    )
    best = F.struct((-F.col("n_chars")).alias("neg"), "doc_id", "rid")
    summary = rows.stat.freqItems(["text_sha256"], support)
    frequent = summary.select(F.explode(summary.columns[0]).alias("text_sha256"))
    won = [F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")]
    winners = stored(rows.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*won))
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    other = rest.join(rest.groupBy("text_sha256").agg(*won), "text_sha256").select(*split.columns)
    settled = split.filter(F.col("best").isNotNull()).unionByName(other)
    return settled.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
        "rid",
    )


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns: one row of each group of equal texts.

    Null texts and texts of white space only are one group. Rows are known by their
    place in the table, so null and repeated ids lose nothing. An empty table gives none.
    """
    docs = identified(docs)
    return only_kept(docs, exact_dedup(docs).filter("kept"))
