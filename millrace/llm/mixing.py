"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks along a fixed random permutation of its documents
(the order of a salted digest of doc_id): a block is an interval of that line, and a
document so large that it would unbalance the source is a block of its own. A
source's target fixes its exact quota of block draws. The quotas are split over the
output shards by a binary tree whose every node draws from the multivariate
hypergeometric law; each shard then takes disjoint consecutive draws from the
permuted draws of every source and orders its rows by another digest. A document is
taken as often as shards draw its block, so all that is taken has gone through the tree.

Sources stay in tables. The tree on the driver has GROUPS columns at most: sources
beyond that share a column, and the permutation of their common draws splits a
shard's quota among them by the same law.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, heavy_keys, hex_digits, id_hash, identified, numbered, running, same, split_join, stored, text_or_empty, with_rid, word_count

WEIGHTS = (3, 1, 2)
#: The mix takes SHARE[0]/SHARE[1] of all words; no source gives more than CAP times its own.
SHARE = (3, 2)
CAP = 2
#: Shards hold about so many words, until there are MOST_SHARDS of them; beyond, shards grow.
WORDS_PER_SHARD = 2_000_000
MOST_SHARDS = 4096
#: Columns of the splitting tree at most.
GROUPS = 64
#: A source is cut into at least BLOCKS blocks; a block has LONGEST words and documents at most, but for its last document.
BLOCKS, LONGEST = 256, 20_000
#: A document with more than 1/LARGE of its source is a block of its own.
LARGE = 64
SALT = "mix-"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size, ...) with rank (by code point, null last), weight and target, stored.

    Every source gets its weight's share of all words. While any source's share is
    above the cap, those above are held there and the rest is shared anew among the
    others; the shares only grow, so no source is freed again. Integers until the one
    final division.
    """
    num, den = share
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", w.cast("long"))
    total, all_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, free = num * total, all_weight  # rest/den words are shared among sources of weight `free` together
    while True:
        # share above cap: rest/den * weight/free > cap * source_size
        full = F.lit(rest).cast("decimal(38,0)") * F.col("weight") > F.lit(den * cap * free).cast("decimal(38,0)") * F.col("source_size") if free else F.lit(True)
        held, held_weight = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0))).first()
        now = num * total - den * cap * held, all_weight - held_weight
        if now == (rest, free):
            break
        rest, free = now
    shared = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(max(1, den * free)).cast("double")
    return ranked.withColumn("target", F.when(full, (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(shared))


def splitting_tree(quotas: list[int], shards: int, seed: int = 17) -> np.ndarray:
    """Block quotas by (shard, column): rows sum to near-equal sizes, columns to the quotas exactly.

    A node with n draws for k shards sends n*(k//2)//k of them to its left half; which
    sources they come from follows the multivariate hypergeometric law.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        first, k, q = todo.pop()
        if k == 1:
            out[first] = q
            continue
        half = k // 2
        n = int(q.sum()) * half // k
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        todo += [(first + half, k - half, q - left), (first, half, left)]
    return out


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest h and the row id rid, stored once: the texts are read no more."""
    return stored(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), id_hash(F.col("doc_id"), SALT).alias("h"), with_rid(docs)))


def _in_blocks(rows: DataFrame, n_rows: int, weights, share, cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their block: large, block; targets of the sources with passes and rest)."""
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    targets = source_targets(sizes, weights, share, cap).withColumn("passes", passes.cast("long"))
    targets = stored(targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("line", F.col("source_size") + F.col("n")))
    # A document takes one place more than it has words, so that empty ones are dealt over blocks too.
    place = F.col("size") + 1
    sided = split_join(rows, targets.select("source", "source_size", "line"), ["source"], heavy_keys(sizes, ["source"], n_rows))
    sided = sided.withColumns({"place": place, "one": F.lit(1).cast("long"), "large": place * LARGE > F.col("line")})
    sided = sided.withColumn("side", F.struct("source", "large"))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    summed = running(sided, "side", "h", ["size", "rid"], {"before": "place", "number": "one"}, hex_digits(most))
    length = F.least(F.lit(LONGEST), F.greatest(F.lit(1), F.floor(F.col("line") / BLOCKS)))
    block = F.when(F.col("large"), F.col("number")).otherwise(F.floor(F.col("before") / length)).cast("long")
    return stored(summed.withColumn("block", block).drop("place", "one", "side", "before", "number", "line")), targets


def _block_draws(rows: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source, rank, large, block, draws): how often each block is drawn, so that its source comes near its target.

    Whole passes over the source, then a prefix of one more: large blocks up to their
    part of what is missing, then the others. At last the one block whose size is
    nearest to what is missing (or too much) is added (or dropped), if that helps.
    """
    blocks = stored(rows.groupBy("source", "large", "block").agg(F.sum("size").alias("words")))
    counts = stored(blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    heavy = heavy_keys(counts, ["source"], counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def per_source(table: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        return split_join(table, facts, ["source"], heavy, how)

    order = F.lpad(F.hex("block"), 16, "0")
    sided = per_source(blocks, targets.select("source", "rank", "source_size", "target", "passes", "rest"))
    sided = sided.withColumns({"side": F.struct("source", "large"), "at": order})
    inner = running(sided, "side", "at", ["words"], {"before": "words"}, 14)
    big = blocks.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("large"), F.col("words"))), F.lit(0)).alias("large_size"))
    more = F.col("passes") < cap
    in_large = more & F.col("large") & ((2 * F.col("before") + F.col("words")) * F.col("source_size") <= 2 * F.col("rest") * F.col("large_size"))
    first = stored(per_source(inner, big).withColumn("extra", F.when(in_large, 1).otherwise(0).cast("long")))
    spent = first.groupBy("source").agg(F.sum(F.col("extra") * F.col("words")).alias("spent"))
    fits = more & ~F.col("large") & (2 * F.col("before") + F.col("words") <= 2 * (F.col("rest") - F.col("spent")))
    drawn = per_source(first, spent).withColumn("draws", F.col("passes") + F.when(fits, 1).otherwise(F.col("extra")))
    drawn = stored(drawn.select("source", "rank", "large", "block", "words", "target", "draws"))
    gap = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("draws") * F.col("words"))).alias("gap"))
    off = F.abs(F.abs(F.col("gap")) - F.col("words"))
    can = F.when(F.col("gap") > 0, F.col("draws") < cap).otherwise(F.col("draws") > 0)
    mend = (
        per_source(drawn, gap)
        .filter(can & (off < F.abs(F.col("gap"))))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "large", "block")).alias("best"), F.first("gap").alias("gap"))
        .select("source", F.col("best.large").alias("mend_large"), F.col("best.block").alias("mend_block"), F.signum("gap").cast("long").alias("mend"))
    )
    mended = (F.col("large") == F.col("mend_large")) & (F.col("block") == F.col("mend_block"))
    draws = F.col("draws") + F.when(mended, F.col("mend")).otherwise(0)
    return stored(per_source(drawn, mend, "left").select("source", "rank", "large", "block", "words", draws.alias("draws")))


def _shards_of_draws(blocks: DataFrame) -> DataFrame:
    """(source, large, block, shards): the shard of every draw of each block, by the splitting tree.

    The draws of a group of sources stand in permuted order; each shard takes as many
    consecutive ones as the tree gives it. Draws that no shard takes are not made.
    """
    spark = blocks.sparkSession
    group = ((F.col("rank") - 1) % GROUPS).cast("int")
    quotas = {r["g"]: r["q"] for r in blocks.groupBy(group.alias("g")).agg(F.sum("draws").alias("q")).collect()}
    words = blocks.agg(F.coalesce(F.sum(F.col("draws") * F.col("words")), F.lit(0))).first()[0]
    shards = max(1, min(MOST_SHARDS, -(-words // WORDS_PER_SHARD)))
    ends = np.cumsum(splitting_tree([quotas.get(g, 0) for g in range(GROUPS)], shards), axis=0)
    bounds = [F.from_json(F.lit(json.dumps(ends[:, g].tolist())), "array<bigint>") for g in range(GROUPS)]
    bounds = spark.range(1).select(F.posexplode(F.array(*bounds)).alias("_g", "ends"))
    each = blocks.filter("draws > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))))
    mixed = F.md5(F.concat_ws(":", F.lit("draw"), "rank", F.col("large").cast("string"), "block", "copy"))
    each = stored(each.select("source", "large", "block", group.alias("g"), mixed.alias("h"), F.lit(1).cast("long").alias("one")))
    place = running(each, "g", "h", ["block"], {"place": "one"}, hex_digits(max([0, *quotas.values()])))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    dealt = place.join(F.broadcast(bounds), F.col("g") == F.col("_g")).withColumn("shard", shard).filter(F.col("shard") < shards)
    return dealt.groupBy("source", "large", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """How often the mix takes each document: one row per row of docs.

    doc_id, source, size (words; null text: 0), source_size, target, times, taken, the
    row id rid, and `shards`, the output shard of each copy. A document is taken whole
    or not at all, `cap` times at most: once for every draw of its block. Rows with one
    doc_id count as separate documents, and stand in the permutation by size, then row;
    empty texts have size 0 and are dealt like others. A null source is a source, the
    last. An empty table gives no rows. Other columns are not read.
    """
    rows = sized_documents(docs)
    n_rows = rows.count()
    placed, targets = _in_blocks(rows, n_rows, weights, share, cap)
    key = ["source", "large", "block"]
    draws = _shards_of_draws(_block_draws(placed, targets, cap))
    # Blocks are many and small: they meet their documents by a shuffle. A block has a bounded number of documents.
    named = draws.select(*[F.col(c).alias(f"_{c}") for c in key], "shards")
    on = same([F.col(c) for c in key], [F.col(f"_{c}") for c in key])
    whole = placed.join(named.hint("merge"), on, "left").drop(*[f"_{c}" for c in key])
    whole = whole.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))).withColumn("times", F.size("shards").cast("long"))
    sources = stored(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    whole = split_join(whole, targets.select("source", "target"), ["source"], heavy_keys(sources, ["source"], n_rows))
    return whole.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "shards", "rid")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as mix_plan takes it, dealt to its shards in permuted order.

    Rows are known by their place in the table, so null and repeated ids stay separate
    documents. A document whose block is not drawn is not in the mix. An empty table gives none.
    """
    columns = docs.columns
    docs = identified(docs)
    plan = mix_plan(docs).filter("times > 0").select(F.col("rid").alias("__mr_row"), F.col("shards").alias("__mr_shards"))
    dealt = docs.join(plan.hint("shuffle_hash"), F.col(RID) == F.col("__mr_row")).select(*columns, RID, F.posexplode("__mr_shards").alias("__mr_copy", "__mr_shard"))
    order = F.md5(F.concat_ws(":", F.lit("order"), F.col("doc_id").cast("string"), F.col(f"{RID}.row"), "__mr_copy"))
    # Ranges of (shard, order) keep each shard together and in order, and split what is too large for one task.
    dealt = dealt.withColumn("__mr_order", order)
    ranged = dealt.repartitionByRange("__mr_shard", "__mr_order").sortWithinPartitions("__mr_shard", "__mr_order")
    return ranged.select(*columns)
