"""What several operators share: word pattern, stable hashes, row ids, shared scratch tables, prefix sums, joins of hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo `mod`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod).cast("int")


def id_hash(doc_id: Column, salt: str) -> Column:
    """A salted hexadecimal digest of the id: the order it gives is a fixed random permutation."""
    return F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))))


#: Tables stored so far and not dropped, and the folder of each table given out, by the object's id.
_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, a temporary one for a local master; a cluster must name one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        context = spark.sparkContext
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            set_dir = jvm_dir.get()
        elif context.master.startswith("local"):
            set_dir = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
            context.setCheckpointDir(set_dir)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return set_dir.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"


def owned(spark: SparkSession, path: str) -> None:
    """Has a written shared_path() deleted when the JVM ends, or by released()."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _made.append((spark, path))


def stored(df: DataFrame) -> DataFrame:
    """df as a table written once in the shared folder: its lineage is cut and lost executors cost nothing.

    The JVM deletes it when it ends, after spark.stop() too; released() does so earlier.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    owned(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


@contextlib.contextmanager
def released() -> Iterator[list[DataFrame]]:
    """When the block ends, deletes the tables that were stored inside it, but for those put on the list it gives."""
    first, kept = len(_made), []
    try:
        yield kept
    finally:
        spared = {_paths[id(df)] for df in kept}
        _delete([x for x in _made[first:] if x[1] not in spared])


def drop(table: DataFrame) -> None:
    """Deletes a stored() table."""
    path = _paths.pop(id(table))
    _delete([x for x in _made if x[1] == path])


def _delete(tables: Sequence[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
        _made.remove((spark, path))


#: The row id that stages carry: (hash of a file's path, row in the file).
RID = "__mr_rid"
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View"}


def _reads_files(plan) -> bool:
    """Whether a plan is one Parquet scan with at most filters and projections above."""
    if plan.nodeName() in _PLAIN:
        return _reads_files(plan.children().head())
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0]


def identified(docs: DataFrame) -> DataFrame:
    """docs with a column RID that tells all rows apart and is the same in every reading.

    Rows of a Parquet table are known by file and row, so nothing is written; any
    other table is stored once.
    """
    if RID in docs.columns:
        return docs
    plan = docs._jdf.queryExecution().analyzed()
    if _reads_files(plan) and "_metadata" not in docs.columns:
        return docs.withColumn(RID, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return stored(docs.withColumn(RID, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def with_rid(docs: DataFrame) -> Column:
    """The row id `rid` of an operator's own narrow table: RID where docs has it, a number otherwise."""
    return (F.col(RID) if RID in docs.columns else F.monotonically_increasing_id()).alias("rid")


def only_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of identified docs whose RID is among kept(rid), without RID. Only ids are built into a table; texts stream past it."""
    keys = kept.select(F.col("rid").alias("__mr_kept"))
    return docs.join(keys.hint("shuffle_hash"), F.col(RID) == F.col("__mr_kept"), "left_semi").drop(RID)


def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Equality in which null equals null; Spark still plans an equi-join."""
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def small(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """A broadcast hint only where the counted rows stay under a fixed bound."""
    return F.broadcast(df) if rows <= most else df


#: A key with more than one in so many of all rows is joined by broadcast; there are fewer such keys than this.
HEAVY = 1000


def heavy_keys(counts: DataFrame, on: Sequence[str], n_rows: int) -> DataFrame | None:
    """The keys of counts(*on, n) that hold over n_rows/HEAVY rows, fewer than HEAVY; None if there are none."""
    if n_rows < HEAVY:
        return None
    heavy = stored(counts.filter(F.col("n") * HEAVY > n_rows).select(*[F.col(c).alias(f"_h_{c}") for c in on]))
    return None if heavy.isEmpty() else heavy


def split_join(rows: DataFrame, table: DataFrame, on: Sequence[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with the one row of `table` for their key; the heavy_keys of rows meet a broadcast, all others are shuffled. Null keys are keys."""
    named = table.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in table.columns if c not in on])
    keyed = same([F.col(c) for c in on], [F.col(f"_k_{c}") for c in on])
    drop = [f"_k_{c}" for c in on]
    if heavy is None:
        return rows.join(named, keyed, how).drop(*drop)
    is_heavy = same([F.col(c) for c in on], [F.col(f"_h_{c}") for c in on])
    few = named.join(F.broadcast(heavy), same([F.col(f"_k_{c}") for c in on], [F.col(f"_h_{c}") for c in on]), "left_semi")
    hot = rows.join(F.broadcast(heavy), is_heavy, "left_semi").join(F.broadcast(few), keyed, how).drop(*drop)
    cold = rows.join(F.broadcast(heavy), is_heavy, "left_anti").join(named, keyed, how).drop(*drop)
    return hot.unionByName(cold)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df stored with `rank` from 1 in the given order: rows are sorted in ranges, and each range counts its own."""
    n = max(1, min(1024, df.count() // 50_000))
    place = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", place))
    part = F.shiftright("_at", 33)
    before, total = [], 0
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        before += [F.lit(r["p"]), F.lit(total)]
        total += r["count"]
    if not total:
        return rows.withColumn("rank", F.col("_at")).drop("_at")
    offset = F.element_at(F.create_map(*before), part)
    return rows.withColumn("rank", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at")


def hex_digits(rows: int) -> int:
    """Leading digest digits that make buckets of about 64 rows; four at most (65,536 buckets)."""
    n, d = rows / 64, 1
    while n > 16 and d < 4:
        n, d = n / 16, d + 1
    return d


#: A bucket of prefix sums above this many rows, and above one in HOT_PART of all, is split by row.
HOT_ROWS, HOT_PART = 4096, 10_000


def running(df: DataFrame, group: str, digest: str, tie: Sequence[str], values: dict[str, str], digits: int) -> DataFrame:
    """Adds, for each output name in `values`, the sum of its column over earlier rows of the group.

    Rows are ordered by (digest, tie). The sum has two levels, so that no task sees
    a whole group: digests are dealt into buckets by their leading digits, each
    bucket sums its own rows, and a table of bucket totals gives what lies before
    each bucket. Digests repeat where ids do, and a bucket may then be large: such a
    bucket (HOT_PART of them at most) is dealt again by a hash of the tie, whose parts
    follow one another.
    """
    df = df.withColumns({"_bucket": F.substring(digest, 1, digits), "_sub": F.lit(0)})
    counts = stored(df.groupBy(F.col(group).alias("_hg"), F.col("_bucket").alias("_hb")).agg(F.count(F.lit(1)).alias("_hn")))
    total = counts.agg(F.coalesce(F.sum("_hn"), F.lit(0))).first()[0]
    hot = counts.filter((F.col("_hn") > HOT_ROWS) & (F.col("_hn") * HOT_PART > total)).drop("_hn")
    if not hot.isEmpty():
        parts = 1 + F.pmod(F.xxhash64(*tie), F.lit(HOT_ROWS))
        marked = df.join(F.broadcast(hot), same([F.col(group), F.col("_bucket")], [F.col("_hg"), F.col("_hb")]), "left")
        df = marked.withColumn("_sub", F.when(F.col("_hb").isNotNull(), parts).otherwise(0).cast("int")).drop("_hg", "_hb")
    inner = W.partitionBy(group, "_bucket", "_sub").orderBy(digest, *tie).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumns({f"_in_{o}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for o, v in values.items()})
    before = W.partitionBy("_g").orderBy("_b", "_s").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.col("_sub").alias("_s"))
        .agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
        .withColumns({f"_before_{o}": F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)) for o in values})
        .drop(*[f"_t_{o}" for o in values])
    )
    joined = rows.join(totals.hint("merge"), same([F.col(group), F.col("_bucket"), F.col("_sub")], [F.col("_g"), F.col("_b"), F.col("_s")]))
    return joined.withColumns({o: F.col(f"_in_{o}") + F.col(f"_before_{o}") for o in values}).drop(
        "_g", "_b", "_s", "_bucket", "_sub", *[f"_in_{o}" for o in values], *[f"_before_{o}" for o in values]
    )
