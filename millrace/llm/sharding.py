"""Resharding by minimum-cost flow: near-equal bytes, fewest bytes moved.

Old shard sizes supply bytes and new capacities demand them; leaving a byte where
it is costs nothing and moving it costs one. The flow (on at most old + new shards)
is solved on the driver by successive shortest paths. A flow from an old shard to a
new one is a run of that shard's documents in digest order, cut at the cumulative
sizes. Documents too large to cut finely (larger than a fixed part of a capacity, so a
bounded number of them) are supply of the flow like all others, but go whole: along an
arc that takes them, or, where the flow would split one, where it adds least to the
bytes moved, and the flow is solved again without it. So the bytes moved are the least
possible, the sum of what each old shard holds above the level, but for the last
document of each run and for documents that the flow would split.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import RID, hex_digits, id_hash, identified, owned, running, shared_path, small, stored, text_or_empty

SHARDS = 24
#: Documents above capacity/GIANT_PART go through the flow whole; there are SHARDS * GIANT_PART at most.
GIANT_PART = 256
LAW = "bytes"
SALT = "shard-"


def old_shard_of(source: Column, shards: int = SHARDS) -> Column:
    """The layout that is resharded here: one shard for each hash of a source, as the sources arrive."""
    return F.pmod(F.xxhash64(F.coalesce(source.cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow from sources to sinks by successive shortest paths with potentials.

    Any source may reach any sink at cost(i, j) a unit. Sums of supply and demand
    must agree. Returns the positive flows.
    """
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    left, want = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        came: list[int] = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            steps = (
                ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n)))
            )
            for v, c in steps:
                new = d + c + potential[u] - potential[v]
                if new < far[v]:
                    far[v], came[v] = new, u
                    heapq.heappush(heap, (new, v))
        sinks = [j for j in range(m) if want[j]]
        end = min(sinks, key=lambda j: (far[n + j] + potential[n + j], j))
        for v in range(n + m):
            if far[v] < float("inf"):
                potential[v] += far[v]
        path, v = [], n + end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        most = min([left[v], want[end], *(flow[(b, a - n)] for a, b in path if a >= n)])
        for a, b in path:
            key, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[key] = flow.get(key, 0) + sign * most
        left[v] -= most
        want[end] -= most
    return {k: f for k, f in flow.items() if f}


def level_of(sizes: list[int], total: int, shards: int) -> float:
    """The size all shards can reach, once the sizes (falling) that exceed it have a shard to themselves."""
    for s in sizes:
        if shards == 1 or s <= total / shards:
            break
        total, shards = total - s, shards - 1
    return total / shards


def place_large(large: list[tuple[int, int]], small: list[int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each (size, old shard), largest first, by the flow of all bytes; what each shard holds of them.

    small holds the bytes of each old shard's other documents. Documents above the level
    have a shard each, by the assignment that keeps most bytes where they are. All others
    are supply of their old shards: a document goes along an arc that takes it whole. One
    that the flow would split goes where it adds least to the bytes moved, and the flow
    is solved again for what is left.
    """
    level = level_of([s for s, _ in large], sum(small) + sum(s for s, _ in large), shards)
    n_over = sum(s > level for s, _ in large)
    load, where = [0] * shards, [-1] * len(large)
    if n_over:
        rest = list(small)
        for s, old in large[n_over:]:
            rest[old] += s
        stays = lambda k, j: min(rest[j], int(level)) if k == n_over else large[k][0] * (large[k][1] == j)
        most = large[0][0] + int(level)
        for k, j in min_cost_flow([1] * n_over + [shards - n_over], [1] * shards, lambda k, j: most - stays(k, j)):
            if k < n_over:
                where[k], load[j] = j, large[k][0]
    left = list(range(n_over, len(large)))
    while left:
        supply = list(small)
        for k in left:
            supply[large[k][1]] += large[k][0]
        room = capacities(sum(supply), load, shards)
        arcs = min_cost_flow(supply, room, lambda i, j: int(i != j))
        split = []
        for k in left:
            size, old = large[k]
            whole = [j for j in range(shards) if arcs.get((old, j), 0) >= size]
            if not whole:
                split.append(k)
                continue
            j = max(whole, key=lambda j: (j == old, arcs[old, j], -j))
            arcs[old, j] -= size
            room[j] -= size
            supply[old] -= size
            where[k], load[j] = j, load[j] + size
        if split:
            k = split.pop(0)
            size, old = large[k]
            supply[old] -= size
            # What lies above the level then; bytes moved: the document's own, and those of the shard that it drives out.
            dear = lambda j: (max(0, size - room[j]), size * (j != old) + max(0, min(supply[j], room[j]) - max(0, room[j] - size)), j)
            j = min(range(shards), key=dear)
            where[k], load[j] = j, load[j] + size
        left = split
    return where, load


class Layout:
    """Where every row of a table goes: cut keys of each old shard's line, and the shards of large documents.

    A row is placed by its size, old shard, digest h and row id alone, so that a scan of
    the texts places them without a join. Fields: rows (the stored narrow table), touched
    (the shards that gain or lose rows).
    """

    def __init__(self, docs: DataFrame, old: Column | None, shards: int):
        self.shards = shards
        self.old = old_shard_of(F.col("source"), shards) if old is None else old.cast("int")
        self.rows = rows = stored(docs.select("doc_id", F.crc32(text_or_empty()).alias("text_crc32"), *[c.alias(n) for n, c in self.keys(docs).items()]))
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.limit = total // (shards * GIANT_PART) + 1
        large = rows.filter(F.col("size") > self.limit).select("size", "old_shard", "rid").collect()
        large.sort(key=lambda r: (-r["size"], r["rid"]))
        common = rows.filter(F.col("size") <= self.limit)
        sizes = common.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        n_old = max([shards, *(r["old_shard"] + 1 for r in [*sizes, *large])])
        supply = [0] * n_old
        for r in sizes:
            supply[r["old_shard"]] = r["bytes"]
        where, load = place_large([(r["size"], r["old_shard"]) for r in large], supply, shards)
        flow = min_cost_flow(supply, capacities(sum(supply), load, shards), lambda i, j: int(i != j))
        # A run of an old shard's bytes for each flow; what stays comes first.
        table: dict[int, tuple[list[int], list[int]]] = {}
        for _, i, j, f in sorted((j != i, i, j, f) for (i, j), f in flow.items()):
            ends, to = table.setdefault(i, ([], []))
            ends.append(f + (ends[-1] if ends else 0))
            to.append(j)
        spark = docs.sparkSession
        runs = _literal(spark, [{"o": i, "ends": ends, "to": to} for i, (ends, to) in table.items()], "o int, ends array<bigint>, to array<int>")
        digits = hex_digits(max([0, *(r["n"] for r in sizes)]))
        lines = running(common, "old_shard", "h", ["rid"], {"before": "size"}, digits).join(F.broadcast(runs), F.col("old_shard") == F.col("o"))
        middle = F.col("before") + F.col("size") / 2
        new = F.element_at("to", F.least(F.size("to"), F.size(F.filter("ends", lambda e: e <= middle)) + 1))
        # The last key of each run: one row for each flow.
        keys = lines.withColumn("to", new).groupBy("old_shard", "to").agg(F.max(F.struct("h", "rid")).alias("last"))
        self.cuts = stored(keys.groupBy(F.col("old_shard").alias("__mr_o")).agg(F.sort_array(F.collect_list(F.struct("last", "to"))).alias("__mr_cuts")))
        pairs = {(r["__mr_o"], c["to"]) for r in self.cuts.collect() for c in r["__mr_cuts"]} | {(r["old_shard"], j) for r, j in zip(large, where, strict=True)}
        self.touched = sorted({s for i, j in pairs if i != j for s in (i, j)})
        ids = [r["rid"].asDict() if isinstance(r["rid"], Row) else r["rid"] for r in large]
        self.large = _literal(spark, [{"__mr_g": i, "__mr_to": j} for i, j in zip(ids, where, strict=True)], f"__mr_g {rows.schema['rid'].dataType.simpleString()}, __mr_to int")

    def keys(self, docs: DataFrame) -> dict[str, Column]:
        size = (F.octet_length(text_or_empty()) + 8).cast("long")
        rid = F.col(RID) if RID in docs.columns else F.monotonically_increasing_id()
        return {"size": size, "old_shard": self.old, "h": id_hash(F.col("doc_id"), SALT), "rid": rid}

    def place(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """rows, which hold the keys with that prefix, with their new shard as {prefix}shard."""
        size, old, h, rid = (F.col(prefix + c) for c in ("size", "old_shard", "h", "rid"))
        key = F.struct(h.alias("h"), rid.alias("rid"))
        out = rows.join(F.broadcast(self.cuts), old == F.col("__mr_o"), "left")
        out = out.join(F.broadcast(self.large), (size > self.limit) & (rid == F.col("__mr_g")), "left")
        cut = F.element_at(F.filter("__mr_cuts", lambda c: c["last"] >= key), 1)["to"]
        return out.withColumn(f"{prefix}shard", F.when(size > self.limit, F.col("__mr_to")).otherwise(cut)).drop("__mr_o", "__mr_cuts", "__mr_g", "__mr_to")

    def slots(self) -> DataFrame:
        dealt = stored(self.place(self.rows).withColumn("one", F.lit(1).cast("long")))
        slots = running(dealt, "shard", "h", ["rid"], {"slot": "one"}, hex_digits(max(1, dealt.count() // self.shards)))
        return slots.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "rid")


def reshard(docs: DataFrame, old: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """New shard and slot for every row of docs, with the old one: sizes in bytes near equal.

    Size is the UTF-8 length of the text plus 8; a null text has none. A text longer
    than a shard's share has a shard to itself. Rows that repeat a doc_id, or have
    none, are placed one by one, in the order of the row id rid. An empty table gives
    no rows; columns besides doc_id, text and those of `old` are not read.
    """
    return Layout(docs, old, shards).slots()


def capacities(total: int, load: list[int], shards: int) -> list[int]:
    """What each shard still takes of `total` bytes so that all come level; a shard above the level takes none."""
    order = sorted(range(shards), key=lambda j: load[j])
    level, rest = 0.0, total
    for k in range(shards, 0, -1):
        level = (rest + sum(load[j] for j in order[:k])) / k
        if level >= load[order[k - 1]]:
            order = order[:k]
            break
    out = [0] * shards
    for j in order:
        out[j] = int(level - load[j])
    for j in order[: total - sum(out)]:
        out[j] += 1
    out[order[0]] += total - sum(out)
    return out


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, column: str = "shard") -> str:
    """Writes the new layout, one folder a shard, for the shards that gain or lose rows; returns the folders' column.

    docs must be identified(), and plan be reshard() of that same table: rows are known
    by their row id, so repeated and null ids each come out once. Shards whose rows all
    stay are left as they are, so only affected files are rewritten. Each file holds a
    run of one shard's slots, in order; a large shard has several. The column's name
    gets underscores in front until it clashes with none of docs.
    """
    if RID not in docs.columns:
        raise ValueError("give reshard and rewrite the same identified() table")
    while column in docs.columns:
        column = f"_{column}"
    moved = plan.filter("shard != old_shard")
    touched = moved.select("shard").union(moved.select("old_shard")).distinct().withColumnRenamed("shard", "__mr_touched")
    keyed = plan.select(F.col("rid").alias("__mr_row"), F.col("shard").alias("__mr_shard"), F.col("slot").alias("__mr_slot"))
    keyed = keyed.join(F.broadcast(touched), F.col("__mr_shard") == F.col("__mr_touched"), "left_semi")
    out = docs.join(keyed.hint("shuffle_hash"), F.col(RID) == F.col("__mr_row")).drop("__mr_row", RID)
    _write(out, ["__mr_slot"], path, column)
    return column


def _write(out: DataFrame, order: list[str], path: str, column: str) -> None:
    """One folder for each __mr_shard, in files that each hold a run of its rows in the given order."""
    out = out.repartitionByRange("__mr_shard", *order).sortWithinPartitions("__mr_shard", *order)
    kept = [c for c in out.columns if not c.startswith("__mr_")]
    out.select(*kept, F.col("__mr_shard").alias(column)).write.partitionBy(column).parquet(path)


def resharded(docs: DataFrame, old: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """The table in its new layout, as read from there: its rows with their __mr_shard and __mr_slot.

    Shards that gain or lose rows are written anew, in a folder of the shared one that
    lives as stored() tables do; a row's slot is its place in its shard's files. Rows of
    the other shards are read where they were. Each text goes through one shuffle.
    """
    docs = identified(docs)
    layout = Layout(docs, old, shards)
    placed = layout.place(docs.withColumns({f"__mr_{n}": c for n, c in layout.keys(docs).items() if n != "rid"}), "__mr_")
    touched = F.col("__mr_shard").isin(layout.touched)
    path = shared_path(docs.sparkSession)
    _write(placed.filter(touched), ["__mr_h", RID], path, "__mr_shard")
    owned(docs.sparkSession, path)
    names = [c for c in docs.columns if c != RID]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != RID)
    files = docs.sparkSession.read.schema(f"{fields}, __mr_shard int").parquet(path)
    task = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    files = files.select(*names, "__mr_shard", task.alias("__mr_task"), F.col("_metadata.row_index").alias("__mr_at"))
    counts = stored(files.groupBy(F.col("__mr_shard").alias("__mr_s"), F.col("__mr_task").alias("__mr_t")).agg(F.count(F.lit(1)).alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__mr_s").orderBy("__mr_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = small(counts.select("__mr_s", "__mr_t", before.alias("__mr_before")), counts.count())
    new = files.join(offsets, (F.col("__mr_shard") == F.col("__mr_s")) & (F.col("__mr_task") == F.col("__mr_t")))
    new = new.select(*names, "__mr_shard", (F.col("__mr_before") + F.col("__mr_at")).alias("__mr_slot"))
    if {*range(shards)} <= {*layout.touched}:
        return new
    slots = layout.slots().select(F.col("rid").alias("__mr_row"), F.col("slot").alias("__mr_slot"))
    stay = placed.filter(~touched).join(slots.hint("shuffle_hash"), F.col(RID) == F.col("__mr_row"))
    return new.unionByName(stay.select(*names, "__mr_shard", "__mr_slot"))
