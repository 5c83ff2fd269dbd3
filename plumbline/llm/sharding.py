"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards have capacities. How many bytes go from each
old shard to each new one is a minimum-cost flow: bytes that stay cost nothing,
bytes that move cost one each, or what a given cost table says. The flow is made
of *blocks*: the rows of an old shard are dealt to blocks by a hash of their text,
and blocks fill the flow's amounts from the largest to the smallest. A block of over
``WHOLE`` of a mean shard is divided by text: each text of that size is a part of its
own, the others go to ``PARTS`` parts by another hash. So equal texts of an old shard are
in one part and in one shard, unless no shard can hold them: only such a text is dealt
in slices by id. Shards are as even as these parts allow.

Only sizes per block, part and slice reach the driver: at most ``BLOCKS`` per old
shard, a few thousand parts and about ``SLICES``, whatever the corpus. Texts are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T, Window

#: Blocks of an old shard.
BLOCKS = 1024
#: Slices all blocks are cut into, about; a slice is what one task numbers at a time.
SLICES = 40_000
SLICE_ROWS = 128
#: A block of more than this share of a mean shard is divided by text, into so many parts beside the texts of that size.
WHOLE = 0.25
PARTS = 64
_INFINITE = float("inf")


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]] | None = None) -> list[list[int]]:
    """Amounts from each old to each new shard that place all of ``supply`` within
    ``capacity`` at the least cost, by shortest augmenting paths. ``cost`` is per
    unit; by default 0 for the same number, else 1. Raises when it does not fit."""
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    cost = cost or [[0 if i == j else 1 for j in range(n)] for i in range(m)]
    source, sink = m + n, m + n + 1
    edges: list[list] = []  # to, left, cost; the reverse of edge e is e ^ 1
    leaving: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(a: int, b: int, amount: int, price: float) -> None:
        for x, y, left, p in ((a, b, amount, price), (b, a, 0, -price)):
            leaving[x].append(len(edges))
            edges.append([y, left, p])

    for i in range(m):
        for j in range(n):
            add(i, m + j, supply[i], cost[i][j])
    for i in range(m):
        add(source, i, supply[i], 0)
    for j in range(n):
        add(m + j, sink, capacity[j], 0)
    while True:
        distance, via = [_INFINITE] * (m + n + 2), [-1] * (m + n + 2)
        distance[source], queue = 0, [source]
        while queue:
            changed = []
            for a in queue:
                for e in leaving[a]:
                    b, left, p = edges[e]
                    if left and distance[a] + p < distance[b] - 1e-12:
                        distance[b], via[b] = distance[a] + p, e
                        changed.append(b)
            queue = list(dict.fromkeys(changed))
        if distance[sink] == _INFINITE:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return [[edges[2 * (i * n + j) + 1][1] for j in range(n)] for i in range(m)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _fill(units: list[tuple], flow: list[list[int]], capacity: list[int]) -> list[int]:
    """A new shard for each unit (size, old shard, numbers): the largest first, to
    where most of the old shard's flow is still open; then single units move from
    the fullest to the emptiest shard, relative to capacity, while that evens them."""
    left = [list(row) for row in flow]
    where = [0] * len(units)
    for k in sorted(range(len(units)), key=lambda k: (-units[k][0], units[k][1:])):
        size, old = units[k][:2]
        j = max(range(len(capacity)), key=lambda j: (left[old][j], j == old, -j))
        left[old][j] -= size
        where[k] = j
    over = [-c for c in capacity]
    inside: list[list[tuple[int, int]]] = [[] for _ in capacity]
    for k, j in enumerate(where):
        over[j] += units[k][0]
        inside[j].append((units[k][0], k))
    for row in inside:
        row.sort()
    for _ in range(4 * len(units) + 64):
        a, b = max(range(len(over)), key=lambda j: (over[j], -j)), min(range(len(over)), key=lambda j: (over[j], j))
        gap = over[a] - over[b]
        at = bisect_left(inside[a], (gap // 2 + 1, -1)) - 1
        if at < 0 or not 0 < inside[a][at][0] < gap:
            break
        size, k = inside[a].pop(at)
        insort(inside[b], (size, k))
        over[a], over[b], where[k] = over[a] - size, over[b] + size, b
    return where


@dataclass(frozen=True)
class Plan:
    """Where every slice of every part goes. ``cells``: (old, block, part, slice, shard,
    first slot); ``slices``: (old, block, part, number of slices), for parts with more than
    one; ``wide``: (old, block) of divided blocks; ``hot``: (old, block, h, hot part)."""

    cells: DataFrame
    slices: DataFrame
    wide: DataFrame
    hot: DataFrame
    flow: list[list[int]]


def sized(docs: DataFrame, old_shard, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, *further) -> DataFrame:
    """(id, size, text_crc32, old, h, block): without the text; h is its hash. ``old_shard`` is a
    column of ints from 0. ``further`` columns are added. A null text has size 1 and the checksum of an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old"), F.xxhash64(F.lit("block"), text).alias("h"), *further,
    ).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))


def _parted(rows: DataFrame, wide: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``part``: 0 for a block that is not divided."""
    marked = rows.join(F.broadcast(wide.withColumn("is_wide", F.lit(True))), ["old", "block"], "left")  # both at most n_old * n_new / WHOLE rows
    other = F.when(F.col("is_wide"), F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    return marked.join(F.broadcast(hot), ["old", "block", "h"], "left").withColumn("part", F.coalesce("hot_part", other)).drop("is_wide", "hot_part")


def _sliced(rows: DataFrame, slices: DataFrame) -> DataFrame:
    n = F.coalesce("n_slices", F.lit(1))
    return rows.join(F.broadcast(slices), ["old", "block", "part"], "left").withColumn(  # a row per part at most
        "slice", F.pmod(F.xxhash64(F.lit("slice"), "id"), n).cast("int")
    ).drop("n_slices")


def plan(rows: DataFrame, n_new: int, capacity: list[int] | None = None, cost: list[list[float]] | None = None) -> Plan:
    """The plan for ``sized`` rows; capacities are equal unless given."""
    spark = rows.sparkSession
    blocks = rows.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["size"] for r in blocks)
    capacity = capacity or equal_capacities(total, n_new)
    large = WHOLE * total / n_new
    wide = spark.createDataFrame([(r["old"], r["block"]) for r in blocks if r["size"] > large], "old int, block int")
    inside = rows.join(F.broadcast(wide), ["old", "block"])
    texts = inside.groupBy("old", "block", "h").agg(F.sum("size").alias("size")).where(F.col("size") > large)
    texts = sorted((r["old"], r["block"], r["h"]) for r in texts.collect()) if any(r["size"] > large for r in blocks) else []
    hot = spark.createDataFrame([(*t, PARTS + k) for k, t in enumerate(texts)], "old int, block int, h bigint, hot_part int")
    parted = _parted(rows, wide, hot)
    parts = {(r["old"], r["block"], 0): (r["size"], r["n"]) for r in blocks if r["size"] <= large}
    if len(parts) < len(blocks):
        of_wide = _parted(inside, wide, hot).groupBy("old", "block", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        parts |= {(r["old"], r["block"], r["part"]): (r["size"], r["n"]) for r in of_wide.collect()}
    per_slice = max(SLICE_ROWS, -(-sum(r["n"] for r in blocks) // SLICES))
    many = [(*key, -(-n // per_slice)) for key, (_, n) in parts.items() if n > per_slice]
    slices = spark.createDataFrame(many, "old int, block int, part int, n_slices int")
    cells = sorted(
        (r["old"], r["block"], r["part"], r["slice"], r["size"], r["n"])
        for r in _sliced(parted, slices).groupBy("old", "block", "part", "slice").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    )
    n_old = max((r["old"] for r in blocks), default=-1) + 1
    supply = [sum(r["size"] for r in blocks if r["old"] == i) for i in range(n_old)]
    flow = minimum_cost_flow(supply, capacity, cost)

    whole = {key for key, (size, _) in parts.items() if key[2] < PARTS or size <= max(capacity)}  # else a text that no shard can hold
    units = [(parts[key][0], *key) for key in sorted(whole)]
    keys = [(*key, None) for key in sorted(whole)]
    for old, block, part, piece, size, _ in cells:
        if (old, block, part) not in whole:
            units.append((size, old, block, part))
            keys.append((old, block, part, piece))
    shard_of = dict(zip(keys, _fill(units, flow, capacity)))
    slot, placed = [0] * n_new, []
    for old, block, part, piece, _, n in cells:
        shard = shard_of[(old, block, part, None if (old, block, part) in whole else piece)]
        placed.append((old, block, part, piece, shard, slot[shard]))
        slot[shard] += n
    table = spark.createDataFrame(placed, "old int, block int, part int, slice int, shard int, first_slot bigint")
    return Plan(table, slices, wide, hot, flow)


def assigned(rows: DataFrame, made: Plan) -> DataFrame:
    """``rows`` with ``slice``, ``shard`` and ``first_slot``: no shuffle, the plan is
    a row per slice, about ``SLICES`` and a row per part at most."""
    return _sliced(_parted(rows, made.wide, made.hot), made.slices).join(F.broadcast(made.cells), ["old", "block", "part", "slice"])


def slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in every shard: the rank within the slice, in
    order of checksum and id, after all slices before it."""
    order = Window.partitionBy("old", "block", "part", "slice").orderBy("text_crc32", "id", "size")
    return placed.withColumn("slot", F.col("first_slot") + F.row_number().over(order) - 1)


def reshard(docs: DataFrame, old_shard, n_new: int = 8, **options) -> DataFrame:
    """(id, size, text_crc32, old, shard, slot): one row per row of ``docs``.

    Null ids and repeated rows are rows like any other; ``docs`` may be empty. A
    null old shard counts as shard 0.
    """
    rows = sized(docs, F.coalesce(old_shard, F.lit(0)))
    return slots(assigned(rows, plan(rows, n_new, **options))).select("id", "size", "text_crc32", "old", "shard", "slot")


#: The column of written shards that tells where a row lay before.
OLD = "_old_shard"


def _written(docs: DataFrame, old_shard, folder: str, n_new: int, **options) -> tuple[Plan, list[int]]:
    """Writes the affected shards; the plan, and which they are."""
    own = [c for c in docs.columns if c.lower() not in ("shard", OLD)]
    old = F.coalesce(old_shard, F.lit(0))
    made = plan(sized(docs, old), n_new, **options)
    moved = made.cells.where("old <> shard")
    hit = moved.select(F.col("shard").alias("s")).unionByName(moved.select(F.col("old").alias("s"))).distinct()
    affected = sorted(r["s"] for r in hit.collect() if r["s"] < n_new)  # shard numbers
    keyed = docs.select(F.struct(*own).alias("row"), old.cast("int").alias("old"),
                        F.xxhash64(F.lit("block"), F.coalesce("text", F.lit(""))).alias("h"), F.col("doc_id").alias("id"))
    keyed = keyed.withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int"))
    out = assigned(keyed, made).where(F.col("shard").isin(affected)).select("row.*", F.col("old").alias(OLD), "shard")
    out.write.mode("errorifexists").partitionBy("shard").parquet(folder)
    return made, affected


def rewrite(docs: DataFrame, old_shard, folder: str, n_new: int = 8, **options) -> DataFrame:
    """Writes the affected shards, those that lose or gain a block, below ``folder``
    as ``shard=N/`` and returns (shard, affected): shards not affected keep their files.

    All columns of ``docs`` are written, and ``_old_shard``; columns of the input named
    ``shard`` or ``_old_shard`` are replaced. The text goes from the scan to its file; each
    shard is written by several tasks, by slice. Null texts, null ids, repeated rows and
    null old shards (shard 0) are written like any other row; of an empty table no shard is
    affected. Raises when ``folder`` is there already: nothing in it is replaced or removed.
    """
    _, affected = _written(docs, old_shard, folder, n_new, **options)
    return docs.sparkSession.range(n_new).select(F.col("id").cast("int").alias("shard"), F.col("id").isin(affected).alias("affected"))


def rewritten(docs: DataFrame, old_shard, folder: str, n_new: int = 8, **options) -> DataFrame:
    """What ``reshard`` gives, after ``rewrite``: the rows of affected shards are read from
    the new files (their sizes and checksums from the texts that stand there), those of the
    others from ``docs``."""
    made, affected = _written(docs, old_shard, folder, n_new, **options)
    stayed = sized(docs, F.coalesce(old_shard, F.lit(0)))
    files = docs.sparkSession.read.schema(_file_schema(docs)).parquet(folder)
    here = assigned(sized(files, F.col(OLD), "doc_id", "text", BLOCKS, F.col("shard").alias("of_file")), made) if affected else None
    there = assigned(stayed, made).where(~F.col("shard").isin(affected))
    if here is None:
        return slots(there).select("id", "size", "text_crc32", "old", "shard", "slot")
    placed = here.drop("shard").withColumnRenamed("of_file", "shard").unionByName(there)
    return slots(placed).select("id", "size", "text_crc32", "old", "shard", "slot")


def _file_schema(docs: DataFrame) -> T.StructType:
    own = [f for f in docs.schema.fields if f.name.lower() not in ("shard", OLD)]
    return T.StructType([*own, T.StructField(OLD, T.IntegerType()), T.StructField("shard", T.IntegerType())])
