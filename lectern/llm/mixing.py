"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import aside


#: Code points of a block.
BLOCK_CHARS = 1 << 16
NO_SOURCE = "\0none"


def pfair_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of sum(weights) slots.

    Block j of a source of weight k in W is released at floor(j W / k) and due at ceil((j + 1) W / k).
    Earliest deadline first over the released blocks meets every deadline, so after t slots a source has
    had more than t k / W - 1 and less than t k / W + 1 blocks, and exactly its share after a period.
    """
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready, out = [], {s: [] for s in weights}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a block missed its deadline")
        out[s].append(t)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """(source, first block, end block, first slot, period, slots) until every block has its slot.

    When a source has no block left, the others go on at their weights among themselves.
    """
    used, base, out = {s: 0 for s in blocks}, 0, []
    while live := {s: weights[s] for s in blocks if used[s] < blocks[s]}:
        total, slots = sum(live.values()), pfair_period(live)
        rest = {s: blocks[s] - used[s] for s in live}
        end = min((rest[s] - 1) // live[s] * total + slots[s][(rest[s] - 1) % live[s]] + 1 for s in live)
        for s in live:
            n = end // total * live[s] + bisect_left(slots[s], end % total)
            if n:
                out.append((s, used[s], used[s] + n, base, total, slots[s]))
            used[s] += n
        base += end
    return out


def tempered_weights(sizes: dict[str, int], units: int = 1000) -> dict[str, int]:
    """Whole weights in proportion to the square root of each source's size, 1 at least."""
    roots = {s: n**0.5 for s, n in sizes.items()}
    total = sum(roots.values()) or 1
    return {s: max(1, round(units * r / total)) for s, r in roots.items()}


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS, chars: str | None = None, broadcast_phases: int = 20_000) -> DataFrame:
    """Adds block, slot and start to every row: read in order of (slot, start), sources stand in their weights.

    Each source's rows, in an order by hash of the id, are a stream of code points (one more for each
    row); a row belongs to the block of `block_chars` in which it starts, and a row longer than that
    leaves blocks empty that still take their slots. `weights` are whole numbers; a source without one
    gets 1; without any, they follow the square roots of the sources' sizes. Every row is kept: when a
    source ends, the rest share its slots. The driver holds one number for each source and a row for each
    source with blocks in each phase between two such ends. Up to `broadcast_phases` of these rows are
    broadcast; more are laid out as a table of blocks, which rows are joined with by (source, block).

    `chars` names a column that has the lengths of the texts, where the texts themselves are not at hand.

    Null sources form a source of their own, null and empty texts take one place, rows tied in id and
    text follow each other in any order, an empty table gives an empty result, and columns named block,
    slot or start are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("block", "slot", "start")]
    of = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    size = (F.coalesce(F.col(chars) if chars else F.length(text), F.lit(0)) + 1).cast("long")
    away, back = aside(kept)
    rows = docs.select(*away, of.alias("_source"), size.alias("_size"), F.xxhash64(F.lit("mix"), F.col(doc_id)).alias("_order"), F.col(doc_id).alias("_id"))
    sums = {r["_source"]: (r["chars"], r["n"]) for r in rows.groupBy("_source").agg(F.sum("_size").alias("chars"), F.count("*").alias("n")).collect()}
    if not sums:
        return docs.select(*kept, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("start"))
    buckets = max(64, sum(n for _, n in sums.values()) // 100_000)
    rows = rows.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    per = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(per, ["_source", "_bucket"])
    placed = placed.withColumn("start", F.col("_before") + F.col("_inside")).withColumn("block", F.expr(f"start div {int(block_chars)}"))

    sizes = {s: c for s, (c, _) in sums.items()}
    target = tempered_weights(sizes) if weights is None else {s: int(weights.get(s, 1)) for s in sizes}
    plan = phases({s: -(-c // block_chars) for s, c in sizes.items()}, target)
    small = len(plan) <= broadcast_phases
    plan = spark.createDataFrame(plan, "_source string, lo long, hi long, base long, period long, slots array<long>")
    slot = F.expr("base + (block - lo) div size(slots) * period + slots[int(pmod(block - lo, size(slots)))]")
    if small:
        found = placed.join(F.broadcast(plan), "_source").where("block >= lo and block < hi")
    else:
        # A row for each block, laid out in parallel; a block holds block_chars rows at most, so no key is hot.
        blocks = plan.repartition("_source", "lo").withColumn("block", F.explode(F.expr("sequence(lo, hi - 1)")))
        found = placed.join(blocks.select("_source", "block", slot.alias("slot")).hint("merge"), ["_source", "block"])
        slot = F.col("slot")
    return found.select(*back, F.col("block").cast("long").alias("block"), slot.alias("slot"), F.col("start").cast("long").alias("start"))


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The columns of `docs`, its rows range-partitioned and sorted into the mixed order."""
    away, back = aside(docs.columns)
    named = {k: f"c{docs.columns.index(how.get(k, k))}" for k in ("source", "text", "doc_id")}
    mixed = mix_sources(docs.select(*away), **{**how, **named})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "slot", "start").sortWithinPartitions("slot", "start").select(*back)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, source, block, slot, start."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "block", "slot", "start")
