"""Mixing sources to target weights: Pfair scheduling of blocks, earliest deadline first."""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.keys import norm_key
from corpuslab.llm.units import unit_count

#: Slots of one round of the schedule, and so the size of the table that is broadcast.
SLOTS = 10_000
#: Documents of which one task takes the running totals.
PER_PART = 200_000

PLAN = "source string, target_share double, max_repeat long, tokens long, demand double, supply double, block double, due_blocks long, ready_blocks long, rounds long, documents long"


def documents_with_tokens(documents: DataFrame) -> DataFrame:
    """`(doc_id, source, tokens)` with the compared form of the source; null texts have 0 tokens."""
    return documents.select("doc_id", norm_key(F.col("source")).alias("source"), unit_count(F.col("text")).alias("tokens"))


def pfair_schedule(due: list[int], ready: list[int], slots: int) -> tuple[list[tuple[int, int, int]], set[int]]:
    """`(slot, source, block)` of a schedule of `slots` slots, and the sources that miss a deadline.

    Block i of a source of weight w = due / slots is released at floor((i - 1) / w) and must be placed before
    ceil(i / w); in each slot the released block with the earliest deadline goes first. Where the weights sum to at most
    1 every deadline is met, so that each source is always within one block of its share. A source has only `ready`
    blocks: those beyond have nothing to be placed when they are released, their slots stay empty and their deadlines are
    missed.
    """
    released: list[tuple[int, int, int]] = []
    absent: list[tuple[int, int]] = []
    waiting = [(0, s, 1) for s, n in enumerate(due) if n > 0]
    heapq.heapify(waiting)
    out, missed = [], set()
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            deadline = ceil(i * slots / due[s])
            if i <= ready[s]:
                heapq.heappush(released, (deadline, s, i))
            else:
                heapq.heappush(absent, (deadline, s))
        if released:
            _, s, i = heapq.heappop(released)
            out.append((slot, s, i))
            if i < due[s]:
                heapq.heappush(waiting, (floor(i * slots / due[s]), s, i + 1))
        while absent and absent[0][0] <= slot + 1:
            missed.add(heapq.heappop(absent)[1])
    return out, missed


def pfair_slots(due: list[int], ready: list[int], slots: int) -> list[tuple[int, int, int]]:
    """The placed blocks of `pfair_schedule`."""
    return pfair_schedule(due, ready, slots)[0]


def mix_plan(sized: DataFrame, targets: DataFrame, slots: int = SLOTS, block_tokens: int | None = None) -> DataFrame:
    """One row per target source: what it is due, what it can supply, and both in blocks of the schedule.

    The mix is as large as all documents together, of listed sources or not; `demand` is the target share of that and
    `supply` the source's tokens times its allowed uses. Sources without documents supply nothing; targets with a null or
    blank source are dropped, negative and null shares count as 0, null repeats as 1.

    The mix is divided into `rounds` rounds of `slots` blocks, one round unless `block_tokens` asks for smaller blocks;
    with more rounds shares are met to 1 / slots. The documents are read once: their tokens are summed per target (and
    for the rest together) before anything moves, and those few sums come to the driver.
    """
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    wanted = (
        targets.select(norm_key(F.col("source")).alias("_key"), "source", share.alias("target_share"), F.coalesce("max_repeat", F.lit(1)).cast("long").alias("max_repeat"))
        .filter("_key is not null")
        .dropDuplicates(["_key"])
        .collect()
    )
    known = F.broadcast(sized.sparkSession.createDataFrame([(r["_key"],) for r in wanted], "_key string"))
    sums = sized.join(known, F.col("source") == F.col("_key"), "left").groupBy("_key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    tokens = {r["_key"]: r["tokens"] or 0 for r in sums}
    total, documents = sum(tokens.values()), sum(r["n"] for r in sums)
    rounds = max(1, ceil(Fraction(total, slots * block_tokens))) if block_tokens else 1
    rows = []
    for r in wanted:
        demand, supply = r["target_share"] * float(total), tokens.get(r["_key"], 0) * r["max_repeat"]
        due = ceil(Fraction(demand) * slots / total) if total else 0
        ready = ceil(Fraction(supply * slots, total)) if total else 0
        rows.append((r["source"], r["target_share"], r["max_repeat"], tokens.get(r["_key"], 0), demand, float(supply), total / slots / rounds, due, ready, rounds, documents))
    return sized.sparkSession.createDataFrame(rows, PLAN)


def schedule(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One round of the schedule, `(source_key, block_no, slot)`, at most `slots` rows plus one per source, made on the driver.

    `plan` has one row per target source, a fixed handful. If the shares sum to more than 1 the schedule is longer.
    """
    rows = plan.select("source", "due_blocks").orderBy("source").collect()
    due = [r.due_blocks for r in rows]
    placed = pfair_slots(due, due, max(slots, sum(due)))
    made = plan.sparkSession.createDataFrame([(rows[s].source, i, t) for t, s, i in placed], "source string, block_no long, slot long")
    return made.select(norm_key(F.col("source")).alias("source"), "block_no", "slot")


def scheduled_shortages(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sources that cannot reach their target share: those that miss a deadline of the schedule.

    A source misses one if it has fewer blocks than it is due. If it has exactly as many, its last block may be too small
    for what is due of it, which only the tokens tell. `due_blocks` and `ready_blocks` are rounded up without error, so
    that both together are the same as comparing all tokens.
    """
    rows = plan.select("source", "due_blocks", "ready_blocks", "supply", "demand").orderBy("source").collect()
    due = [r.due_blocks for r in rows]
    _, missed = pfair_schedule(due, [r.ready_blocks for r in rows], max(slots, sum(due)))
    short = [(r.source,) for i, r in enumerate(rows) if i in missed or (0 < r.due_blocks == r.ready_blocks and r.supply < r.demand)]
    return plan.sparkSession.createDataFrame(short, "source string")


def mix(sized: DataFrame, plan: DataFrame, slots: int = SLOTS, parts: int | None = None) -> DataFrame:
    """The mix, one row per use of a document: `(slot, source, doc_id, use, tokens)`, to be read in order of slot.

    Each source takes its documents in the order of a digest, up to `max_repeat` times, until its demand is met; a
    document is due in the block in which its first token falls. Running totals are taken over parts of each source,
    ranges of the digest, and the parts' totals (targets times parts rows, broadcast), so that no source is gathered into
    one task; there are as many parts as `PER_PART` documents each ask for. Documents without tokens or of unlisted
    sources are not used. The documents move once, as ids and token counts.
    """
    facts = plan.select(norm_key(F.col("source")).alias("source"), "max_repeat", F.col("tokens").alias("of_source"), F.least("demand", "supply").alias("goal"), "block", "due_blocks").filter("goal > 0")
    parts = parts or min(65_536, max(16, (plan.agg(F.max("documents")).first()[0] or 0) // PER_PART))
    order = F.md5(F.col("doc_id").cast("string"))
    part = F.floor(F.conv(F.substring("_order", 1, 4), 16, 10).cast("long") * parts / 65_536)
    each = sized.filter("tokens > 0 and doc_id is not null").withColumn("_order", order).withColumn("_part", part)
    each = each.join(F.broadcast(facts.select("source")), "source").repartition("source", "_part")
    sums = each.groupBy("source", "_part").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_part").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), ["source", "_part"]).join(F.broadcast(facts), "source")
    uses = placed.withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("max_repeat", F.lit(1)))))
    at = (F.col("use") - 1) * F.col("of_source") + F.col("_offset") + F.col("_before")
    used = uses.withColumn("_at", at).filter(F.col("_at") < F.col("goal")).withColumn("_block", F.floor(F.col("_at") / F.col("block")))
    placed_in = used.withColumn("block_no", F.col("_block") % F.col("due_blocks") + 1).withColumn("_round", F.floor(F.col("_block") / F.col("due_blocks")))
    slotted = placed_in.join(F.broadcast(schedule(plan, slots)), ["source", "block_no"])
    return slotted.select((F.col("_round") * F.lit(slots) + F.col("slot")).alias("slot"), "source", "doc_id", "use", "tokens")


def mix_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source the share reached in the mix next to the one wanted, with uses and tokens."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("uses"))
    got = got.withColumn("_all", F.sum("used_tokens").over(Window.partitionBy()))  # a row per target source
    key = plan.withColumn("_key", norm_key(F.col("source")))
    joined = key.join(F.broadcast(got.withColumnRenamed("source", "_key")), "_key", "left")
    used = F.coalesce("used_tokens", F.lit(0))
    return joined.select("source", "target_share", used.alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(used / F.col("_all"), F.lit(0.0)).alias("actual_share"))
