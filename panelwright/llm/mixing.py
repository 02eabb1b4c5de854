"""Mixing of sources to target shares of tokens.

Each document of a source is to appear target / available times. The whole part is the same for all; the fraction is an
inclusion probability that the cube method turns into 0 or 1. In its flight phase three undecided documents at a time move
along the null space of the two constraints (number of documents, number of tokens) until one of them is decided, so both
totals stay exactly as they were; at most two documents of a block remain. Blocks run in parallel; what remains of them is
balanced again, block by block, and the last one or two documents of a source are the landing problem, for which the constraint on tokens is dropped.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut, partitions_for

#: Documents that one flight handles.
BLOCK = 20_000
_EPS = 1e-9


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Chances after the flight phase: 0 or 1 but for at most two, their sum and their sum weighted by size kept."""
    out = list(chances)
    open_units = [i for i, p in enumerate(out) if _EPS < p < 1 - _EPS]
    for i, p in enumerate(out):
        out[i] = 0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p
    window: list[int] = []
    for unit in open_units:
        window.append(unit)
        while len(window) == 3:
            a, b, c = window
            xa, xb, xc = sizes[a], sizes[b], sizes[c]
            u = (xb - xc, xc - xa, xa - xb)  # null vector of [[1, 1, 1], [xa, xb, xc]]
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - out[k]) / v if v > 0 else out[k] / -v for k, v in zip(window, u) if v)
            down = min(out[k] / v if v > 0 else (1 - out[k]) / -v for k, v in zip(window, u) if v)
            step = up if rng.random() * (up + down) < down else -down
            for k, v in zip(window, u):
                p = out[k] + step * v
                out[k] = 0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p
            window = [k for k in window if 0.0 < out[k] < 1.0]
    return out


def landing(chances: list[float], rng: random.Random) -> list[float]:
    """Decides the at most few open units: the constraint on tokens is dropped, so pairs move against each other with their
    number kept, and the last one is drawn. Every unit keeps its chance."""
    out = list(chances)
    window: list[int] = []
    for unit in [i for i, p in enumerate(out) if 0.0 < p < 1.0]:
        window.append(unit)
        if len(window) == 2:
            a, b = window
            up, down = min(1 - out[a], out[b]), min(out[a], 1 - out[b])
            step = up if rng.random() * (up + down) < down else -down
            for k, p in ((a, out[a] + step), (b, out[b] - step)):
                out[k] = 0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p
            window = [k for k in window if 0.0 < out[k] < 1.0]
    for k in window:
        out[k] = float(rng.random() < out[k])
    return out


def _balance(seed: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        table = table.sort_by([("__order", "ascending"), ("__id", "ascending")])
        first = [table.column(c)[0].as_py() for c in ("plan_id", "source", "__block")]
        sizes, chances = table.column("__tokens").to_pylist(), table.column("__chance").to_pylist()
        rng = random.Random(f"{seed}/{first}/{last}")
        chances = flight(sizes, chances, rng)
        if last:
            chances = landing(chances, rng)
        return table.set_column(table.schema.get_field_index("__chance"), "__chance", pa.array(chances, pa.float64()))

    return run


def mix_plan(sizes: DataFrame, plans: DataFrame, total: int | None = None) -> DataFrame:
    """Per row of plans: what its source must give and can give.

    sizes: (source, n_tokens) of all documents. Columns: plan_id, source, max_repeats, documents, available, share, target,
    times, capped. available is 0 for a source without documents; a null or negative weight counts as 0, a null or negative
    max_repeats as 0; the total is that of all documents, those without a source or of other sources included.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").cast("long").alias("available"))
    totals = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total")) if total is None else sizes.sparkSession.range(1).select(F.lit(total).alias("total"))
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    sums = plans.groupBy("plan_id").agg(F.sum(weight).alias("weights"))
    rows = plans.select("plan_id", "source", weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).join(sums, "plan_id").join(by_source, "source", "left").crossJoin(F.broadcast(totals))
    rows = rows.select("plan_id", "source", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0)).alias("share"), "total")
    rows = rows.withColumn("target", F.col("share") * F.col("total")).withColumn("capped", F.col("max_repeats") * F.col("available") < F.col("target"))
    times = F.when(F.col("capped"), F.col("max_repeats").cast("double")).otherwise(F.coalesce(F.try_divide("target", F.col("available").cast("double")), F.lit(0.0)))
    return rows.select("plan_id", "source", "max_repeats", "documents", "available", "share", "target", times.alias("times"), "capped")


def mix_sources(sizes: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(plan_id, source, id_col, n_tokens, repeats): how often each document appears in each plan, 0 left out.

    plan is the result of mix_plan, best written once by `cut`. No document appears more than max_repeats times; a source that
    can't reach its share even so appears max_repeats times whole. Documents whose source is null or in no plan appear
    nowhere. Documents of 0 tokens are handled like others, ties of size too; a repeated id is two documents. Empty tables
    give an empty result. The result depends on the rows and the seed alone, not on their order or partitions.
    """
    spark = sizes.sparkSession
    needs = plan.select("plan_id", "source", F.floor("times").cast("int").alias("__whole"), (F.col("times") - F.floor("times")).alias("__chance"), F.ceil(F.col("documents") / block).cast("int").alias("__blocks"), "documents")
    most = needs.agg(F.max("__blocks"), F.sum(F.when(F.col("__chance") > _EPS, F.col("documents")))).first()
    blocks, undecided = most[0] or 1, most[1] or 0
    docs = sizes.select("source", F.col(id_col).alias("__id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("__tokens"))
    units = docs.join(needs.drop("documents"), "source")
    order = F.xxhash64("__id", F.lit(seed))
    units = units.withColumn("__order", order).withColumn("__block", F.pmod(order, F.col("__blocks")).cast("int"))
    columns = ["plan_id", "source", "__id", "__tokens", "__whole", "__chance", "__order", "__blocks", "__block"]
    units = units.select(*columns)
    decided = [units.filter(F.col("__chance") <= _EPS)]
    open_units = units.filter(F.col("__chance") > _EPS)
    while True:
        last = blocks <= 1
        # A number of partitions of its own, as adaptive execution would merge the flights, small in bytes, into one task.
        parts = max(2 * spark.sparkContext.defaultParallelism, partitions_for(spark, undecided, 4 * block))
        flights = open_units.repartition(parts, "plan_id", "source", "__block").groupBy("plan_id", "source", "__block")
        step = cut(flights.applyInArrow(_balance(seed, last), open_units.schema), "mix")
        closed = (F.col("__chance") <= 0.0) | (F.col("__chance") >= 1.0)
        decided.append(step.filter(closed))
        if last:
            break
        # At most two units of a block are left: balance those of block / 4 old blocks as one new block.
        blocks, undecided = -(-blocks // max(2, block // 4)), undecided * 2 // block + 1
        open_units = step.filter(~closed).withColumn("__block", (F.col("__block") / max(2, block // 4)).cast("int")).select(*columns)
    done = decided[0]
    for part in decided[1:]:
        done = done.unionByName(part)
    repeats = F.col("__whole") + F.when(F.col("__chance") >= 1.0, 1).otherwise(0)
    return done.select("plan_id", "source", F.col("__id").alias(id_col), F.col("__tokens").alias("n_tokens"), repeats.alias("repeats")).filter("repeats > 0")


def mix_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of mix_plan with what was reached: documents, records and tokens taken, and the share of the plan's tokens.

    exhausted: every document of the source stands at max_repeats and the tokens reached are still below the target; this is
    told from the mix, while mix_plan's capped is told in advance.
    """
    got = mixed.groupBy("plan_id", "source").agg(F.count(F.lit(1)).alias("taken_documents"), F.sum("repeats").alias("taken_records"), F.sum(F.col("repeats") * F.col("n_tokens")).cast("long").alias("taken_tokens"), F.max("repeats").alias("most_repeats"))
    totals = got.groupBy("plan_id").agg(F.sum("taken_tokens").alias("plan_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = plan.join(got, ["plan_id", "source"], "left").join(totals, "plan_id", "left")
    rows = rows.select("plan_id", "source", "share", "target", "available", "documents", "max_repeats", "capped", zero("taken_documents"), zero("taken_records"), zero("taken_tokens"), zero("most_repeats"), "plan_tokens")
    exhausted = (F.col("taken_records") == F.col("documents") * F.col("max_repeats")) & (F.col("taken_tokens") < F.col("target"))
    return rows.select(
        "plan_id", "source", "share", "target", "available", "max_repeats", "capped", "taken_documents", "taken_records", "taken_tokens", "most_repeats",
        F.coalesce(F.try_divide(F.col("taken_tokens").cast("double"), F.col("plan_tokens").cast("double")), F.lit(0.0)).alias("reached_share"), exhausted.alias("exhausted"),
    )
