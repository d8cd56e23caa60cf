"""Copies of documents that mix sources to target sizes, by pivotal dependent rounding.

Every source gets a share of the total size by weight, at most ``most`` times its own
size; what is above that is shared out again. A document then has the fractional copy
number target / size of its source: the whole part is taken, the fractions are rounded
together. Of two fractional documents one passes size to the other, in a random direction
that keeps both expectations, until one of them is whole; so the sum of size * copies
stays what it was. Blocks of a source work alone and leave one fractional document each;
the remaining ones meet in a reduction tree until a source has one, which is rounded at
random. Every draw is seeded by ids, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronlens.llm import words
from patronlens.llm.common import arrow_pass, read, stash

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS, FAN_IN = 2_000, 1_000  # documents of a block, blocks that meet in a node of the tree


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (a hash of the text) and size (its words) of every row."""

    def build(batch: pa.RecordBatch):
        counts = [words.split(part).counts for _, part in words.chunks(batch.column("text"))]
        yield {
            "doc_id": batch.column("doc_id"),
            "source": batch.column("source"),
            "mark": batch.column("mark"),
            "size": np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64),
        }

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("mark"),
        F.col("text").cast("string").alias("text"),
    )
    return arrow_pass(rows, build, "doc_id long, source string, mark long, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``source_size``, ``rows`` and ``target``. Sources in code-point order, null last.

    Water filling in closed form: sources are capped in the order of cap per weight, and
    the level is that of the first place where all remaining sources stay below their cap.
    There is a row for each source, not for each document, in these windows.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(choice, (rank % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = capped.withColumn("level", level)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)
    return leveled.withColumn("water", first_open["level"]).select(
        "source",
        "source_size",
        "rows",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(F.col("cap"), F.col("weight") * F.coalesce("water", F.lit(math.inf))))
        .alias("target"),
    )


_STATE = "doc_id long, source string, mark long, size long, times long, mass double, whole long, rest double, block long"


def _settle_block(final: bool):
    """Round the units of a block until one is left between none and all of its ``mass``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mass", "order", "doc_id", "mark"], ascending=[False, True, True, True])
        mass, rest = group["mass"].tolist(), group["rest"].tolist()
        whole = group["whole"].to_numpy(copy=True)
        draws = np.random.default_rng(int(group["seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF).random(len(group))
        held = -1
        # by falling mass: small units are settled against a large one, which may be the one left over
        for i in (i for i, r in enumerate(rest) if r > 0):
            if held < 0:
                held = i
                continue
            gain = min(mass[held] - rest[held], rest[i])
            loss = min(rest[held], mass[i] - rest[i])
            # the expectation of both stays: gain * P(gain) = loss * P(loss)
            to, of = (held, i) if draws[i] * (gain + loss) < loss else (i, held)
            if mass[to] - rest[to] <= rest[of]:
                rest[of] -= mass[to] - rest[to]
                rest[to] = mass[to]
            else:
                rest[to] += rest[of]
                rest[of] = 0.0
            for j in (to, of):
                if rest[j] >= mass[j] * (1 - 1e-12):
                    whole[j] += 1
                    rest[j] = 0.0
                elif rest[j] <= mass[j] * 1e-12:
                    rest[j] = 0.0
            held = next((j for j in (held, i) if rest[j] > 0), -1)
        if final and held >= 0:
            whole[held] += draws[held] * mass[held] < rest[held]
            rest[held] = 0.0
        return group.assign(whole=whole, rest=rest).drop(columns=["order", "seed"])

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Copies of every document, and the targets of every source.

    The first has doc_id, source, mark, size, times (rows that repeat these four) and
    ``whole``, the copies of each of these rows; the second is that of ``targets``.
    Equal rows are rounded as one. Texts without words (null, empty) have size 0 and are
    taken ``whole`` times of their source's whole part. An empty table gives no rows.
    """
    sized = stash(sizes(docs), "sizes")
    goals = stash(targets(sized, weights, most), "targets")
    units = sized.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("times"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.xxhash64("doc_id", "mark")
    goal = goals.select(F.col("source").alias("goal_source"), "target", "source_size", "rows")
    state = (
        units.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("mass", (F.col("size") * F.col("times")).cast("double"))
        .withColumn("whole", F.floor(ratio))
        .withColumn("rest", (ratio - F.floor(ratio)) * F.col("mass"))
        .withColumn("block", F.pmod(place, F.ceil(F.col("rows") / BLOCK_ROWS)))
        .select("doc_id", "source", "mark", "size", "times", "mass", "whole", "rest", "block")
    )
    blocks = goals.agg(F.max(F.ceil(F.col("rows") / BLOCK_ROWS))).first()[0] or 1
    done, level = [], 0
    while True:
        seeded = state.withColumn("order", place).withColumn("seed", F.xxhash64("source", "block", F.lit(level)))
        settled = stash(
            seeded.groupBy("source", "block").applyInPandas(_settle_block(blocks == 1), _STATE), f"mix-{level}"
        )
        done.append(settled.filter("rest = 0"))
        if blocks == 1:
            break
        state = settled.filter("rest > 0").withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "mark", "size", "times", "whole"), goals


def op8(spark: SparkSession, folder: str) -> DataFrame:
    copies, goals = mix(read(spark, folder, "documents"))
    goal = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    return (
        copies.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole")).alias("taken"), "source")
    )
