"""Chat formatting: logged snapshots of one conversation collapse to the longest, then are rendered.

A log that writes a conversation again after every turn holds many conversations that are
beginnings of others. Every turn gets a rolling hash of all turns up to it (position,
role and text; sums of two hashes in decimal, so they never overflow). A conversation
whose last rolling hash is that of an earlier turn of another one is dropped by an
anti-join; of equal conversations the least id stays. Only DataFrame functions.

Hashes of turns are stored in range order, so a conversation of any length spreads over
several parts. Places and rolling hashes are running numbers of a part plus what its
earlier parts hold. Texts are moved only to render what is kept, and before that where
several turns have one number and role, as text then decides their order. A rendered
conversation is one string, so it is gathered in one task and must stay below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronlens.llm.common import read, stash

# The turn markers of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


# a part's rows have the numbers part * 2**33, part * 2**33 + 1, ...
PART_BITS = 33


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """Hashes of turns in order, stored: ``at`` numbers them over all conversations, ``part`` is the stretch each lies in."""
    marked = turns.withColumn("mark", F.xxhash64("role", "text")).withColumn("other", F.xxhash64("text", "role"))
    groups = marked.groupBy("conv_id", "turn", "role").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    tied = stash(groups.filter("least <> most").select(*[F.col(c).alias(f"tied_{c}") for c in ("conv_id", "turn", "role")]), "tied")
    same = (F.col("conv_id") == F.col("tied_conv_id")) & F.col("turn").eqNullSafe(F.col("tied_turn")) & (F.col("role") == F.col("tied_role"))
    narrow = marked.join(tied, same, "left").select(
        "conv_id", "turn", "role", "mark", "other", F.when(F.col("tied_conv_id").isNotNull(), F.col("text")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stash(numbered.select("conv_id", F.shiftright("at", PART_BITS).alias("part"), "at", "mark", "other"), "turns")


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """conv_id, part and for each name the sum over the earlier parts of the conversation: a row per part."""
    parts = rows.groupBy("conv_id", "part").agg(*[c.alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        "conv_id",
        "part",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums],
        *[F.sum(name).over(Window.partitionBy("conv_id")).alias(f"{name}_in_all") for name in sums],
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of conversations that no longer one begins with; the least id of equal ones."""
    in_part = Window.partitionBy("conv_id", "part").orderBy("at")
    so_far = in_part.rowsBetween(Window.unboundedPreceding, 0)
    narrow = _ordered(turns)
    placed = (
        narrow.join(_before(narrow, n=F.count(F.lit(1))), ["conv_id", "part"])
        .withColumn("place", F.col("n_before") + F.row_number().over(in_part))
        .withColumnRenamed("n_in_all", "n_turns")
    )
    hashed = stash(
        placed.select(
            "conv_id",
            "part",
            "at",
            "place",
            "n_turns",
            F.xxhash64("place", "mark").cast("decimal(38,0)").alias("one"),
            F.xxhash64("other", "place").cast("decimal(38,0)").alias("two"),
        ),
        "hashed-turns",
    )
    rolling = hashed.join(_before(hashed, a=F.sum("one"), b=F.sum("two")), ["conv_id", "part"]).select(
        "conv_id",
        "place",
        "n_turns",
        (F.col("a_before") + F.sum("one").over(so_far)).cast("decimal(38,0)").alias("one"),
        (F.col("b_before") + F.sum("two").over(so_far)).cast("decimal(38,0)").alias("two"),
    )
    longest = (
        rolling.filter("place = n_turns").groupBy("place", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    )
    begun = rolling.filter("place < n_turns").select("place", "one", "two").distinct()
    return longest.join(begun, ["place", "one", "two"], "left_anti").select(
        "conv_id", F.col("place").cast("long").alias("n_turns")
    )


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and ``rendered`` of every maximal conversation.

    Turns go by number, nulls first, equal numbers by role and text; repeated rows are
    turns like others. Null roles and texts are empty. Texts are rendered as they are, also
    where they hold the markers themselves. Rows without a conversation id belong to none
    and are left out. Other columns are ignored. An empty table gives no rows.
    """
    turns = _turns(conversations)
    kept = turns.join(maximal_conversations(turns), "conv_id")
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))
    return (
        kept.select("conv_id", "n_turns", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text").alias("turn"))
        .groupBy("conv_id", "n_turns")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
    )


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return render(read(spark, folder, "conversations"))


ORACLE = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, count(*) AS n_turns,
           list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY place) AS turns
    FROM t GROUP BY conv_id
), e AS (
    SELECT turns, n_turns, min(conv_id) AS conv_id FROM c GROUP BY turns, n_turns
)
SELECT conv_id, n_turns, array_to_string(turns, '') AS rendered
FROM e
WHERE NOT EXISTS (
    SELECT 1 FROM e AS l WHERE l.n_turns > e.n_turns AND l.turns[1] = e.turns[1] AND l.turns[1:e.n_turns] = e.turns
)
"""
