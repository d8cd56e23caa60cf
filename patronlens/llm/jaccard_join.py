"""Documents whose word-shingle sets overlap by at least 80 % (Jaccard), and their components.

Equal sets are one set from the start. The others go through an exact prefix join that
uses what is known of similar sets, so that it neither compares within large groups of
copies nor loses a link:

* Order. Shingles that are frequent in a task's share of the input come last, the rest in
  hash order, so prefixes hold rare shingles. The list of frequent shingles is bounded; it
  changes only how much work is done, never the result.
* Answers of similar sets. Sets that share minima of several hash functions are compared
  with one leader for each minimum. Sets found similar form groups; an index list then has
  one entry for each group and block, not for each set, and pairs inside a group are never
  made.
* Skipping by position. An index list is dealt by shingle; its blocks, one for each group,
  hold the range of sizes and the most shingles from the position on. Blocks whose sizes
  cannot match are skipped, and so are pairs of groups whose first shared position or
  whose number of shared shingles leaves too few for the needed overlap.
* Derived answers. For a remaining pair of groups first the leaders are compared. If they
  are not similar, |x - y| >= |p - q| - |x - p| - |y - q| (symmetric differences) tells
  which members cannot be similar either; only the other members are compared.

Comparisons are exact: 9 * overlap >= 4 * (n_x + n_y), the same as 100 * intersection >=
80 * union, on 64-bit hashes of five lower-cased words.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import words
from patronlens.llm.common import arrow_pass, components, in_small_batches, read, stash, text_rows

WIDTH = 5
FREQUENT = 4  # times in a task's share that make a shingle frequent there
FREQUENT_LIMIT = 200_000  # entries of the list of frequent shingles: 1.6 MB for each task
MEMBERS = 64  # members of a group whose texts travel in one row
MINIMA, BANDS, AGREEING = 16, 4, 10  # hash minima of a set, those used as keys, those that must agree with a leader
_SALTS = words.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """For slices of ``texts``: first row, sorted distinct shingle hashes of all rows, bounds of each row.

    A text with fewer words than ``width`` is one shingle, a text without words none.
    """
    for first_row, part in words.chunks(texts):
        found = words.split(part, lower=True)
        hashes, first = found.windows(width)
        row = np.searchsorted(found.bounds, first, "right") - 1
        n = found.counts
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            # a short text's only shingle: its words' hash, told apart from full ones by its length
            whole = words.sequence(found, found.bounds[short], found.bounds[short + 1])
            hashes = np.concatenate([hashes, words.mix(whole + n[short].astype(np.uint64))])
            row = np.concatenate([row, short])
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        yield first_row, hashes, np.searchsorted(row, np.arange(len(part) + 1))


def _segment_min(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    filled = bounds[:-1] < bounds[1:]
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    if len(values):
        out[filled] = np.minimum.reduceat(values, bounds[:-1][filled])
    return out


def _profile(width: int):
    """Per document its set's size, two sums that identify the set, and hash minima."""

    def build(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        for row, hashes, bounds in shingle_sets(batch.column("text"), width):
            sums = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
            np.cumsum(words.mix(hashes), out=sums[0, 1:])
            np.cumsum(words.mix(hashes ^ _SALTS[0]), out=sums[1, 1:])
            minima = [_segment_min(words.mix(hashes ^ s), bounds).view(np.int64) for s in _SALTS]
            flat = np.stack(minima, axis=1)
            yield {
                "doc_id": ids.slice(row, len(bounds) - 1),
                "n": np.diff(bounds).astype(np.int64),
                "sum1": (sums[0][bounds[1:]] - sums[0][bounds[:-1]]).view(np.int64),
                "sum2": (sums[1][bounds[1:]] - sums[1][bounds[:-1]]).view(np.int64),
                "minima": pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), MINIMA).cast(pa.list_(pa.int64())),
            }

    return build


def frequent_shingles(texts: DataFrame, width: int, least: int = FREQUENT, limit: int = FREQUENT_LIMIT) -> np.ndarray:
    """The shingles that are frequent within tasks, most frequent first, at most ``limit``, sorted by hash."""

    def run(batches):
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            for _, hashes, _ in shingle_sets(batch.column("text"), width):
                held.append(hashes)
            if sum(map(len, held)) > 2_000_000:
                yield counted(held)
                held = [np.zeros(0, np.uint64)]
        yield counted(held)

    def counted(held):
        found, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= least
        return pa.RecordBatch.from_arrays(
            [pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["shingle", "times"]
        )

    rows = (
        in_small_batches(texts.select("text"))
        .mapInArrow(run, "shingle long, times long")
        .groupBy("shingle")
        .agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "shingle")
        .limit(limit)
    )
    return np.sort(np.array([r[0] for r in rows.select("shingle").collect()], dtype=np.int64).view(np.uint64))


def _prefixes(width: int, frequent):
    """Index entries of groups: the first shingles of each set in the common order.

    A prefix has as many shingles as a similar set can lack, and one. Entries of one
    group in one slice of the input are merged, so a large group costs each task a few.
    """

    def build(batch: pa.RecordBatch):
        last = frequent.value
        groups = np.asarray(batch.column("group"))
        parts = []
        for first_row, hashes, bounds in shingle_sets(batch.column("text"), width):
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            place = np.minimum(np.searchsorted(last, hashes), max(len(last) - 1, 0))
            late = last[place] == hashes if len(last) else np.zeros(len(hashes), dtype=bool)
            order = np.lexsort((hashes, late, row))
            position = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
            take = position < (n - (4 * n + 4) // 5 + 1)[row]
            size = n[row][take]
            parts.append((hashes[order][take], groups[row[take] + first_row], size, size - position[take]))
        if not parts:
            return
        shingle, group, size, rest = map(np.concatenate, zip(*parts))
        order = np.lexsort((group, shingle))
        shingle, group, size, rest = shingle[order], group[order], size[order], rest[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(new)
        if len(at):
            yield {
                "shingle": shingle[at].view(np.int64),
                "group": group[at],
                "least": np.minimum.reduceat(size, at).astype(np.int64),
                "most": np.maximum.reduceat(size, at).astype(np.int64),
                "rest": np.maximum.reduceat(rest, at).astype(np.int64),
            }

    return build


def _overlaps(width: int):
    """Symmetric difference of the two texts' sets for each pair."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        found = []
        for _, hashes, bounds in shingle_sets(texts, width):
            found += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return found

    def build(batch: pa.RecordBatch):
        left, right = sets(batch.column("text_a")), sets(batch.column("text_b"))
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
        sizes = [len(x) + len(y) for x, y in zip(left, right)]
        yield {
            "a": batch.column("a"),
            "b": batch.column("b"),
            "apart": np.array([s - 2 * o for s, o in zip(sizes, both)], dtype=np.int64),
            "linked": np.array([9 * o >= 4 * s for s, o in zip(sizes, both)], dtype=bool),
        }

    return build


@contextmanager
def _early_filters(spark: SparkSession):
    """Let Spark filter texts by the ids of a small table before it shuffles them, at any size of the texts."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of ids with ``apart`` and ``linked``, from the whole texts, in a stored table."""
    pairs = stash(pairs, "pairs").filter("a <> b")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = "a long, b long, apart long, linked boolean"
    with _early_filters(pairs.sparkSession):
        return stash(arrow_pass(both.select("a", "b", "text_a", "text_b"), _overlaps(width), schema), "compared")


def _sizes_fit(x: str, y: str):
    return F.expr(f"5 * least({x}, {y}) >= 4 * greatest({x}, {y})")


def _with_leaders(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the leader of a minimum and another set with it, if enough minima agree."""
    keyed = sets.select("doc_id", F.posexplode(F.slice("minima", 1, BANDS)).alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
    met = keyed.join(leaders.filter("a < last"), ["band", "key"]).filter("doc_id <> a")
    pairs = met.select("a", F.col("doc_id").alias("b")).distinct()
    own = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("minima").alias("minima_b"))
    led = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("minima").alias("minima_a"))
    agreeing = F.expr("aggregate(zip_with(minima_a, minima_b, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    return (
        pairs.join(own, "b").join(led, "a").filter(_sizes_fit("n_a", "n_b") & (agreeing >= AGREEING)).select("a", "b").distinct()
    )


def _groups_that_may_link(entries: DataFrame, grouped: DataFrame) -> DataFrame:
    """Pairs of groups (a < b) of which two members' prefixes allow a link."""
    lists = (
        entries.repartition("shingle")
        .groupBy("shingle", "group")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("rest").alias("rest"))
    )
    reach = (
        "x.shingle = y.shingle AND x.group < y.group"
        " AND 5 * x.most >= 4 * y.least AND 5 * y.most >= 4 * x.least"
    )
    shared = (
        lists.alias("x").join(lists.alias("y"), F.expr(reach))
        .groupBy(F.col("x.group").alias("a"), F.col("y.group").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("x.rest", "y.rest")).alias("rest"))
    )
    spans = grouped.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return (
        shared.join(spans.toDF("a", "least_a", "most_a"), "a")
        .join(spans.toDF("b", "least_b", "most_b"), "b")
        # all that two sets share follows their first shared shingle
        .filter("9 * rest >= 4 * (least_a + least_b)")
        # beyond the prefixes at most ceil(0.8 n) - 1 shingles of a set can be shared
        .filter("9 * (shared + int((4 * greatest(most_a, most_b) + 4) / 5) - 1) >= 4 * (least_a + least_b)")
        .select("a", "b")
    )


def _member_links(width: int):
    """Linked pairs between the members of two blocks, of all pairs that known differences don't exclude."""

    def side(members: list[dict]) -> list[tuple]:
        sets = []
        for _, hashes, bounds in shingle_sets(pa.array([m["text"] for m in members], pa.string()), width):
            sets += [hashes[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        return [(m["doc_id"], m["apart"], s) for m, s in zip(members, sets)]

    def build(batch: pa.RecordBatch):
        found = []
        for pair in batch.to_pylist():
            right = side(pair["members_b"])
            for a, apart_a, x in side(pair["members_a"]):
                for b, apart_b, y in right:
                    sizes = len(x) + len(y)
                    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)) or (a == pair["a"] and b == pair["b"]):
                        continue
                    # the triangle inequality; unknown distances exclude nothing
                    if apart_a is not None and apart_b is not None and 9 * (pair["between"] - apart_a - apart_b) > sizes:
                        continue
                    if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * sizes:
                        found.append((a, b))
        yield {"a": np.array([a for a, _ in found], dtype=np.int64), "b": np.array([b for _, b in found], dtype=np.int64)}

    return build


def _links_of_members(led: DataFrame, starred: DataFrame, grouped: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Linked pairs (a, b) of members of groups whose leaders aren't similar but whose members may be.

    Members travel in blocks of at most about MEMBERS texts: a row is a pair of blocks,
    not a pair of documents.
    """
    # groups that other leaders connect by now need no comparison, nor have groups of one other members
    joined = components(led.filter("linked").select("a", "b"))
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    pairs = (
        led.groupBy("a", "b").agg(F.min("apart").alias("between"), F.max("linked").alias("linked")).filter("NOT linked")
        .join(joined.toDF("a", "whole_a"), "a", "left")
        .join(joined.toDF("b", "whole_b"), "b", "left")
        .filter("coalesce(whole_a, a) <> coalesce(whole_b, b)")
        .join(several.toDF("a", "several_a"), "a", "left")
        .join(several.toDF("b", "several_b"), "b", "left")
        .filter("several_a IS NOT NULL OR several_b IS NOT NULL")
        .select("a", "b", "between")
    )
    pairs = stash(pairs, "open-groups")
    known = starred.groupBy(F.col("b").alias("doc_id"), F.col("a").alias("group")).agg(F.max("apart").alias("apart"))
    open_groups = pairs.select(F.col("a").alias("group")).union(pairs.select("b")).distinct()
    members = (
        grouped.join(open_groups, "group").join(known, ["doc_id", "group"], "left")
        .join(grouped.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks")), "group")
        .select("group", "doc_id", F.expr("if(doc_id = group, 0, apart)").alias("apart"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"))
    )
    members = stash(members, "open-members").filter("doc_id >= 0 OR doc_id < 0")
    packed = (
        members.join(texts, "doc_id")
        .groupBy("group", "block")
        .agg(F.collect_list(F.struct("doc_id", "apart", "text")).alias("members"))
    )
    with _early_filters(pairs.sparkSession):
        packed = stash(packed, "member-blocks").select("group", "members")
    both = pairs.join(packed.toDF("a", "members_a"), "a").join(packed.toDF("b", "members_b"), "b")
    return stash(arrow_pass(both, _member_links(width), "a long, b long"), "member-links")


def similar_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links.

    Null and empty texts, and texts of white space, have no shingles and link with
    nothing. Rows without an id have no component (null). Rows that repeat an id are one
    document, which links where any of its texts does; ``n_shingles`` is the row's own.
    Other columns are ignored. An empty table gives no rows.
    """
    texts = text_rows(docs).filter("doc_id is not null")
    profile = "doc_id long, n long, sum1 long, sum2 long, minima array<long>"
    sets = stash(arrow_pass(text_rows(docs), _profile(width), profile), "sets")
    filled = sets.filter("n > 0 AND doc_id is not null")
    equal = filled.groupBy("n", "sum1", "sum2").agg(F.min("doc_id").alias("rep"))
    placed = filled.join(equal, ["n", "sum1", "sum2"])
    distinct = stash(
        placed.filter("doc_id = rep").dropDuplicates(["doc_id", "sum1", "sum2"]).select("doc_id", "n", "minima"), "distinct"
    )

    starred = compare(_with_leaders(distinct), texts, width)
    linked = starred.filter("linked").select("a", "b")
    groups = components(linked).withColumnsRenamed({"node": "doc_id", "component_id": "group"})
    grouped = stash(
        distinct.join(groups, "doc_id", "left").select("doc_id", "n", F.coalesce("group", "doc_id").alias("group")), "grouped"
    )

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, width))
    entries = arrow_pass(
        texts.join(grouped.select("doc_id", "group").distinct(), "doc_id").select("text", "group"),
        _prefixes(width, frequent),
        "shingle long, group long, least long, most long, rest long",
    )
    led = compare(_groups_that_may_link(entries, grouped), texts, width)
    away = grouped.filter("doc_id <> group").select(F.col("group").alias("a"), F.col("doc_id").alias("b")).distinct()
    starred = starred.union(compare(away.join(starred, ["a", "b"], "left_anti"), texts, width))
    late = _links_of_members(led, starred, grouped, texts, width)
    found = linked.union(led.filter("linked").select("a", "b")).union(late)
    copies = placed.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    whole = components(found.union(copies)).withColumnRenamed("node", "doc_id")
    return sets.join(whole, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return similar_sets(read(spark, folder, "documents"))
