"""Exact near-duplicate links of embeddings by dual traversal of cover trees.

Equal vectors of a label are one point with a number of copies. Points are dealt by label
and nearest pivot (pivots come from a bounded sample, farthest first), and large cells are
split, into blocks of bounded size. Each block gets a cover tree: nested levels whose
radii halve, each level's nodes among those of the next, every node with the exact radius
that covers all points below it. Two blocks of a label are compared if the distance of
their roots is at most the sum of their radii and the threshold; then both trees go down
level by level together, and node pairs farther apart than their radii and the threshold
are dropped. Only at the leaves is the cosine itself computed, in double precision.

A comparison returns a row for each point with links: its number of links and the least
point it is connected to in these two blocks; pairs are never emitted. Blocks bound the
memory of a task; the number of block comparisons that no tree can prune (random vectors
in many dimensions) grows with the square of a label's distinct points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patronlens.llm.common import components, in_small_batches, read, stash

THRESHOLD = 0.98
CELL_POINTS, BLOCK_POINTS = 1_024, 2_048  # points for each pivot, points of a block at most
PIVOTS, SAMPLE = 1_024, 16_384  # pivots in all and sampled points in all, at most
SLACK = 1e-6  # distances near 0 are roots of rounded differences


def points(vectors: DataFrame) -> DataFrame:
    """Distinct vectors of each label: ``point`` (the least vec_id), ``copies``, ``label`` and ``embedding``.

    Rows without id or label, and vectors that are null, empty, zero or hold null or
    non-finite components are no points.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.filter(sound & F.exists(x, lambda v: v != 0))
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("copies"))


def farthest_first(unit: np.ndarray, first: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in farthest-first order, and how far each was from all rows before it."""
    n = len(unit) if limit is None else min(limit, len(unit))
    order, gaps = np.zeros(n, dtype=np.int64), np.zeros(n)
    away = np.full(len(unit), np.inf)
    at = first
    for i in range(n):
        order[i], gaps[i] = at, away[at]
        away = np.minimum(away, 2 - 2 * (unit @ unit[at]))
        away[at] = -1.0
        at = int(np.argmax(away))
        away[order[i]] = -1.0
    gaps[:1] = 4.0
    return order, np.sqrt(np.maximum(gaps, 0))


def cover_tree(unit: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The points in farthest-first order and, for each level from the root, (size, below, radius).

    The nodes of a level are the first ``size`` points of the order, so levels are nested;
    ``below`` names for each point the node above it on this level, ``radius`` covers all
    points below a node.
    """
    order, gaps = farthest_first(unit)
    unit = unit[order]
    sizes, reach = [1], 2.0
    while sizes[-1] < len(unit):
        reach /= 2
        # all rows that are this far from the ones before; at the end the rest
        size = int((gaps > reach).sum()) if reach > 1e-3 else len(unit)
        if size > sizes[-1]:
            sizes.append(size)
    levels, below = [], np.arange(len(unit))
    for size in reversed(sizes):
        nearest = np.argmax(unit @ unit[:size].T, axis=1)
        nearest[:size] = np.arange(size)
        below = nearest[below]
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit, unit[below])))
        radius = np.zeros(size)
        np.maximum.at(radius, below, away)
        levels.append((size, below, radius))
    return order, levels[::-1]


def near_pairs(x: np.ndarray, y: np.ndarray, trees: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in tree order) of all pairs of the two point sets with cosine >= threshold."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    unit_x, unit_y = x / norm_x[:, None], y / norm_y[:, None]
    left, right = trees
    alive, above_x, above_y = np.ones((1, 1), dtype=bool), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for i in range(max(len(left), len(right))):
        (n_x, below_x, r_x), (n_y, below_y, r_y) = left[min(i, len(left) - 1)], right[min(i, len(right) - 1)]
        if i:
            alive = alive[np.ix_(above_x[:n_x], above_y[:n_y])]
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return rows, cols
        away = np.sqrt(np.maximum(0, 2 - 2 * (unit_x[rows] @ unit_y[cols].T)))
        alive[np.ix_(rows, cols)] &= away <= r_x[rows][:, None] + r_y[cols][None, :] + reach
        above_x, above_y = below_x, below_y
    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    cosine = (x[rows] @ y[cols].T) / (norm_x[rows][:, None] * norm_y[cols][None, :])
    a, b = np.nonzero(alive[np.ix_(rows, cols)] & (cosine >= threshold))
    return rows[a], cols[b]


def _least_connected(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the least name it is connected to by the pairs (a, b)."""
    least = names.copy()
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (least == before).all():
            return least


def _pivots(found: DataFrame, n_points: int) -> dict:
    """Unit vectors by label, farthest first, from a bounded sample over all labels and sizes."""
    wanted = min(PIVOTS, -(-n_points // CELL_POINTS))
    rows = found.select("label", "embedding").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()
    by_label: dict = {}
    for label, vector in rows:
        by_label.setdefault((label, len(vector)), []).append(vector)
    out = {}
    for key, members in by_label.items():
        unit = np.array(members, dtype=np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        order, _ = farthest_first(unit, limit=max(1, wanted * len(members) // len(rows)))
        out[key] = unit[order]
    return out


def _with_cells(found: DataFrame, pivots: dict) -> DataFrame:
    """``found`` plus ``cell``, the number of the nearest pivot of its label and length (0 without pivots)."""
    schema = StructType([*found.schema.fields, StructField("size", LongType()), StructField("cell", LongType())])

    def run(batches):
        for batch in batches:
            labels, lists = batch.column("label").to_pylist(), batch.column("embedding")
            bounds = np.asarray(lists.offsets)
            flat = np.asarray(lists.values, dtype=np.float64)
            sizes, cells = np.diff(bounds), np.zeros(len(batch), dtype=np.int64)
            for key in set(zip(labels, sizes.tolist())):
                own = np.array([i for i, k in enumerate(zip(labels, sizes.tolist())) if k == key])
                if key in pivots:
                    x = flat[bounds[own][:, None] + np.arange(key[1])]
                    cells[own] = np.argmax(x @ pivots[key].T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes.astype(np.int64)), pa.array(cells)], names=[*batch.schema.names, "size", "cell"]
            )

    return found.mapInArrow(run, schema)


_PACKED = "label {label}, size long, cell long, part long, names binary, copies binary, vectors binary, tree binary, root array<double>, radius double"


def _pack(table: pa.Table) -> pa.Table:
    """One block: its points in tree order, its tree, and the root with the radius that covers all."""
    table = table.sort_by("point")
    width = table["size"][0].as_py()
    x = np.asarray(table["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, width)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    order, levels = cover_tree(unit)
    row = {c: table[c][0].as_py() for c in ("label", "size", "cell", "part")} | {
        "names": np.asarray(table["point"], dtype=np.int64)[order].tobytes(),
        "copies": np.asarray(table["copies"], dtype=np.int64)[order].tobytes(),
        "vectors": x[order].tobytes(),
        "tree": _tree_bytes(levels),
        "root": unit[order[0]].tolist(),
        "radius": float(levels[0][2][0]),
    }
    schema = pa.schema(
        [(c, table.schema.field(c).type) for c in ("label", "size", "cell", "part")]
        + [(c, pa.binary()) for c in ("names", "copies", "vectors", "tree")]
        + [("root", pa.list_(pa.float64())), ("radius", pa.float64())]
    )
    return pa.Table.from_pylist([row], schema=schema)


def _tree_bytes(levels: list) -> bytes:
    head = np.array([len(levels), len(levels[0][1]), *[n for n, _, _ in levels]], dtype=np.int64)
    return head.tobytes() + b"".join(b.astype(np.int64).tobytes() + r.tobytes() for _, b, r in levels)


def _tree(raw: bytes) -> list:
    n_levels, n = np.frombuffer(raw, np.int64, 2)
    sizes, at, levels = np.frombuffer(raw, np.int64, n_levels, 16), 16 + 8 * int(n_levels), []
    for size in sizes.tolist():
        below = np.frombuffer(raw, np.int64, n, at)
        radius = np.frombuffer(raw, np.float64, size, at + 8 * int(n))
        levels.append((size, below, radius))
        at += 8 * (int(n) + size)
    return levels


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                x, y = pair["x"], pair["y"]
                names = [np.frombuffer(b["names"], np.int64) for b in (x, y)]
                copies = [np.frombuffer(b["copies"], np.int64) for b in (x, y)]
                vectors = [np.frombuffer(b["vectors"], np.float64).reshape(len(n), -1) for b, n in zip((x, y), names)]
                a, b = near_pairs(*vectors, (_tree(x["tree"]), _tree(y["tree"])), threshold)
                if pair["same"]:
                    a, b = a[a != b], b[a != b]
                    links = np.bincount(a, weights=copies[0][b], minlength=len(names[0]))
                    place, least = names[0], _least_connected(names[0], a, b)
                else:
                    links = np.concatenate(
                        [
                            np.bincount(a, weights=copies[1][b], minlength=len(names[0])),
                            np.bincount(b, weights=copies[0][a], minlength=len(names[1])),
                        ]
                    )
                    place = np.concatenate(names)
                    least = _least_connected(place, a, b + len(names[0]))
                at = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[at]), pa.array(links[at].astype(np.int64)), pa.array(least[at])],
                    names=["point", "links", "least"],
                )

    return run


def linked_points(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """point, links and least rows of all block comparisons, in a stored table. ``found`` is stored."""
    pivots = _pivots(found, found.count())
    cells = stash(_with_cells(found, pivots), "cells")
    counts = cells.groupBy("label", "size", "cell").agg(F.ceil(F.count(F.lit(1)) / (0.8 * BLOCK_POINTS)).alias("parts"))
    dealt = cells.join(counts, ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), "parts")).drop("parts")
    schema = _PACKED.format(label=found.schema["label"].dataType.simpleString())
    blocks = stash(dealt.groupBy("label", "size", "cell", "part").applyInArrow(_pack, schema), "blocks")
    at = F.struct("cell", "part")
    brief = blocks.select("label", "size", at.alias("at"), "root", "radius")
    apart = F.sqrt(
        F.aggregate(F.zip_with("x.root", "y.root", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    )
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    pairs = (
        brief.alias("x").join(brief.alias("y"), F.expr("x.label = y.label AND x.size = y.size AND x.at <= y.at"))
        .filter(apart <= F.col("x.radius") + F.col("y.radius") + reach)
        .select("x.label", "x.size", F.col("x.at").alias("at_x"), F.col("y.at").alias("at_y"))
    )
    body = F.struct("names", "copies", "vectors", "tree")
    left = blocks.select("label", "size", at.alias("at_x"), body.alias("x"))
    right = blocks.select("label", "size", at.alias("at_y"), body.alias("y"))
    both = pairs.join(left, ["label", "size", "at_x"]).join(right, ["label", "size", "at_y"])
    both = both.select("x", "y", (F.col("at_x") == F.col("at_y")).alias("same"))
    return stash(in_small_batches(both).mapInArrow(_compare(threshold), "point long, links long, least long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows that are no points (see ``points``) and vectors of other lengths link with
    nothing; a row without an id has no component and is not kept. Equal vectors of a
    label link with each other; repeated rows are vectors like others. An empty table
    gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    found = stash(points(rows), "points")
    linked = linked_points(found, threshold)
    links = linked.groupBy("point").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("point").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "point")
    facts = found.join(links, "point", "left").join(groups, "point", "left").select(
        "label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "point").alias("component")
    )
    joined = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("label"))).join(
        facts.withColumnRenamed("label", "key"), ["key", "embedding"], "left"
    )
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
      AND len([e FOR e IN embedding IF e <> 0]) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
), r(a, b) AS (
    SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
    SELECT a, min(b) AS least FROM r GROUP BY a
), n AS (
    SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
