"""Best-fit packing of token pieces into sequences, with certified bin counts.

Documents are encoded where they lie; only piece descriptions (id, place, length, crc)
are shuffled. The pieces of each length are dealt in turn to partitions of bounded size,
so all partitions have the same mix of lengths. Each partition packs its pieces by
best-fit decreasing and gets a lower bound on its sequences from dual-feasible functions:
any function u with u(a) + u(b) + ... <= 1 wherever a + b + ... <= 1 bounds the count by
the sum of u over the pieces. Sequences that are full stay. A partition with a gap gives
up all its other sequences, one whose count meets its bound only the emptiest, which
might be filled elsewhere. What was given up is dealt out and packed again; where that
needs no fewer sequences, the earlier placement stays and only the emptiest sequence of
each partition is exchanged, until one partition is left or nothing is saved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronlens.llm.common import arrow_pass, read, stash, text_rows
from patronlens.llm.tokens import encoded_slices, standard_tokenizer

LENGTH = 1024
# pieces of a partition, and rounds in which partitions with a gap give up all but their full sequences
BLOCK_PIECES, GAP_ROUNDS = 20_000, 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, copy long, block long, bin long, offset long, room long, emptiest boolean, bins long, bound long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every text (null: empty): whole if it fits, else cut so that only the first may be shorter."""

    def build(batch: pa.RecordBatch):
        ids_of = batch.column("doc_id")
        for first, ids, bounds in encoded_slices(batch.column("text"), tokenizer):
            raw = memoryview(ids.tobytes())
            out = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                head = (b - a - 1) % length + 1
                for k, at in enumerate([a, *range(a + head, b, length)]):
                    end = a + head if k == 0 else at + length
                    out.append((first + i, k, at - a, end - at, zlib.crc32(raw[4 * at : 4 * end])))
            rows = [np.array(c) for c in zip(*out)]
            yield {
                "doc_id": ids_of.take(pa.array(rows[0])),
                "piece": rows[1].astype(np.int32),
                "start": rows[2].astype(np.int64),
                "length": rows[3].astype(np.int64),
                "ids_crc32": rows[4].astype(np.int64),
            }

    return arrow_pass(text_rows(docs), build, PIECE, encodes=True)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """The largest lower bound on the bins for ``lengths`` from a family of dual-feasible functions.

    All in whole numbers. The identity gives the sum bound. For 0 < t <= capacity / 2,
    pieces above capacity - t count as a whole bin and those below t as none (the sum
    bound on the rest). For k = 1, 2, ..., a piece x with x * (k + 1) not a multiple of
    the capacity counts floor(x * (k + 1) / capacity) / k, others x / capacity.
    """
    return least_bins_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1], capacity)


def least_bins_of_counts(count: np.ndarray, capacity: int) -> int:
    """``least_bins`` for ``count[n]`` pieces of each length n."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    below, mass = np.cumsum(count), np.cumsum(count * size)
    for t in range(1, capacity // 2 + 1):
        large = int(below[capacity] - below[capacity - t])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 33):
        steps, left = np.divmod(size * (k + 1), capacity)
        value = np.where(left == 0, size * k, steps * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, taken in the given (decreasing) order, and the room left in each bin.

    Bins are held by their room; the set of rooms in use is one integer, so the tightest
    fit is its lowest bit at or above the length.
    """
    by_room: dict[int, list[int]] = {}
    rooms, bins, offsets, left = 0, [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            chosen = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(left)
            left.append(capacity)
        bins.append(chosen)
        offsets.append(capacity - room)
        left[chosen] = room - length
        if room > length:
            by_room.setdefault(room - length, []).append(chosen)
            rooms |= 1 << (room - length)
    return bins, offsets, left


def _pack_block(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("copy", "ascending")]
        group = group.sort_by(order)
        lengths = group["length"].to_numpy()
        bins, offsets, left = best_fit(lengths.tolist(), capacity)
        bins, room = np.array(bins, dtype=np.int64), np.array(left, dtype=np.int64)
        found = {
            "bin": bins,
            "offset": np.array(offsets, dtype=np.int64),
            "room": room[bins],
            "emptiest": bins == np.argmax(room),
            "bins": np.full(len(bins), len(left)),
            "bound": np.full(len(bins), least_bins(lengths, capacity)),
        }
        for name, column in found.items():
            group = group.append_column(name, pa.array(column))
        return group

    return run


def _deal(rows: DataFrame, blocks: int, level: int) -> DataFrame:
    """``rows`` with a ``block``: those of each length go to the blocks in turn, the next length where it stopped.

    A row's turn is its number in a slice of its length plus the rows before that slice, so
    no task sorts more than a slice, however common a length. Slices and numbers follow from
    ids; so reruns agree, also over other file splits.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(level)), F.lit(blocks)))
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    # one row for each length here
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(first, "length")
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "copy")
    turn = F.col("first") + F.col("before") + F.row_number().over(within)
    return (
        sliced.join(before, ["length", "slice"])
        .withColumn("block", F.pmod(turn, F.lit(blocks)))
        .select(*rows.columns, "block")
    )


def _round(rows: DataFrame, length: int, level: int) -> tuple[DataFrame, int]:
    """``rows`` placed by best-fit decreasing in partitions, and the number of these."""
    blocks = max(1, -(-rows.count() // BLOCK_PIECES))
    dealt = _deal(rows, blocks, level) if blocks > 1 else rows.withColumn("block", F.lit(0).cast("long"))
    return stash(dealt.groupBy("block").applyInArrow(_pack_block(length), PLACED), f"packed-{level}"), blocks


def _sequences(placed: DataFrame) -> int:
    return placed.filter("offset = 0").count()


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset; every piece is placed once.

    ``bins`` and ``bound`` are those of the partition that placed the piece last. Pieces
    of equal length are taken by id, so reruns agree; repeated rows are placed each. No
    pieces, no rows.
    """
    columns = cut.columns
    distinct = cut.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    rows = stash(distinct.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")), "pieces")

    def numbered(placed: DataFrame, level: int) -> DataFrame:
        number = (F.lit(level).cast("long") * (1 << 58)) + F.col("block") * (1 << 24) + F.col("bin")
        return placed.withColumn("sequence_id", number)

    placed, blocks = _round(rows, length, 0)
    done, level, of_level, gaps = [], 0, 0, True
    while blocks > 1:
        gaps = gaps and level < GAP_ROUNDS
        given_up = (F.col("room") > 0) & (F.col("emptiest") | (F.lit(gaps) & (F.col("bins") > F.col("bound"))))
        given = placed.filter(given_up)
        before = _sequences(given)
        if not before:
            break
        level += 1
        again, fewer = _round(given.select(*rows.columns), length, level)
        if _sequences(again) < before:
            done.append(numbered(placed.filter(~given_up), of_level))
            placed, blocks, of_level = again, fewer, level
        elif gaps:
            gaps = False
        else:
            break
    out = numbered(placed, of_level)
    for more in done:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset", "bins", "bound")


def certificate(packed: DataFrame, length: int = LENGTH) -> tuple[int, int]:
    """The number of sequences of a packing, and a lower bound on that of any packing of its pieces."""
    counts = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
    count = np.zeros(length + 1, dtype=np.int64)
    for r in counts:
        count[r["length"]] = r["n"]
    return _sequences(packed), least_bins_of_counts(count, length)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces(read(spark, folder, "documents"), standard_tokenizer()))
