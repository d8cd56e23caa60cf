"""Exact removal of word passages that an earlier document already has.

A window is ``width`` consecutive words of one document. A word goes if any window over
it also starts in a document with a smaller id.

Method. Every window gets a Rabin-Karp hash. So that not all of them have to travel,
every window is first represented by the least Rabin-Karp hash among its shorter windows
of ``gram`` words (equal windows have equal representatives): representatives are counted
in Spark, and only windows whose representative occurs in two documents are counted
themselves. Hash counts are combined in each task before the shuffle, so a passage that a
third of all documents share costs one row per task in the counts; the joins that take
counts back to windows still meet all its windows under one key. Windows with a smaller owner go back
to their documents and merge into maximal removal intervals there. A whole text that a
smaller id also has needs no windows: all of them go.

Windows are compared by two independent 64-bit hashes (that of the window and that of the
representative), which is an equality test up to a chance below n**2 / 2**128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from patronlens.llm import words
from patronlens.llm.common import arrow_pass, read

WIDTH, GRAM = 50, 16


def _window_rows(texts: pa.Array, width: int, gram: int):
    """Of every window: the row of its text, its first word, its hash and its representative."""
    for first_row, part in words.chunks(texts):
        found = words.split(part)
        grams, gram_first = found.windows(gram)
        whole, first = found.windows(width)
        if not len(whole):
            continue
        row = np.searchsorted(found.bounds, first, "right") - 1
        # grams of one text are consecutive: the j-th word of a text starts the j-th gram
        place = np.searchsorted(gram_first, first)
        low = _running_min(grams, width - gram + 1)[place]
        yield row + first_row, first - found.bounds[row], whole, low


def _running_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values, by doubling; cut short at the end."""
    out, done = values.copy(), 1
    while done < span:
        step = min(done, span - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _representatives(width: int, gram: int):
    def build(batch: pa.RecordBatch):
        ids, marks = np.asarray(batch.column("doc_id")), np.asarray(batch.column("mark"))
        for row, _, _, low in _window_rows(batch.column("text"), width, gram):
            keep = np.ones(len(row), dtype=bool)
            keep[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
            yield {"low": low[keep].view(np.int64), "doc_id": ids[row[keep]], "mark": marks[row[keep]]}

    return build


def _shared_windows(width: int, gram: int):
    """Windows whose representative is in the ``lows`` of their document."""

    def build(batch: pa.RecordBatch):
        ids, lists = np.asarray(batch.column("doc_id")), batch.column("lows")
        marks = np.asarray(batch.column("mark"))
        bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        firsts = np.asarray(batch.column("firsts").values)
        owner = np.repeat(np.arange(len(lists)), np.diff(bounds)).astype(np.uint64)
        shared = words.mix(flat[bounds[0] : bounds[-1]].view(np.uint64) + owner * np.uint64(0x9E3779B97F4A7C15))
        owned = firsts[bounds[0] : bounds[-1]]
        order = np.argsort(shared)
        shared, owned = shared[order], owned[order]
        for row, first, whole, low in _window_rows(batch.column("text"), width, gram):
            key = words.mix(low + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            place = np.minimum(np.searchsorted(shared, key), max(len(shared) - 1, 0))
            hit = shared[place] == key if len(shared) else np.zeros(len(key), dtype=bool)
            yield {
                "low": low[hit].view(np.int64),
                "hash": whole[hit].view(np.int64),
                "doc_id": ids[row[hit]],
                "mark": marks[row[hit]],
                "first": first[hit].astype(np.int64),
                "later": owned[place][hit] < ids[row[hit]],
            }

    return build


def removal_intervals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per id with something to remove: ``gone``, the (mark, first word) pairs of the windows to go.

    ``docs`` has doc_id (never null), text and mark, a hash of the text that tells apart
    rows of one id. A pair with first word -1 stands for all windows of the text.
    """
    whole = docs.select("doc_id", "mark", F.xxhash64(F.lit(1), "text").alias("mark2"))
    originals = (
        whole.groupBy("mark", "mark2")
        .agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last_doc"))
        .filter("original < last_doc")
    )
    copies = whole.join(originals, ["mark", "mark2"]).filter("doc_id > original").select("doc_id", "mark")
    copied = copies.groupBy("doc_id").agg(F.collect_set("mark").alias("copied"))

    grams = arrow_pass(
        docs.select("doc_id", "text", "mark"), _representatives(width, gram), "low long, doc_id long, mark long"
    )
    shared = (
        grams.groupBy("low")
        .agg(F.min("doc_id").alias("first_doc"), F.min("mark").alias("least_mark"), F.max("mark").alias("most_mark"))
        .filter("least_mark < most_mark")
    )
    lists = (
        grams.select("low", "doc_id")
        .join(shared.select("low", "first_doc"), "low")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("low", "first_doc")).alias("pairs"))
        .join(copied, "doc_id", "left")
        .select("doc_id", F.col("pairs.low").alias("lows"), F.col("pairs.first_doc").alias("firsts"), "copied")
    )
    windows = arrow_pass(
        docs.join(lists, "doc_id").filter("NOT coalesce(array_contains(copied, mark), false)"),
        _shared_windows(width, gram),
        "low long, hash long, doc_id long, mark long, first long, later boolean",
    )
    owners = windows.groupBy("low", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_doc"))
    repeated = windows.filter("later").join(owners.filter("owner < last_doc"), ["low", "hash"]).filter("owner < doc_id")
    gone = repeated.select("doc_id", "mark", "first").union(copies.withColumn("first", F.lit(-1).cast("long")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("mark", "first")).alias("gone"))


def _kept(width: int):
    """The words left of each text."""

    def build(batch: pa.RecordBatch):
        texts, lists = batch.column("text"), batch.column("gone")
        bounds, pairs = np.asarray(lists.offsets), lists.values
        marks, firsts = np.asarray(pairs.field("mark")), np.asarray(pairs.field("first"))
        own = np.asarray(batch.column("mark"))
        n_words, n_removed, kept = [], [], []
        for first_row, part in words.chunks(texts):
            found = words.split(part)
            data = found.data.tobytes()
            for i in range(len(part)):
                a, b = int(found.bounds[i]), int(found.bounds[i + 1])
                row = slice(bounds[first_row + i], bounds[first_row + i + 1])
                at = firsts[row][marks[row] == own[first_row + i]]
                if (at < 0).any():
                    at = np.arange(b - a - width + 1)
                edge = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                keep = np.cumsum(edge)[:-1] == 0
                starts, ends = found.starts[a:b][keep], found.ends[a:b][keep]
                n_words.append(b - a)
                n_removed.append(int(b - a - keep.sum()))
                kept.append(b" ".join([data[x:y] for x, y in zip(starts.tolist(), ends.tolist())]))
        yield {
            "doc_id": batch.column("doc_id"),
            "text": texts,
            "rest": batch.column("rest"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return build


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text``, ``rest``, ``n_words``, ``n_removed`` and ``kept_text`` of every row.

    ``rest`` holds all other columns, so their names never clash; ``kept_text`` has the
    kept words with one space between. Null and empty texts have no words. Rows without
    an id own no window and lose none. Rows of one id don't remove each other. Texts
    shorter than ``width`` words are whole. An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("mark"),
        (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"),
    )
    # all columns go to both joins, so that their shuffle by id is one and the same
    known = rows.filter("doc_id is not null")
    joined = known.join(removal_intervals(known, width, gram), "doc_id", "left")
    unknown = rows.filter("doc_id is null").withColumn("gone", F.lit(None).cast(joined.schema["gone"].dataType))
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            rows.schema["rest"],
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept_text", StringType()),
        ]
    )
    return arrow_pass(joined.unionByName(unknown), _kept(width), schema)


def op7(spark, folder: str) -> DataFrame:
    result = remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
