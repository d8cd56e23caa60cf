"""Exact top-k inner products of a query set against all rows, term at a time.

Rows are sparse lists of (term, weight). Blocks of candidate rows are inverted: for each
term the places and weights of the rows that have it. A block of queries has one dense
array of scores for the candidates; term by term, the weights of the queries that have
the term are scattered times the postings' weights into it. Of each score row a partition
selection keeps the k best, and the selections of all candidate blocks are merged.
Queries and candidates travel as blocks of bounded size; every candidate block meets
every query block once; the pairs are dealt to tasks by both blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronlens.llm.common import in_small_batches, read, stash

K = 5
QUERY_ROWS, CANDIDATE_ROWS = 512, 4_096  # rows of a block; a score array has QUERY_ROWS * CANDIDATE_ROWS doubles
EXACT = 1 << 53  # whole doubles below are exact
_BLOCK = "block long, ids binary, rows binary, terms binary, weights binary"


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the nonzero components floor(scale * x) as ``terms`` and ``weights``.

    Rows without an id or vector, or whose vector holds a null or non-finite component,
    take no part. Weights are whole doubles. Scores are sums of at most ``size`` products, so
    they are exact while size * weight**2 stays below 2**53; a larger component is an error.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    most = F.sqrt(F.lit(float(EXACT)) / F.size("embedding"))
    message = F.lit("a component is so large that scores would not be exact")
    whole = F.transform(
        x,
        lambda v: F.when(F.abs(v * scale) < most - 1, F.floor(v * scale).cast("double")).otherwise(
            F.raise_error(message).cast("double")
        ),
    )
    numbered = F.transform(whole, lambda v, i: F.struct(i.alias("term"), v.alias("weight")))
    kept = F.filter(numbered, lambda t: t["weight"] != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("row")).select(
        "vec_id", F.col("row.term").alias("terms"), F.col("row.weight").alias("weights")
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size``, numbered from 0; row ids, row numbers, terms and weights as bytes."""
    n = max(1, -(-rows.count() // size))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        out = []
        for at in range(0, len(table), size):
            part = table.slice(at, size).combine_chunks()
            lengths = np.diff(np.asarray(part["terms"].combine_chunks().offsets))
            terms = np.asarray(part["terms"].combine_chunks().flatten(), dtype=np.int32)
            weights = np.asarray(part["weights"].combine_chunks().flatten(), dtype=np.float64)
            number = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            order = np.argsort(terms, kind="stable")  # inverted: all rows of a term together
            out.append(
                {
                    "block": table["block"][0].as_py() + n * (at // size),
                    "ids": np.asarray(part["vec_id"], dtype=np.int64).tobytes(),
                    "rows": number[order].tobytes(),
                    "terms": terms[order].tobytes(),
                    "weights": weights[order].tobytes(),
                }
            )
        schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "rows", "terms", "weights")]])
        return pa.Table.from_pylist(out, schema=schema)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    return stash(dealt.groupBy("block").applyInArrow(run, _BLOCK), "blocks")


def _postings(row: dict) -> tuple:
    ids = np.frombuffer(row["ids"], np.int64)
    numbers, terms = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["terms"], np.int32)
    weights = np.frombuffer(row["weights"], np.float64)
    distinct, at = np.unique(terms, return_index=True)
    ends = np.append(at[1:], len(terms))
    return ids, {int(t): (numbers[a:b], weights[a:b]) for t, a, b in zip(distinct, at, ends)}


def _search(k: int):
    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                query_ids, query_terms = _postings(pair["query"])
                ids, postings = _postings(pair["candidate"])
                scores = np.zeros((len(query_ids), len(ids)))
                for term, (queries, amounts) in query_terms.items():
                    if term in postings:
                        rows, weights = postings[term]
                        scores[np.ix_(queries, rows)] += amounts[:, None] * weights[None, :]
                # ids ascend, so a stable order by score leaves ties with the smaller id first
                scores[query_ids[:, None] == ids[None, :]] = -np.inf
                # k best of each row and all ties with the last of them
                limit = min(k, len(ids))
                least = np.partition(scores, len(ids) - limit, axis=1)[:, len(ids) - limit]
                near = (scores >= least[:, None]) & np.isfinite(scores)
                q, c = np.nonzero(near)
                order = np.lexsort((ids[c], -scores[q, c], q))
                q, c = q[order], c[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, c = q[rank < k], c[rank < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[q]), pa.array(ids[c]), pa.array(scores[q, c].astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Both sides are rows of ``integer_rows``. Ties go to the smaller id; a candidate with
    the query's id is left out; with fewer candidates all are returned. Repeated query
    rows count once, repeated candidate rows each. Empty sides give no rows.
    """
    left = _blocks(queries.dropDuplicates(["vec_id"]), QUERY_ROWS)
    right = _blocks(candidates, CANDIDATE_ROWS)
    columns = ["ids", "rows", "terms", "weights"]
    # every block of one side with every block of the other: bounded blocks, not rows
    n = left.count()
    places = left.select("block").withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)  # block numbers only
    numbered = left.join(places, "block")
    # few query blocks would be few tasks, so their candidate blocks are dealt to several shares each
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-tasks // max(n, 1)))
    query = numbered.select(
        "place", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.struct(*columns).alias("query")
    )
    candidate = right.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("place"),
        F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"),
        F.struct(*columns).alias("candidate"),
    )
    # by number of partitions: sizes in bytes say little about this work, so they must not join them again
    pairs = candidate.repartition(tasks, "place", "share").join(query.repartition(tasks, "place", "share"), ["place", "share"])
    found = in_small_batches(pairs.select("query", "candidate")).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = integer_rows(read(spark, folder, "embeddings"))
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


ORACLE = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
