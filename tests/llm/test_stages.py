"""The pipeline's stages and some registered queries against brute force on small and odd tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest
from conftest import SF, prose
from pyspark.sql import functions as F

from patronlens.llm import mixing, packing, token_files, topk, toxicity, warc
from patronlens.llm.tokens import standard_tokenizer

CLASHING = "mark int, whole int, of_doc int, of_source string, copy int, `row` int, of_mark int, size int"


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in any column, copies, repeated rows and columns named as those that stages use inside."""
    shared = prose(11, 70)
    rows = [(1, prose(1, 120), "s1"), (2, prose(1, 120), "s1"), (3, shared + " " + prose(2, 30), "s2"), (4, prose(3, 30) + " " + shared, "s1")]
    rows += [(5, None, "s1"), (6, "", None), (7, "one two", None), (None, prose(4, 60), "s2"), (8, prose(5, 80), "s2"), (8, prose(5, 80), "s2")]
    values = [(i, t, "en", s, len(t or ""), 1, 2, 3, "x", 4, 5, 6, 7) for i, t, s in rows]
    return spark.createDataFrame(values, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_empty_tables(spark, odd_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage(spark, odd_documents.limit(0), SF)
    assert empty.count() == 0
    found = stage(spark, odd_documents, SF)
    rows = [tuple(r) for r in odd_documents.collect()]
    if name == "packing":
        kept = found.groupBy("doc_id").agg(F.min("start").alias("first")).collect()
        assert Counter(r["doc_id"] for r in kept) == Counter({r[0] for r in rows}) and all(r["first"] == 0 for r in kept)
        return
    assert found.columns == odd_documents.columns == empty.columns
    got = Counter(tuple(r) for r in found.collect())
    if name == "toxicity":
        assert got == Counter(rows)
    if name == "near_copies":
        expected = brute.similar([(r[0], r[1]) for r in rows if r[0] is not None])
        gone = {i for i, (_, c) in expected.items() if c < i}
        assert gone == {2} and got == Counter(r for r in rows if r[0] not in gone)
    if name == "repeated_passages":
        assert {r[0] for r in got} == {r[0] for r in rows}
        assert {r[5:] for r in got} == {rows[0][5:]}
        texts = defaultdict(list)
        for r in got:
            texts[r[0]].append(r[1])
        assert len(brute.words(texts[4][0])) == 30 and len(brute.words(texts[3][0])) == 100 and not brute.words(texts[2][0])
    if name == "mixing":
        assert set(got) <= set(rows)
        sizes = defaultdict(int)
        for r in rows:
            sizes[r[3]] += len(brute.words(r[1]))
        taken = defaultdict(int)
        for r, n in got.items():
            assert n <= 3 * Counter(rows)[r]
            taken[r[3]] += n * len(brute.words(r[1]))
        for source, target in brute.mix_targets(dict(sizes)).items():
            assert abs(taken[source] - target) <= 240


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def library_ids(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(standard_tokenizer())
    return [[*e.ids, 2] for e in tool.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_file_query_equals_the_library(spark):
    rows = sorted(documents(spark))
    ids = library_ids([t for _, t in rows])
    start, expected = 0, {}
    for (doc, _), own in zip(rows, ids):
        expected[doc] = (start, len(own), crc(own))
        start += len(own)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op5(spark, SF).collect()}
    assert found == expected


def test_packing_query_places_every_piece(spark):
    rows = documents(spark)
    ids = dict(zip((i for i, _ in rows), library_ids([t for _, t in rows])))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in packing.op6(spark, SF).collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and 0 < r.length <= 1024
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, own in ids.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(pieces[doc])):
            assert (piece, start) == (n, at) and (n == 0 or length == 1024)
            at += length
        assert at == len(own)
    total = sum(map(len, ids.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_mixing_query_meets_its_targets(spark):
    sizes = {r.doc_id: (r.source, len(brute.words(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per_source = defaultdict(int)
    for source, size in sizes.values():
        per_source[source] += size
    goals, taken = brute.mix_targets(dict(per_source)), defaultdict(int)
    first = sorted(map(tuple, mixing.op8(spark, SF).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.op8(spark, SF).collect()), key=repr)
    for doc, size, source_size, target, took, source in first:
        assert (source, size) == sizes[doc] and source_size == per_source[source] and target == pytest.approx(goals[source])
        assert took % max(size, 1) == 0 and took <= 3 * size
        taken[source] += took
    largest = max(s for _, s in sizes.values())
    assert len(first) == len(sizes) and all(abs(taken[s] - goals[s]) <= largest for s in goals)


def test_toxicity_query_holds_out_and_predicts(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op4(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(p == t for p, t in judged) >= 0.95 * len(judged)


def test_warc_query_equals_hashes_of_the_pages(spark):
    import base64
    import hashlib

    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for i, body in pages:
        last[body] = max(last.get(body, i), i)
    found = {r.page_id: r for r in warc.op9(spark, SF).collect()}
    assert sorted(found) == sorted(i for i, _ in pages)
    for i, body in pages:
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[body] == i else ("revisit", last[body]))


def test_components_beyond_exact_scores_are_an_error(spark):
    rows = [(1, [1e30, 1.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not be exact"):
        topk.integer_rows(df).collect()
    largest = 2.0**17  # 2 * (256 * 2**17)**2 is below 2**53
    exact = topk.integer_rows(spark.createDataFrame([(1, [largest, largest]), (2, [largest, -1.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(exact, exact).collect()[0]["score"] in (2**50 - 2**33, 2**50 - 2**33)
