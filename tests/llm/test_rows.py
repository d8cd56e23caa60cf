from __future__ import annotations

import base64
import hashlib
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from conftest import SF, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronlens.llm import (
    chat,
    common,
    embedding_dedup,
    mixing,
    packing,
    queries,
    token_files,
    tokens,
    topk,
    toxicity,
    warc,
)

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n=300, dim=8):
    """Clusters, exact and scaled copies, and vectors that take no part."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(20, dim))
    rows = [(i, (base[i % 20] + draw.normal(scale=0.08, size=dim)).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(5)] + [(n + 10, [2 * x for x in rows[0][1]], 0), (n + 11, rows[0][1], 1)]
    rows += [(n + 20, None, 0), (n + 21, [], 0), (n + 22, [0.0] * dim, 0), (n + 23, [float("nan")] * dim, 0)]
    rows += [(n + 24, [None, *rows[0][1][1:]], 0), (n + 25, rows[0][1], None), (n + 26, rows[0][1][:4], 0), (None, rows[0][1], 0)]
    rows += [(n + 27, [float("inf"), *rows[0][1][1:]], 0)]
    return rows


def takes_part(x):
    return x is not None and all(v is not None and np.isfinite(v) for v in x)


def linked(rows, threshold=0.98):
    good = [(i, np.array(x, np.float32).astype(float), l) for i, x, l in rows if i is not None and l is not None and takes_part(x) and any(x)]
    links = []
    for n, (i, x, l) in enumerate(good):
        for j, y, m in good[n + 1 :]:
            if l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((i, j))
    ids = [i for i, _, _ in rows if i is not None]
    count = {i: 0 for i in ids}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return count, brute.components(ids, links)


@pytest.mark.parametrize("block", [2048, 40])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_POINTS", block)
    monkeypatch.setattr(embedding_dedup, "CELL_POINTS", block // 2)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("copies", F.lit(1)).withColumn("x", F.lit(2)).repartition(3)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    count, component = linked(rows)
    assert len(found) == len(rows) and sum(count.values()) > 500
    for i in count:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (count[i], component[i], component[i] == i)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 1000))
def test_cover_trees_lose_no_pair(n, m, seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(4, 5))
    x, y = (base[draw.integers(4, size=k)] + draw.normal(scale=draw.choice([0.01, 0.2]), size=(k, 5)) for k in (n, m))
    sides = []
    for side in (x, y):
        order, levels = embedding_dedup.cover_tree(side / np.linalg.norm(side, axis=1)[:, None])
        assert sorted(order.tolist()) == list(range(len(side))) and levels[-1][0] == len(side)
        again = embedding_dedup._tree(embedding_dedup._tree_bytes(levels))
        assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(levels, again))
        sides.append((side[order], levels))
    a, b = embedding_dedup.near_pairs(sides[0][0], sides[1][0], (sides[0][1], sides[1][1]), 0.98)
    unit = [s / np.linalg.norm(s, axis=1)[:, None] for s, _ in sides]
    near = unit[0] @ unit[1].T
    clear = np.abs(near - 0.98) > 1e-12
    got = np.zeros_like(near, dtype=bool)
    got[a, b] = True
    assert (got == (near >= 0.98))[clear].all()


@pytest.mark.parametrize("k", [5, 400])
def test_top_k_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    rows = odd_vectors()
    part = topk.integer_rows(spark.createDataFrame(rows, VECTORS).withColumn("rows", F.lit(0)))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(part.filter("vec_id % 50 = 0"), part, k).collect()}
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x, _ in rows if i is not None and takes_part(x)}
    expected = {}
    for q in (i for i in whole if i % 50 == 0):
        dot = lambda x, y: int(x[: len(y)] @ y[: len(x)])
        best = sorted(((-dot(whole[q], x), i) for i, x in whole.items() if i != q))[:k]
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert found == expected
    assert topk.top_k(part.limit(0), part, k).count() == topk.top_k(part, part.limit(0), k).count() == 0


def test_only_block_numbers_meet_the_window_without_a_partition(spark):
    part = topk.integer_rows(spark.createDataFrame(odd_vectors(), VECTORS))
    lines = topk.top_k(part, part)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Window [row_number() windowspecdefinition(block#" in line]
    assert below and not any(c in line for line in below for c in ("ids#", "rows#", "terms#", "weights#"))


def test_conversations_collapse_to_the_longest(spark):
    turns = ["hi", "hello", "bye", "ok"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", turns[t]) for c, n in ((1, 2), (2, 4), (3, 3), (4, 4)) for t in range(n)]
    rows += [(8, 0, "user", x) for x in ("q", "p", "r")] + [(9, 0, "user", "p"), (10, 0, "user", "r"), (11, 0, "user", "p"), (11, 0, "user", "q")]
    rows += [(5, 0, "user", "hi"), (5, 1, "user", "hello"), (6, None, None, None), (7, 3, "user", "b"), (7, 3, "user", "a"), (None, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9)).repartition(3)
    found = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert found == {
        2: (4, "".join(line("user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns))),
        5: (2, line("user", "hi") + line("user", "hello")),
        6: (1, line("", "")),
        7: (2, line("user", "a") + line("user", "b")),
        8: (3, line("user", "p") + line("user", "q") + line("user", "r")),
        10: (1, line("user", "r")),
    }
    assert chat.render(df.limit(0)).count() == 0


def test_a_long_conversation_spreads_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        said = [(t, "user", f"turn {t}" if t != 700 else "long " * 200_000) for t in range(2_000)]
        rows = [(c, *turn) for c, n in ((1, 1_500), (2, 2_000), (3, 2_000), (4, 1)) for turn in said[:n]]
        rows += [(5, *said[0]), (5, 1, "user", "turn 1<|im_end|>\n")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        stored = chat._ordered(chat._turns(df))
        assert stored.filter("conv_id = 2").select("part").distinct().count() > 1
        found = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert found == {
        2: (2_000, "".join(line(role, text) for _, role, text in said)),
        5: (2, line("user", "turn 0") + line("user", "turn 1<|im_end|>\n")),
    }


def test_few_query_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 20)
    vectors = [(i, [float(i % 7), float(-i % 5), 1.0]) for i in range(400)]
    part = topk.integer_rows(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    seen = topk.top_k(part.filter("vec_id % 50 = 0"), part)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [place" in plan and "share" in plan
    assert seen.count() == 8 * 5


def ids_of(texts):
    tool = tokens.encoder(tokens.standard_tokenizer()).tokenizer
    return [e.ids + [tokens.END] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_all_ids_in_order(spark, odd_docs, odd_texts, no_docs, tmp_path):
    path = token_files.write_tokens(odd_docs, str(tmp_path / "tokens"), tokens.standard_tokenizer())
    expected = dict(zip([i for i, _ in odd_texts], ids_of([t for _, t in odd_texts])))
    assert {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()} == expected
    assert [r.doc_id for r in token_files.read_tokens(spark, path, 7, 10).collect()] == [7, 10]
    start = 0
    for r in token_files.token_counts(spark, path).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens) == (start, len(expected[r.doc_id]))
        start += r.n_tokens
    empty = token_files.write_tokens(no_docs, str(tmp_path / "none"), tokens.standard_tokenizer())
    assert token_files.token_counts(spark, empty).count() == 0


def test_token_files_are_encoded_as_told(spark, odd_docs, tmp_path):
    import pyarrow.parquet as pq

    path = token_files.write_tokens(odd_docs, str(tmp_path / "tokens"), tokens.standard_tokenizer())
    found = next(f for f in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(found).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["ids"].has_dictionary_page
    assert columns["ids"].has_column_index and columns["doc_id"].has_offset_index


def check_packing(rows, texts, capacity):
    expected = {i: ids for (i, _), ids in zip(texts, ids_of([t for _, t in texts]))}
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == crc(expected[r.doc_id][r.start : r.start + r.length])
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= capacity
    assert by_doc.keys() == expected.keys()
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
        assert sum(r.length for r in parts) == len(expected[i]) and all(r.length == capacity for r in parts[1:])
    return len(by_sequence)


@pytest.mark.parametrize("block", [20_000, 10])
def test_packing_places_every_piece_once(spark, monkeypatch, odd_docs, odd_texts, no_docs, block):
    monkeypatch.setattr(packing, "BLOCK_PIECES", block)
    rows = packing.pack(packing.pieces(odd_docs, tokens.standard_tokenizer())).collect()
    n = check_packing(rows, odd_texts, packing.LENGTH)
    assert n <= packing.least_bins(np.array([r.length for r in rows]), packing.LENGTH) + 2
    assert packing.pack(packing.pieces(no_docs, tokens.standard_tokenizer())).count() == 0


def made_pieces(spark, n, length):
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.expr(length).cast("long").alias("length"),
        F.col("id").alias("ids_crc32"),
    )


@pytest.mark.parametrize(
    "length", ["pmod(xxhash64(id), 1024) + 1", "300 + pmod(xxhash64(id), 121)", "if(id % 3 = 0, 513, 1 + pmod(xxhash64(id), 700))"]
)
def test_partitions_of_the_real_size_need_no_more_than_one_run(spark, length):
    cut = made_pieces(spark, 60_000, length)
    packed = packing.pack(cut).cache()
    lengths = sorted((r.length for r in packed.select("length").collect()), reverse=True)
    one_run = len(packing.best_fit(lengths, packing.LENGTH)[2])
    sequences, bound = packing.certificate(packed)
    assert bound == packing.least_bins(np.array(lengths), packing.LENGTH)
    assert bound <= sequences <= one_run * 1.0001 + 1
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert held.filter("n <> end OR n > 1024").count() == 0 and held.count() == sequences
    assert packed.select("doc_id").distinct().count() == packed.count() == 60_000


def test_packing_agrees_over_file_splits_and_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 100)
    cut = made_pieces(spark, 400, "1 + pmod(xxhash64(id), 900)")
    odd = cut.filter("doc_id < 30").withColumn("doc_id", F.lit(None).cast("long"))
    big = cut.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") + (1 << 60) + 1)
    cut = cut.union(cut.filter("doc_id < 50")).union(odd).union(big)
    first, again = (sorted(map(tuple, packing.pack(cut.repartition(n)).collect()), key=str) for n in (1, 5))
    assert first == again and len(first) == 485
    assert sum(r[0] is not None and r[0] > 1 << 60 for r in first) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bounds_and_best_fit_enclose_the_optimum(lengths):
    bins, offsets, left = packing.best_fit(sorted(lengths, reverse=True), 12)

    def fits(rest, rooms):
        if not rest:
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                if fits(rest[1:], rooms[:i] + [room - rest[0]] + rooms[i + 1 :]):
                    return True
        return False

    ordered = sorted(lengths, reverse=True)
    optimum = next(n for n in range(1, len(lengths) + 1) if fits(ordered, [12] * n))
    assert packing.least_bins(np.array(lengths), 12) <= optimum <= len(left)


def taken(copies):
    return copies.groupBy("source").agg(F.sum(F.col("size") * F.col("times") * F.col("whole")).alias("taken"))


@pytest.mark.parametrize("block", [20_000, 3])
def test_mix_comes_near_its_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    names = ["b", "a", "B", None, "é", "z"]
    rows = [(i, prose(i, 1 + i % 30), names[min(i % 17, 5)], i) for i in range(200)] + [(500, None, "a", 0), (501, "", "tiny", 0), (502, "w", "tiny", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rest long").repartition(4)
    copies, goals = mixing.mix(df)
    copies = copies.cache()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    expected = brute.mix_targets(sizes)
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in goals.collect()} == {s: (sizes[s], expected[s]) for s in sizes}
    for r in taken(copies).collect():
        assert abs(r.taken - expected[r.source]) <= 30
    assert copies.filter("whole > 3 OR whole < 0").count() == 0 and copies.count() == len(rows)
    again, _ = mixing.mix(df.repartition(7))
    assert again.exceptAll(copies).count() == 0


def test_mix_of_odd_tables(odd_docs, odd_texts, no_docs):
    copies, _ = mixing.mix(odd_docs)
    assert copies.agg(F.sum("times")).first()[0] == len(odd_texts)
    assert mixing.mix(no_docs)[0].count() == 0


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1\r\nx", "<p>a</p>", "b" * 300_000, "\n"]
    rows = [(10 - i, None if i == 2 else f"http://x/{i}", h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = warc.write_archives(df, str(tmp_path / "warc"))
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.record_id, []).append(r)
    for i, h in ((i, h or "") for i, _, h in rows if i is not None):
        largest = max(j for j, _, x in rows if j is not None and (x or "") == h)
        [r] = by_id[f"<urn:page:{i}>"]
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert r.payload_length == str(len(h.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if i == largest else ("revisit", f"<urn:page:{largest}>"))
        assert bytes(r.payload) == (h.encode() if i == largest else b"")
    assert sorted(r.record_type for r in by_id["<urn:page:>"]) == ["response", "revisit"]
    revisits = warc.read_archives(spark, path, payloads=False).filter("record_type = 'revisit'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert revisits.count() == 4 and "record_type" not in plan.split("Filter", 1)[-1].split("BatchScan")[0].replace("isnotnull(record_type", "")
    none = warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    docs = common.read(spark, SF, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    lexicon = toxicity.learn(docs, common.read(spark, SF, "labels"))
    rows = docs.collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if lexicon.score(r.text) < toxicity.THRESHOLD}
    kept = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    similar = brute.similar([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in similar.items() if c == i}
    cut = corpus_pipeline.drop_repeated_passages(spark, kept, SF).cache()
    expected = brute.without_repeats([(r.doc_id, r.text) for r in kept.collect()])
    before = {r.doc_id: r for r in kept.collect()}
    for r in cut.collect():
        if expected[r.doc_id][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id][2] and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]
    assert cut.columns == docs.columns and cut.count() == kept.count()
    mixed = corpus_pipeline.mix_sources(spark, cut, SF).cache()
    copies = {r.doc_id: r.whole for r in mixing.mix(cut)[0].collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    assert packed.agg(F.sum("length")).first()[0] == sum(map(len, ids_of([r.text for r in mixed.collect()])))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    from oracle_check import difference, duck

    actual = queries.queries()[name](spark, SF).toPandas()
    assert difference(actual, duck(SF).execute(queries.oracle_sql()[name]).df()) is None
