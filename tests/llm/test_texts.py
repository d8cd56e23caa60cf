from __future__ import annotations

import functools

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronlens.llm import common, jaccard_join, substring_dedup, tokens, toxicity, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x85 éZ", max_size=30)), max_size=6))
def test_words_are_runs_of_other_bytes(texts):
    found = words.split(pa.array(texts, pa.string()))
    data = found.data.tobytes()
    spans = [data[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist())]
    expected = [brute.words(t) for t in texts]
    assert spans == [w for e in expected for w in e] and found.counts.tolist() == [len(e) for e in expected]
    by_word = {}
    for word, value in zip(spans, found.hashes.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_equal_windows_have_equal_hashes():
    found = words.split(pa.array(["x a b c", "a b c y", "a b"]))
    hashes, first = found.windows(3)
    assert first.tolist() == [0, 1, 4, 5] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 3


def similar(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_sets(df).collect()}


def test_similar_sets_equal_brute_force(odd_docs, odd_texts):
    assert similar(odd_docs) == brute.similar(odd_texts)


def test_similar_sets_of_a_large_group(spark):
    """A chain of edits: members far apart are linked only through those between."""
    draw = np.random.default_rng(5)
    text, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[int(draw.integers(120))] = f"n{i}"
    rows += [(100 + i, " ".join([f"w{k}" for k in range(90)] + [f"z{i}x{k}" for k in range(40 + i)])) for i in range(30)]
    assert similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute.similar(rows)


def test_similar_sets_without_ids_and_repeated_rows(spark, no_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    found = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join.similar_sets(no_docs).count() == 0


def removed(df):
    rows = substring_dedup.remove_repeats(df).withColumn("sha", F.sha2(F.col("kept_text"), 256)).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in rows}


def test_removed_passages_equal_brute_force(odd_docs, odd_texts):
    assert removed(odd_docs) == brute.without_repeats(odd_texts)


def test_repeated_rows_and_rows_without_id_remove_nothing(spark, no_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (None, None), (7, text + " more")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found) == [(0, 0, 0), (0, 60, 0), (5, 60, 0), (5, 60, 0), (7, 61, 60)]
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("width,gram", [(6, 2), (3, 2)])
def test_short_windows(spark, width, gram):
    draw = np.random.default_rng(width)
    rows = [(i, " ".join(map(str, draw.integers(0, 3, int(draw.integers(0, 30)))))) for i in range(40)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width, gram)
    expected = brute.without_repeats(rows, width)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found.collect()} == {i: e[:2] for i, e in expected.items()}


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4)]
    found = {r.node: r.component_id for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folding():
    assert toxicity.fold("You ST0P1D, m0rоn! in 2024") == " you stopid moron in 2024 ".replace("stopid", "stopid")
    assert toxicity.fold(None or "") == "  "


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({"trash": 5.0, "vequ*": 4.0})
    assert lexicon.strength("a trash can here") == 0 and lexicon.strength("") == lexicon.strength(None) == 0
    assert lexicon.strength("such trash") > lexicon.strength("such trash " + "word " * 500) > 0
    assert lexicon.strength("le vequle") > 0 and lexicon.strength("le avequle") == 0
    assert toxicity.Lexicon({}, ()).score("anything") < toxicity.THRESHOLD


@pytest.mark.parametrize("gap,share", [(0.0, 0.1), (0.5, 0.1), (3.0, 0.02), (3.0, 0.5)])
def test_the_curve_is_fitted_also_where_classes_are_apart(gap, share):
    draw = np.random.default_rng(2)
    y = (draw.random(12_000) < share).astype(float)
    x = np.where(y == 1, gap + draw.random(12_000), 0.0)
    bias, slope = toxicity.logistic_fit(x, y)
    assert slope > 1 and abs(bias) < 30
    p = 1 / (1 + np.exp(-(bias + slope * x)))
    assert (p[x > 0.3] > toxicity.THRESHOLD).mean() > 0.9 and p[y == 0].max() < toxicity.THRESHOLD


def test_toxicity_learns_from_training_rows(spark):
    draw = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(1200):
        text = [f"w{x}" for x in draw.integers(0, 300, 40)]
        toxic = int(i % 6 == 0)
        if toxic:
            text[int(draw.integers(40))] = f"gru{draw.integers(1000)}"
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, lexicon, ["doc_id"]).select("row.doc_id", "score").join(labels, "doc_id")
    held = rows.filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(held) > 200 and sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in held) >= 0.95 * len(held)


def test_toxicity_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 2), (4, 0), (4, 1)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        lexicon = toxicity.learn(docs, labels)
        rows = toxicity.score(docs, lexicon).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.row.group == "x" for r in rows)


@pytest.mark.parametrize("kind", ["none", "held out", "balanced", "balanced, one seed"])
def test_the_starting_lexicon_without_evidence(spark, kind):
    texts = [f"w{i} w{i + 1} w{i + 2} and so on" for i in range(40)] + ["you stupid idiot", "you stup1d m0ron over there"]
    if kind == "balanced, one seed":
        texts[1] += " scum"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    free = [i for i in range(1, 40) if i not in held]
    rows = {"none": [], "held out": [(i, i % 2) for i in held]}.get(kind, [(i, n % 2 ^ 1) for n, i in enumerate(free[: len(free) // 2 * 2])])
    lexicon = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert set(toxicity.SEED_TERMS) <= set(lexicon.weights)
    assert all(lexicon.score(t) >= toxicity.THRESHOLD for t in texts[40:])
    if kind != "balanced, one seed":
        assert all(lexicon.score(t) < toxicity.THRESHOLD for t in texts[:40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab1 \n\t.'é　\x85\x1c", max_size=25)), max_size=4))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    tool = tokens.encoder(tokens.standard_tokenizer())
    ids, bounds = tool.encode(texts)
    whole = tool.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [w.ids + [tokens.END] for w in whole]


MARKER = "<|endoftext|>"


@functools.cache
def library():
    """The tokenizer as its file gives it, not the one that the encoder holds."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.standard_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([MARKER, "<|endof", "text|>", "a", "b", " ", "  ", "\n", "\t", "é", "."]), max_size=12).map("".join), max_size=4))
def test_markers_in_texts_have_the_ids_of_the_library(texts):
    whole = [library().encode(t, add_special_tokens=False).ids + [tokens.END] for t in texts]
    ids, bounds = tokens.encoder(tokens.standard_tokenizer()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole


def test_a_marker_is_one_token():
    texts = [f"a {MARKER} b", f"a   {MARKER}b", MARKER * 2, f"x\n\n{MARKER}", "plain text"]
    ids, bounds = tokens.encoder(tokens.standard_tokenizer()).encode(texts)
    found = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert found[0] == [64, 220, 50256, 275, tokens.END] and found[1] == [64, 220, 220, 220, 50256, 65, tokens.END]
    assert found[2] == [50256, 50256, tokens.END] and 50256 not in found[4]


ODD = [" ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\u1680", "\u0085", "\x1c", "\u201cq\u201d", "\u00c2", "\u3042", "\U0001f600", "a", "b", "1", ".", "x" * 70]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(ODD), max_size=14).map("".join), max_size=5))
def test_wide_spaces_and_long_cuts_have_the_ids_of_the_library(texts):
    whole = [library().encode(t or "", add_special_tokens=False).ids + [tokens.END] for t in texts]
    ids, bounds = tokens.encoder(tokens.standard_tokenizer()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole


def odd_words(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i) % 997}{'-' * (i % 5)}" for i in range(n))


def test_forgotten_cuts_are_learned_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    monkeypatch.setattr(tokens, "_RECENT", 50)
    monkeypatch.setattr(tokens, "_BLOCK", 64)
    tool = tokens.Encoder(tokens.standard_tokenizer())
    for seed in range(12):
        texts = [odd_words(seed, 400), "always the the the same", None, odd_words(seed + 1, 30)]
        ids, bounds = tool.encode(texts)
        whole = [library().encode(t or "", add_special_tokens=False).ids + [tokens.END] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole
    tool._drop_rare()
    assert tool.check.size <= 150
    assert (tool._find(*hashes_of(" the")) >= 0).all()


def hashes_of(cut: str):
    data = np.frombuffer(cut.encode(), dtype=np.uint8)
    return words.byte_hashes(data, np.array([0]), np.array([len(data)]))


def test_cuts_of_one_hash_are_told_apart(monkeypatch):
    real = words.byte_hashes

    def crowded(data, starts, ends):
        one, two = real(data, starts, ends)
        return one % np.uint64(5), two

    monkeypatch.setattr(words, "byte_hashes", crowded)
    tool = tokens.Encoder(tokens.standard_tokenizer())
    for seed in range(4):
        texts = [odd_words(seed, 60), "", odd_words(seed + 1, 60)]
        ids, bounds = tool.encode(texts)
        whole = [library().encode(t, add_special_tokens=False).ids + [tokens.END] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole


def test_queries_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op2(spark, SF).collect()}
    assert found == brute.similar(rows)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op7(spark, SF).collect()}
    assert found == brute.without_repeats(rows)
