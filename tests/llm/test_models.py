from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import brute
import numpy as np
import pytest
from conftest import SF, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronlens.llm import centroids, hidden_markov, infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill in middle --------------------------------------------------------------------------


def infilled(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


@pytest.mark.parametrize("frame", [infill.FRAME_BYTES, 7])
def test_outputs_equal_the_definition(spark, monkeypatch, odd_texts, frame):
    rows = [(i, t) for i, t in odd_texts if frame > 7 or len(t or "") < 5_000]
    rows += [(1000 + i, "a <P> b c" if i % 2 else "<S" + "> x y <M> z") for i in range(6)]
    rows += [(2000 + i, "x" * 300 + " é" * 40 + "\n \t") for i in range(12)] + [(3000 + i, "< <P <S M> P>< <M") for i in range(9)]
    rows += [(None, "a b c"), (None, None), (1, odd_texts[0][1]), (4000, "\x85a\x1cb  ")]
    # tiny frames through the functions that the tables use: what workers run can't be patched from here
    found = []
    for i, t in rows:
        text = (t or "").encode()
        stored = infill.Seekable(*infill.pack(text, frame))
        marks = any(m in text for m in (b"<P>", b"<S>", b"<M>"))
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        n, form, prefix, middle, frames = infill.infilled(stored, [int(h[8 * k : 8 * k + 8], 16) for k in range(4)], marks)
        output = b"".join(infill.streamed(frames)).decode()
        assert b"".join(infill.restored(frames, form)) == text
        found.append((n, form, prefix, middle, output))
    assert found == [infilled(i, t) for i, t in rows]
    if frame > 7:
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("frames", F.lit(1)).withColumn("n", F.lit("x"))
        got = infill.digests(infill.transform(infill.frames(df.repartition(3)))).collect()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected = [(i, *infilled(i, t)[:4], sha(infilled(i, t)[4]), sha(t or "")) for i, t in rows]
        assert Counter(map(tuple, got)) == Counter(expected)
        assert infill.digests(infill.transform(infill.frames(df.limit(0)))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \t\n<PSM>é 😀", max_size=60), st.integers(1, 9), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_seekable_texts_round_trip(text, size, drawn):
    raw = text.encode()
    units, chars, frames = infill.pack(raw, size)
    assert b"".join(infill.streamed(frames)) == raw
    assert units[-1] == len(UNIT.findall(text)) and chars[-1] == len(text)
    stored, ends = infill.Seekable(units, chars, frames), list(itertools.accumulate(map(len, UNIT.findall(text))))
    for k, end in enumerate(ends, 1):
        frame, at, before = stored.after(k)
        lengths = [len(p) for p in infill.streamed(frames)]
        assert sum(lengths[:frame]) + at == len(text[:end].encode()) and before == end
    marked = any(m in text for m in ("<P>", "<S>", "<M>"))
    form, out = infill.infilled(stored, drawn, marked)[1::3]
    assert b"".join(infill.restored(out, form)) == raw


def test_cuts_decompress_their_frames_only(monkeypatch):
    raw = prose(3, 30_000).encode()
    stored = infill.Seekable(*infill.pack(raw, 4096))
    opened = []
    unpack = stored._decompress
    monkeypatch.setattr(stored, "_decompress", lambda f: opened.append(f) or unpack(f))
    form, frames = infill.infilled(stored, [11_000, 22_000, 0, 0], False)[1::3]
    assert form == "spm" and len(opened) <= 4 and len(stored.frames) > 30
    assert len(set(frames) & set(stored.frames)) >= len(stored.frames) - 2  # the others are passed on as they are


# --- centroids -------------------------------------------------------------------------------


def clustered(rows, clusters=8, rounds=10, dim=64):
    """{vec_id: (cluster, distance, cluster_inertia, inertia, sha)} in Python integers."""
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cents = [v for _, v in sorted(ok, key=lambda r: (sha(f"3:{r[0]}"), r[1]))[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        held = [[] for _ in cents]
        for _, v in ok:
            held[near(v)[1]].append(v)
        cents = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, cents)]
    found = [(i, *near(v)) for i, v in ok]
    per = Counter()
    for _, d, k in found:
        per[k] += d
    total = sum(per.values())
    return sorted((i, k, d, per[k], total, sha(",".join(map(str, cents[k])))) for i, d, k in found)


def float_rows(n, seed=4):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(6, 64))
    return [(i, np.float32(base[i % 6] + draw.normal(scale=0.4, size=64)).tolist()) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, cluster int, v int"


def test_clusters_equal_integer_arithmetic(spark):
    rows = float_rows(90)
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(7, rows[8][1]), (300, [0.0] * 64), (301, [0.0] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [float("nan")] + [1.0] * 63), (405, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS).repartition(3)
    whole = centroids.whole_vectors(df).cache()
    found = sorted(tuple(r) for r in centroids.assign(whole, centroids.fit(whole)).collect())
    assert found == clustered(rows)


def test_few_or_no_vectors(spark):
    rows = float_rows(3)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)
    whole = centroids.whole_vectors(df)
    assert sorted(tuple(r) for r in centroids.assign(whole, centroids.fit(whole)).collect()) == clustered(rows)
    empty = centroids.whole_vectors(df.limit(0))
    assert centroids.fit(empty) == [] and centroids.assign(empty, []).count() == 0
    without_id = centroids.whole_vectors(spark.createDataFrame([(None, rows[0][1], 1, 2), (5, rows[1][1], 1, 2)], VECTORS))
    assert centroids.first_centroids(without_id) == [[math.floor(1024 * x) for x in rows[k][1]] for k in (1, 0)]


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63, 1, 2)], VECTORS)
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.whole_vectors(df).collect()


def test_rounds_run_without_python(spark):
    whole = centroids.whole_vectors(spark.createDataFrame([(i, v, 1, 2) for i, v in float_rows(20)], VECTORS))
    plan = whole.select(centroids.nearest([[0] * 64, [1] * 64]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "zip_with" in plan.lower()


# --- hidden Markov model ---------------------------------------------------------------------


def small_model(states=3, symbols=6, seed=2):
    draw = np.random.default_rng(seed)
    rows = lambda *shape: draw.dirichlet(np.ones(shape[-1]), shape[:-1])
    emits = np.zeros((hidden_markov.SYMBOLS, states))
    emits[:symbols] = rows(states, symbols).T
    none = np.zeros(0)
    return hidden_markov.Model(none, none, none, none, 1, 1, rows(states), rows(states), rows(states, states), emits)


def by_paths(seq, model, start):
    """Likelihood, and expected symbols, moves and first states, summed over all state paths."""
    states = range(len(start))
    total, emits, moves, first = 0.0, Counter(), Counter(), Counter()
    for path in itertools.product(states, repeat=len(seq)):
        p = start[path[0]] * math.prod(model.emits[s, k] for s, k in zip(seq, path))
        p *= math.prod(model.moves[a, b] for a, b in zip(path, path[1:]))
        total += p
        first[path[0]] += p
        for s, k in zip(seq, path):
            emits[s, k] += p
        for pair in zip(path, path[1:]):
            moves[pair] += p
    scaled = lambda c: {k: v / total for k, v in c.items()}
    return total, scaled(emits), scaled(moves), scaled(first)


def test_recursions_equal_sums_over_all_paths(monkeypatch):
    monkeypatch.setattr(hidden_markov, "STRETCH", 4)
    model, draw = small_model(), np.random.default_rng(5)
    sizes = [1, 6, 3, 4, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    seq = draw.integers(0, 6, bounds[-1])
    docs = [seq[a:b] for a, b in zip(bounds, bounds[1:])]
    expected = [math.log10(by_paths(d, model, model.start)[0]) for d in docs]
    for long, width in ((100, 4), (2, 2), (0, 3)):
        assert np.allclose(hidden_markov.likelihoods(seq, bounds, model, long, width), expected)
    total = {"emits": np.zeros((hidden_markov.SYMBOLS, 3)), "moves": np.zeros((3, 3)), "start": np.zeros(3), "later": np.zeros(3)}
    hidden_markov.expected_counts(seq, bounds, model, total)
    emits, moves, start, later = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for d in docs:
        for at in range(0, len(d), 4):
            _, e, m, f = by_paths(d[at : at + 4], model, model.start if at == 0 else model.later)
            for k, v in e.items():
                emits[k] += v
            for k, v in m.items():
                moves[k] += v
            for k, v in f.items():
                (start if at == 0 else later)[k] += v
    for name, wanted in (("moves", moves), ("start", start), ("later", later)):
        assert np.allclose(total[name], wanted, rtol=1e-4, atol=1e-5)
    assert np.allclose(total["emits"][:6], emits, rtol=1e-4, atol=1e-5)


def tokens(text):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*brute.WORD.findall(lowered), b" "]


def unigram(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {
        i: (len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for i, t in rows
        for ws in [tokens(t)]
    }


def crc_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scored(docs, held=None, **of):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2 if held is None else held
    model, blocks = hidden_markov.language_model(docs, held, **of)
    return model, {r.doc_id: r for r in hidden_markov.score(blocks, model).collect()}


def test_one_state_is_the_unigram_model(odd_docs, odd_texts):
    n, expected = unigram(odd_texts, crc_held)
    model, found = scored(odd_docs, states=1, rounds=2)
    assert model.train_tokens == n and set(found) == set(expected)
    for i, (size, known, base) in expected.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (crc_held(i), size, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, base, rel_tol=1e-5)


def test_model_is_a_distribution_and_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = -math.inf
    for rounds in (0, 1, 3):
        model, found = scored(docs, rounds=rounds)
        assert np.allclose(model.emits.sum(0), 1) and np.allclose(model.moves.sum(1), 1) and math.isclose(model.start.sum(), 1)
        now = sum(r.score for r in found.values() if not r.held_out)
        assert now > last
        last = now
    again = scored(docs.repartition(5), rounds=3)[1]
    assert all(math.isclose(again[i].score, r.score, rel_tol=1e-3) for i, r in found.items())


def test_language_model_of_odd_tables(spark, no_docs):
    assert scored(no_docs)[1] == {}
    rows = [(2, "a b"), (2, "a b"), (None, "a c"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit("x")).withColumn("block", F.lit(1))
    model, blocks = hidden_markov.language_model(df, F.lit(False))
    found = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in hidden_markov.score(blocks, model).collect())
    assert found == [(0, 3, 3), (2, 3, 3), (2, 3, 3), (5, 1, 1), (6, 1, 1)] and model.train_tokens == 11
    _, unseen = scored(df.filter("doc_id > 4"), F.lit(True))
    assert {(r.n_known, r.base_score, r.score) for r in unseen.values()} == {(0, 0.0, 0.0)}


def test_registered_model_beats_the_unigram(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, expected = unigram(docs, crc_held)
    rows = hidden_markov.op13(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(expected)
    for r in rows:
        size, known, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc_held(r.doc_id), size, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_emissions_keep_the_unseen_alike():
    model = replace(small_model(), types=np.arange(hidden_markov.SYMBOLS) % 3 + 1.0)
    expected = np.random.default_rng(1).random((hidden_markov.SYMBOLS, 3)) * 50
    expected[hidden_markov.UNSEEN] = 0
    emits = hidden_markov._emissions(expected, model)
    assert np.allclose(emits.sum(0), 1)
    assert np.allclose(emits[hidden_markov.UNSEEN], 1 / (expected.sum() + model.types.sum()))
