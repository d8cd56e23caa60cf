"""A hidden Markov language model of whole documents.

Tokens are the lower-cased words of a document and one end. Every document is encoded once
in blocks of an Arrow batch: a list of the block's distinct words and a code per token. The
counts of all training words are aggregated from the lists and joined back to them; the
most frequent words, which every block holds, are looked up without a shuffle.

A latent state emits a symbol: an own one for each of the OWN_WORDS most frequent training
words and for the end, one for each class of other words (by their last two bytes), and one
for words never seen in training. A word of a class then has its add-one share of the
class. With the add-one mass of each symbol in every state, a model of one state is the
add-one unigram model exactly, and an unseen word has the same probability in all states.

Baum-Welch: each round is one pass over the stored symbols of the training documents. A
task runs the scaled forward and backward recursions on all its stretches at once and
yields its expected counts; Spark adds them up (in whole 2**-20, so that any order gives
the same model) and the driver takes one row per symbol. A training sequence is a stretch of at
most STRETCH tokens; later stretches of a document start from a distribution of their own.

Scores are exact likelihoods of whole documents by the scaled forward recursion. A document
longer than LONG tokens is cut in stretches whose transfer matrices are computed side by
side and multiplied in order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import words
from patronlens.llm.common import arrow_pass, read, stash, text_rows

STATES, ROUNDS, SEED = 8, 6, 13
OWN_WORDS, CLASSES = 16_384, 512
STRETCH, LONG = 256, 4_096
END_HASH = np.uint64(0x656E64)  # stands for the end among the hashes of words
UNSEEN, END, FIRST_OWN = 0, 1, 2
FIRST_CLASS = FIRST_OWN + OWN_WORDS
SYMBOLS = FIRST_CLASS + CLASSES
_UNIT = float(1 << 20)
# rows of expected counts besides those of symbols
_STARTS, _LATER, _TRANSITIONS = -1, -2, -3
_ENCODED = (
    "block long, doc_ids array<long>, held array<boolean>, bounds array<long>, codes binary, "
    "hashes array<long>, endings array<int>, trained array<long>"
)
_SYMBOLS = (
    "block long, doc_ids array<long>, held array<boolean>, bounds array<long>, symbols binary, "
    "known array<long>, base array<double>, shares array<double>"
)
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


# --- tokens ----------------------------------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    """Whole numbers compressed plane by plane of their bytes; most high bytes of frequency ranks are 0."""
    import zstandard

    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def _unpacked(data: pa.Scalar, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, the end after each text, and the bounds of the texts."""
    hashes, endings, counts = [], [], []
    for _, part in words.chunks(texts):
        found = words.split(part, lower=True)
        last = words._FOLDED[found.data[found.ends - 1]].astype(np.int64)
        before = np.where(found.ends - found.starts > 1, words._FOLDED[found.data[np.maximum(found.ends - 2, 0)]], 0)
        at = found.bounds[1:]
        hashes.append(np.insert(found.hashes, at, END_HASH))
        endings.append(np.insert((last * 257 + before) * 40_503 % 65_521 % CLASSES, at, 0))
        counts.append(found.counts + 1)
    none = np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))])
    return np.concatenate([none.astype(np.uint64), *hashes]), np.concatenate([none, *endings]), bounds


def encode(docs: DataFrame, held_out: Column) -> DataFrame:
    """Blocks of whole documents: token codes, and of each distinct word hash, class and count in training.

    ``held_out`` is a condition on ``doc_id``; where it is null the document is for training.
    """

    def build(batch: pa.RecordBatch):
        if not len(batch):
            return
        hashes, endings, bounds = _tokens(batch.column("text"))
        distinct, first, codes, uses = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        frequent = np.argsort(-uses, kind="stable")  # small codes for frequent words
        distinct, first, codes = distinct[frequent], first[frequent], np.argsort(frequent)[codes]
        held = batch.column("held").to_numpy(zero_copy_only=False)
        trained = np.bincount(codes[np.repeat(~held, np.diff(bounds))], minlength=len(distinct))
        yield {
            "block": pa.array([batch.column("block")[0].as_py()], pa.int64()),
            "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "held": pa.array([held], pa.list_(pa.bool_())),
            "bounds": pa.array([bounds.astype(np.int64)], pa.list_(pa.int64())),
            "codes": pa.array([_packed(codes.astype("<u4"))], pa.binary()),
            "hashes": pa.array([distinct.view(np.int64)], pa.list_(pa.int64())),
            "endings": pa.array([endings[first].astype(np.int32)], pa.list_(pa.int32())),
            "trained": pa.array([trained.astype(np.int64)], pa.list_(pa.int64())),
        }

    rows = text_rows(docs).select(
        F.monotonically_increasing_id().alias("block"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text"
    )
    return arrow_pass(rows, build, _ENCODED)


def _entries(encoded: DataFrame) -> DataFrame:
    """A row for each distinct word of each block, with its place in the block's list."""
    listed = F.arrays_zip(F.col("hashes").alias("hash"), F.col("endings").alias("ending"), F.col("trained").alias("trained"))
    return encoded.select("block", F.posexplode(listed).alias("at", "word")).select("block", "at", "word.*")


def vocabulary(encoded: DataFrame) -> DataFrame:
    """hash, class and count of every training word, the end among them."""
    seen = _entries(encoded).filter("trained > 0")
    return seen.groupBy("hash").agg(F.max("ending").alias("ending"), F.sum("trained").alias("count"))


# --- the model -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Bounded in size: own words, per symbol training tokens and distinct words, and the latent states."""

    own: np.ndarray  # hashes of own words, ascending
    own_counts: np.ndarray
    tokens: np.ndarray  # of each symbol, in training
    types: np.ndarray  # distinct words of each symbol; one for the unseen
    train_tokens: int
    train_words: int
    start: np.ndarray
    later: np.ndarray  # of a stretch that isn't a document's first
    moves: np.ndarray
    emits: np.ndarray  # symbols x states

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each own word, -1 for other words."""
        if not len(self.own):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, at, -1)


def _share(expected: np.ndarray) -> np.ndarray:
    """Of each state among all tokens; never quite none."""
    return np.maximum(expected.sum(0) / expected.sum(), 1e-9)


def _emissions(expected: np.ndarray, model: Model) -> np.ndarray:
    """Symbols x states: expected counts plus the add-one mass, dealt to the states by their share."""
    share = _share(expected)
    mass = expected + model.types[:, None] * share
    return mass / (expected.sum(0) + model.types.sum() * share)


def initial(vocab: DataFrame, states: int = STATES, seed: int = SEED) -> Model:
    """The symbols of a stored vocabulary, and states that differ by seeded factors."""
    totals = vocab.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens")).first()
    end = int(END_HASH)
    others = vocab.filter(F.col("hash") != end)
    top = others.orderBy(F.desc("count"), "hash").limit(OWN_WORDS).collect()
    classes = others.groupBy("ending").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("tokens")).collect()
    ends = vocab.filter(F.col("hash") == end).select("count").collect()
    own = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["count"] for r in top], np.int64)
    tokens, types = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    types[UNSEEN] = 1
    if ends:
        tokens[END], types[END] = ends[0]["count"], 1
    for r in classes:
        tokens[FIRST_CLASS + r["ending"]], types[FIRST_CLASS + r["ending"]] = r["tokens"], r["n"]
    np.subtract.at(tokens, [FIRST_CLASS + r["ending"] for r in top], counts)
    np.subtract.at(types, [FIRST_CLASS + r["ending"] for r in top], 1)
    order = np.argsort(own)
    tokens[FIRST_OWN : FIRST_OWN + len(own)], types[FIRST_OWN : FIRST_OWN + len(own)] = counts[order], 1
    even, draw = np.full(states, 1 / states), np.random.default_rng(seed)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    model = Model(own[order], counts[order], tokens, types, int(totals.tokens), totals.n, even, even, moves, np.zeros(0))
    emits = (tokens + types)[:, None] * np.exp(draw.normal(size=(SYMBOLS, states)))
    return replace(model, emits=emits / emits.sum(0))


def symbols(encoded: DataFrame, vocab: DataFrame, model: Model) -> DataFrame:
    """The blocks with a symbol for each token, and per document known tokens and two sums of logarithms.

    ``base`` is the add-one unigram score, ``shares`` what words of classes have of their class.
    """
    session = encoded.sparkSession
    own = session.createDataFrame([(int(h),) for h in model.own.view(np.int64)], "hash long")
    counted = (
        _entries(encoded.select("block", "hashes", "endings", "trained"))
        .select("block", "at", "hash")
        .join(F.broadcast(own), "hash", "left_anti")  # at most OWN_WORDS rows
        .join(vocab.select("hash", "count"), "hash")
    )
    lists = counted.groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("found"))
    joined = encoded.drop("trained").join(
        lists.select(F.col("block").alias("of"), F.col("found.at").alias("ats"), F.col("found.count").alias("counts")),
        F.col("block") == F.col("of"),
        "left",
    ).drop("of")

    def build(batch: pa.RecordBatch):
        for row in range(len(batch)):
            part = {c: batch.column(c).slice(row, 1) for c in batch.schema.names}
            hashes, endings, bounds, ats, counts = (
                np.asarray(part[c].flatten()) for c in ("hashes", "endings", "bounds", "ats", "counts")
            )
            codes = _unpacked(part["codes"][0], "<u4")
            number, count = model.lookup(hashes.view(np.uint64)), np.zeros(len(hashes), np.int64)
            count[ats] = counts
            if len(model.own):
                count = np.where(number >= 0, model.own_counts[number], count)
            symbol = np.where(number >= 0, FIRST_OWN + number, np.where(count > 0, FIRST_CLASS + endings, UNSEEN))
            is_end = hashes.view(np.uint64) == END_HASH
            symbol[is_end & (count > 0)] = END
            plus_one = np.log10(count + 1.0)
            of_class = symbol >= FIRST_CLASS
            share = np.where(of_class, plus_one - np.log10(np.maximum((model.tokens + model.types)[symbol], 1)), 0.0)
            starts, sizes = bounds[:-1], np.diff(bounds)
            scale = np.log10(model.train_tokens + model.train_words + 1)
            yield {c: part[c] for c in ("block", "doc_ids", "held", "bounds")} | {
                "symbols": pa.array([_packed(symbol.astype("<u2")[codes])], pa.binary()),
                "known": pa.array([np.add.reduceat((count > 0)[codes].astype(np.int64), starts)], pa.list_(pa.int64())),
                "base": pa.array([np.add.reduceat(plus_one[codes], starts) - sizes * scale], pa.list_(pa.float64())),
                "shares": pa.array([np.add.reduceat(share[codes], starts)], pa.list_(pa.float64())),
            }

    return arrow_pass(joined, build, _SYMBOLS)


# --- recursions ------------------------------------------------------------------------------

@dataclass
class Stretches:
    """Runs of tokens, longest first, laid out step by step: all first tokens, all second ones, and so on."""

    starts: np.ndarray
    sizes: np.ndarray
    order: np.ndarray  # which of the given runs each one is

    @classmethod
    def of(cls, starts: np.ndarray, sizes: np.ndarray) -> Stretches:
        order = np.argsort(-sizes, kind="stable")
        return cls(starts[order], sizes[order], order)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """How many runs are longer than t, for each t, and where step t begins in the layout."""
        longest = int(self.sizes[0]) if len(self.sizes) else 0
        active = np.searchsorted(-self.sizes, -np.arange(longest), "left")
        return active, np.concatenate([[0], np.cumsum(active)])

    def laid_out(self, values: np.ndarray) -> np.ndarray:
        active, _ = self.steps()
        return np.concatenate([values[self.starts[:n] + t] for t, n in enumerate(active)]) if len(active) else values[:0]


def cut(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of stretches of at most ``width`` tokens, and the document of each."""
    pieces = -(-np.diff(bounds) // width)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    starts = bounds[doc] + width * words.expand(np.zeros(len(pieces), np.int64), pieces)
    return starts, np.minimum(width, bounds[doc + 1] - starts), doc


def forward(symbol: np.ndarray, runs: Stretches, priors: np.ndarray, moves: np.ndarray, emits: np.ndarray):
    """State weights after each run (in the runs' order) and log10 of the likelihood scaled out of them."""
    active, at = runs.steps()
    laid = runs.laid_out(symbol)
    last, logs = np.array(priors, dtype=np.float64), np.zeros(len(priors))
    weights = last
    for t, n in enumerate(active):
        emitted = emits[laid[at[t] : at[t + 1]]]
        weights = (weights[:n] if t == 0 else weights[:n] @ moves) * emitted
        scale = weights.sum(1)
        weights = weights / scale[:, None]
        logs[:n] += np.log10(scale)
        last[:n] = weights
    return last, logs


def expected_counts(symbol: np.ndarray, bounds: np.ndarray, model: Model, total: dict) -> None:
    """Add the expected counts of the documents between ``bounds`` to ``total``."""
    starts, sizes, doc = cut(bounds, STRETCH)
    if not len(starts):
        return
    runs = Stretches.of(starts, sizes)
    active, at = runs.steps()
    laid = runs.laid_out(symbol)
    first = (starts == bounds[doc])[runs.order]
    moves, emits = model.moves.astype(np.float32), model.emits.astype(np.float32)
    states = moves.shape[0]
    held, scales = np.empty((len(laid), states), np.float32), np.empty((len(laid), 1), np.float32)
    weights = np.where(first[:, None], model.start, model.later).astype(np.float32)
    for t, n in enumerate(active):
        here = slice(at[t], at[t + 1])
        weights = (weights[:n] if t == 0 else weights[:n] @ moves) * emits[laid[here]]
        scales[here] = weights.sum(1, keepdims=True)
        weights /= scales[here]
        held[here] = weights
    back, turned = np.ones((active[-1], states), np.float32), np.ascontiguousarray(moves.T)
    moved = np.zeros((states, states))
    for t in range(len(active) - 2, -1, -1):
        n, here = active[t + 1], slice(at[t + 1], at[t + 2])
        ahead = emits[laid[here]] * back / scales[here]
        held[here] *= back
        before = slice(at[t], at[t] + n)
        moved += held[before].T @ ahead
        back = np.ones((active[t], states), np.float32)
        back[:n] = ahead @ turned
    held[: at[1]] *= back
    total["moves"] += moved * model.moves
    total["start"] += held[: at[1]][first].sum(0, dtype=np.float64)
    total["later"] += held[: at[1]][~first].sum(0, dtype=np.float64)
    for k in range(states):
        total["emits"][:, k] += np.bincount(laid, weights=held[:, k], minlength=SYMBOLS)


def _round(model: Model):
    """A task's expected counts: a row for each symbol, each state's moves and the starts."""
    states = len(model.start)

    def run(batches):
        total = {"emits": np.zeros((SYMBOLS, states)), "moves": np.zeros((states, states))}
        total |= {"start": np.zeros(states), "later": np.zeros(states)}
        for batch in batches:
            for row in range(len(batch)):
                symbol = _unpacked(batch.column("symbols")[row], "<u2")
                bounds = np.asarray(batch.column("bounds").slice(row, 1).flatten())
                train = ~batch.column("held").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                kept = symbol[np.repeat(train, np.diff(bounds))]
                expected_counts(kept, np.concatenate([[0], np.cumsum(np.diff(bounds)[train])]), model, total)
        seen = np.flatnonzero(total["emits"].sum(1))
        names = np.concatenate([seen, [_STARTS, _LATER], _TRANSITIONS - np.arange(states)]).astype(np.int32)
        counts = np.vstack([total["emits"][seen], total["start"], total["later"], total["moves"]])
        whole = np.rint(counts * _UNIT).astype(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), states).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(names), lists], names=["symbol", "counts"])

    return run


def train(blocks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``rounds`` rounds of Baum-Welch over the training documents of stored blocks of symbols."""
    states = len(model.start)
    passed = blocks.select("held", "bounds", "symbols")
    for _ in range(rounds if model.train_tokens else 0):
        counted = passed.mapInArrow(_round(model), "symbol int, counts array<long>")
        sums = [F.sum(F.col("counts")[k]).alias(f"s{k}") for k in range(states)]
        rows = counted.groupBy("symbol").agg(*sums).collect()  # at most SYMBOLS + states + 2
        names = np.array([r[0] for r in rows])
        counts = np.array([r[1:] for r in rows], np.float64) / _UNIT
        expected = np.zeros((SYMBOLS, states))
        expected[names[names >= 0]] = counts[names >= 0]
        share = _share(expected)
        of = {int(n): c + 0.1 * share for n, c in zip(names, counts) if n < 0}
        moves = np.array([of[_TRANSITIONS - k] for k in range(states)])
        model = replace(
            model,
            start=of[_STARTS] / of[_STARTS].sum(),
            later=of[_LATER] / of[_LATER].sum(),
            moves=moves / moves.sum(1, keepdims=True),
            emits=_emissions(expected, model),
        )
    return model


def likelihoods(symbol: np.ndarray, bounds: np.ndarray, model: Model, long: int = LONG, width: int = STRETCH) -> np.ndarray:
    """log10 likelihood of the symbols of each document; exact, however long."""
    states, sizes = len(model.start), np.diff(bounds)
    out = np.zeros(len(sizes))
    short = np.flatnonzero(sizes <= long)
    runs = Stretches.of(bounds[short], sizes[short])
    out[short[runs.order]] = forward(symbol, runs, np.tile(model.start, (len(short), 1)), model.moves, model.emits)[1]
    for i in np.flatnonzero(sizes > long):
        starts, lengths, _ = cut(bounds[i : i + 2], width)
        # a run for each stretch and state before it
        runs = Stretches.of(np.repeat(starts, states), np.repeat(lengths, states))
        from_state = runs.order % states
        last, logs = forward(symbol, runs, model.moves[from_state], model.moves, model.emits)
        matrices, scales = np.empty_like(last), np.empty_like(logs)
        matrices[runs.order], scales[runs.order] = last, logs
        lead = Stretches.of(starts[:1], lengths[:1])
        weights, logged = forward(symbol, lead, model.start[None], model.moves, model.emits)
        weights, total = weights[0], logged[0]
        for k in range(1, len(starts)):
            rows = slice(k * states, (k + 1) * states)
            with np.errstate(divide="ignore"):
                parts = np.log10(weights) + scales[rows]
            most = parts.max()
            weights = (10.0 ** (parts - most)) @ matrices[rows]
            total += most + np.log10(weights.sum())
            weights /= weights.sum()
        out[i] = total
    return out


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score (log10 likelihood) of every document.

    A null text counts as empty and has the end only; rows that repeat an id are scored each;
    without training documents every token is unseen, with probability 1; an empty table
    gives no rows.
    """

    def build(batch: pa.RecordBatch):
        for row in range(len(batch)):
            part = {c: batch.column(c).slice(row, 1).flatten() for c in ("doc_ids", "held", "bounds", "known", "base", "shares")}
            bounds = np.asarray(part["bounds"])
            symbol = _unpacked(batch.column("symbols")[row], "<u2")
            yield {
                "doc_id": part["doc_ids"],
                "held_out": part["held"],
                "n_tokens": np.diff(bounds),
                "n_known": part["known"],
                "base_score": part["base"],
                "score": likelihoods(symbol, bounds, model) + np.asarray(part["shares"]),
            }

    return arrow_pass(blocks, build, _SCORES)


def language_model(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model of the documents that are not held out, and the stored blocks of all to be scored."""
    encoded = stash(encode(docs, held_out), "encoded")
    vocab = stash(vocabulary(encoded), "vocabulary")
    model = initial(vocab, states)
    blocks = stash(symbols(encoded, vocab, model), "symbols")
    return train(blocks, model, rounds), blocks


def op13(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model, blocks = language_model(read(spark, folder, "documents"), held_out)
    return score(blocks, model).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
