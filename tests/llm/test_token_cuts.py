"""Words are remembered without the marks after them, and ids stay those of the whole text."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from patronlens.llm import tokens, words

TEXTS = [
    "",
    "a",
    ".",
    "word. word, word! word; word*** (word) word's don't we'll'd 'tis rock'n'roll a.b.c x's'",
    "Größe, été. naïve! ñ, é, word́. é. z​! abc , abc　.",
    "u.s.a.\n.net\n,x\t.y\r\n!z  ..  a  .  b\n\n.c",
    "mail@example.com http://a.b/c?d=e&f=g#h 1.5e10 12,000.00 a1.b2 _x_ __init__ `a` {b} [c] ~d^ \\e|",
    "end.<|endoftext|>next. a<|b",
    "中文, abc。 Абв. \U0001f600a! x\U0001f600.",
]


@pytest.fixture
def encoder():
    return tokens.Encoder(tokens.standard_tokenizer())


def whole(encoder, text):
    return [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END]


def test_ids_are_those_of_whole_texts(encoder):
    draw = np.random.default_rng(4)
    letters = list("abZ  '.,!s1\n\té　<|>-") + ["'ll", "'t", " the"]
    texts = TEXTS + ["".join(draw.choice(letters, draw.integers(0, 40))) for _ in range(2000)]
    ids, bounds = encoder.encode(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == whole(encoder, text), repr(text)


def test_a_word_is_learned_once_whatever_mark_follows(encoder):
    words = ["alpha", "beta", "gamma", "delta"]
    text = " ".join(w + mark for mark in ("", ".", ",", "!", "?", ";", "***") for w in words)
    ids, _ = encoder.encode([text])
    assert ids.tolist() == whole(encoder, text)
    assert encoder.check.size <= 1 + len(words) + 6  # the first word has no space before it


def test_memory_of_encoding_does_not_follow_the_batch():
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(40_000)}" for _ in range(2_000)) for _ in range(150)]
    batch = pa.array(texts)
    tokens.forget_encoders()
    tokens.encoder(tokens.standard_tokenizer())
    tracemalloc.start()
    try:
        found = [ids.tolist()[:5] for _, ids, _ in tokens.encoded_slices(batch, tokens.standard_tokenizer())]
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(found) > 1 and batch.nbytes > 1_500_000
    assert peak < 60 << 20


def test_powers_of_hashes_take_little_more_room_than_the_longest_slice():
    powers = words._Polynomial(0x5851F42D4C957F2D)
    values = np.arange(1 << 16, dtype=np.uint64)
    for n in (1 << 15, 1 << 16):
        powers.ranges(values[:n], np.array([0]), np.array([n]))
    powers.ranges(np.arange((1 << 16) + 9, dtype=np.uint64), np.array([0]), np.array([9]))
    assert len(powers._up) <= 1.2 * (1 << 16)
