"""Token ids of whole texts by a public tokenizer, in Arrow batches.

The byte-level tokenizer first splits a text into pieces and never joins pieces across
white space that is followed by something else, nor a letter and a punctuation mark after
it. So texts are cut there (at ASCII letters and marks only, which bytes tell), and each distinct
cut is encoded once and remembered; the ids are those of the whole text. Cuts are found,
hashed and looked up as arrays of whole slices; only those not yet known become strings.

A remembered cut is known by two 64-bit hashes of its at most 64 bytes. Longer cuts, and
those whose first hash is that of another cut, go to the library each time. So do texts
with strings of the tokenizer's added tokens, whole: they become those tokens there.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from patronlens.llm import words
from patronlens.llm.common import give_back

END = 2
LONGEST = 64  # bytes of a cut that is remembered
REMEMBERED = 1_500_000  # cuts a Python worker keeps, about 60 bytes each; those that recur stay longest
_RECENT = 100_000  # cuts in the small table of new ones
_BLOCK = 1 << 18  # cuts handled at a time
_TOGETHER = 256
_encoders: dict[str, Encoder] = {}

# what a byte after a space or line end says: 0 white space or control, 1 something else, 2 the next bytes decide
_AFTER = np.ones(256, dtype=np.uint8)
_AFTER[:0x21] = 0
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
# a mark after a letter starts a piece: no piece that holds the letter can take it in
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_MARK[0x30:0x3A] = False
_WIDE_SPACES = [
    int.from_bytes(chr(c).encode())
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


class _Column:
    """Values in room that grows by a quarter, as both rooms are held while it does."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1 << 10, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(end + (end >> 2), self.room.dtype)
            room[: self.size] = self.held
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]


def _cut_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where cuts start: at texts that are not empty, at spaces and line ends before something else, at marks after letters."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~first[at + 1]]
    after = _AFTER[data[at + 1]]
    unsure = at[after == 2]
    lead = data[unsure + 1].astype(np.int64)
    # a lead byte has its next bytes in the same text: one after 0xC2, two after the others
    code = (lead << 8) | data[unsure + 2]
    code = np.where(lead == 0xC2, code, (code << 8) | data[np.minimum(unsure + 3, len(data) - 1)])
    first[at[after == 1]] = True
    first[unsure[~np.isin(code, _WIDE_SPACES)]] = True
    first[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    return np.flatnonzero(first[:-1])


class Encoder:
    """Encodes texts with one tokenizer file; cuts that occur again are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.markers = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        [self.line_end] = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.new = none, none  # sorted first hashes and the numbers of their cuts
        # by number of the cut
        self.check, self.uses = _Column(np.uint64), _Column(np.int64)
        self.ids, self.bounds = _Column(np.uint32), _Column(np.int64)
        self.bounds.add(np.zeros(1, np.int64))

    def _drop_rare(self) -> None:
        """Forget the cuts that were not used again since the last time, and the rarer half if too many are left."""
        uses = self.uses.held // 2
        keep = uses > 0
        if keep.sum() > REMEMBERED // 2:
            keep = np.zeros(len(uses), dtype=bool)
            keep[np.argpartition(uses, -(REMEMBERED // 2))[-(REMEMBERED // 2) :]] = True
        check, ids, bounds, (keys, numbers) = self.check.held, self.ids.held, self.bounds.held, self._merged()
        lengths = np.diff(bounds)[keep]
        self.forget()
        self.check.add(check[keep])
        self.uses.add(uses[keep])
        self.ids.add(ids[words.expand(bounds[:-1][keep], lengths)])
        self.bounds.add(np.cumsum(lengths))
        left = keep[numbers]
        self.old = keys[left], (np.cumsum(keep) - 1)[numbers[left]].astype(np.int32)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        (keys, numbers), (new_keys, new_numbers) = self.old, self.new
        at = np.searchsorted(keys, new_keys)
        return np.insert(keys, at, new_keys), np.insert(numbers, at, new_numbers)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of cuts by their hashes, -1 where they are not known."""
        found = np.full(len(first), -1, dtype=np.int64)
        for keys, numbers in (self.old, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                hit = keys[at] == first
                found[hit] = numbers[at[hit]]
        known = found >= 0
        found[known] = np.where(self.check.held[found[known]] == second[known], found[known], -1)
        return found

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _learn(self, cuts: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Encode and remember cuts; their numbers. ``first`` is sorted."""
        # cuts that start with a space are encoded together, with a line end between, which is one token there
        plain = np.array([c[:1] == b" " and b"\n" not in c for c in cuts], dtype=bool)
        together = [c for c, p in zip(cuts, plain) if p]
        joined = [b"\n".join(together[at : at + _TOGETHER]).decode() for at in range(0, len(together), _TOGETHER)]
        ids, lengths = [], []
        for row in self._encoded(joined):
            line = row == self.line_end
            ids.append(row[~line])
            lengths.append(np.diff(np.flatnonzero(np.concatenate([[True], line, [True]]))) - 1)
        single = self._encoded([c.decode() for c, p in zip(cuts, plain) if not p])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        known = self.check.size
        self.check.add(second[order])
        self.uses.add(np.zeros(len(cuts), np.int64))
        for part in (*ids, *single):
            self.ids.add(part)
        lengths = np.concatenate([*lengths, np.array([len(x) for x in single], dtype=np.int64)]).astype(np.int64)
        self.bounds.add(self.bounds.held[-1] + np.cumsum(lengths))
        numbers = np.empty(len(cuts), dtype=np.int64)
        numbers[order] = known + np.arange(len(cuts))
        keys, of = self.new
        at = np.searchsorted(keys, first)
        self.new = np.insert(keys, at, first), np.insert(of, at, numbers.astype(np.int32))
        if len(self.new[0]) > _RECENT:
            self.old, self.new = self._merged(), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return numbers

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each short cut, -1 for one that has the first hash of another."""
        one, two = words.byte_hashes(data, starts, ends)
        first, at, which, times = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
        second = two[at]
        found = self._find(first, second)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = data.tobytes()
            cuts = [raw[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            found[new] = self._learn(cuts, first[new], second[new])
        self.uses.held[found] += times
        return np.where(second[which] == two, found[which], -1)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as unsigned 32-bit integers, END after each text, and each text's bounds."""
        if self.check.size > REMEMBERED or self.ids.size > 8 * REMEMBERED:
            self._drop_rare()
        data, offsets = words.text_bytes(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        n_texts = len(offsets) - 1
        starts = _cut_starts(data, offsets)
        marked = self._marked(data, offsets)
        inside = np.searchsorted(offsets, starts, "right") - 1
        keep = ~marked[inside] | (starts == offsets[inside])
        starts, inside = starts[keep], inside[keep]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        short = (ends - starts <= LONGEST) & ~marked[inside]

        numbers = np.full(len(starts), -1, dtype=np.int64)
        for at in range(0, len(starts), _BLOCK):
            these = at + np.flatnonzero(short[at : at + _BLOCK])
            # long cuts between short ones are left out of what is hashed
            packed = words.expand(starts[these], ends[these] - starts[these])
            last = np.cumsum(ends[these] - starts[these])
            numbers[these] = self._numbers(data[packed], last - (ends[these] - starts[these]), last)
        lengths = np.zeros(len(starts), dtype=np.int64)
        known = numbers >= 0
        lengths[known] = np.diff(self.bounds.held)[numbers[known]] if known.any() else 0
        others = np.flatnonzero(~known)
        direct = self._encoded([data[s:e].tobytes().decode() for s, e in zip(starts[others], ends[others])])
        lengths[others] = [len(x) for x in direct]

        sums = np.concatenate([[0], np.cumsum(lengths)])
        bounds = sums[np.searchsorted(inside, np.arange(n_texts + 1))] + np.arange(n_texts + 1)
        ids = np.empty(int(bounds[-1]), dtype="<u4")
        ids[bounds[1:] - 1] = END
        place = sums[:-1] + inside
        for at in range(0, len(starts), _BLOCK):
            these = at + np.flatnonzero(known[at : at + _BLOCK])
            source = words.expand(self.bounds.held[numbers[these]], lengths[these])
            ids[words.expand(place[these], lengths[these])] = self.ids.held[source]
        for i, found in zip(others, direct):
            ids[place[i] : place[i] + len(found)] = found
        return ids, bounds

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold the string of an added token."""
        raw = data.tobytes()
        marked = np.zeros(len(offsets) - 1, dtype=bool)
        if any(m in raw for m in self.markers):
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                marked[i] = any(raw.find(m, a, b) >= 0 for m in self.markers)
        return marked


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Free what this Python worker remembers of encoding, and give the memory back to the system."""
    if _encoders:
        _encoders.clear()
        give_back()


def standard_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_slices(texts: pa.Array, path: str):
    """First row, ids and bounds of consecutive slices of about CHUNK_BYTES; a text is never cut."""
    tool = encoder(path)
    for first, part in words.chunks(texts):
        yield first, *tool.encode(part)
