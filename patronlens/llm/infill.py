"""Fill-in-middle outputs from texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME_BYTES, cut where a unit (a
word with the white space before it) ends, with the number of units and characters before
each frame. A cut after k units is found by those counts: only its frame is decompressed.
An output is again a list of frames, which together are one valid zstandard stream: frames
that no cut touches are passed on as they are, in their new order. Digests and restored
texts stream the frames in order, one at a time in memory.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm.common import arrow_pass, read, stash

FRAME_BYTES = 64 << 10
LEVEL = 1
SEED, RATE, SUFFIX_FIRST = 42, 50, 80  # of 100 texts: transformed; of those: suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
# units[i], chars[i]: how many end, and how many there are, before frame i; one entry more than frames
_STORE = "doc_id long, draws array<long>, marked boolean, units array<long>, chars array<long>, frames array<binary>"
_OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.cache
def _codec():
    import zstandard

    packer, unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    return packer.compress, unpacker.decompress


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit of a text ends: after the last byte of every word, and at the end of the text."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    end = ~space
    end[:-1] &= space[1:]
    end[-1:] = True
    return np.flatnonzero(end) + 1


def characters(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def frame_bounds(text: bytes, ends: np.ndarray, size: int = FRAME_BYTES) -> list[int]:
    """Byte positions from 0 to the end between which the frames lie.

    A frame ends with a unit; only inside a unit longer than a frame it ends between two
    characters.
    """
    bounds = [0]
    while bounds[-1] < len(text):
        limit = bounds[-1] + size
        if limit >= len(text):
            bounds.append(len(text))
            break
        last = np.searchsorted(ends, limit, "right") - 1
        stop = int(ends[last]) if last >= 0 else 0
        if stop <= bounds[-1]:
            stop = limit
            while stop < min(limit + 3, len(text)) and text[stop] & 0xC0 == 0x80:
                stop += 1
        bounds.append(stop)
    return bounds


def pack(text: bytes, size: int = FRAME_BYTES) -> tuple[list[int], list[int], list[bytes]]:
    """Cumulative units and characters, and the frames of a text."""
    compress = _codec()[0]
    ends = unit_ends(text)
    bounds = frame_bounds(text, ends, size)
    pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    chars = np.cumsum([0, *map(characters, pieces)]).tolist()
    return np.searchsorted(ends, bounds, "right").tolist(), chars, [compress(p) for p in pieces]


class Seekable:
    """A stored text; remembers the frame it decompressed last."""

    def __init__(self, units: list[int], chars: list[int], frames: list[bytes]):
        self.units, self.chars, self.frames = units, chars, frames
        self._compress, self._decompress = _codec()
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self._last[0] != i:
            self._last = (i, self._decompress(self.frames[i]))
        return self._last[1]

    def after(self, k: int) -> tuple[int, int, int]:
        """The place after k units: frame, byte in it, and characters before."""
        if k == 0:
            return 0, 0, 0
        i = int(np.searchsorted(self.units, k, "left")) - 1
        piece = self.frame(i)
        at = int(unit_ends(piece)[k - self.units[i] - 1])
        return i, at, self.chars[i] + characters(piece[:at])

    def between(self, low: tuple, high: tuple | None) -> Iterator[tuple[bool, bytes]]:
        """(is a frame, bytes) from one place to another; whole frames stay compressed."""
        i, at = low[:2]
        stop, end = high[:2] if high else (len(self.frames), 0)
        while i < stop or (i == stop and at < end):
            if at == 0 and i < stop:
                yield True, self.frames[i]
            else:
                yield False, self.frame(i)[at : end if i == stop else None]
            i, at = i + 1, 0

    def joined(self, parts: Iterable[tuple[bool, bytes]]) -> list[bytes]:
        """Frames of the parts in order; neighbouring loose bytes become one."""
        out, loose = [], []
        for is_frame, data in parts:
            if is_frame:
                if loose:
                    out.append(self._compress(b"".join(loose)))
                    loose = []
                out.append(data)
            else:
                loose.append(data)
        return out + [self._compress(b"".join(loose))] if loose else out


def infilled(text: Seekable, draws: list[int], marked: bool) -> tuple:
    """n, form, characters of the prefix and the middle (None if plain) and the output's frames."""
    n = text.units[-1]
    if not text.frames or marked or draws[2] % 100 >= RATE:
        return n, "plain", None, None, text.frames
    form = "spm" if draws[3] % 100 < SUFFIX_FIRST else "psm"
    first, second = (text.after(k) for k in sorted(d % (n + 1) for d in draws[:2]))
    parts = {PREFIX: ((0, 0, 0), first), MIDDLE: (first, second), SUFFIX: (second, None)}
    pieces = (p for mark in ORDERS[form] for p in ((False, mark), *text.between(*parts[mark])))
    return n, form, first[2], second[2] - first[2], text.joined(pieces)


def streamed(frames: list[bytes]) -> Iterator[bytes]:
    decompress = _codec()[1]
    return map(decompress, frames)


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text in order, from an output's frames and its form alone.

    One pass finds the markers (a text that holds one is plain), then prefix, middle and
    suffix are streamed.
    """
    if form == "plain":
        yield from streamed(frames)
        return
    wanted, marks, starts, at, tail = list(ORDERS[form]), [], [], 0, b""
    for piece in streamed(frames):
        window, begin, after = tail + piece, at - len(tail), 0
        while wanted and (hit := window.find(wanted[0], after)) >= 0:
            marks.append(begin + hit)
            after = hit + len(wanted.pop(0))
        tail = window[max(after, len(window) - 2) :]  # a marker may begin in one frame and end in the next
        starts.append(at)
        at += len(piece)
    if wanted:
        raise ValueError(f"an output of form {form} lacks {wanted[0]!r}")
    starts.append(at)
    ranges = {m: (a + len(m), b) for m, a, b in zip(ORDERS[form], marks, [*marks[1:], at])}
    held = Seekable([], [], frames)
    for low, high in (ranges[PREFIX], ranges[MIDDLE], ranges[SUFFIX]):
        i = int(np.searchsorted(starts, low, "right")) - 1
        while low < high:
            yield held.frame(i)[low - starts[i] : high - starts[i]]
            i, low = i + 1, starts[i + 1]


# --- tables ----------------------------------------------------------------------------------

def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers from 0 to 2**32 - 1 that depend on the id and the seed only; a null id counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _array(kind: pa.DataType, rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def frames(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The seekable frames of every whole text; a null text counts as empty and has none."""

    def build(batch: pa.RecordBatch):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        units, chars, packed = zip(*map(pack, texts))
        yield {
            "doc_id": batch.column("doc_id"),
            "draws": batch.column("draws"),
            "marked": pa.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]),
            "units": _array(pa.int64(), units),
            "chars": _array(pa.int64(), chars),
            "frames": _array(pa.binary(), packed),
        }

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), draws(doc_id, seed).alias("draws"), F.col("text").cast("string").cast("binary").alias("text"))
    return arrow_pass(rows, build, _STORE)


def transform(stored: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output's ``frames`` of stored texts.

    n is the number of units. The form is plain, and the output the text, if it is empty or
    holds a marker or the draw says so. Repeated rows and ids give a row each; an empty
    table none.
    """

    def build(batch: pa.RecordBatch):
        held = (Seekable(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("units", "chars", "frames"))))
        rows = [infilled(*row) for row in zip(held, batch.column("draws").to_pylist(), batch.column("marked").to_pylist())]
        n, form, prefix, middle, out = zip(*rows)
        yield {
            "doc_id": batch.column("doc_id"),
            "n": pa.array(n, pa.int64()),
            "form": pa.array(form, pa.string()),
            "prefix_chars": pa.array(prefix, pa.int64()),
            "middle_chars": pa.array(middle, pa.int64()),
            "frames": _array(pa.binary(), out),
        }

    return arrow_pass(stored, build, _OUTPUT)


def _sha256(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs' columns, with digests of each output and of the text restored from it, for the frames."""

    def build(batch: pa.RecordBatch):
        rows = list(zip(batch.column("frames").to_pylist(), batch.column("form").to_pylist()))
        kept = {c: batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")}
        yield kept | {
            "output_sha256": pa.array([_sha256(streamed(f)) for f, _ in rows], pa.string()),
            "restored_sha256": pa.array([_sha256(restored(f, form)) for f, form in rows], pa.string()),
        }

    return arrow_pass(outputs, build, _DIGESTS)


def op11(spark: SparkSession, folder: str) -> DataFrame:
    stored = stash(frames(read(spark, folder, "documents")), "frames")
    return digests(transform(stored))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
), p AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS k1,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS k2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM d
), c AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(list_slice(units, 1, least(k1, k2)), '') AS prefix,
           array_to_string(list_slice(units, least(k1, k2) + 1, greatest(k1, k2)), '') AS middle,
           array_to_string(list_slice(units, greatest(k1, k2) + 1, n), '') AS suffix
    FROM p
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
