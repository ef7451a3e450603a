"""Vectorised words and n-grams of Arrow string batches.

A word is a maximal run of letters and digits of any script, in the normal form of each character: compatibility form
(full-width letters are plain ones), lower case, without accents. Whatever else there is, no-break spaces, curly quotes
and dashes among it, separates words. In scripts that are written without spaces (UNSPACED) each character is a word.
Characters whose form is several letters, such as ligatures, stay as they are. In SQL the words are SQL_WORDS.
Hashes are of 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
SQL_WORDS = rf"regexp_extract_all(regexp_replace(strip_accents(lower(translate(text, '{_WIDE}', '{"".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''")}'))), '({UNSPACED})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
#: Bytes of text that are handled at once, so that the tables below stay in a few tens of MB.
CHUNK = 1_000_000

_POINTS = 0x30000  # beyond are no letters
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[int, np.ndarray] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        t = np.full(max(n, CHUNK // 2), base, np.uint64)
        t[0] = 1
        have = _tables[base] = np.cumprod(t, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null is empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in table, never across texts, and the n + 1 first runs of the texts."""
    w = np.zeros(len(buf) + 2, np.uint8)
    w[1:-1] = table[buf]
    cut = offsets[1:-1]
    new = (w[1:-1] > w[:-2]).view(np.uint8)
    last = (w[1:-1] > w[2:]).view(np.uint8)
    inner = cut[(cut > 0) & (cut < len(buf))]
    new[inner] = w[1:-1][inner]
    last[inner - 1] = w[1:-1][inner - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=total[1:]) if n else None
    return mix((total[ends] - total[starts]) * _powers(_PINV, n + 1)[starts])


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point: 0 separates, 1 is of a word, 2 is a word, 3 is a mark, to be left out; and its normal form."""
    points = np.arange(_POINTS, dtype="<u4")
    points[0xD800:0xE000] = 32
    chars = pa.array(list(points.tobytes().decode("utf-32-le")), pa.string())
    bare = pc.utf8_lower(pc.replace_substring_regex(pc.utf8_normalize(chars, "NFKD"), r"\p{M}+", ""))
    forms = pc.if_else(pc.equal(pc.utf8_length(bare), 1), bare, chars)
    kind = pc.match_substring_regex(chars, r"^[\p{L}\p{N}]$").to_numpy(zero_copy_only=False).astype(np.uint8)
    kind[pc.match_substring_regex(chars, f"^{UNSPACED}$").to_numpy(zero_copy_only=False) & (kind > 0)] = 2
    kind[pc.match_substring_regex(chars, r"^\p{M}$").to_numpy(zero_copy_only=False)] = 3
    return kind, np.frombuffer("".join(forms.to_pylist()).encode("utf-32-le"), np.uint32)


@dataclass
class Words:
    buf: np.ndarray  # normal forms of the characters but marks
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    origin: np.ndarray | None  # place of each in the texts, if there are marks
    size: int  # characters of all texts

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Start and end of words i to j - 1 in characters of the texts, marks included."""
        a, z = int(self.starts[i]), int(self.ends[j - 1])
        if self.origin is not None:
            a, z = int(self.origin[a]), int(self.origin[z]) if z < len(self.origin) else self.size
        return a, z

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 with a space between."""
        return b" ".join(self.buf[s:e].astype("<u4").tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and text index of each n-gram; a text of fewer words, but not of none, has one of all its words."""
        h, total = self.hashes, len(self.hashes)
        doc = np.repeat(np.arange(len(self.first) - 1), self.counts)
        if not total:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc
        end = self.first[1:][doc]
        acc = np.zeros(total, np.uint64)
        pad = np.concatenate([h, np.zeros(n, np.uint64)])
        for j in range(n):
            acc = acc * _Q + pad[j : j + total]
        at = np.arange(total)
        whole = end - at >= n
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        for d in short:
            a = np.uint64(int(self.counts[d]))
            with np.errstate(over="ignore"):
                for x in h[self.first[d] : self.first[d + 1]]:
                    a = a * _Q + x
            acc[self.first[d]] = a
        whole[self.first[short]] = True
        at = np.flatnonzero(whole)
        return mix(acc[at]), at, doc[at]


def words(texts: pa.Array) -> Words:
    buf, offsets = raw(texts)
    kinds, forms = _characters()
    origin = None
    if not len(buf) or buf.max() < 128:
        kind, buf = kinds[:128][buf], forms[:128].astype(np.uint8)[buf]
    else:
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        points = np.minimum(points, np.uint32(_POINTS - 1))
        kind, buf = kinds[points], forms[points]
    size = len(buf)
    marks = kind == 3
    if marks.any():
        origin = np.flatnonzero(~marks)
        offsets = np.searchsorted(origin, offsets)
        kind, buf = kind[origin], buf[origin]
    one = (kind == 2).any()
    starts, ends, first = _runs(kind, offsets) if one else bounds(kind, offsets, np.arange(3, dtype=np.uint8))
    return Words(buf, starts, ends, first, span_hashes(buf, starts, ends), origin, size)


def _runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As bounds(), with each character of kind 2 a run."""
    held = np.zeros(len(kind) + 2, np.uint8)
    held[1:-1] = kind
    here, alone = held[1:-1] > 0, held == 2
    cut = np.zeros(len(kind) + 1, bool)
    cut[offsets] = True
    new = here & ((held[:-2] == 0) | alone[1:-1] | alone[:-2] | cut[:-1])
    last = here & ((held[2:] == 0) | alone[1:-1] | alone[2:] | cut[1:])
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of batch of about limit bytes of column; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, np.cumsum(lengths, dtype=np.int64)
    while at < len(lengths):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and what one stage keeps the next one lacks."""
    if len(_tables) and max(map(len, _tables.values())) > 2 * CHUNK:
        _tables.clear()  # grown by a very long text
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about limit bytes of column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for c in chunks(b, column, limit):
            n = pc.sum(pc.binary_length(c.column(column))).as_py() or 0
            if held and size + n > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if c.num_rows:
                held.append(c)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the n segments that the n + 1 offsets first delimit; an empty one gives 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text index of each window of exactly n words."""
    total = len(w.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = total - n + 1
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * _Q + w.hashes[j : j + m]
    doc = np.repeat(np.arange(len(w.first) - 1), w.counts)[:m]
    at = np.flatnonzero(w.first[1:][doc] - np.arange(m) >= n)
    return mix(acc[at]), at, doc[at]


def with_columns(batch: pa.RecordBatch, keep: np.ndarray, names: list[str], arrays: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """The rows keep of batch, columns by position, some replaced or added."""
    rows = pa.array(keep, pa.int64())
    cols = [arrays[x] if x in arrays else batch.column(names.index(x)).take(rows) for x in schema.names]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)
