"""Token ids as patched frame-of-reference blocks.

Texts are encoded by a byte-level BPE vocabulary given by its path and pattern. Each document's ids are cut into blocks
of BLOCK; a block keeps its minimum, the differences packed at the width that holds PERCENTILE of them, and the others
in an exception list. block_starts indexes the blocks by their byte in payload, so any block is decoded alone.

Layout of a block, little-endian: minimum u32, ids u16, width u8, exceptions u8; the low width bits of the differences,
most significant bit first, padded to a byte; the places of the exceptions, u8 each; their high bits (difference
shifted right by width), u32 each. With BLOCK at most 256, a place fits a byte and exceptions a byte too, as at most
(1 - PERCENTILE) of a block are exceptions.

Words repeat, so each batch is encoded by its distinct words: before a single space between two characters that are
not white space no token reaches across. Texts with other white space at such places are encoded whole.

Defined cases: null and empty texts have no token, an empty payload and no block. Null ids, repeated rows and texts of
any length are encoded alike, each row for itself; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._stage import lean

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 128
PERCENTILE = 0.9
#: Bytes of text encoded at once.
GATHER = 3_000_000
_ODD = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}] | [\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]|^[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]|[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]$"

_encoders: dict[str, tuple] = {}


def encoder(path: str, pattern: str = PATTERN):  # noqa: ANN201
    """The tokenizer of a file of base64 tokens and ranks, and for each id whether its token begins with a space."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spaced = np.zeros(max(ranks.values()) + 1, bool)
        spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), spaced
    return _encoders[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the n + 1 offsets."""
    enc, spaced = encoder(path)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    first = np.zeros(len(codes) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    ids = np.frombuffer(enc.encode_to_numpy(" " + " ".join(distinct.to_pylist())), np.uint32) if len(distinct) else np.zeros(0, np.uint32)
    if len(distinct):
        # "" is a word of its own only at the start of a text; it has no token and is put right below
        opens = np.flatnonzero(spaced[ids])
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        if empty.any():
            ids = np.frombuffer(enc.encode_to_numpy(" " + " ".join(x for x in distinct.to_pylist() if x)), np.uint32) if not empty.all() else np.zeros(0, np.uint32)
            opens = np.flatnonzero(spaced[ids])
        starts = np.zeros(len(distinct), np.int64)
        sizes = np.zeros(len(distinct), np.int64)
        starts[~empty] = opens
        sizes[~empty] = np.diff(np.append(opens, len(ids)))
    else:
        starts = sizes = np.zeros(0, np.int64)
    # the first word of a text has no space before it
    heads = [enc.encode_ordinary(x) if x else [] for x in distinct.take(pa.array(codes[at[:-1]])).to_pylist()] if n else []
    for i in np.flatnonzero(odd):
        heads[i] = enc.encode_ordinary(texts[int(i)].as_py())
    extra = np.fromiter((t for h in heads for t in h), np.uint32)
    head_sizes = np.fromiter(map(len, heads), np.int64, n)
    word_sizes = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    word_starts = starts[codes] if len(codes) else np.zeros(0, np.int64)
    word_sizes[first] = head_sizes
    word_starts[first] = len(ids) + np.cumsum(head_sizes) - head_sizes
    pool = np.concatenate([ids, extra])
    ends = np.concatenate([[0], np.cumsum(word_sizes)])
    where = np.repeat((word_starts - ends[:-1]).astype(np.int32), word_sizes)  # a batch has far under 2**31 ids
    where += np.arange(ends[-1], dtype=np.int32)
    return pool[where].astype(np.uint32), ends[at]


def pack(ids: np.ndarray, offsets: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[list[np.ndarray], list[bytes]]:
    """For each document the starts of its blocks, and its payload."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    per = -(-sizes // block)
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(n), per)
    start = offsets[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * block
    length = np.minimum(block, offsets[1:][doc] - start)
    total = len(start)
    if not total:
        return [np.zeros(0, np.int32)] * n, [b""] * n
    grid = np.minimum(start[:, None] + np.arange(block), len(ids) - 1)
    real = np.arange(block) < length[:, None]
    values = ids[grid]
    low = np.where(real, values, np.uint32(0xFFFFFFFF)).min(1)
    rest = np.where(real, values - low[:, None], np.uint32(0))
    # bit lengths: differences are under 2**24, so exact as float32, whose exponent has them
    bits = np.maximum((rest.astype(np.float32).view(np.uint32) >> 23).astype(np.int16) - 126, 0).astype(np.uint8)
    ranked = np.sort(np.where(real, bits, 255).astype(np.uint8), 1)
    width = ranked[np.arange(total), np.minimum(np.ceil(length * percentile).astype(np.int64), length) - 1].astype(np.int64)
    over = (bits > width[:, None]) & real
    n_over = over.sum(1)
    packed: list[bytes] = [b""] * total
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        if w:
            kind, size = (">u2", 16) if w <= 16 else (">u4", 32)
            low_bits = np.unpackbits(rest[some].astype(kind).view(np.uint8), axis=1).reshape(len(some), block, size)[:, :, size - w :]
            rows = np.packbits(low_bits.reshape(len(some), block * w), axis=1)
            whole, step = rows.tobytes(), rows.shape[1]
            for j, (k, m) in enumerate(zip(some.tolist(), ((length[some] * w + 7) // 8).tolist())):
                packed[k] = whole[j * step : j * step + m]
    head = np.zeros(total, np.dtype([("low", "<u4"), ("n", "<u2"), ("w", "u1"), ("x", "u1")]))
    head["low"], head["n"], head["w"], head["x"] = low, length, width, n_over
    raw = head.tobytes()
    b, place = np.nonzero(over)
    high = (rest[b, place].astype(np.int64) >> width[b]).astype("<u4")
    place = place.astype(np.uint8)
    cut = np.concatenate([[0], np.cumsum(n_over)]).tolist()
    blobs = [raw[8 * k : 8 * k + 8] + packed[k] + (place[cut[k] : cut[k + 1]].tobytes() + high[cut[k] : cut[k + 1]].tobytes() if cut[k + 1] > cut[k] else b"") for k in range(total)]
    lengths = np.fromiter(map(len, blobs), np.int64, total)
    starts, payloads = [], []
    bounds = first.tolist()
    for d in range(n):
        a, z = bounds[d], bounds[d + 1]
        starts.append((np.cumsum(lengths[a:z]) - lengths[a:z]).astype(np.int32))
        payloads.append(b"".join(blobs[a:z]))
    return starts, payloads


def unpack_block(payload: bytes, at: int) -> np.ndarray:
    """The ids of the block that starts at byte at."""
    low = int.from_bytes(payload[at : at + 4], "little")
    n = int.from_bytes(payload[at + 4 : at + 6], "little")
    w, x = payload[at + 6], payload[at + 7]
    at += 8
    size = (n * w + 7) // 8
    out = np.zeros(n, np.int64)
    if w:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at))[: n * w].reshape(n, w).astype(np.int64)
        out = (bits << np.arange(w - 1, -1, -1)).sum(1)
    at += size
    if x:
        place = np.frombuffer(payload, np.uint8, x, at)
        out[place] |= np.frombuffer(payload, "<u4", x, at + x).astype(np.int64) << w
    return out + low


def unpack(payload: bytes, starts: list[int]) -> np.ndarray:
    return np.concatenate([unpack_block(payload, s) for s in starts]) if len(starts) else np.zeros(0, np.int64)


PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_blocks", T.IntegerType()),
        T.StructField("block_starts", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def token_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, percentile: float = PERCENTILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its ids in packed blocks, and where each block starts."""
    if not 1 <= block <= 256 or not 0 < percentile <= 1 or block * (1 - percentile) > 255:
        raise ValueError("block must be 1 to 256 and percentile in (0, 1], with at most 255 exceptions in a block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in X.gathered(batches, "text", GATHER):
            ids, offsets = encode(big.column("text"), vocabulary)
            row = 0
            for b in X.chunks(big, "text", X.CHUNK * 2):
                n = b.num_rows
                own = offsets[row : row + n + 1]
                starts, payloads = pack(ids[own[0] : own[-1]], own - own[0], block, percentile)
                counts = np.fromiter(map(len, starts), np.int32, n)
                flat = np.concatenate(starts) if n else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.diff(own)), pa.array(counts), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32))), pa.array(payloads, pa.binary())],
                    names=[f.name for f in PACKED],
                )
                row += n

    lean(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)
