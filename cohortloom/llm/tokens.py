"""Vectorised words and n-gram hashes of Arrow string columns, and packed sorted hash sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SLICE = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C17)  # odd, 3 modulo 4
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _R), ("i", _RINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes) of a string or binary array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d[o[0] : o[-1]]


def word_hashes(arr) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the end) of texts whose words have one space between."""
    off, data = buffers(arr)
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        b, o = data[off[at] : off[to]], off[at : to + 1] - off[at]
        n = len(b)
        if n:
            word = b != 32
            first = word.copy()
            first[1:] &= ~word[:-1]
            inner = o[1:-1]
            inner = inner[inner < n]
            first[inner] = word[inner]
            last = word.copy()
            last[:-1] &= ~word[1:]
            last[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last)
            p, inv = _pow(n)
            cs = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[b] * p, out=cs[1:])
            hashes.append(mix((cs[e + 1] - cs[s]) * inv[s] + (e - s + 1).astype(np.uint64)))
            counts[at:to] = np.diff(np.searchsorted(s, o))
        at = to
    starts = np.zeros(len(off), np.int64)
    np.cumsum(counts, out=starts[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), starts


def doc_of(starts: np.ndarray) -> np.ndarray:
    """The text that each word is in."""
    return np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))


def ngrams(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of all n-grams that lie within one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, inv = _pow(len(words))
    cs = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p, out=cs[1:])
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(words))
    pos = np.flatnonzero(left >= n)
    return mix((cs[pos + n] - cs[pos]) * inv[pos] + np.uint64(n)), pos


def text_hash(words: list[str]) -> int:
    """The n-gram hash of a list of words, as ngrams() has it; for small sides."""
    h, s = word_hashes(pa.array([" ".join(words)]))
    g, _ = ngrams(h, s, len(words))
    return int(g[0])


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted uint64 array as zstd of the byte planes of its differences."""
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(x: np.ndarray) -> bytes:
    """A plain array as zstd of its byte planes."""
    w = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, w).T).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(w, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def bucket_bounds(n: int) -> np.ndarray:
    """The least hash of each of n buckets of equal width."""
    return np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
