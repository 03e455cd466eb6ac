"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents are laid out in chunks by a hash of their row. Every chunk's distinct pre-tokens (their positions are the
places at which the chunk's texts have them) are shuffled by word hash, packed and sorted; each bucket encodes each
distinct word of the whole corpus once and answers every chunk with its words' ids in the same order. The answers are
joined back to the chunks, where ids are put in place by position. Decoding joins the ids with the token-byte table,
which has the vocabulary's fixed size, and puts the bytes together by position.

The merges come from a public rank file; ``ranks_path`` names it. The rank file is read by each worker.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids and decodes to an empty text;
repeated rows are encoded each; an empty table gives no rows; special tokens' strings are ordinary text; whole
texts are encoded; other columns are not returned.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common, tokens

RANKS = os.environ.get("COHORTLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern of the rank file; it covers every character.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 4 << 20  # of a chunk, as stored

_loaded: dict[str, tuple] = {}


def vocabulary(path: str):
    """(tiktoken encoding, bytes of all tokens, their offsets), read once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        words = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            words[i] = w
        size = np.fromiter(map(len, words), np.int64, len(words))
        enc = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = enc, np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size)])
    return _loaded[path]


_split = regex.compile(SPLIT)


def _dictionary(t: pa.Table) -> tuple[pa.Array, np.ndarray, list[int], list]:
    """(distinct pieces of a chunk, index of every piece in order, pieces of every text or -1 for null, ids)."""
    code: dict[str, int] = {}
    index, counts, ids = [np.zeros(0, np.int32)], [], []
    for rows in common.unpacked(t):
        ids += rows.column("doc_id").to_pylist()
        for cell in rows.column("text"):
            text = cell.as_py()
            if text is None:
                counts.append(-1)
                continue
            own = np.array([code.setdefault(p, len(code)) for p in _split.findall(text)], np.int32)
            index.append(own)
            counts.append(len(own))
    return pa.array(list(code), pa.string()), np.concatenate(index), counts, ids


def _in_order(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words' places by bucket and then bytes, their buckets): the same however the chunk's rows come."""
    bucket, by_bytes = _buckets(words, n), pc.sort_indices(words).to_numpy()
    order = by_bytes[np.argsort(bucket[by_bytes], kind="stable")]
    return order, bucket[order]


def _buckets(words: pa.Array, n: int) -> np.ndarray:
    """Bucket of every word by a hash of its bytes."""
    off, data = tokens.buffers(words)
    if not len(words):
        return np.zeros(0, np.int64)
    h = np.zeros(len(words), np.uint64)
    for at in range(0, len(words), 65536):
        o = off[at : at + 65537]
        b = data[o[0] : o[-1]]
        p, inv = tokens._pow(max(1, len(b)))
        cs = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(tokens._BYTES[b] * p[: len(b)], out=cs[1:])
        s, e = o[:-1] - o[0], o[1:] - o[0]
        h[at : at + len(s)] = tokens.mix((cs[e] - cs[s]) * inv[np.minimum(s, len(b) - 1)])
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ask(n_buckets: int):
    def ask(t: pa.Table) -> pa.Table:
        words = _dictionary(t)[0]
        order, bucket = _in_order(words, n_buckets)
        z = zstandard.ZstdCompressor(level=3)
        used, cells = np.unique(bucket), []
        bounds = np.searchsorted(bucket, np.r_[used, n_buckets])
        for a, b in zip(bounds, bounds[1:]):
            off, data = tokens.buffers(words.take(pa.array(order[a:b])))
            size = np.diff(off)
            cells.append(z.compress(len(size).to_bytes(4, "little") + size.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() + data.tobytes()))
        return pa.table({"bucket": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), t.column("chunk")[0].as_py()), pa.int64()), "words": pa.array(cells, pa.binary())})

    return ask


def _answer(path: str):
    def answer(t: pa.Table) -> pa.Table:
        enc, _, _ = vocabulary(path)
        dz, lists = zstandard.ZstdDecompressor(), []
        for cell in t.column("words"):
            raw = dz.decompress(cell.as_py())
            n = int.from_bytes(raw[:4], "little")
            size = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, -1).T).view(np.uint32).ravel()
            off = np.zeros(n + 1, np.int32)
            np.cumsum(size, out=off[1:])
            lists.append(pa.StringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(raw[4 + 4 * n :])))
        coded = pa.chunked_array(lists, pa.string()).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        ids = [enc._core_bpe.encode_single_piece(w.encode()) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.uint16 if max(map(len, ids), default=0) < 65536 else np.uint32, len(ids)).astype(np.uint32)
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        index, at, cells = coded.indices.to_numpy(), 0, []
        for x in lists:
            i = index[at : at + len(x)]
            at += len(x)
            head = tokens.pack(size[i])
            take = _ranges(start[i], size[i])
            cells.append(len(head).to_bytes(4, "little") + head + tokens.pack(flat[take]))
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "ids": pa.array(cells, pa.binary())})

    return answer


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then those of start[1], ..."""
    size = size.astype(np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size, size) + np.repeat(start.astype(np.int64), size)


def _place(n_buckets: int, arrow_id: pa.DataType):
    def place(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, index, counts, doc_ids = _dictionary(docs)
        order, bucket = _in_order(words, n_buckets)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist()))
        sizes, flats = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for b in np.unique(bucket):
            cell = got[int(b)]
            n = int.from_bytes(cell[:4], "little")
            sizes.append(tokens.unpack(cell[4 : 4 + n], np.uint32))
            flats.append(tokens.unpack(cell[4 + n :], np.uint32) if len(cell) > 4 + n else flats[0])
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        first = np.cumsum(size, dtype=np.int64) - size
        size_of, first_of = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size_of[order], first_of[order] = size, first
        starts = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))]).astype(np.int64)
        step = 1 << 19  # pieces at once, so that temporaries stay small
        n_ids = np.concatenate([[0], np.cumsum(size_of[index])])
        ids = np.empty(n_ids[-1], np.int32)
        for at in range(0, len(index), step):
            i = index[at : at + step]
            ids[n_ids[at] : n_ids[at + len(i)]] = flat[_ranges(first_of[i], size_of[i])]
        lists = pa.ListArray.from_arrays(pa.array(n_ids[starts].astype(np.int32)), pa.array(ids), mask=pa.array([n < 0 for n in counts], pa.bool_()))
        return pa.table({"doc_id": pa.array(doc_ids, arrow_id), "token_ids": lists})

    return place


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, token_ids) of every row."""
    n_chunks = common.parts(docs, chunk_bytes)
    n_buckets = max(1, min(n_chunks, 1 << 20))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).alias("chunk"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    laid = common.laid_out(rows, common.partitions(docs))
    asked = laid.groupBy("chunk").applyInArrow(common.trimming(_ask(n_buckets)), "bucket long, chunk long, words binary")
    answered = asked.groupBy("bucket").applyInArrow(common.trimming(_answer(ranks_path)), "chunk long, bucket long, ids binary")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return laid.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(common.trimming(_place(n_buckets, to_arrow_type(rows.schema["doc_id"].dataType))), schema)


def _decode(path: str):
    def decode(batches):
        _, data, off = vocabulary(path)
        size = np.diff(off)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)])
            ids = lists.flatten().to_numpy()
            step, texts = max(1, b.num_rows // max(1, len(ids) // (1 << 20))), []
            for at in range(0, b.num_rows, step):
                s = starts[at : at + step + 1]
                i = ids[s[0] : s[-1]]
                raw = data[_ranges(off[i], size[i])]
                bounds = np.concatenate([[0], np.cumsum(size[i])])[s - s[0]]
                texts.append(pa.StringArray.from_buffers(len(s) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))))
            text = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            text = pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "text"])

    return decode


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """encoded (doc_id, token_ids) with the decoded text; its ids must be whole texts of this vocabulary."""
    rows = encoded.select("doc_id", "token_ids")
    return rows.mapInArrow(_decode(ranks_path), T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text) of every row; text is decoded from the ids."""
    both = decode(encode(docs, id_col, text_col, ranks_path), ranks_path)
    return both.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(common.table(spark, sf_dir, "documents"))
