"""A salvage reader of WARC files.

Records are read member by member (gzip) or line by line (plain). A record is valid if its member inflates with a
right checksum, its version line (of any version) and headers parse, its block has the stated length, ends in two line
ends and has the stated digest (``WARC-Block-Digest``; sha1, sha256, sha512 and md5, in hexadecimal or base 32).
After a failed check the reader searches for the next byte from which a valid record begins (a member's magic
or a version line), goes on there, and logs the bytes between as a quarantined gap with its reason.

A member of several records gives all of them, found in its inflated bytes as in a plain file: each has the member's offset, the
first its length and the others 0, so that lengths sum to the bytes covered; a gap in there has length 0 and names its
inflated bytes.

Files of any size are read in byte ranges: ``read_warc`` gives each task a range, which takes the records that
begin in it. A range's reader looks for its first record as after a failure; the bytes up to there belong to the
record of the range before, so gaps are only known once neighbours are put together: a range reports what it
skipped at its front with ``front`` set, and ``whole_gaps`` subtracts the records that reach into it. A record that
goes beyond its range is read on, twice as far each time.

Defined cases: null and empty contents have no records and no gaps; a file of rubbish is one gap; equal
records come twice if they are in the file twice; an empty table gives no rows; other columns are never looked at;
headers may be of any length. Digests of other algorithms and of payloads are not looked at. A record has to fit into a worker's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d{1,3}\.\d{1,3}\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d{1,3}\.\d{1,3}\r\n")
#: Longest version line.
_LINE = 14
#: Compressed bytes that are inflated at once.
_STEP = 1 << 16


class Broken(Exception):
    """Why no valid record begins at a byte."""


class Short(Exception):
    """The bytes at hand end before the record does."""


def _digest_fails(said: str, block: bytes) -> bool:
    name, colon, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("sha1", "sha256", "sha512", "md5"):
        return False
    own = hashlib.new(name, block, usedforsecurity=False)
    value = value.strip()
    return value.lower() != own.hexdigest() and value.upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("=")


def parse_record(b: bytes, at: int = 0, size: int | None = None) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, block, end) of the plain record at a byte; size: of the whole file, of which b may be the beginning."""
    size = len(b) if size is None else size
    m = _VERSION.match(b, at)
    if not m:
        if len(b) < size and len(b) - at < _LINE:
            raise Short
        raise Broken("no version line")
    headers: dict[str, str] = {}
    pos, last = m.end(), ""
    while (e := b.find(b"\r\n", pos)) != pos:
        if e < 0:
            if len(b) < size:
                raise Short
            raise Broken("headers don't end")
        line = b[pos:e]
        pos = e + 2
        if line[:1] in (b" ", b"\t") and last:
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken("bad header line")
        last = name.strip().decode("utf-8", "replace").lower()
        headers[last] = value.strip().decode("utf-8", "replace")
    n = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", n) or "warc-type" not in headers:
        raise Broken("no type or length")
    start = pos + 2
    end = start + int(n)
    if end + 4 > size:
        raise Broken("block is cut off")
    if end + 4 > len(b):
        raise Short
    if b[end : end + 4] != b"\r\n\r\n":
        raise Broken("length is wrong")
    block = b[start:end]
    if _digest_fails(headers.get("warc-block-digest", ""), block):
        raise Broken("digest is wrong")
    return headers, block, end + 4


class _Zeros:
    """Next zero bytes, each found once: a name or comment of a false member may be as long as the file."""

    def __init__(self):
        self.known: dict[int, tuple[int, int, int]] = {}

    def after(self, b: bytes, at: int, kind: int) -> int:
        """The first zero byte from at on, -1 if there is none."""
        start, end, of = self.known.get(kind, (0, -2, 0))
        if not (start <= at <= end or end == -1 and start <= at and of == len(b)):
            end = b.find(b"\0", at)
            self.known[kind] = at, end, len(b)
        return end


def _deflated(b: bytes, at: int, size: int, zeros: _Zeros) -> int:
    """Where the compressed bytes of the gzip member at a byte begin."""
    head = b[at : at + 12]
    if len(head) == 12 and not head[3] & 0xE0:
        pos = at + 10
        if head[3] & 4:
            pos += 2 + int.from_bytes(head[10:12], "little")
        for flag in (8, 16):
            if head[3] & flag:
                pos = zeros.after(b, pos, flag) + 1
                if not pos:
                    break
        else:
            return pos + head[3] // 2 % 2 * 2
    elif len(head) == 12:
        raise Broken("member doesn't inflate")
    if len(b) < size:
        raise Short
    raise Broken("member is cut off")


def read_member(b: bytes, at: int, size: int | None = None, zeros: _Zeros | None = None) -> tuple[list[tuple], int]:
    """([("record", headers, block) or ("gap", reason)], end) of the gzip member at a byte; it has a record at least."""
    size = len(b) if size is None else size
    z, pos, pieces = zlib.decompressobj(-15), _deflated(b, at, size, zeros or _Zeros()), []
    while not z.eof:
        some = b[pos : pos + _STEP]
        if not some:
            if len(b) < size:
                raise Short
            raise Broken("member is cut off")
        try:
            pieces.append(z.decompress(some))
        except zlib.error:
            raise Broken("member doesn't inflate") from None
        pos += len(some)
    pos -= len(z.unused_data)
    if len(b) < pos + 8:
        if len(b) < size:
            raise Short
        raise Broken("member is cut off")
    plain, end = b"".join(pieces), pos + 8
    if zlib.crc32(plain).to_bytes(4, "little") + (len(plain) % 2**32).to_bytes(4, "little") != b[pos:end]:
        raise Broken("checksum is wrong")
    found, here, bad, why, first = [], 0, None, "", None
    while here < len(plain):
        try:
            headers, block, after = parse_record(plain, here)
        except Broken as e:
            first = first or e
            if bad is None:
                bad, why = here, str(e)
            m = _VERSION.search(plain, here + 1)
            here = m.start() if m else len(plain)
            continue
        if bad is not None:
            found.append(("gap", f"inflated bytes {bad} to {here}: {why}"))
            bad = None
        found.append(("record", headers, block))
        here = after
    if bad is not None:
        found.append(("gap", f"inflated bytes {bad} to {here}: {why}"))
    if not any(x[0] == "record" for x in found):
        raise first or Broken("no version line")
    return found, end


def salvage_range(read: Callable[[int, int], bytes], size: int, begin: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Yields ("record", offset, length, headers, block) and ("gap", offset, length, reason, front) for records that begin in [begin, stop).

    read(offset, n) gives bytes of a file of size bytes. front: the gap begins at begin > 0, so the record of the range
    before may reach into it.
    """
    stop = size if stop is None else min(stop, size)
    if begin >= stop:
        return
    b = read(begin, min(size, stop + _LINE) - begin)
    here, until, left = 0, stop - begin, size - begin  # offsets in b
    bad, why, zeros = None, "", _Zeros()

    def following(at: int) -> int:
        m = _NEXT.search(b, at, until + _LINE)
        return min(m.start(), until) if m else until

    if begin:
        bad, why = 0, "before the range's first record"
        here = following(0)
    while here < until:
        try:
            if b[here : here + 3] == _MAGIC:
                found, end = read_member(b, here, left, zeros)
            else:
                headers, block, end = parse_record(b, here, left)
                found = [("record", headers, block)]
        except Short:
            b += read(begin + len(b), min(left, 2 * len(b) + _STEP) - len(b))
            continue
        except Broken as e:
            if bad is None:
                bad, why = here, str(e)
            here = following(here + 1)
            continue
        if bad is not None:
            if here > bad:
                yield "gap", begin + bad, here - bad, why, bad == 0 and begin > 0
            bad = None
        length = end - here
        for x in found:
            if x[0] == "gap":
                yield "gap", begin + here, 0, x[1], False
            else:
                yield "record", begin + here, length, x[1], x[2]
                length = 0
        here = end
    if bad is not None and until > bad:
        yield "gap", begin + bad, until - bad, why, bad == 0 and begin > 0


def salvage(data: bytes, begin: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """salvage_range() of bytes at hand."""
    return salvage_range(lambda at, n: data[at : at + n], len(data), begin, stop)


RESULT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("byte_offset", T.LongType()), T.StructField("byte_length", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("block", T.BinaryType())])


def _row(x) -> tuple:
    if x[0] == "gap":
        return ("gap", x[1], x[2], x[3], None, None, None, None)
    h = x[3]
    return ("record", x[1], x[2], None, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), x[4])


def _batches(rows, schema: T.StructType):
    """Rows whose last value is a record's block as batches of at most 2000 rows and about 4 MB."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    make = lambda some: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1] or b"")
        if size > 1 << 22 or len(held) >= 2000:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)


def read_contents(files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """Records and gaps of every row's bytes: (file, kind, byte_offset, byte_length, reason, record_type, record_id, uri, block)."""
    rows = files.select(F.col(id_col).alias("file"), F.col(content_col).alias("content")).filter("content IS NOT NULL")
    schema = T.StructType([rows.schema["file"], *RESULT.fields])

    def read(batches):
        for b in batches:
            for i, content in zip(b.column(0), b.column(1)):
                yield from _batches(((i.as_py(), *_row(x)) for x in salvage(content.as_py())), schema)

    return rows.mapInArrow(read, schema)


def read_warc(spark: SparkSession, paths: list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """Records and gaps of files: (file, front, kind, ..., block); paths or URIs of any file system that Arrow opens and all executors reach.

    A task reads its range and takes the records that begin in it.
    """
    from pyarrow import fs

    def opened(path: str):
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("front", T.BooleanType()), *RESULT.fields])
    ranges = []
    for p in paths:
        system, inner = opened(p)
        n = system.get_file_info(inner).size
        if n is None:
            raise FileNotFoundError(p)
        ranges += [(p, s, min(s + range_bytes, n), n) for s in range(0, n, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], schema)

    def read(batches):
        for b in batches:
            for path, begin, stop, size in zip(*(c.to_pylist() for c in b.columns)):
                system, inner = opened(path)
                with system.open_input_file(inner) as f:
                    found = salvage_range(lambda at, n, f=f: f.read_at(n, at), size, begin, stop)
                    yield from _batches(((path, x[0] == "gap" and bool(x[4]), *_row(x)) for x in found), schema)

    plan = spark.createDataFrame(ranges, "path string, begin long, stop long, size long").repartition(len(ranges))
    return plan.mapInArrow(read, schema)


def whole_gaps(read: DataFrame) -> DataFrame:
    """The gaps of read_warc (file, byte_offset, byte_length, reason), without what records of the range before cover."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("byte_offset").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind") == "record", F.col("byte_offset") + F.col("byte_length"))).over(w)
    inner = F.col("byte_length") == 0  # within a member, which its records cover
    cut = F.when(inner, F.col("byte_offset")).otherwise(F.greatest(F.col("byte_offset"), F.coalesce("reach", F.lit(0))))
    end = F.col("byte_offset") + F.col("byte_length")
    return read.select("file", "kind", "byte_offset", "byte_length", "reason").withColumn("reach", reach).filter("kind = 'gap'").select("file", cut.alias("byte_offset"), (end - cut).alias("byte_length"), "reason", inner.alias("inner")).filter("byte_length > 0 OR inner").drop("inner")


def write_record(kind: str, record_id: str, uri: str, block: bytes, packed: bool = True) -> bytes:
    """A record's bytes."""
    digest = base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()
    plain = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Target-URI: {uri}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return _packed(plain) if packed else plain


def _packed(plain: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


#: What damaged_capture does to the middle record, by page.
DAMAGE = ("none", "none", "changed block", "flipped byte", "cut off", "rubbish before", "wrong length", "no magic")


def damaged_capture(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """The capture of a page: request, response and metadata records, packed or plain, damaged in a way that its id decides."""
    n = zlib.crc32(str(page_id).encode())
    how, packed, uri = DAMAGE[n % len(DAMAGE)], n // len(DAMAGE) % 4 > 0, url or ""
    first = write_record("request", f"urn:page:{page_id}:request", uri, b"GET " + uri.encode(), packed)
    middle = write_record("response", f"urn:page:{page_id}:response", uri, (html or "").encode(), packed)
    last = write_record("metadata", f"urn:page:{page_id}:metadata", uri, str(len(html or "")).encode(), packed)
    if how == "changed block":
        bad = write_record("response", f"urn:page:{page_id}:response", uri, (html or "").encode() + b".", False)
        bad = bad[:-5] + b"!" + bad[-4:]
        middle = _packed(bad) if packed else bad
    elif how == "flipped byte":
        k = len(middle) - 6 if packed else middle.index(b"Content-Length") + 14
        middle = middle[:k] + bytes([middle[k] ^ 0x15]) + middle[k + 1 :]
    elif how == "cut off":
        middle = middle[: len(middle) * 2 // 3]
    elif how == "rubbish before":
        middle = b"\x00rubbish \x1f\x8b\x08 WARC/1.1 \r\n" + middle
    elif how == "wrong length":
        bad = write_record("response", f"urn:page:{page_id}:response", uri, (html or "").encode(), False).replace(b"Content-Length: ", b"Content-Length: 9", 1)
        middle = _packed(bad) if packed else bad
    elif how == "no magic":
        middle = b"\x00\x00" + middle[2:]
    return first + middle + last


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, content): the damaged captures of all pages."""

    def write(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                content = [damaged_capture(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["page_id", "content"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(write, T.StructType([rows.schema["page_id"], T.StructField("content", T.BinaryType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recovered of the damaged captures of all pages, with the gaps."""
    read = read_contents(captures(common.table(spark, sf_dir, "pages")), "page_id")
    return read.select(F.col("file").alias("page_id"), "kind", "byte_offset", "byte_length", "reason", "record_type", "record_id", "uri", F.length("block").cast("long").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"))
