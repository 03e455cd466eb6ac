"""Pieces shared by the training-data operators: tables, shared storage, keep-decisions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

ZSTD_LEVEL = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode may leave it unset: it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cohortloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Tables that lazy results may still read; those that nobody released go when the driver ends.
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _made[:]:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # Spark may be gone by now
                release(spark, path)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: a plan cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made[:] = [m for m in _made if m[1] != path]


def normalized(text: Column) -> Column:
    """Lower case, every run of characters that are neither letters nor digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


NORMALIZED_SQL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def input_bytes(df: DataFrame) -> int:
    """The bytes that df is made from: what its files have by the optimizer's statistics, no job; a plan on rows
    of unknown size (which the optimizer takes for endless) is measured once, at half its strings' bytes, as if stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    each = [leaves.apply(i) for i in range(leaves.size())]
    if not any(leaf.getClass().getSimpleName() == "LogicalRDD" for leaf in each):
        return sum(int(str(leaf.stats().sizeInBytes())) for leaf in each)
    width = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema]
    total = width[0]
    for w in width[1:]:
        total = total + w
    return int(df.agg(F.sum(total.cast("long")).alias("n")).first()["n"] or 0) // 2


def parts(df: DataFrame, bytes_each: int) -> int:
    """How many parts of about bytes_each make up df."""
    return max(1, min(2**20, -(-input_bytes(df) // bytes_each)))


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of df's texts: the session's number, and no fewer than one for each 8 MB as stored."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(df, 8 << 20))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_field(df: DataFrame, id_col: str, name: str = "doc_id") -> T.StructField:
    return T.StructField(name, df.schema[id_col].dataType, True)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id and 64 bits of the text."""
    return [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__th")]


def apply_decisions(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that decisions (__id, __th, __keep) don't drop, with docs' own columns.

    Rows without a decision stay as they are. Of identical rows with __keep one stays. One shuffle of
    docs at most: the window has the join's partitioning.
    """
    cid, cth, ckeep, crn, cdid, cdth = fresh(docs, "cl_id", "cl_th", "cl_keep", "cl_rn", "cl_did", "cl_dth")
    left = docs.withColumns({cid: F.col(f"`{id_col}`"), cth: F.xxhash64(F.col(f"`{text_col}`"))})
    right = decisions.select(F.col("__id").alias(cdid), F.col("__th").alias(cdth), F.col("__keep").alias(ckeep))
    joined = left.join(right, left[cid].eqNullSafe(right[cdid]) & (left[cth] == right[cdth]), "left")
    joined = joined.filter(F.col(ckeep).isNull() | F.col(ckeep))
    w = Window.partitionBy(cid, cth).orderBy(F.lit(1))
    ranked = joined.withColumn(crn, F.when(F.col(ckeep), F.row_number().over(w)).otherwise(1))
    return ranked.filter(F.col(crn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of an undirected edge table (a, b), and its path; a component's name is its least node.

    Each round takes the least label around every node and then jumps along labels, so rounds grow with the
    logarithm of the longest chain; every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edges_path = materialize(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels, path = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("up"))
        stepped = better.join(up, "now", "left").select("node", "was", F.least("now", F.coalesce("up", "now")).alias("component"))
        stepped, new = materialize(stepped, "labels")
        changed = not stepped.filter("component <> was").isEmpty()
        release(spark, path)
        labels, path = stepped.select("node", "component"), new
        if not changed:
            release(spark, edges_path)
            return labels, path


def trim() -> None:
    """Give memory that a worker has freed back to the system: the next task may run beside others of more need."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimming(f):
    """f (of one or two Arrow tables) and trim() after it."""

    def one(t):
        out = f(t)
        trim()
        return out

    def two(t, u):
        out = f(t, u)
        trim()
        return out

    return two if f.__code__.co_argcount == 2 else one  # applyInArrow looks at the arguments


def _pack(batches):
    import numpy as np
    import pyarrow as pa

    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for b in batches:
        if not b.num_rows:
            continue
        chunk = b.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0])
        cells, kept = [], []
        for i, j in zip(at, np.r_[at[1:], len(order)]):
            part = b.take(pa.array(order[i:j])).select([1, 2])
            for k in range(0, part.num_rows, 1024):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part.slice(k, 1024))
                cells.append(sink.getvalue().to_pybytes())
                kept.append(chunk[order[i]])
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(cells, pa.binary())], names=["chunk", "packed"])


def laid_out(rows: DataFrame, n: int) -> DataFrame:
    """(chunk, packed) of rows (chunk, doc_id, text), in n partitions by chunk; each cell holds a batch's rows of a chunk, compressed together."""
    return rows.mapInArrow(_pack, "chunk long, packed binary").repartition(n, "chunk")


def unpacked(t):
    """The (doc_id, text) tables of a chunk's cells, one by one."""
    import pyarrow as pa

    for cell in t.column("packed"):
        yield pa.ipc.open_stream(cell.as_buffer()).read_all()
