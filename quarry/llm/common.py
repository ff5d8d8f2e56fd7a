"""What several operators share: reading tables, durable intermediate tables, Arrow maps."""

from __future__ import annotations

import atexit
import functools
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words and is stripped from lines: [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where nothing names one, a local session gets a folder beside its warehouse;
    on a cluster that could be one machine's disk, so there it is an error.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.steps-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, made.removeprefix("file:"), ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by durable() that no later step reads."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replacing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add under the same names (in any case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with more columns, their types as in SQL; df's own schema stays as it is."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns.items())])


def let(c: Column, f) -> Column:
    """f of c, which is made once however often f names it."""
    return F.transform(F.array(c), f)[0]


def running(lengths: Column) -> Column:
    """The sums of all lengths before each place, in blocks of about the square root of their number."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    block = lambda l: F.greatest(F.ceil(F.sqrt(F.size(l))).cast("int"), F.lit(1))
    sums = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m["l"]) - 1) / m["b"]).cast("int")), lambda j: add(F.slice(m["l"], j * m["b"] + 1, m["b"])))
    before = lambda m, i: add(F.slice(m["s"], 1, F.floor(i / m["b"]).cast("int"))) + add(F.slice(m["l"], F.floor(i / m["b"]).cast("int") * m["b"] + 1, i % m["b"]))
    with_block = lambda l: let(F.struct(l.alias("l"), block(l).alias("b")), lambda m: let(F.struct(m["l"].alias("l"), m["b"].alias("b"), sums(m).alias("s")), lambda k: F.transform(k["l"], lambda _, i: before(k, i))))
    return let(lengths, with_block)


#: What one Arrow batch may hold, and what Spark's own limits are.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": (8 << 20, ("67108864", "64MB", "67108864b")), "spark.sql.execution.arrow.maxRecordsPerBatch": (4096, ("10000",))}


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of 8 MB instead of 64, where the session leaves it at that: buffers of that size are held twice a task outside the heap."""
    for key, (most, usual) in BATCH.items():
        if spark.conf.get(key, usual[0]) in usual and not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(most))


#: Bytes of text, and rows, that a map over Arrow batches turns into Python values at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of a text column (a row that is longer stands alone)."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def tidy(function):
    """A map over Arrow batches that gives its memory back at the end; a worker that is used again would keep it."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        release_memory()

    return run


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)
