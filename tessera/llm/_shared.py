"""What the training-data operators share: reading tables, the shared folder, text blocks for Arrow workers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into objects at once, and bytes to an Arrow batch if the session has no own wish.
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, once the session sends texts to workers in small batches; a size set by its owner stays."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, None) in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT), "64m", "64MB"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session may go without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing.

    The files live as long as the folder does; results may read them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.startswith((shared_root(spark), "file:" + shared_root(spark).removeprefix("file://"), "file://" + shared_root(spark).removeprefix("file://"))):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans nobody holds any more, between rounds of one operator."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs folded into one column `row`, and further columns beside it: whatever docs' columns are called, none can
    clash with a name of an operator's own. `select("row.*")` gives them back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty, under a name of its own."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def as_bytes(texts: pa.Array) -> pa.Array:
    """An Arrow column of text as bytes, which need not be UTF-8; nothing is copied."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def id_text(column: str = "doc_id") -> Column:
    """The id as text, null as empty; what crc32 folds are taken from."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most about `most` bytes in the given column of bytes or text, with that column as a
    list of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        col = col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else as_bytes(col)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        at = np.searchsorted(np.cumsum(sizes) - sizes, np.arange(0, sizes.sum() + 1, most))
        cuts = np.unique(np.concatenate([at, [0, batch.num_rows]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(lo), int(hi - lo)), [x or b"" for x in col.slice(int(lo), int(hi - lo)).to_pylist()]
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the system: workers live on, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def count_by_partition(df: DataFrame) -> int:
    """Rows of df, by a native count."""
    return df.agg(F.count(F.lit(1))).first()[0]
