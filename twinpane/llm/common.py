"""What the operators share: tables, the shared scratch folder, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session may leave it unset (tests); it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = getattr(spark, "_twinpane_dir", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="twinpane-")
        spark._twinpane_dir = held
    return held


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/twinpane/{name}-{uuid.uuid4().hex}"


#: Hadoop sets the mode of each local file, its checksum file and its folder by a `chmod` process, and until such a child
#: runs its own program, it counts the whole memory of its JVM again. Plain files spare the checksum files; Parquet's own
#: checksums, of every page, are verified instead. Folders of other schemes ignore the options of PLAIN_FILES.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: it cuts lineage, survives lost executors and has a known size."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).options(**VERIFIED).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


BATCH_BYTES = 4 << 20


def table_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers, unless the session sets its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in {x[0] for x in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """The function of a task's batches, which gives memory back when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


BITMAP_BITS = 1 << 26


def marked(df: DataFrame, keys: DataFrame, by: list[str], into: str) -> DataFrame:
    """df with a boolean column: false where no row of keys has these values (nulls are values), else true, or rarely true.

    The test is a bitmap of hashes, built by executors: at most BITMAP_BITS / 8 bytes, whatever the size of keys. So
    rows that can't match need no shuffle; an exact join decides the rest.
    """
    place = F.pmod(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by)), F.lit(BITMAP_BITS))
    spots = keys.select(place.alias("at"))
    held = spots.groupBy(F.bitmap_bucket_number("at").alias("_bm_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bm_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bm_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    looked = df.withColumn("_bm_at", F.bitmap_bucket_number(place)).join(F.broadcast(held), F.col("_bm_at") == F.col("_bm_bucket"), "left")
    return looked.withColumn(into, hit).drop("_bm_at", "_bm_bucket", "_bm_bits")


def map_arrow(df: DataFrame, over: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    @trimmed
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from over(batch)

    return df.mapInArrow(run, schema)


def crc_fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as the text ''."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))) % modulus


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df but those that the operator is about to add; clashing input columns give way."""
    return [c for c in df.columns if c not in names]
