"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text read as empty; other columns cannot clash with ours."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not own:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="folioframe-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def batches_by_bytes(it: Iterator[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of one piece stays near `limit` bytes (one row at least)."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


#: What empties the caches that operators keep in a worker from task to task.
CACHES: list[Callable[[], None]] = []


def give_back() -> None:
    """Drop what other operators' tasks have left in this worker, and return freed memory that the allocators kept to the system."""
    for clear in CACHES:
        clear()
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def relieve_driver(spark: SparkSession) -> None:
    """Return memory that the driver has freed to the system: its JVM's heap, what the C library keeps of that JVM's planning and compiling, and its Python's.

    Dropped shuffles and broadcasts go with the collection too.
    """
    gc.collect()
    trim()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # JVMs before 17.0.9 and on other systems have no such command
        given, kinds, args = array(jvm.java.lang.Object, 1), array(jvm.java.lang.String, 1), array(jvm.java.lang.Object, 4)
        given[0], kinds[0] = array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        for i, x in enumerate((jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", given, kinds)):
            args[i] = x
        # by the interface's method: the server's own class is not open to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def offsets_of(strings: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, from 0."""
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    raw = np.frombuffer(strings.buffers()[1], dtype=np.int64 if wide else np.int32)
    part = raw[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return part


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, joined, and the offsets in them."""
    at = offsets_of(strings)
    data = strings.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: A key is hot if it holds more than one row in so many, so fewer keys than this are hot.
HOT = 4096


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: Column, total: int) -> DataFrame:
    """Inner join on `keys`, unique in `right`; `rows` says how many rows of `left` a key holds, of `total` at least.

    The hot keys, fewer than HOT of them, are broadcast, so their rows stay where they are; only the others are shuffled.
    """
    hot = rows * F.lit(HOT) > F.lit(total)
    marked = left.join(F.broadcast(right.filter(hot).withColumn("__hot", F.lit(True))), keys, "left")
    stay = marked.filter("__hot").drop("__hot")
    move = marked.filter(F.col("__hot").isNull()).select(*left.columns).join(right.filter(~hot), keys)
    return stay.unionByName(move)


def hex64(column: Column) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place; FOLIOFRAME_TOKENIZERS overrides the installed package."""
    own = os.environ.get("FOLIOFRAME_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared checkpoint folder, read back; removed when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_drop_tables)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


def _drop_tables() -> None:
    for spark, path in _tables:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has gone; the folder is the cluster's to clean
            return
