"""What the operators of this subpackage share: reading tables, cutting lineage, shared storage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import shared_folder

#: White space of the word and text contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables that materialise wrote, once all that was made of them has been written itself."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release_memory() -> None:
    """Give back to the system what this Python worker has freed: workers are used again, so what the allocators of
    one stage keep would stand beside the memory of the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def open_shared(uri: str):
    """A seekable file of the shared folder, by any URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return store.open_input_file(path)
