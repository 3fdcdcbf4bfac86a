"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the contracts' words: space and the controls 09 to 0D.
WS = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the checkpoint folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a local session (as in tests) gets a
    temporary one; on a cluster, whose executors could not read it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return f"{sc.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` has left for tables that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that a long expression is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def by_key(columns: list[str], found: Callable, key: str = "key") -> Callable:
    """For mapInArrow over rows sorted by ``key``: calls ``found`` with the columns of each key's rows (of two at least).

    It gives pairs (a, b) of longs. Rows are held as Arrow batches, one key's at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held)) > 1:
                rows = pa.concat_batches(held)
                out = np.array(found(*[rows[c] for c in columns]), np.int64).reshape(-1, 2)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        for b in batches:
            keys = b[key].to_numpy()
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y:
                    if held and keys[x] != last:
                        yield from done()
                        held = []
                    last = keys[x]
                    held.append(b.slice(x, y - x))
        if held:
            yield from done()

    return run
