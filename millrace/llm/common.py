"""What the corpus operators share: tables, the shared folder, word rules and batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: after A-Z are lower-cased, a longest run of these characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Text bytes that a Python worker holds at once, besides a single longer text.
BATCH_BYTES = 1 << 20
ARROW_ROWS = 1000
#: Most rows of a table of a few numbers and words that is broadcast; beyond that the same join is shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary one if all runs in this process (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing already done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small_batches(spark: SparkSession) -> None:
    """Has the session pass texts to Python workers in Arrow batches of ARROW_ROWS at most: batches of long rows fill workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to have few rows. df is to be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner removes it
        pass


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names under other ones, and what to rename back: room for an operator's own columns."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    back = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            other = f"{c}_"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            back[other] = c
    return df.withColumnsRenamed({c: other for other, c in back.items()}), back


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about `limit` bytes, at least a row each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
