"""Tables written to the folder that all executors share.

An iterative operator cuts its lineage by writing each state as parquet and
reading it back: the files survive the loss of any executor, are columnar, and
the plan that made them runs once (an eager ``checkpoint()`` runs its last stage
twice). The folder is the one of ``spark.checkpoint.dir``; where a session has
none, as in tests, a temporary folder of this machine is set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = at.get() if at.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="adstrata-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back, with ``df``'s schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def observed(rows: Observation) -> dict[str, int]:
    """What an observation saw; nothing if the optimizer found the frame empty and dropped the observer with it."""
    return rows.get if rows._jo.getRow().length() else {}


def written_counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """``written`` and the number of rows, known from the same job."""
    rows = Observation()
    back = written(df.observe(rows, F.count(F.lit(1)).alias("n")), name)
    return back, observed(rows).get("n", 0)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{folder(spark)}/adstrata/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    p, fs = file_of(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place by renaming a finished one, so that a reader sees the old text or the new."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    p, fs = file_of(spark, path)
    aside, _ = file_of(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, p, how)


def file_of(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``written`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path and _made.pop(path, None) is not None:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p, fs = file_of(spark, path)
    fs.delete(p, True)


def release() -> None:
    """Delete every scratch table that is left; frames that read one can't be used afterwards."""
    for path, spark in list(_made.items()):
        _made.pop(path, None)
        try:
            delete(spark, path)
        except Exception:  # the session may be gone
            pass


atexit.register(release)
