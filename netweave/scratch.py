"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage: a lost executor costs no more than the tasks that read it.
The folder is the cluster's ``spark.checkpoint.dir``; only a local session without one gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_leaving: set[str] = set()


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI that Spark can write to."""
    _ship(spark)
    conf = spark.sparkContext.getConf()
    app = spark.sparkContext.applicationId
    if given := conf.get("spark.checkpoint.dir"):
        if app not in _leaving:
            _leaving.add(app)
            atexit.register(_leave, spark)
        return given.rstrip("/")
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="netweave-")
        spark.sparkContext.setCheckpointDir(_local[app])
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def _ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/netweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a count of partitions is taken from the data.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` in a partition for each ``TASK_ROWS`` of about ``rows``, and not fewer than the session has, so that what a task holds does not grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def release(spark: SparkSession) -> None:
    """Delete what this application has written; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/netweave/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _leave(spark: SparkSession) -> None:
    """Delete the tables when the driver's program ends; a context that was stopped before leaves them to ``release``."""
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            release(spark)
    except Exception:  # the JVM may be gone, and the program is over anyway
        pass


def _place(df: DataFrame) -> tuple[Column, Column]:
    """The file of a row, hashed, and its place there; a column of the name ``_metadata`` does not hide them."""
    meta = df.metadataColumn("_metadata")
    return F.xxhash64(meta["file_path"]), meta["row_index"]


def is_file_scan(df: DataFrame) -> bool:
    """Whether rows of ``df`` can be named by their file and place: it reads files, and no join, explode or the like repeats their rows."""
    plan = df._jdf.queryExecution().analyzed().toString()
    steps = {re.match(r"\W*(\w*)", line)[1] for line in plan.splitlines() if line.strip()}
    if not steps <= {"Relation", "Project", "Filter", "SubqueryAlias", "ResolvedHint"}:
        return False
    try:
        df.select(*_place(df))
    except AnalysisException:
        return False
    return True


def as_files(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` itself if it reads files, else a written copy."""
    _ship(df.sparkSession)
    return df if is_file_scan(df) else materialize(df, name)


def with_row_key(df: DataFrame, name: str = "__row") -> DataFrame:
    """Add a struct that names each row by its file and its place there, the same on every read.

    Rows that do not come from files are written to the shared folder first. ``name`` must be free.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name}; pass another name for the row key")
    df = as_files(df)
    file, row = _place(df)
    return df.select("*", F.struct(file.alias("f"), row.alias("i")).alias(name))
