"""What a run leaves: metrics with their configuration, events, and which runs are done; JSON below one root that Spark can write to."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_digest(config: dict) -> str:
    """Twelve digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def run_path(root: str, name: str, config: dict) -> str:
    return f"{root.rstrip('/')}/{name}/{config_digest(config)}"


def _append(spark: SparkSession, path: str, row: dict) -> None:
    # as text, so that files of different fields do not clash
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def write_metrics(spark: SparkSession, root: str, name: str, config: dict, metrics: dict) -> str:
    """Write a finished run; returns its folder. A run of the same name and configuration is replaced."""
    path = run_path(root, name, config)
    row = {"name": name, "config": config, "digest": config_digest(config), "metrics": metrics}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")
    return path


def append_event(spark: SparkSession, path: str | None, event: str, **payload) -> None:
    """Add an event to the log in the folder ``path``; nothing happens without one."""
    if path is not None:
        _append(spark, path, {"event": event, **payload})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, payload as JSON text)."""
    return spark.read.text(path).select(F.get_json_object("value", "$.event").alias("event"), F.col("value").alias("payload"))


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(name, digest, metrics as JSON text) of all finished runs below ``root``; none where nothing was written."""
    try:
        rows = spark.read.text(f"{root.rstrip('/')}/*/*/metrics")
    except AnalysisException:
        rows = spark.createDataFrame([], "value string")
    return rows.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("name", "digest", "metrics")])


def open_jobs(spark: SparkSession, root: str, jobs: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Those of ``jobs`` (name, configuration) that are not finished."""
    done = {(r["name"], r["digest"]) for r in finished(spark, root).select("name", "digest").collect()}  # a row for each run
    return [(n, c) for n, c in jobs if (n, config_digest(c)) not in done]
