"""Batches of stages: what is finished is skipped, failures are collected, outcomes are a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.sources.tables import exists


def run_stages(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], folder: str) -> DataFrame:
    """(stage, status, n_rows): each stage's table is written to folder/<stage>; one that is there is skipped, one that
    raises is failed and the others go on. The driver holds a row a stage."""
    out = []
    for name, build in stages.items():
        path = f"{folder}/{name}"
        status = "skipped" if exists(spark, path) else "done"
        if status == "done":
            try:
                build().write.parquet(path)
            except Exception:  # whatever a stage raises is its own outcome
                status = "failed"
        out.append((name, status, 0 if status == "failed" else spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "stage string, status string, n_rows long")
