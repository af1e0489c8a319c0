"""What every operator needs: reading a table, a registry of queries, state kept by a Python worker, cutting of lineage."""

from __future__ import annotations

import os
import sys
import tempfile
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def kept(key: object, build: Callable[[], Any]) -> Any:
    """A value that a Python worker builds once and keeps from task to task.

    Functions reach the workers by value, so a global of this package would start anew with each task.
    """
    store = sys.modules.setdefault("_corpusloom_kept", types.ModuleType("_corpusloom_kept")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from it, so no lost executor makes them anew.

    The folder is `spark.checkpoint.dir` of the session; where it is unset, as in tests on one machine, a folder of this process.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getpid()}"))
    return df.checkpoint(eager=True)


class Registry:
    """Queries by name, each with the SQL that must give the same rows, where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


#: The registry of everything outside the subpackage for language-model data.
CORE = Registry()
