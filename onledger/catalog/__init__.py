"""Registry: query name -> Spark job and, where SQL can express it, the DuckDB statement it must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from onledger.bindings import Tables, duck

GROUPS = ("io", "decoding", "filters", "joins", "aggregates", "windows", "sorting", "wallets", "attribution", "evidence",
          "followers", "portfolio", "quality", "streams")


@dataclass(frozen=True)
class Entry:
    name: str
    job: Callable[[Tables], DataFrame]
    check: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, check: str | None = None):
    def wrap(job):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, job, duck(check) if check else None)
        return job

    return wrap


def load() -> dict[str, Entry]:
    for group in GROUPS:
        importlib.import_module(f"onledger.catalog.{group}")
    return ENTRIES


def run(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.job(Tables(spark, sf_dir))

    call.__name__ = entry.name
    return call
