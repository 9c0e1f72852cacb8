"""Readiness checks as rows: name, status (ok, fail, skip), detail. A crash is a failure of its check alone."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching
from ..session import scratch
from . import insights

SCHEMA = "name string, status string, detail string, seconds double"
#: Settings that an analysis with remote sources and models needs.
REQUIRED = ("YOUTUBE_API_KEY", "OPENROUTER_API_KEY", "DATABASE_URL")


class Skip(Exception):
    """Raised by a check that can't be made here."""


def missing_settings(required: tuple[str, ...] = REQUIRED, environment=os.environ) -> list[str]:
    return [name for name in required if not environment.get(name)]


#: What the probes of models send.
SAMPLE = ("Please make a second part about this", "I got lost after the second step, how does it work?")


def probes(spark: SparkSession, *, sentiment=None, intent=None, embedder=None, write=None, width: int | None = None, environment=os.environ) -> dict[str, Callable[[], str]]:
    """Checks of the seams of an analysis, for run_checks(): settings, the store, and a call to each model. A model that isn't given is skipped."""

    def settings() -> str:
        missing = missing_settings(environment=environment)
        if missing:
            raise ValueError("not set: " + ", ".join(missing))
        return f"{len(REQUIRED)} set"

    def store() -> str:
        path = scratch(spark, "preflight")
        spark.range(1).write.parquet(path)
        if [r[0] for r in spark.read.parquet(path).collect()] != [0]:  # the row just written
            raise ValueError("what was written isn't what is read")
        return "written and read again"

    def given(model):
        if model is None:
            raise Skip("no model given")
        return model

    def labels(kind: str, model) -> str:
        found = batching.label_batch(given(model), kind, list(enumerate(SAMPLE)), deepest=0)
        return f"{len(found)} valid labels"

    def drafts() -> str:
        for kind in ("request", "confusion", "mood"):
            if insights.checked_draft(kind, given(write)(kind, list(SAMPLE)), list(SAMPLE)) is None:
                raise ValueError(f"no valid {kind} draft with verbatim quotes")
        return "3 valid drafts"

    def vectors() -> str:
        widths = {len(v) for v in batching.ordered_vectors(given(embedder).embed(list(SAMPLE)), len(SAMPLE))}
        if len(widths) != 1 or width not in (None, *widths):
            raise ValueError(f"vectors of {sorted(widths)} numbers" + (f", not {width}" if width else ""))
        return f"{len(SAMPLE)} vectors of {widths.pop()}"

    return {
        "settings": settings, "store": store, "sentiment model": lambda: labels("sentiment", sentiment), "intent model": lambda: labels("intent", intent),
        "synthesis": drafts, "embeddings": vectors,
    }


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], str]]) -> DataFrame:
    rows = []
    for name, check in checks.items():
        began = time.perf_counter()
        try:
            status, detail = "ok", check()
        except Skip as e:
            status, detail = "skip", str(e)
        except Exception as e:  # noqa: BLE001
            status, detail = "fail", f"{type(e).__name__}: {e}"
        rows.append((name, status, detail, time.perf_counter() - began))
    return spark.createDataFrame(rows, SCHEMA)


def summary(report: DataFrame) -> DataFrame:
    """ready only if nothing failed and nothing was skipped."""
    return report.agg(F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "skip").alias("skipped"), F.bool_and(F.col("status") == "ok").alias("ready"))


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("name", "status", "detail")).alias("line"))


def table_checks(table: DataFrame, *, key: str, domains: dict[str, list] | None = None, width: tuple[str, int] | None = None) -> DataFrame:
    """One row for each check of a table, in one pass: unique keys, label domains, vector width."""
    bad: dict[str, Column] = {f"{c} in its domain": ~F.coalesce(F.col(c).isin(values), F.lit(False)) for c, values in (domains or {}).items()}
    if width:
        bad[f"{width[0]} of {width[1]}"] = F.size(width[0]) != width[1]
    bad[f"{key} is there"] = F.col(key).isNull()
    counted = table.agg(*(F.count_if(c).alias(n) for n, c in bad.items()))
    repeated = table.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"{key} is unique"))
    both = counted.crossJoin(repeated)  # one row each
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("violations")) for n in both.columns)))
    return both.select(rows.alias("r")).select("r.name", "r.violations", F.when(F.col("r.violations") == 0, "ok").otherwise("fail").alias("status"))


def render(report: DataFrame) -> DataFrame:
    """Report rows as display lines, everything from outside escaped."""
    from ..functions import text as X

    quotes = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("> "), X.escape_markdown(q))), "\n")
    head = F.concat(F.lit("### "), X.escape_markdown(F.col("headline")), F.lit(" ("), F.col("mention_count").cast("string"), F.lit(")\n"))
    return report.select("kind", "group", F.concat(head, quotes).alias("markdown"))
