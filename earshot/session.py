"""Session defaults for tests, benches and stand-alone runs; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "earshot", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    os.environ.setdefault("PYSPARK_PYTHON", __import__("sys").executable)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in the one that spark.checkpoint.dir names; a local session may do without."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="earshot-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, *parts: Callable[[], object]) -> list:
    """What the parts return; their jobs run at the same time. All are waited for, then the first error is raised."""
    with ThreadPoolExecutor(len(parts)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(part)) for part in parts]
    return [w.result() for w in waiting]
