"""Session and checkpoint helpers shared by jobs and tests."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyfield")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the reliable checkpoint folder that the session names.

    Only a session on one machine that names none gets one of its own, which ends with the process.
    """
    context = rows.sparkSession.sparkContext
    if not rows.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyfield-cut-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return rows.checkpoint()
