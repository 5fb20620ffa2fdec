"""Session helpers shared by every operator: table access, lineage cuts, size checks."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``.  Where it names none, a folder of
    our own is set on one machine only; on a cluster it would not be shared, so that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "hanloom-checkpoint"))
    return df.checkpoint(eager)


def keep(df: DataFrame) -> DataFrame:
    """Persist ``df`` until ``release`` is called for its session; storage may spill to disk."""
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_hanloom_kept"):
        context._hanloom_kept = []
    kept = df.persist()
    context._hanloom_kept.append(kept)
    return kept


def release(spark: SparkSession) -> int:
    """Unpersist all that operators have kept, once their results have been read; gives how many there were."""
    kept = getattr(spark.sparkContext, "_hanloom_kept", [])
    for df in kept:
        df.unpersist()
    spark.sparkContext._hanloom_kept = []
    return len(kept)


def build_session(app: str = "hanloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is written for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_hanloom_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="hanloom-ship-")) / "hanloom_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    context._hanloom_shipped = True
