"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def session(name: str = "ringfold", cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine is tested with; on a cluster the submitter's own session is used."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(HERE.parent), os.environ.get("PYTHONPATH", "")) if x)
    settings = {
        "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, once for each session, unless their path already names its folder."""
    context = spark.sparkContext
    if str(HERE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_ringfold_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="ringfold-")) / "ringfold.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(HERE.rglob("*.py")):
            out.write(f, f.relative_to(HERE.parent))
        if (extra := HERE.parent / "corpus_pipeline.py").exists():
            out.write(extra, extra.name)
    context.addPyFile(str(path))
    context._ringfold_sent = True
