"""The package itself, sent to executors that could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless workers find it by their path or working folder."""
    path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if _ROOT in path or Path.cwd() == _ROOT or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="lodeseek-code-")) / "lodeseek.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((_ROOT / "lodeseek").rglob("*.py")):
            z.write(file, file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
