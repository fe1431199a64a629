"""Gives executors this package, for sessions whose Python workers can't import it from their own path."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the session's executors, once an application; the driver serves them, executors need no folder of its."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        home, archive = Path(__file__).parent, Path(tempfile.mkdtemp(prefix="framelake-")) / "framelake_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(home.rglob("*.py")):
                out.write(source, source.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SENT.add(app)
    return spark


def shipping(query):
    """The query, with the package sent before it runs."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(shipped(spark), sf_dir)

    return run
