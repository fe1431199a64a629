"""Operators that take several rounds over tables, each round's table written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a local session gets a temporary folder of its own, a cluster an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="framelake-"))


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: its lineage ends there, and lost executors read the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/framelake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended where ``df`` has such a column already, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def reachable(starts: DataFrame, hops: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, frame) of all frames that some start (``keys``, frame) reaches by hops (``keys``, frame, next), starts included.

    Each frame has one hop at most and hops lead forward. Hops are joined with themselves, so each round doubles the steps that one hop takes:
    as many rounds as the longest way's length has binary digits.
    """
    place = [*keys, "frame"]
    found, hop = starts.select(place).distinct(), settled(hops.select(*place, "next").where("next is not null"), "hops")
    while not hop.isEmpty():
        ahead = found.join(hop, place).select(*keys, F.col("next").alias("frame"))
        found = settled(found.union(ahead).distinct(), "reached")
        hop = settled(hop.join(hop.select(*keys, F.col("frame").alias("next"), F.col("next").alias("beyond")), [*keys, "next"]).select(*place, F.col("beyond").alias("next")), "hops")
    return found
