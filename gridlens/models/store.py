"""Model tables in Parquet: a folder for each saved version, and a manifest that says which one counts.

The tables of a version are written first and its line in the manifest last, in one file. So a reader
sees all tables of one save or all of the one before, never some of each, and a save that stops half
way changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridlens.session import remove_dir

ANY_MODE = "any"
MANIFEST = "version string, number bigint, tables array<string>"


def _manifest(spark: SparkSession, path: str, model: str, mode: str) -> list[Row]:
    """The saved versions, the newest first; one short row a save that was not cleared."""
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{path}/{model}/{mode}/manifest")
    except AnalysisException:
        return []
    return lines.orderBy(F.desc("number"), F.desc("version")).collect()


def save_model(tables: dict[str, DataFrame], path: str, model: str, mode: str = ANY_MODE) -> str:
    """Write all tables as a new version of the model in this mode and make it the one that is read.

    Returns the version's name. Older versions stay for readers that still use them; see
    ``clear_old_versions``.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _manifest(spark, path, model, mode)
    version, number = uuid.uuid4().hex, (known[0]["number"] + 1 if known else 1)
    for name, df in tables.items():
        df.write.parquet(f"{path}/{model}/{mode}/{version}/{name}")
    line = spark.createDataFrame([(version, number, sorted(tables))], MANIFEST)
    line.coalesce(1).write.mode("append").parquet(f"{path}/{model}/{mode}/manifest")
    return version


def load_model(spark: SparkSession, path: str, model: str, mode: str,
               tables: list[str]) -> dict[str, DataFrame]:
    """Tables of the model's newest version in that mode, or else of the one saved for any mode."""
    for place in (mode, ANY_MODE):
        if versions := _manifest(spark, path, model, place):
            if missing := sorted(set(tables) - set(versions[0]["tables"])):
                raise FileNotFoundError(f"no {', '.join(missing)} of model {model!r} for mode {mode!r} in {path}")
            return {n: spark.read.parquet(f"{path}/{model}/{place}/{versions[0]['version']}/{n}") for n in tables}
    raise FileNotFoundError(f"no model {model!r} for mode {mode!r} in {path}")


def clear_old_versions(spark: SparkSession, path: str, model: str, mode: str = ANY_MODE) -> int:
    """Delete the tables of all versions but the newest; how many were deleted. Call it when no
    reader is left on them."""
    old = _manifest(spark, path, model, mode)[1:]
    for row in old:
        remove_dir(spark, f"{path}/{model}/{mode}/{row['version']}")
    return len(old)
