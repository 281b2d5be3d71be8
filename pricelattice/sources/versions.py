"""A stored panel as versions of its commodity-year partitions, with a manifest that names the current one of each.

``root/data/version=<id>/commodity=…/year=…`` holds the files, ``root/manifests/<number>`` the manifests: which version each commodity
and year is read from. A merge reads the touched pairs only (a literal predicate on partition columns), stages the merged pairs under a version
of their own, and then publishes the next manifest by renaming a finished file. Nothing that the current manifest names is ever written to, so readers
and a run that is killed at any point see the old panel or the new one, never a part. Two runs that publish the same number can't both
succeed: the loser fails and leaves the panel as it is.

A manifest has one line per commodity and year; it is read on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = ["commodity", "year"]
Manifest = dict[tuple[str | None, int | None], str]
#: Rows of a file at most; far below the 2 GB that one binaryFile row can hold.
MAX_FILE_ROWS = 5_000_000


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place, files = _place(spark, f"{root}/manifests")
    if not files.exists(place):
        return []
    return sorted(int(name) for x in files.listStatus(place) if (name := x.getPath().getName()).isdigit())


def current(spark: SparkSession, root: str) -> tuple[int, Manifest]:
    """Number of the newest manifest (0: none) and what it names."""
    numbers = _numbers(spark, root)
    if not numbers:
        return 0, {}
    place, files = _place(spark, f"{root}/manifests/{numbers[-1]:010d}")
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return numbers[-1], {(x["commodity"], x["year"]): x["version"] for x in map(json.loads, text.splitlines())}


def publish(spark: SparkSession, root: str, number: int, manifest: Manifest) -> None:
    """Make ``manifest`` the one with this number; fails when another run has published it."""
    lines = "\n".join(json.dumps({"commodity": c, "year": y, "version": v}) for (c, y), v in sorted(manifest.items(), key=str))
    staged, files = _place(spark, f"{root}/manifests/.staged-{uuid.uuid4().hex}")
    stream = files.create(staged, False)
    try:
        stream.write(bytearray(lines.encode()))
    finally:
        stream.close()
    final, _ = _place(spark, f"{root}/manifests/{number:010d}")
    if files.exists(final) or not files.rename(staged, final):
        files.delete(staged, False)
        raise RuntimeError(f"manifest {number} of {root} was published by another run; merge again")


def is_versioned(spark: SparkSession, root: str) -> bool:
    return bool(_numbers(spark, root))


def pair_of(commodity: Column, year: Column) -> Column:
    """A pair as one string, nulls included; usable in partition filters."""
    return F.concat(F.coalesce(year.cast("string"), F.lit("-")), F.when(commodity.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), commodity)))


def _named(pairs: Iterable[tuple]) -> list[str]:
    return [f"{'-' if y is None else y}{'-' if c is None else '=' + c}" for c, y in pairs]


def read(spark: SparkSession, root: str, pairs: list[tuple] | None = None) -> DataFrame | None:
    """The panel, or its given pairs, by a literal predicate on (version, commodity, year); None where no such pair is stored."""
    manifest = current(spark, root)[1]
    wanted = {p: v for p, v in manifest.items() if pairs is None or p in set(pairs)}
    if not wanted:
        return None
    parts = [f"{root}/data/version={v}" for v in sorted(set(wanted.values()))]
    kinds = {c: f"{c} {t}" for c, t in (("version", "string"), ("commodity", "string"), ("year", "int"))}
    bare = spark.read.option("basePath", f"{root}/data").parquet(*parts)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema if f.name not in kinds), *kinds.values()])
    stored = spark.read.schema(shape).option("basePath", f"{root}/data").parquet(*parts)
    names = [f"{v}/{n}" for v, n in zip(wanted.values(), _named(wanted))]
    return stored.where(F.concat("version", F.lit("/"), pair_of(F.col("commodity"), F.col("year"))).isin(names)).drop("version", "year")


def stage(rows: DataFrame, root: str) -> str:
    """Write rows as a version that nothing names yet. A commodity and year with many rows is dealt over several tasks."""
    version = uuid.uuid4().hex
    dealt = rows.withColumn("year", F.year("date")).hint("rebalance", F.col("commodity"), F.col("year"))
    dealt.write.option("maxRecordsPerFile", MAX_FILE_ROWS).partitionBy(*PAIR).parquet(f"{root}/data/version={version}")
    return version


def touched_pairs(rows: DataFrame) -> list[tuple]:
    """The (commodity, year) pairs of some rows, on the driver: one per commodity and year."""
    return [tuple(r) for r in rows.select("commodity", F.year("date").alias("year")).distinct().collect()]


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete versions and manifests that the newest manifest doesn't need; returns how many versions went. Not beside running merges."""
    number, manifest = current(spark, root)
    data, files = _place(spark, f"{root}/data")
    gone = [x.getPath() for x in files.listStatus(data) if x.getPath().getName().removeprefix("version=") not in set(manifest.values())] if files.exists(data) else []
    for place in gone:
        files.delete(place, True)
    for old in _numbers(spark, root)[:-1]:
        files.delete(_place(spark, f"{root}/manifests/{old:010d}")[0], False)
    return len(gone)
