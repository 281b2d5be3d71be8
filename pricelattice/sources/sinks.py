"""Writers: panel upsert, ledgers, snapshots with checksums and their verification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import readiness as rd
from ..operators.coverage import commodity_scope_table
from ..operators.normalize import ensure_market_id
from ..operators.panel import merge_market_daily
from ..session import cut_lineage
from ..spec import ReadinessPolicy, SelectionPolicy
from . import versions
from .readers import path_exists

DATA = "data"
#: Files of up to this many bytes are read as one value; larger ones pass by in pieces (Spark refuses values of 2 GB).
WHOLE_FILE = 64 << 20
BOM = b"\xef\xbb\xbf"


def write_panel(panel: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Panel as Parquet by commodity and year, so commodity and date predicates prune files."""
    out = panel.withColumn("year", F.year("date")).hint("rebalance", F.col("commodity"), F.col("year"))
    out.write.option("maxRecordsPerFile", versions.MAX_FILE_ROWS).partitionBy("commodity", "year").mode(mode).parquet(path)


def upsert_panel(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Merge into a stored panel of versions (``sources/versions.py``): only the commodity-year pairs that receive rows are scanned
    and written, beside the current ones, and one rename of a manifest makes them current."""
    incoming = cut_lineage(incoming)
    pairs = versions.touched_pairs(incoming)
    number, manifest = versions.current(spark, path)
    if pairs:
        version = versions.stage(merge_market_daily(versions.read(spark, path, pairs), incoming, look=False), path)
        versions.publish(spark, path, number + 1, manifest | dict.fromkeys(pairs, version))
    merged = versions.read(spark, path)
    return incoming if merged is None else merged


def write_result(df: DataFrame, folder: str, name: str) -> None:
    """One result table; tables that carry a commodity are partitioned by it."""
    w = df.write.mode("overwrite")
    (w.partitionBy("commodity") if "commodity" in df.columns else w).parquet(f"{folder}/{name}")


def _stream_digests(skip_unreadable: bool):
    """Rows ``key, size, piece`` (a file's pieces in order, each with a line feed behind it) to ``key, sha256``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, n, hashes = None, 0, 0, ()

        def ended() -> pa.RecordBatch:
            # Spark drops a byte-order mark and doesn't tell whether the last line ended in a line feed: the file's length does
            lacks = size - (n - 1)
            if lacks not in (0, 1, 3, 4) and not skip_unreadable:
                raise OSError(f"a file of {size} bytes gave {n - 1}")
            found = [] if lacks not in (0, 1, 3, 4) else [hashes[lacks >= 3]]
            if lacks in (1, 4):
                found[0].update(b"\n")
            return pa.RecordBatch.from_pydict({"key": pa.array([key] * len(found), pa.int64()), "sha256": pa.array([h.hexdigest() for h in found], pa.string())})

        for batch in batches:
            keys, sizes = batch.column("key").to_numpy(), batch.column("size").to_numpy()
            pieces = batch.column("piece").cast(pa.large_binary())
            ends, data = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1], memoryview(pieces.buffers()[2] or b"")
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)]).tolist()
            for first, last in zip(starts, [*starts[1:], len(keys)]):
                if keys[first] != key:
                    if key is not None:
                        yield ended()
                    key, size, n, hashes = int(keys[first]), int(sizes[first]), 0, (hashlib.sha256(), hashlib.sha256(BOM))
                for h in hashes:
                    if n:
                        h.update(b"\n")
                    h.update(data[ends[first]:ends[last] - 1])
                n += int(ends[last] - ends[first])
        if key is not None:
            yield ended()
    return run


def _digests(spark: SparkSession, folder: str, keep: str = "*", skip_unreadable: bool = False) -> DataFrame:
    """(path, sha256, bytes) of every file below a folder, or of one file, with whole paths.

    SHA-256 is a chain over a file's bytes, so a file is one task's. Up to ``WHOLE_FILE`` bytes it is one value there. A larger one is read line
    by line (any bytes are lines): a codec that passes bytes on keeps Spark from splitting it, and the pieces are hashed as they come by.
    """
    def scan(kind: str, **options):
        return spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=keep, ignoreCorruptFiles=skip_unreadable, **options).load(folder)

    raw = scan("binaryFile")
    small = raw.where(F.col("length") <= WHOLE_FILE).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = raw.where(F.col("length") > WHOLE_FILE).select("path", F.col("length").alias("bytes"), F.xxhash64("_metadata.file_path").alias("key"))
    def ending(path: str):
        name = F.element_at(F.split(path, "/"), -1)
        return F.when(name.contains("."), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise(name)

    # Hadoop's constant: its shaded client has another name for the option
    passes = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    found = raw.where(F.col("length") > WHOLE_FILE).select(ending("path").alias("end"), ending("_metadata.file_path").alias("coded"))
    for end, coded in sorted(map(tuple, found.distinct().collect())):
        codec = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", passes.OPT_EXTENSION: end}
        lines = scan("text", lineSep="\n", **codec).where((F.col("_metadata.file_size") > WHOLE_FILE) & F.col("_metadata.file_name").endswith(coded))
        pieces = lines.select(F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("size"),
                              F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("piece"))
        told = large.where(ending("path") == end).join(pieces.mapInArrow(_stream_digests(skip_unreadable), "key bigint, sha256 string"), "key", "left")
        told = told.where("sha256 is not null") if skip_unreadable else told.withColumn("sha256", F.coalesce("sha256", F.raise_error(F.concat("path", F.lit(" was not read")))))
        small = small.unionByName(told.select("path", "sha256", "bytes"))
    return small


def file_hashes(spark: SparkSession, folder: str, keep: str = "*", skip_unreadable: bool = False) -> DataFrame:
    """(path, sha256, bytes) of every file below a folder; one file per row, hashed on the executors.

    ``skip_unreadable`` leaves out files that the file system itself refuses to read, for verification only.
    """
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    # paths relative to the folder, so a snapshot can be moved
    rel = F.element_at(F.split(F.col("path"), root + "/", 2), 2)
    return _digests(spark, folder, keep, skip_unreadable).select(rel.alias("path"), "sha256", "bytes").where(
        ~F.element_at(F.split("path", "/"), -1).rlike(r"^(_SUCCESS|\..*)$"))


def append_provenance(spark: SparkSession, ledger: str, source: str, tier: str, rows: int, raw_path: str | None = None, note: str = "") -> None:
    """Append one ingest record with the hashes of the raw files."""
    one = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("recorded_at_utc"),
                                F.lit(source).alias("source"), F.lit(tier).alias("source_tier"), F.lit(rows).cast("bigint").alias("rows"),
                                F.lit(raw_path or "").alias("raw_path"), F.lit(note).alias("note"))
    if raw_path and path_exists(spark, raw_path):
        digest = _digests(spark, raw_path).select("path", F.col("sha256").alias("h"))
        # one digest over the sorted per-file digests of the raw input
        one = one.withColumn("raw_sha256", digest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).scalar())
    else:
        one = one.withColumn("raw_sha256", F.lit(""))
    one.coalesce(1).write.mode("append").json(ledger)


def append_job_ledger(outcomes: DataFrame, ledger: str) -> None:
    """Append (job_key, status, row_count, error) rows; failures stay on record beside successes."""
    outcomes.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(ledger)


def write_selection_report(panel: DataFrame, folder: str, policy: SelectionPolicy = SelectionPolicy()) -> None:
    table = commodity_scope_table(panel, policy)
    table = table.withColumn("policy", F.lit(json.dumps(asdict(policy), sort_keys=True)))
    table.write.mode("overwrite").parquet(f"{folder}/commodity_scope_selection")


def freeze_scope(spark: SparkSession, prices: DataFrame, markets: DataFrame | None, weather: DataFrame | None, commodities: list[str],
                 start: str, end: str, target: str, policy: ReadinessPolicy = ReadinessPolicy(), allow_demo: bool = False,
                 label: str = "") -> DataFrame:
    """Snapshot of one scope: panel, its markets, its weather, readiness, manifest and the manifest's own digest.

    Refuses a blocked scope, an empty one and an existing target. Returns the manifest.
    """
    if path_exists(spark, target):
        raise FileExistsError(target)
    gates = cut_lineage(rd.readiness_gates(rd.readiness_summary(prices, markets, weather, commodities, start, end), policy))
    status = rd.readiness_status(gates).first()
    if status["readiness"] == "BLOCKED" and not allow_demo:
        raise ValueError("freeze blocked by gate(s): " + status["failed_gates"])
    scope = cut_lineage(rd.in_scope(prices, commodities, start, end))
    if scope.isEmpty():
        raise ValueError("selected scope holds no observations")
    data = f"{target}/{DATA}"
    write_panel(scope, f"{data}/market_daily")
    ids = rd.used_markets(scope)
    if markets is not None:
        m = ensure_market_id(markets)
        rest = [c for c in m.columns if c != "market_id"]
        m = m.join(ids, "market_id", "left_semi").groupBy("market_id").agg(F.min(F.struct(*rest)).alias("m")).select("market_id", "m.*")
        m.write.parquet(f"{data}/markets")
    if weather is not None:
        w = ensure_market_id(weather).withColumn("date", F.to_date("date")).join(ids, "market_id", "left_semi")
        w = w.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        w.write.option("maxRecordsPerFile", versions.MAX_FILE_ROWS).parquet(f"{data}/weather_daily")
    gates.write.json(f"{data}/readiness")
    manifest = file_hashes(spark, data).withColumns({
        "label": F.lit(label), "readiness": F.lit(status["readiness"]), "start_date": F.lit(start), "end_date": F.lit(end),
        "commodities": F.lit(",".join(commodities))})
    manifest.write.parquet(f"{target}/manifest")
    file_hashes(spark, f"{target}/manifest").write.json(f"{target}/manifest_digest")
    return spark.read.parquet(f"{target}/manifest")


def _compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    e = expected.select("path", F.col("sha256").alias("expected"))
    a = actual.select("path", F.col("sha256").alias("actual"))
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
              .when(F.col("expected") != F.col("actual"), "mismatch").otherwise("ok"))
    return e.join(a, "path", "full_outer").select("path", status.alias("status"), "expected", "actual")


def verify_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """(path, status, expected, actual) for every data file and every manifest file.

    Status is ok, mismatch, missing (or refused by the file system's own checksum), unlisted (extra data file) or no digest (manifest file nobody vouches for).
    """
    if not path_exists(spark, f"{target}/manifest"):
        return spark.createDataFrame([("manifest", "missing", None, None)], "path string, status string, expected string, actual string")
    # checksums are the point here, so read the manifest's own digest before trusting the manifest
    own = file_hashes(spark, f"{target}/manifest", skip_unreadable=True)
    if path_exists(spark, f"{target}/manifest_digest"):
        digest = spark.read.schema("path string, sha256 string, bytes bigint").json(f"{target}/manifest_digest")
    else:
        digest = spark.createDataFrame([], "path string, sha256 string, bytes bigint")
    meta = _compare(digest, own).withColumns({
        "path": F.concat(F.lit("manifest/"), F.col("path")),
        "status": F.when(F.col("status") == "unlisted", "no digest").otherwise(F.col("status"))})
    files = _compare(spark.read.parquet(f"{target}/manifest"), file_hashes(spark, f"{target}/{DATA}", skip_unreadable=True))
    return meta.unionByName(files)


def snapshot_ok(check: DataFrame) -> bool:
    """True when every listed file is intact; files nobody listed do not count against a snapshot."""
    return check.where(~F.col("status").isin("ok", "unlisted")).isEmpty()


def write_result_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of a result folder, stored beside it."""
    file_hashes(spark, folder).write.mode("overwrite").json(folder.rstrip("/") + "_manifest")
    return spark.read.json(folder.rstrip("/") + "_manifest")
