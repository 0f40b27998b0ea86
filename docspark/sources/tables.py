"""Tables in the folder that driver and executors share, and newline-delimited JSON."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a local session can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-docspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docspark-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and its size is known."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Documents of newline-delimited JSON; blank lines are skipped. With a schema, one pass; without, it is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """Documents of mixed shape: one VARIANT column `doc`; extract typed fields with try_variant_get."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("doc"))


def canonical_json(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON with its keys in order, at all levels; null fields stay."""
    from docspark.functions.canonical import canonical

    return df.select(canonical(df).alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    canonical_json(df).write.mode("overwrite").text(path)


BUNDLE_VERSION = 1


def write_bundle(collections: dict[str, DataFrame], path: str, version: str = "dev") -> dict:
    """An artifact bundle: each collection as canonical NDJSON (portable) and as Parquet (fast), and a manifest of their
    row counts and checksums. Returns the manifest."""
    spark = next(iter(collections.values())).sparkSession
    entries = {}
    for name, df in sorted(collections.items()):
        write_ndjson(df, f"{path}/portable/{name}")
        df.write.mode("overwrite").parquet(f"{path}/fast/{name}")
        entries[name] = {"schema": df.schema.jsonValue(), **_checked(canonical_json(spark.read.parquet(f"{path}/fast/{name}")))}
    manifest = {"layout": BUNDLE_VERSION, "version": version, "collections": entries, "totals": {"collections": len(entries), "documents": sum(e["documents"] for e in entries.values())}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str, required: str | None = None) -> dict[str, DataFrame]:
    """The collections of a bundle: the fast copy where its checksum is the manifest's, else the portable one; raises if
    neither is, or if the bundle's version isn't the required one."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["layout"] != BUNDLE_VERSION or required is not None and manifest["version"] != required:
        raise ValueError(f"incompatible bundle: version {manifest['version']}, layout {manifest['layout']}")
    out = {}
    for name, entry in manifest["collections"].items():
        wanted, schema = {k: entry[k] for k in ("documents", "checksum")}, T.StructType.fromJson(entry["schema"])
        for read in (lambda n=name: spark.read.parquet(f"{path}/fast/{n}"), lambda n=name, s=schema: read_ndjson(spark, f"{path}/portable/{n}", s)):
            try:
                df = read()
                if _checked(canonical_json(df)) == wanted:
                    out[name] = df
                    break
            except (AnalysisException, PySparkException):
                continue  # a copy that can't be read: the next one is tried
        if name not in out:
            raise ValueError(f"bundle {path}: no copy of {name} has the manifest's checksum")
    return out


def _checked(lines: DataFrame) -> dict:
    """Row count and a checksum that doesn't depend on the rows' order: the sum of their 64-bit hashes, in hexadecimal."""
    n, total = lines.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first()
    return {"documents": n, "checksum": f"{int(total or 0) % 2**64:016x}"}
