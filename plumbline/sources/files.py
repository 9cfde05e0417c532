"""Files as samples: scanning, provenance, manifests, findings and artifacts on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that operating systems leave behind.
SYSTEM_NAMES = (".ds_store", "thumbs.db", "desktop.ini", "__macosx")
PROVENANCE_COLUMNS = ("source", "license", "collector", "consent")


def scan_files(spark: SparkSession, path: str, max_bytes: int = 50_000_000, seen: DataFrame | None = None) -> DataFrame:
    """``path``, ``bytes``, ``sha256``, ``status`` and ``reason`` of all files below ``path``.

    System files and forks are ignored; files over ``max_bytes`` and paths that differ from an
    earlier one in case only are rejected. Paths in ``seen`` are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.length(F.lit(path.rstrip("/"))) + 2
    clean = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(F.substring(clean, base, F.length(clean)).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if seen is not None:
        rows = rows.join(seen.select("path"), "path", "left_anti")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ignored = name.isin(*SYSTEM_NAMES) | F.startswith(name, F.lit("._")) | F.exists(F.split(F.lower("path"), "/"), lambda p: p.isin(*SYSTEM_NAMES))
    nth = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("path"))
    reason = F.when(ignored, "system file").when(F.col("bytes") > max_bytes, "too large").when(nth > 1, "path differs in case only")
    status = F.when(ignored, "ignored").when(F.col("reason").isNotNull(), "rejected").otherwise("candidate")
    return rows.withColumn("reason", reason).withColumn("status", status)


def join_provenance(samples: DataFrame, csv: DataFrame, most: int = 500) -> DataFrame:
    """Known columns of a provenance table, trimmed and cut, joined by the path below the root, else by the full path."""
    known = [c for c in PROVENANCE_COLUMNS if c in csv.columns]
    rows = csv.dropDuplicates(["path"]).select(F.trim("path").alias("p"), *[F.substring(F.trim(c), 1, most).alias(c) for c in known])
    inner = samples.withColumn("__inner", F.regexp_replace("path", "^[^/]+/", ""))
    first = inner.join(rows.select(F.col("p").alias("__inner"), *[F.col(c).alias(f"a_{c}") for c in known]), "__inner", "left")
    both = first.join(rows.select(F.col("p").alias("path"), *[F.col(c).alias(f"b_{c}") for c in known]), "path", "left")
    return both.select(*samples.columns, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in known])


def write_findings(findings: DataFrame, audit_id: str, path: str) -> None:
    """Replace one audit's rows; running it again changes nothing."""
    rows = findings.withColumn("audit_id", F.lit(audit_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(path)


def write_manifest(samples: DataFrame, path: str) -> str:
    """Write (path, sha256, label, split) in order of path as JSON lines; return ``manifest_digest`` of the rows."""
    samples.select("path", "sha256", "label", "split").sort("path").write.mode("overwrite").json(path)
    return manifest_digest(samples).first()["digest"]


def manifest_digest(samples: DataFrame) -> DataFrame:
    """One row: ``n`` and ``digest``, the hash of the number of rows and of the sums of the parts of their hashes.

    The rows alone decide it, in whatever order they are, and nothing is gathered to compute it.
    """
    line = F.sha2(F.concat_ws("\x1f", "path", "sha256", "label", "split"), 256)
    part = lambda i: F.sum(F.conv(F.substring("line", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}")
    sums = samples.select(line.alias("line")).agg(F.count("*").alias("n"), *[part(i) for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


def integrity_check(samples: DataFrame, content: str = "text", digest: str = "raw_sha") -> DataFrame:
    """Rows, and rows whose content no longer has its digest."""
    return samples.agg(F.count("*").alias("n"), F.count_if(F.sha2(content, 256) != F.col(digest)).alias("changed"))
