"""Writing tables: never over existing ones, with order-free checksums."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that driver and executors share; only a session on this machine alone may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumbung-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, wherever it is, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def write_csv_folder(df: DataFrame, path: str, by: str) -> None:
    """One CSV file, all cells quoted, in a folder ``by``=value for each value; rows as they are sorted within their task (SK2 for many files)."""
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    df.write.mode("errorifexists").partitionBy(by).options(**options).csv(path)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet, snappy; an existing path is an error (SK1, SK3)."""
    df.write.mode("errorifexists").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    """One utf-8 CSV file with a byte-order mark and LF ends, made row by row on the driver; returns its sha256 (SK2)."""
    import csv

    with open(path, "x", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_json(values: dict, path: str) -> None:
    with open(path, "x", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, default=str)


def write_reports(reports: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each report as Parquet in its own folder, and a table of their checksums (SK4)."""
    spark = next(iter(reports.values())).sparkSession
    store, p = hadoop_path(spark, folder)
    if store.exists(p):
        raise FileExistsError(folder)
    parts = []
    for name, df in reports.items():
        write_new(df, f"{folder}/{name}")
        parts.append(table_hash(df.sparkSession.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("report"), "n_rows", "hash"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_hash(df: DataFrame) -> DataFrame:
    """n_rows and a hash that does not depend on the rows' order (SK8)."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.pmod(each, F.lit(1 << 31)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (SK9)."""
    store, p = hadoop_path(spark, f"{path}/_SUCCESS")
    return store.exists(p)


def write_resumable(parts: dict[str, Callable[[], DataFrame]], folder: str, spark: SparkSession) -> DataFrame:
    """Writes each part that is not yet done, and removes what a failed write left; returns (part, status, n_rows) (SK9, X16).

    A part is done when its table was written to its end, so a second call after a failure goes on where the first stopped.
    """
    rows = []
    for name, make in parts.items():
        path = f"{folder}/{name}"
        status = "dilewati" if is_done(spark, path) else "ditulis"
        if status == "ditulis":
            store, p = hadoop_path(spark, path)
            store.delete(p, True)
            try:
                write_new(make(), path)
            except Exception:
                store.delete(p, True)
                raise
        rows.append((name, status, spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "part string, status string, n_rows bigint")
