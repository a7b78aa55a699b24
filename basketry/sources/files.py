"""Files in and out: declared CSV, Parquet tables, views, point reads and manifests."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The declared schemas of the raw retail files, by table.
RAW_SCHEMAS: dict[str, str] = {
    "customers": "customer_id string, signup_date date, country string, city string, household_size_est int, loyalty_tier string, preferred_channel string, churn_label boolean",
    "products": "product_id string, department string, category string, brand string, is_private_label boolean, is_perishable boolean, unit_price double, pack_size int, typical_repurchase_days int",
    "promotions": "promotion_id string, product_id string, promo_type string, discount_value double, start_date date, end_date date",
    "baskets": "basket_id string, customer_id string, channel string, basket_date timestamp, store_id string, total_amount double",
    "basket_items": "basket_id string, product_id string, quantity int, unit_price_paid double, promotion_id string",
    "sessions": "session_id string, customer_id string, session_date timestamp, device_type string, converted boolean, basket_id string",
    "session_events": "session_id string, product_id string, event_type string, event_timestamp timestamp",
}
CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "nullValue": "", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def read_raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One CSV table by its declared schema; an empty field is null."""
    if table not in RAW_SCHEMAS:
        raise KeyError(f"no such table: {table}")
    return spark.read.options(**CSV_OPTIONS).schema(RAW_SCHEMAS[table]).csv(f"{folder}/{table}.csv")


def read_all_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: read_raw(spark, folder, t) for t in RAW_SCHEMAS}


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Each table as Parquet in a folder of its own, replacing what is there."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{folder}/{name}")


def write_single(df: DataFrame, path: str) -> None:
    """A small table as one Parquet file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Temporary views for SQL; lazy, nothing is read."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{n}" for n in tables]


def point_read(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the row groups of the scan."""
    return spark.read.parquet(path).where(F.col(key) == value)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, *paths: str) -> str:
    """The first of several paths that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(" or ".join(paths))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n_rows, digest``: an order-free digest of each table's rows, to tell whether inputs are the same."""
    out = None
    for name, df in tables.items():
        row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
        part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("table"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


#: Rows that a report may have: it is written by the driver.
REPORT_ROWS = 100_000


def _few(df: DataFrame, most: int) -> list:
    """The rows of a report; more than ``most`` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write it as a table")
    return rows


def write_report(df: DataFrame, path: str, most: int = REPORT_ROWS) -> None:
    """A report of few rows as JSON, written by the driver."""
    rows = [r.asDict(recursive=True) for r in _few(df, most)]
    with open(path, "w") as f:
        json.dump(rows, f, default=str, indent=1)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _few(df, most))])


def freeze(spark: SparkSession, metrics: dict, inputs: dict[str, DataFrame], path: str, force: bool = False) -> None:
    """Metrics with the digests of the tables they come from, as the reference for what comes later."""
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} is there already")
    digests = {r["table"]: [r["n_rows"], r["digest"]] for r in manifest(inputs).collect()}
    with open(path, "w") as f:
        json.dump({"frozen": datetime.date.today().isoformat(), "inputs": digests, "metrics": metrics}, f, indent=1, default=str)


def frozen(path: str, inputs: dict[str, DataFrame]) -> dict:
    """The metrics of a snapshot; an error if the tables aren't those that it comes from."""
    with open(path) as f:
        snapshot = json.load(f)
    now = {r["table"]: [r["n_rows"], r["digest"]] for r in manifest(inputs).collect()}
    if changed := sorted(t for t in snapshot["inputs"].keys() | now.keys() if snapshot["inputs"].get(t) != now.get(t)):
        raise ValueError(f"not the same inputs: {', '.join(changed)}")
    return snapshot["metrics"]
