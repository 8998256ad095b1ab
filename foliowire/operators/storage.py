"""Keyed table maintenance: insert-if-absent, upserts, retention, appends, bounded reads and nested edits.

"First" and "latest" per key are min_by / max_by aggregates rather than row numbers: they combine on
the map side, so a key holding a third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that comes first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(first).select(*keys, "row.*")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that comes last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(last).select(*keys, "row.*")


def insert_if_absent(batch: DataFrame, store: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``store`` does not hold yet."""
    return first_per_key(batch, [key], order).join(store.select(key).distinct(), key, "left_anti")


def append_absent(batch: DataFrame, path: str, key: str, order: list[str], **columns: Column) -> None:
    """Append the rows of ``batch`` whose key the table at ``path`` does not hold; ``columns`` are added to them."""
    store = batch.sparkSession.read.schema(batch.select(key).schema).parquet(path)
    insert_if_absent(batch, store, key, order).withColumns(columns).write.mode("append").parquet(path)


def upsert(batch: DataFrame, path: str, keys: list[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
    """Merge ``batch`` into the keyed table at ``path``, rewriting only the hash buckets that the batch touches.

    ``combine`` reduces rows of one key, stored and new, to one row with the same columns. The first call
    makes the table. New bucket files replace the old ones when the job commits.
    """
    spark = batch.sparkSession
    schema = StructType([*batch.schema.fields, StructField("bucket", IntegerType())])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(path)
    bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    stored = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched)).select(*batch.columns)
    merged = combine(stored.unionByName(batch)).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


#: Rows a bucket of a versioned table should hold at most; with more, the next merge doubles the buckets.
ROWS_PER_BUCKET = 2_000_000
_COMMIT = "version bigint, folders array<bigint>, sizes array<bigint>"


def _last_commit(spark: SparkSession, path: str) -> Row | None:
    """The newest committed version: per bucket the version that holds its rows (-1: none) and their number."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy(F.desc("version")).first()
    except AnalysisException:  # no version yet
        return None


def _bucket_rows(spark: SparkSession, path: str, schema: StructType, commit: Row | None, buckets: list[int]) -> DataFrame:
    folders = [f"{path}/rows/version={commit.folders[b]}/bucket={b}" for b in buckets if commit.folders[b] >= 0] if commit else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*folders).select(*schema.names)


def current_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the newest committed version of a table that ``merge_version`` maintains."""
    commit = _last_commit(spark, path)
    return _bucket_rows(spark, path, schema, commit, list(range(len(commit.folders))) if commit else [])


def merge_version(batch: DataFrame, path: str, keys: list[str], combine: Callable[[DataFrame], DataFrame],
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Merge ``batch`` into the versioned keyed table at ``path``; returns the version that holds the result (0: none yet).

    ``combine`` reduces rows of one key, stored and new, to one row with the same columns. The buckets that the batch touches
    are written whole into the folder of a new version; all others stay where they are. The version counts only when its commit,
    one row written last, is there: a job that dies before leaves the table as it was, and the next merge overwrites what it
    left. Readers keep the files they opened. When the buckets hold more than ``rows_per_bucket`` rows on average, a merge
    rewrites them all as twice as many or more, so a batch of few keys reads and writes a bounded amount whatever the table's size.

    One writer at a time. Folders of versions that the newest commit does not name may be deleted once no reader needs them.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    commit = _last_commit(spark, path)
    n_buckets = before = len(commit.folders) if commit else 1
    n_rows = sum(commit.sizes) if commit else batch.count()
    while n_rows > n_buckets * rows_per_bucket:
        n_buckets *= 2
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most ``n_buckets`` numbers
    if not touched:
        return commit.version if commit else 0
    resized = n_buckets != before
    stored = _bucket_rows(spark, path, batch.schema, commit, list(range(before)) if resized else touched)
    version = commit.version + 1 if commit else 1
    rows = f"{path}/rows/version={version}"
    combine(stored.unionByName(batch)).withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(rows)
    written = {r.bucket: r["count"] for r in spark.read.schema("bucket int").parquet(rows).groupBy("bucket").count().collect()}
    keep = commit is not None and not resized
    folders, sizes = (list(commit.folders), list(commit.sizes)) if keep else ([-1] * n_buckets, [0] * n_buckets)
    for b in touched if keep else range(n_buckets):
        folders[b], sizes[b] = (version, written[b]) if b in written else (-1, 0)
    _write_commit(spark, path, version, folders, sizes)
    return version


def _write_commit(spark: SparkSession, path: str, version: int, folders: list[int], sizes: list[int]) -> None:
    one = spark.createDataFrame([(folders, sizes)], "folders array<bigint>, sizes array<bigint>")
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def purge_before(spark: SparkSession, table: str, column: str, first: date) -> list[str]:
    """Drop the partitions of a managed table, by date ``column``, that lie before ``first``; returns the dropped dates."""
    dates = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # one per day
    old = sorted(d for d in dates if d < first.isoformat())
    for day in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = DATE '{day}')")
    return old


def ingest_statistics(batch: DataFrame, store: DataFrame, key: str, order: list[str], by: str) -> DataFrame:
    """Per source: rows saved (first of their key, not stored before) and rows counted as duplicates."""
    held = store.select(F.col(key).alias("held")).distinct()
    per_key = batch.groupBy(key, by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    winners = per_key.groupBy(key).agg(F.min_by(by, "first").alias("winner"), F.sum("n").alias("n_all"))
    saved = winners.join(held, F.col(key) == F.col("held"), "left_anti").groupBy(F.col("winner").alias(by)).agg(
        F.count(F.lit(1)).alias("saved"))
    seen = batch.groupBy(by).agg(F.count(F.lit(1)).alias("seen"))
    return seen.join(saved, by, "left").select(
        by, F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved"),
        (F.col("seen") - F.coalesce("saved", F.lit(0))).cast("bigint").alias("duplicates"))


def feedback_rows(votes: DataFrame) -> DataFrame:
    """Votes as rows of the feedback table."""
    return votes.select("alert_id", "user_id", "useful", "comment", F.col("voted_at").alias("created_at"), F.col("voted_at").alias("updated_at"), "vote_id")


def merge_feedback(rows: DataFrame) -> DataFrame:
    """Last vote and comment per (alert, user), with the time of the first vote kept."""
    order = F.struct("updated_at", "vote_id")
    return rows.groupBy("alert_id", "user_id").agg(
        F.max_by("useful", order).alias("useful"), F.max_by("comment", order).alias("comment"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max_by("vote_id", order).alias("vote_id"))


def upsert_feedback(votes: DataFrame) -> DataFrame:
    return merge_feedback(feedback_rows(votes))


def keep_recent(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Retention: rows not older than ``days`` before ``as_of``; a predicate the scan can prune on."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append the non-duplicate alerts, partitioned by creation date.

    The rebalance gathers a date's rows into few files and splits a date that is too large for one task.
    """
    (
        alerts.where(~F.col("is_duplicate"))
        .withColumn("created_date", F.to_date("created_at"))
        .hint("rebalance", "created_date")
        .write.mode("append").partitionBy("created_date").parquet(path)
    )


def newest(df: DataFrame, ts: str, tie: str, n: int, where: Column | None = None) -> DataFrame:
    """The ``n`` newest rows, optionally of a selection; runs as a bounded top-k per task."""
    chosen = df if where is None else df.where(where)
    return chosen.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def edit_assets(portfolios: DataFrame, additions: DataFrame, removals: DataFrame, touched_at: Column) -> DataFrame:
    """Apply asset additions (portfolio_id, asset) and removals (portfolio_id, ticker) to nested portfolios."""
    adds = additions.groupBy("portfolio_id").agg(F.collect_list("asset").alias("added"))
    drops = removals.groupBy("portfolio_id").agg(F.collect_set("ticker").alias("dropped"))
    joined = portfolios.join(adds, "portfolio_id", "left").join(drops, "portfolio_id", "left")
    kept = F.when(F.col("dropped").isNull(), F.col("assets")).otherwise(
        F.filter("assets", lambda a: ~F.array_contains("dropped", a["ticker"])))
    changed = F.col("added").isNotNull() | F.col("dropped").isNotNull()
    edited = F.when(F.col("added").isNull(), kept).otherwise(F.concat(kept, "added"))
    return joined.select(
        *[c for c in portfolios.columns if c not in ("assets", "updated_at")], edited.alias("assets"),
        F.when(changed, touched_at).otherwise(F.col("updated_at") if "updated_at" in portfolios.columns else F.lit(None).cast("timestamp")).alias("updated_at"))
