"""Status, health, log, inventory and metric reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Upper bounds in seconds (inclusive) of the run and fetch histograms.
RUN_BOUNDS = (1, 2, 5, 10, 30, 60, 120)
FETCH_BOUNDS = (0.1, 0.5, 1, 2, 5, 10, 30)


def runs_by_status(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def histogram(rows: DataFrame, value: str, bounds: tuple = RUN_BOUNDS, by: list[str] | None = None) -> DataFrame:
    """count, sum, min and max of each bucket; the last bucket has no bound ('+Inf')."""
    bucket = F.lit("+Inf")
    for b in reversed(bounds):
        bucket = F.when(F.col(value) <= b, F.lit(f"{b:g}")).otherwise(bucket)
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or []), bucket.alias("le")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def newest_logs(logs: DataFrame, k: int = 20) -> DataFrame:
    return logs.orderBy(F.col("id").desc()).limit(k)


def latest_log(logs: DataFrame) -> DataFrame:
    return newest_logs(logs, 1)


def accounts_in_order(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy("created_at", "id")


def gauges(accounts: DataFrame, pending: DataFrame, as_of: Column) -> DataFrame:
    """How many rows are pending, and the first account's days to expiry."""
    first = accounts.agg(F.min_by("session_expiry", F.struct("created_at", "id")).alias("expiry"))
    days = first.select(fn.days_left(fn.parse_expiry("expiry"), as_of).alias("days_to_expiry"))
    return pending.agg(F.count(F.lit(1)).alias("pending_rows")).join(days)  # one row each


def expiring(accounts: DataFrame, as_of: Column, within: int = 7) -> DataFrame:
    left = fn.days_left(fn.parse_expiry("session_expiry"), as_of)
    return accounts.agg(F.count(F.lit(1)).alias("accounts"), F.count_if(left < within).alias("expiring"))


def health(accounts: DataFrame, logs: DataFrame, last_sync: str, as_of: Column) -> DataFrame:
    """One row: unhealthy without accounts or syncs, degraded if a session runs out soon or the last run failed."""
    last = logs.agg(F.max_by("status", "id").alias("last_status"))
    x = expiring(accounts, as_of).join(last)
    sick = (F.col("accounts") == 0) | (F.lit(last_sync) == "")
    weak = (F.col("expiring") > 0) | (F.coalesce("last_status", F.lit("")) != "success")
    status = F.when(sick, "unhealthy").when(weak, "degraded").otherwise("healthy")
    hours = fn.hours_since(F.lit(last_sync or None).cast("date"), as_of)
    return x.select("accounts", "expiring", "last_status", status.alias("status"), F.when(sick, 503).otherwise(200).alias("http_status"), hours.alias("hours_since_sync"))


def error_text(errors: DataFrame, by: list[str], order: str, message: str = "message") -> DataFrame:
    """Messages of a group, in order, joined by '; '."""
    return errors.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, message))), lambda x: x[message]), "; ").alias("errors"))


def inventory(components: DataFrame) -> DataFrame:
    """Components (name, version, purl, licenses) with their kind and first licence, by kind and name."""
    kind = F.when(F.startswith("purl", F.lit("pkg:golang/")), "go").when(F.startswith("purl", F.lit("pkg:apk/")), "apk").otherwise("other")
    return components.select(kind.alias("kind"), "name", "version", fn.first_license("licenses").alias("license")).orderBy("kind", "name", "version")


def inventory_counts(components: DataFrame) -> DataFrame:
    """Components of each kind and in all (kind null)."""
    return inventory(components).rollup("kind").agg(F.count(F.lit(1)).alias("components"))


def read_inventory(spark, path: str) -> DataFrame:
    from ..schemas import INVENTORY

    return spark.read.schema(INVENTORY).json(path, multiLine=True).select(F.explode("components").alias("c")).select("c.*")


def tag_names(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """The tags that pages of a registry's answer list; a page that cannot be read lists none."""
    return pages.select(F.explode(F.from_json(page_col, "results array<struct<name:string>>")["results"]["name"]).alias("tag"))


def newest_version(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """The newest release tag."""
    return tags.where(fn.is_release_tag(tag)).agg(F.max_by(tag, fn.parse_version(tag)).alias("newest"))


def countries_in_order(banks: DataFrame, country: str = "country", position: str = "position") -> DataFrame:
    """Distinct countries by first appearance."""
    return banks.groupBy(country).agg(F.min(position).alias("first_seen")).orderBy("first_seen")


def fetch_outcome(attempts: DataFrame) -> DataFrame:
    """One row: 'fetch_error' if every account failed, else 'success', with the errors joined."""
    errors = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("account", "error")))), lambda x: F.concat_ws(": ", x["account"].cast("string"), x["error"])), "; ")
    n, bad = F.count(F.lit(1)), F.count("error")
    return attempts.agg(F.when((n > 0) & (n == bad), "fetch_error").otherwise("success").alias("status"), bad.alias("failed"), errors.alias("errors"))
