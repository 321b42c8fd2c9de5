"""Keyed tables: upsert, insert-ignore, get-or-create, updates and deletes as new DataFrames."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as fn


def stable_id(*parts: Column) -> Column:
    """A repeatable row id from what names the row."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key: one partial aggregate, whatever the number of changes of a key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with ``changes`` (one row a key) put over the rows of the same key."""
    kept = table.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it does not have."""
    return table.unionByName(rows.select(table.columns).join(table.select(key), key, "left_anti"))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def prune_refs(refs: DataFrame, as_of: Column, days: int = 21, date_col: str = "date") -> DataFrame:
    """Refs dated at most ``days`` before ``as_of``; the last day is kept."""
    return refs.where(F.col(date_col) >= F.date_sub(as_of, days))


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    """One row: the setting's value, '' when missing."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def exists(table: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether any row satisfies ``predicate``."""
    return table.agg((F.count(F.when(predicate, 1)) > 0).alias("found"))


def resolve_file(files: DataFrame, wanted: str) -> DataFrame:
    """The one live file whose id, name or group is ``wanted``; no row unless exactly one is."""
    hits = files.where(~F.col("deleted") & ((F.col("file_id") == wanted) | (F.col("name") == wanted) | (F.col("group_id") == wanted)))
    one = hits.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*files.columns)).alias("__f"))
    return one.where("__n = 1").select("__f.*")


def name_to_id(dim: DataFrame, order: str = "ord") -> DataFrame:
    """(name, id) of live rows with a name; the last id of a name wins."""
    live = dim.where((F.col("tombstone") == 0) & (F.coalesce("name", F.lit("")) != ""))
    return live.groupBy("name").agg(F.max_by("id", order).alias("id"))


def get_or_create_payees(payees: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, id, created) for every distinct name, and the identity mapping rows of new payees."""
    wanted = names.select("name").where("name IS NOT NULL AND name <> ''").distinct()
    known = payees.where("tombstone = 0").groupBy("name").agg(F.min("id").alias("id"))
    found = wanted.join(known, "name", "left").withColumn("created", F.col("id").isNull()).withColumn("id", F.coalesce("id", stable_id(F.lit("payee"), F.col("name"))))
    return found, found.where("created").select("id", F.col("id").alias("targetId"))


def get_or_create_accounts(accounts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name, id, created), transfer payees and payee mappings. A new account gets a nameless payee that points to it."""
    wanted = names.select("name").distinct()
    known = accounts.where("tombstone = 0").groupBy("name").agg(F.min("id").alias("id"))
    found = wanted.join(known, "name", "left").withColumn("created", F.col("id").isNull()).withColumn("id", F.coalesce("id", stable_id(F.lit("account"), F.col("name"))))
    payees = found.where("created").select(stable_id(F.lit("transfer"), F.col("id")).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("tombstone"), F.col("id").alias("transfer_acct"))
    return found, payees, payees.select("id", F.col("id").alias("targetId"))


def new_transactions(rows: DataFrame, payees: DataFrame) -> DataFrame:
    """Ledger rows of feed transactions: a repeatable id, title-cased payee, null for empty texts."""
    titled = rows.withColumn("name", fn.title_case("payee"))
    found, _ = get_or_create_payees(payees, titled)
    return titled.join(found, "name", "left").select(
        stable_id(F.lit("txn"), F.col("account"), F.col("entry_ref"), F.col("date").cast("string"), F.col("amount_cents").cast("string"), F.col("feed_ord").cast("string")).alias("id"),
        F.col("account").alias("acct"), fn.date_to_int("date").alias("date"), F.col("amount_cents").alias("amount"), F.col("id").alias("description"),
        fn.null_if_empty("notes").alias("notes"), fn.null_if_empty("entry_ref").alias("financial_id"), F.col("cleared").cast("int").alias("cleared"), fn.null_if_empty("payee").alias("imported_description"),
    )


def legacy_refs(state: DataFrame) -> DataFrame:
    """(ref, date) of a legacy state document."""
    return state.select(F.explode("imported_refs").alias("ref", "date"))


def legacy_pending(state: DataFrame) -> DataFrame:
    """(key, txn_id) of a legacy state document."""
    return state.select(F.explode("pending_map").alias("key", "txn_id"))


def import_legacy(state: DataFrame, accounts: DataFrame, settings: DataFrame, refs: DataFrame, pending: DataFrame) -> dict[str, DataFrame]:
    """The four tables after a legacy state document: known refs and pending keys stay as they are, the last sync date
    is put over the old one, and the session becomes the first account only where there is none."""
    session = state.where("coalesce(session_id, '') <> '' AND coalesce(account_uid, '') <> ''")
    none_yet = accounts.agg(F.count(F.lit(1)).alias("__n")).where("__n = 0")
    own = {"session_id": F.col("session_id"), "account_uid": F.col("account_uid"), "session_expiry": F.coalesce("session_expiry", F.lit(""))}
    first = session.join(none_yet).select(*[own.get(f.name, F.lit("" if f.dataType.typeName() == "string" else 1)).cast(f.dataType).alias(f.name) for f in accounts.schema])
    date = state.where("coalesce(last_sync_date, '') <> ''").select(F.lit("last_sync_date").alias("key"), F.col("last_sync_date").alias("value"))
    return {
        "accounts": accounts.unionByName(first), "settings": upsert(settings, date, "key"),
        "refs": insert_ignore(refs, legacy_refs(state), "ref"), "pending": insert_ignore(pending, legacy_pending(state), "key"),
    }


def append_log(path: str, runs: DataFrame, order: str = "ran_at") -> DataFrame:
    """Append ``runs`` (a few rows) to the log at ``path``, with ids that go on from the last; returns the whole log."""
    spark = runs.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except AnalysisException:  # no log yet
        last = 0
    numbered = runs.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("long") + last)  # one cycle's runs
    numbered.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def as_map(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row with all pairs as a map: for small keyed tables that go back to a caller whole."""
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("entries"))
