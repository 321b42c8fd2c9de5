"""Landed feed pages (JSON, one page a record) to normalised transactions.

A scan of an account is a chain of pages: the first is asked for without a key, every other one with the continuation
key of the page before it, and the last has none. ``scan_accounts`` reads chains whole: a page that is missing, was
refused or cannot be decoded fails its account's scan, which then gives no rows but says why; the others go on.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..schemas import FEED_JSON, FEED_PAGE
from ..session import scratch


def page_records(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Each page's records as raw JSON in ``record``, with their position; pages without transactions give none.

    A record keeps the page's other columns.
    """
    parsed = pages.withColumn("__page", F.from_json(F.col(page_col), FEED_PAGE))
    kept = [c for c in pages.columns if c != page_col]
    return parsed.select(*kept, F.posexplode("__page.transactions").alias("position", "record"))


def continuation(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Pages with the key that asks for the next one ('' on the last)."""
    return pages.withColumn("continuation_key", fn.first_filled(F.from_json(F.col(page_col), FEED_PAGE)["continuation_key"]))


def _once(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with column ``name``, behind a generator, so that the optimiser never copies what makes it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def normalise_records(records: DataFrame, own_names: list[str] | None = None, record_col: str = "record") -> DataFrame:
    """Typed columns of every record; ``valid`` is false where date or amount cannot be read."""
    r, entries = F.col("__r"), F.col("__entries.list")
    parsed = _once(records, "__r", F.from_json(F.col(record_col), FEED_JSON))
    parsed = _once(parsed, "__entries", F.struct(fn.remittance_list(r["remittance_information"]).alias("list")))
    ind = fn.indicator(r["credit_debit_indicator"], r["credit_debit_indic"])
    out = parsed.withColumns(
        {
            "status": fn.status_or_booked(r["status"]),
            "date": fn.parse_date(r["transaction_date"], r["booking_date"], r["value_date"]),
            "amount_cents": fn.signed_cents(r["transaction_amount"]["amount"], ind),
            "payee": fn.payee_of(ind, r["creditor"]["name"], r["creditor_name"], r["debtor"]["name"], r["debtor_name"], r["remittance_information"], own_names or [], entries),
            "notes": fn.notes_of(r["remittance_information_unstructured"], r["remittance_information"], entries),
            "entry_ref": fn.entry_ref(r["entry_reference"], r["transaction_id"]),
        }
    ).drop("__r", "__entries")
    return out.withColumn("valid", F.col("date").isNotNull() & F.col("amount_cents").isNotNull())


def feed_scan(pages: DataFrame, own_names: list[str] | None = None, page_col: str = "page") -> DataFrame:
    """All well-formed transactions of the landed pages; malformed records are dropped."""
    return normalise_records(page_records(pages, page_col), own_names).where("valid").drop("valid", "record")


def read_pages(spark, path: str) -> DataFrame:
    """Landed pages, one JSON document a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "page")


# Scans with their faults

_PAGE = "transactions array<string>, continuation_key variant, __bad string"
_KEPT = ("account", "page_no", "request_key", "status", "page")


def decode_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``records`` (raw JSON), ``continuation_key`` ('' on the last) and ``fault``: null, or why the page
    cannot be read. A page is a JSON object; its transactions are a list of objects, its key is a text; both may be
    null or missing, and so may be the whole object."""
    parsed = _once(pages, "__p", F.from_json("page", _PAGE, {"columnNameOfCorruptRecord": "__bad"}))
    p, text = F.col("__p"), F.btrim(F.coalesce(F.col("page"), F.lit("")), F.lit(" \t\r\n"))
    null = text == "null"
    object_ = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    kind = F.coalesce(F.schema_of_variant(p["continuation_key"]), F.lit("VOID"))
    listed = F.coalesce(F.forall(p["transactions"], lambda r: F.coalesce(F.startswith(r, F.lit("{")), F.lit(True))), F.lit(True))
    good = null | (object_ & p.isNotNull() & p["__bad"].isNull() & kind.isin("STRING", "VOID") & listed)
    fault = F.when(F.coalesce("status", F.lit(200)) != 200, F.concat(F.lit("status "), "status")).when(~good, "cannot be decoded")
    records = F.filter(F.coalesce(p["transactions"], F.array().cast("array<string>")), lambda r: r.isNotNull())
    key = F.coalesce(F.when(kind == "STRING", F.try_variant_get(p["continuation_key"], "$", "string")), F.lit(""))
    return parsed.withColumns({"fault": fault, "records": F.when(fault.isNull(), records), "continuation_key": F.when(fault.isNull(), key)}).drop("__p")


def scan_status(decoded: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """(account, pages, error) of each account's scan; error is null where the whole chain was read.

    Every page meets the one before it under their account and number, so an account of any number of pages is no task
    of its own. ``accounts`` (account) names those that should have been scanned; one without pages has failed."""
    own = F.struct(F.col("page_no").alias("at"), F.struct(F.coalesce("request_key", F.lit("")).alias("asked"), "continuation_key", "fault").alias("own"), F.lit(None).cast("string").alias("before"))
    next_ = F.struct((F.col("page_no") + 1).alias("at"), F.lit(None).cast(decoded.select(own["own"]).schema[0].dataType).alias("own"), F.coalesce("continuation_key", F.lit("")).alias("before"))
    met = decoded.select("account", F.explode(F.array(own, next_)).alias("x")).groupBy("account", F.col("x.at").alias("at"))
    met = met.agg(F.count("x.own").alias("landed"), F.min("x.own").alias("own"), F.max("x.before").alias("before"))
    name = F.concat(F.lit("page "), "at")
    asked = F.coalesce("before", F.lit(""))
    fault = (
        F.when(F.col("landed") > 1, F.concat(name, F.lit(" was landed more than once")))
        .when((F.col("landed") == 0) & (asked != ""), F.concat(name, F.lit(" is missing")))
        .when(F.col("own.fault").isNotNull(), F.concat(name, F.lit(": "), "own.fault"))
        .when((F.col("landed") == 1) & (F.col("own.asked") != asked), F.concat(name, F.lit(" does not continue the one before it")))
    )
    ends = (F.col("landed") == 1) & (F.col("own.continuation_key") == "")
    told = met.withColumn("fault", fault).groupBy("account").agg(
        F.min(F.when(F.col("fault").isNotNull(), F.struct("at", "fault"))).alias("bad"), F.min(F.when(ends & F.col("fault").isNull(), F.col("at"))).alias("end"),
        F.min(F.when(F.col("landed") > 0, F.col("at"))).alias("first"), F.count_if(F.col("landed") > 0).alias("landed"),
    )
    failed = F.when(F.coalesce("first", F.lit(-1)) != 0, "page 0 is missing").when(F.col("end").isNull() | (F.col("bad.at") < F.col("end")), F.coalesce("bad.fault", F.lit("the last page is missing")))
    out = told.select("account", F.when(failed.isNull(), F.col("end") + 1).otherwise(F.lit(0)).cast("long").alias("pages"), failed.alias("error"))
    if accounts is None:
        return out
    return accounts.select("account").distinct().join(out, "account", "left").select("account", F.coalesce("pages", F.lit(0)).alias("pages"), F.when(F.col("pages").isNull(), "page 0 is missing").otherwise(F.col("error")).alias("error"))


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "pages")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_accounts(pages: DataFrame, own_names: list[str] | None = None, accounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the accounts whose scan was whole, and the status of every account's scan.

    pages: account, page_no (from 0), request_key, status (null: 200), page. Malformed records inside a page are
    dropped; pages behind an account's last one are not part of its scan. Decoded pages are written to the shared folder
    once, as the scans' status is needed before, and beside, the rows."""
    decoded = _written(decode_pages(pages.select(*_KEPT)).drop("page"))
    status = scan_status(decoded, accounts)
    whole = status.where("error IS NULL").select("account", F.col("pages").alias("__pages"))
    read = decoded.join(whole, "account").where(F.col("page_no") < F.col("__pages"))
    records = read.select("account", "page_no", F.posexplode("records").alias("position", "record"))
    return normalise_records(records, own_names).where("valid").drop("valid", "record"), status
