"""Matching feed rows to ledger rows: by reference, else by account, amount and a window of days.

feed: feed_ord, account, date, amount_cents, payee, notes, entry_ref, cleared
ledger: id, ord, account, date, amount_cents, payee_id, payee_name, notes, financial_id, cleared, imported_payee
"""

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as fn

WINDOW_DAYS = 7


def exact_matches(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(feed_ord, ledger_id): the ledger row of the account with the feed row's reference, newest date, then first, wins."""
    known = ledger.where("financial_id IS NOT NULL AND financial_id <> ''")
    best = known.groupBy("account", "financial_id").agg(F.max_by("id", F.struct("date", -F.col("ord"))).alias("ledger_id"))
    wanted = feed.where("entry_ref <> ''").select("feed_ord", "account", F.col("entry_ref").alias("financial_id"))
    return wanted.join(best, ["account", "financial_id"]).select("feed_ord", "ledger_id")


def _rank(payee: Column, name: Column, date: Column, target: Column) -> list[Column]:
    """Same payee first, then the distance of YYYYMMDD numbers (not of days)."""
    return [F.when(fn.same_fold(payee, name), 0).otherwise(1), F.abs(fn.date_to_int(date) - fn.date_to_int(target))]


def _stretch(date: Column, days: int) -> Column:
    """The number of the stretch of days + 1 days that holds ``date``; a window of ``days`` to both sides meets three at most."""
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / (days + 1)).cast("long")


def window_candidates(feed: DataFrame, ledger: DataFrame, excluded: DataFrame | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """All (feed row, ledger row) of equal account and amount within ``days``, with the rank of each.

    The join goes by account, amount and stretch of days, so a common amount is dealt out over time and only rows of
    neighbouring days meet."""
    l = _free(ledger, excluded).select("account", "amount_cents", F.col("id").alias("ledger_id"), F.col("date").alias("l_date"), F.col("payee_name").alias("l_payee"), F.col("ord").alias("l_ord"), _stretch(F.col("date"), days).alias("stretch"))
    reach = F.sequence(_stretch(F.date_sub("date", days), days), _stretch(F.date_add("date", days), days))
    f = feed.select("account", "amount_cents", "feed_ord", "date", "payee", F.explode(reach).alias("stretch"))
    pairs = f.join(l, ["account", "amount_cents", "stretch"]).where(F.col("l_date").between(F.date_sub("date", days), F.date_add("date", days)))
    other_payee, distance = _rank(F.col("payee"), F.col("l_payee"), F.col("l_date"), F.col("date"))
    return pairs.withColumns({"other_payee": other_payee, "distance": distance})


def _free(ledger: DataFrame, excluded: DataFrame | None) -> DataFrame:
    return ledger if excluded is None else ledger.join(excluded.select(F.col("ledger_id").alias("id")), "id", "left_anti")


def _nearest(feed: DataFrame, ledger: DataFrame, by: list[str], days: int) -> DataFrame:
    """(by, date, distance, l_ord, ledger_id): what suits best on a feed day among ledger rows with equal ``by``. Rows of
    one day are one on either side, so a day meets at most three stretches of days, however many rows there are."""
    l = ledger.groupBy(*by, F.col("date").alias("l_date")).agg(F.min(F.struct("l_ord", "ledger_id")).alias("l")).withColumn("stretch", _stretch(F.col("l_date"), days))
    reach = F.sequence(_stretch(F.date_sub("date", days), days), _stretch(F.date_add("date", days), days))
    f = feed.select(*by, "date").distinct().select("*", F.explode(reach).alias("stretch"))
    pairs = f.join(l, [*by, "stretch"]).where(F.col("l_date").between(F.date_sub("date", days), F.date_add("date", days)))
    distance = F.abs(fn.date_to_int("l_date") - fn.date_to_int("date"))
    return pairs.groupBy(*by, "date").agg(F.min(F.struct(distance.alias("distance"), "l.l_ord", "l.ledger_id")).alias("b"))


def window_matches(feed: DataFrame, ledger: DataFrame, excluded: DataFrame | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """(feed_ord, ledger_id, distance) of the best candidate of each feed row, each row for itself.

    A row of the same payee comes before all others, and where there is none, all others count alike: so the best one of
    a day is the first of the payee's or of all, and pairs of rows are never made."""
    by, own = ["account", "amount_cents"], ["account", "amount_cents", "fold"]
    l = _free(ledger, excluded).select(*by, "date", fn.folded("payee_name").alias("fold"), F.col("ord").alias("l_ord"), F.col("id").alias("ledger_id"))
    f = feed.select("feed_ord", *by, "date", fn.folded("payee").alias("fold"))
    same = f.join(_nearest(f, l, own, days), [*own, "date"], "left")
    others = _nearest(same.where("b IS NULL"), l, by, days).withColumnRenamed("b", "o")
    found = same.where("b IS NULL").drop("b").join(others, [*by, "date"]).select("feed_ord", F.lit(1).alias("other_payee"), F.col("o").alias("b"))
    found = same.where("b IS NOT NULL").select("feed_ord", F.lit(0).alias("other_payee"), "b").unionByName(found)
    best = found.groupBy("feed_ord").agg(F.min(F.struct("other_payee", "b")).alias("x"))
    return best.select("feed_ord", "x.b.ledger_id", "x.b.distance", (F.col("x.other_payee") == 0).alias("same_payee"))


def _serve(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """First come, first served over groups sorted by group, then ledger rows by (l_ord, ledger_id), then feed rows by
    feed_ord. Of a group the ledger rows that are left are held, in queues by day and by payee and day; a feed row looks
    at the first row left of each day of its window."""
    now, days_, own, gone, nth, served = None, {}, {}, set(), 0, None
    numbers: dict[int, int] = {}

    def number(day: int) -> int:
        if day not in numbers:
            d = dt.date(1970, 1, 1) + dt.timedelta(days=day)
            numbers[day] = d.year * 10_000 + d.month * 100 + d.day
        return numbers[day]

    def best(queues: dict, payee, day: int):
        """The nearest day's first row left, of equally near ones the smaller; queues lose what is gone on the way."""
        found, target = None, number(day)
        for d in range(day - days, day + days + 1):
            queue = queues.get(d if payee is None else (payee, d))
            if not queue:
                continue
            while queue and queue[0][0] in gone:
                queue.popleft()
            if queue:
                key = (abs(number(d) - target), *queue[0])
                if found is None or key < found:
                    found = key
        return found

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("account", "amount_cents", "island", "feed_ord", "day", "fold", "ledger_id")]
        feed_ords, ids = [], []
        for account, cents, island, feed_ord, day, fold, ledger_id in zip(*columns, strict=True):
            if (account, cents, island) != now:
                now, days_, own, gone, nth, served = (account, cents, island), {}, {}, set(), 0, None
            if feed_ord is None:
                row = (nth, ledger_id)
                nth += 1
                days_.setdefault(day, deque()).append(row)
                if fold is not None:
                    own.setdefault((fold, day), deque()).append(row)
                continue
            if feed_ord == served:
                continue
            got = (best(own, fold, day) if fold is not None else None) or best(days_, None, day)
            if got is not None:
                gone.add(got[1])
                served = feed_ord
                feed_ords.append(feed_ord)
                ids.append(got[2])
        if ids:
            yield pa.record_batch([pa.array(feed_ords, batch.column("feed_ord").type), pa.array(ids, batch.column("ledger_id").type)], names=["feed_ord", "ledger_id"])


def greedy_matches(feed: DataFrame, ledger: DataFrame, excluded: DataFrame | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """One-to-one assignment in feed order: a ledger row taken by one feed row is gone for the later ones.

    Rows only compete inside one (account, amount), and there only along an unbroken run of stretches of days, an
    island. Islands are dealt whole, and a feed row looks at the days of its window, not at the rows of those days, so
    pairs are never made. First come, first served is sequential by nature: an island is served by one task, which holds
    its ledger rows (some 200 bytes each) and nothing of its feed."""
    by = ["account", "amount_cents"]
    l = _free(ledger, excluded).where("date IS NOT NULL").select(*by, F.col("ord").alias("l_ord"), F.col("id").alias("ledger_id"), "date", fn.folded("payee_name").alias("fold"), _stretch(F.col("date"), days).alias("stretch"))
    # a feed row reaches three stretches in a row, so only a gap of three parts two islands
    along = Window.partitionBy(*by).orderBy("stretch")
    parted = (F.col("stretch") - F.lag("stretch").over(along) > 2).cast("long")
    islands = l.select(*by, "stretch").distinct().withColumn("island", F.coalesce(F.sum(parted).over(along), F.lit(0)))
    reach = F.sequence(_stretch(F.date_sub("date", days), days), _stretch(F.date_add("date", days), days))
    f = feed.where("feed_ord IS NOT NULL").select("feed_ord", *by, "date", fn.folded("payee").alias("fold"))
    where = f.select(*by, "date").distinct().select("*", F.explode(reach).alias("stretch")).join(islands, [*by, "stretch"]).groupBy(*by, "date").agg(F.min("island").alias("island"))
    day = F.unix_date("date").alias("day")
    rows = l.join(islands, [*by, "stretch"]).select(*by, "island", F.lit(None).cast(dict(f.dtypes)["feed_ord"]).alias("feed_ord"), day, "fold", "l_ord", "ledger_id")
    rows = rows.unionByName(f.join(where, [*by, "date"]).select(*by, "island", "feed_ord", day, "fold"), allowMissingColumns=True)
    # ledger rows, which have no feed_ord, come first
    dealt = rows.repartition(*by, "island").sortWithinPartitions(*by, "island", F.col("feed_ord").asc_nulls_first(), "l_ord", "ledger_id")
    types = dict(rows.dtypes)
    return dealt.mapInArrow(lambda x: _serve(x, days), f"feed_ord {types['feed_ord']}, ledger_id {types['ledger_id']}")


def patch(feed: DataFrame, ledger: DataFrame, matches: DataFrame, payee_ids: DataFrame) -> DataFrame:
    """Matched ledger rows after the feed row's values, with ``changed``.

    payee_ids: (name, id) of title-cased payees. An empty feed value changes nothing; cleared follows the feed, so it
    can go back; the imported payee is only filled when empty.
    """
    f = feed.select("feed_ord", F.col("entry_ref").alias("f_ref"), F.col("notes").alias("f_notes"), F.col("cleared").alias("f_cleared"), F.col("payee").alias("f_payee"), fn.title_case("payee").alias("f_title"))
    m = matches.select("feed_ord", F.col("ledger_id").alias("id")).join(f, "feed_ord").join(ledger, "id")
    m = m.join(payee_ids.select(F.col("name").alias("f_title"), F.col("id").alias("f_payee_id")), "f_title", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ref = (text("f_ref") != "") & (text("financial_id") != F.col("f_ref"))
    notes = (text("f_notes") != "") & (text("notes") != F.col("f_notes"))
    cleared = F.col("cleared") != F.col("f_cleared")
    payee = (text("f_title") != "") & (text("payee_name") != F.col("f_title")) & F.col("f_payee_id").isNotNull() & (text("payee_id") != F.col("f_payee_id"))
    imported = (text("f_payee") != "") & (text("imported_payee") == "")
    return m.select(
        "feed_ord", "id", F.when(ref, F.col("f_ref")).otherwise(text("financial_id")).alias("financial_id"), F.when(notes, F.col("f_notes")).otherwise(text("notes")).alias("notes"),
        F.col("f_cleared").alias("cleared"), F.when(payee, F.col("f_payee_id")).otherwise(text("payee_id")).alias("payee_id"), F.when(payee, F.col("f_title")).otherwise(text("payee_name")).alias("payee_name"),
        F.when(imported, F.col("f_payee")).otherwise(text("imported_payee")).alias("imported_payee"), (ref | notes | cleared | payee | imported).alias("changed"),
    )


def reconcile(feed: DataFrame, ledger: DataFrame, payee_ids: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Every feed row with its ledger row, how it was found (exact, window, created) and whether that changed anything.

    Rows with a known reference take their ledger rows first; the others are matched by window one to one."""
    exact = exact_matches(feed, ledger).withColumn("how", F.lit("exact"))
    matched = exact
    if fuzzy:
        open_rows = feed.join(exact, "feed_ord", "left_anti")
        matched = exact.unionByName(greedy_matches(open_rows, ledger, exact).withColumn("how", F.lit("window")))
    patched = patch(feed, ledger, matched, payee_ids).select("feed_ord", "changed")
    return (
        feed.select("feed_ord", "account").join(matched, "feed_ord", "left").join(patched, "feed_ord", "left")
        .select("feed_ord", "account", "ledger_id", F.coalesce("how", F.lit("created")).alias("how"), F.coalesce("changed", F.lit(False)).alias("changed"), F.col("how").isNull().alias("was_created"))
    )
