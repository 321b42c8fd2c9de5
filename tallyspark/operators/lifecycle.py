"""One sync cycle: pending and booked feed rows against known references, pending keys and the ledger.

Pending keys and references are known by their text alone, whatever the account; ledger rows belong to accounts. Rows
of one key follow each other in feed order, as each depends on what the rows before it did: the feed is dealt by key,
sorted inside partitions, and every key is walked once in constant memory; rows that have their key for themselves are
told all at once. Everything else is set-based.
"""

from collections.abc import Iterator, MutableMapping
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .store import stable_id


def with_keys(feed: DataFrame) -> DataFrame:
    return feed.withColumn("pending_key", fn.pending_key("entry_ref", "date", "amount_cents"))


def _with_state(feed: DataFrame, refs: DataFrame, pending: DataFrame, ledger: DataFrame, payee_ids: DataFrame) -> DataFrame:
    """Feed rows with what was known before the batch: their reference, their pending row and its account, the ledger
    row of their account with their reference (newest date, then first), and their payee's id."""
    x = with_keys(feed.withColumn("entry_ref", _text("entry_ref"))).withColumn("title", fn.title_case(_text("payee")))
    known = refs.where("ref <> ''").select(F.col("ref").alias("entry_ref"), F.lit(True).alias("ref_known")).distinct()
    x = x.join(known, "entry_ref", "left").join(_waiting(pending, ledger), "pending_key", "left").join(_named(ledger), ["account", "entry_ref"], "left")
    return _with_ids(x, payee_ids).select(*_OWN, F.coalesce("ref_known", F.lit(False)).alias("ref_known"), "pending_id", "pending_row", "own")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _row() -> Column:
    """A ledger row as its key keeps it."""
    return F.struct("id", "account", "amount_cents", *[_text(c).alias(c) for c in ("notes", "payee_id", "payee_name")], "cleared", _text("imported_payee").alias("imported_payee"))


def _waiting(pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """(pending_key, pending_id, pending_row) of each waiting row; the row is null if the ledger has it no more."""
    held = pending.groupBy(F.col("key").alias("pending_key")).agg(F.max("txn_id").alias("pending_value"))
    held = held.withColumn("pending_id", fn.split_pending("pending_value")["txn_id"]).drop("pending_value")
    return held.join(ledger.select(F.col("id").alias("pending_id"), _row().alias("pending_row")), "pending_id", "left")


def _named(ledger: DataFrame) -> DataFrame:
    """(account, entry_ref, own): the account's ledger row with the reference, newest date, then first."""
    return ledger.where("coalesce(financial_id, '') <> ''").groupBy("account", F.col("financial_id").alias("entry_ref")).agg(F.max_by(_row(), F.struct("date", -F.col("ord"))).alias("own"))


_OWN = ("pending_key", "feed_ord", "account", "status", "date", "amount_cents", "entry_ref", "payee", "notes", "title", "payee_id", "new_id")


def _with_ids(x: DataFrame, payee_ids: DataFrame) -> DataFrame:
    """Keyed rows with the id of their payee and the id they get if they become ledger rows."""
    payees = payee_ids.groupBy(F.col("name").alias("title")).agg(F.min("id").alias("payee_id"))
    new_id = stable_id(F.lit("txn"), F.col("account").cast("string"), F.col("entry_ref"), F.col("date").cast("string"), F.col("amount_cents").cast("string"), F.col("feed_ord").cast("string"))
    payee_id = F.coalesce("payee_id", F.when(F.col("title") != "", stable_id(F.lit("payee"), F.col("title"))), F.lit(""))
    return x.join(payees, "title", "left").withColumns({"payee": _text("payee"), "notes": _text("notes"), "payee_id": payee_id, "new_id": new_id})


_SETTLED_DDL = (
    "feed_ord bigint, account bigint, status string, pending_key string, entry_ref string, date date, amount_cents bigint, branch string, how string, ledger_id string, changed boolean, "
    "notes string, payee_id string, payee_name string, cleared boolean, imported_payee string"
)
_SETTLED = pa.schema(
    [("feed_ord", pa.int64()), ("account", pa.int64()), ("status", pa.string()), ("pending_key", pa.string()), ("entry_ref", pa.string()), ("date", pa.date32()), ("amount_cents", pa.int64()), ("branch", pa.string()), ("how", pa.string()), ("ledger_id", pa.string()), ("changed", pa.bool_())]
    + [("notes", pa.string()), ("payee_id", pa.string()), ("payee_name", pa.string()), ("cleared", pa.bool_()), ("imported_payee", pa.string())]
)


class Key:
    """What is known of one pending key while its rows go by: whether its reference was booked, the row that waits, and
    by account the ledger row with its reference as it is by now."""

    def __init__(self, name: str, booked: bool, waits: dict | None, rows: MutableMapping | None = None):
        self.name, self.booked, self.waits = name, booked, waits
        self.rows = {} if rows is None else rows

    def step(self, r: SimpleNamespace) -> dict:
        self.booked |= r.ref_known
        if r.own is not None:
            self.rows.setdefault(r.account, dict(r.own))
        if r.status == "PDNG":
            if self.waits is not None:
                return {"branch": "pending_known"}
            row, done = self.reconcile(r, False)
            if done["changed"]:
                self.waits = row
            return {"branch": "pending_new", **done}
        if r.entry_ref and self.booked:
            return {"branch": "ref_known"}
        if self.waits is None:
            _, done = self.reconcile(r, True)
            self.booked |= bool(r.entry_ref) and done["changed"]
            return {"branch": "booked", **done}
        row, self.waits, self.booked = self.waits, None, self.booked or bool(r.entry_ref)
        if row["account"] != r.account:  # not among the account's rows: the pending row is gone
            return {"branch": "pending_gone", **self.reconcile(r, True)[1]}
        row = self.rows[r.account] if r.account in self.rows and self.rows[r.account]["id"] == row["id"] else row
        row["cleared"] = True
        return {"branch": "confirmed", "how": "pending", "changed": True, **_values(row)}

    def reconcile(self, r: SimpleNamespace, cleared: bool) -> tuple[dict, dict]:
        """The account's row with the reference after the feed row's values, or a new row. An empty value changes
        nothing, cleared follows the feed, and the imported payee is only filled when empty."""
        row = self.rows.get(r.account) if r.entry_ref else None
        if row is None:
            row = {"id": r.new_id, "account": r.account, "amount_cents": r.amount_cents, "notes": r.notes, "payee_id": r.payee_id, "payee_name": r.title, "cleared": cleared, "imported_payee": r.payee}
            if r.entry_ref:
                self.rows[r.account] = row
            return row, {"how": "created", "changed": True, **_values(row)}
        new = {"cleared": cleared}
        if r.notes:
            new["notes"] = r.notes
        if r.title and r.title != row["payee_name"] and r.payee_id != row["payee_id"]:
            new |= {"payee_id": r.payee_id, "payee_name": r.title}
        if r.payee and not row["imported_payee"]:
            new["imported_payee"] = r.payee
        changed = any(row[k] != v for k, v in new.items())
        row |= new
        return row, {"how": "exact", "changed": changed, **_values(row)}


def _values(row: dict) -> dict:
    """A ledger row's id and values as columns of the settled row."""
    return {"ledger_id": row["id"], **{k: row[k] for k in ("amount_cents", "notes", "payee_id", "payee_name", "cleared", "imported_payee")}}


def _field(rows: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(rows, name)


def _alone(b: pa.RecordBatch) -> pa.RecordBatch:
    """What ``Key.step`` says of rows that have their key for themselves, for all of them at once."""
    x, own, waits = {n: b.column(n) for n in b.schema.names}, b.column("own"), b.column("pending_row")
    is_ = lambda c: pc.fill_null(c, False)
    filled = lambda c: is_(pc.not_equal(x[c], ""))
    kept = lambda c: pc.if_else(use_own, _field(own, c), pc.if_else(use_waits, _field(waits, c), pa.scalar(None, _field(own, c).type)))
    pending, waiting = is_(pc.equal(x["status"], "PDNG")), x["pending_id"].is_valid()
    account = _field(waits, "account")
    here = pc.and_(waits.is_valid(), pc.or_(is_(pc.equal(account, x["account"])), pc.and_(account.is_null(), x["account"].is_null())))
    known = pc.and_(filled("entry_ref"), is_(x["ref_known"]))
    booked = pc.if_else(known, "ref_known", pc.if_else(pc.invert(waiting), "booked", pc.if_else(here, "confirmed", "pending_gone")))
    branch = pc.if_else(pending, pc.if_else(waiting, "pending_known", "pending_new"), booked)
    confirmed, looked = pc.equal(branch, "confirmed"), pc.is_in(branch, pa.array(["pending_new", "booked", "pending_gone"]))
    exact = pc.and_(looked, pc.and_(own.is_valid(), filled("entry_ref")))
    created = pc.and_not(looked, exact)
    use_own = pc.or_(exact, pc.and_(confirmed, is_(pc.equal(_field(own, "id"), _field(waits, "id")))))
    use_waits = pc.and_not(confirmed, use_own)
    cleared = pc.if_else(pc.or_(looked, confirmed), pc.invert(pending), pa.scalar(None, pa.bool_()))
    names = pc.and_(pc.and_(exact, filled("title")), pc.and_(is_(pc.not_equal(x["title"], _field(own, "payee_name"))), is_(pc.not_equal(x["payee_id"], _field(own, "payee_id")))))
    imports = pc.and_(pc.and_(exact, filled("payee")), is_(pc.equal(_field(own, "imported_payee"), "")))
    notes = pc.if_else(pc.or_(created, pc.and_(exact, filled("notes"))), x["notes"], kept("notes"))
    moved = pc.or_(pc.fill_null(pc.not_equal(_field(own, "cleared"), cleared), True), is_(pc.not_equal(notes, _field(own, "notes"))))
    changed = pc.or_(pc.or_(created, confirmed), pc.and_(exact, pc.or_(moved, pc.or_(names, imports))))
    made = {
        "branch": branch, "how": pc.if_else(confirmed, "pending", pc.if_else(exact, "exact", pc.if_else(created, "created", pa.scalar(None, pa.string())))),
        "ledger_id": pc.if_else(created, x["new_id"], kept("id")), "changed": changed, "amount_cents": pc.if_else(pc.or_(use_own, use_waits), kept("amount_cents"), x["amount_cents"]), "notes": notes,
        "payee_id": pc.if_else(pc.or_(created, names), x["payee_id"], kept("payee_id")), "payee_name": pc.if_else(pc.or_(created, names), x["title"], kept("payee_name")),
        "cleared": cleared, "imported_payee": pc.if_else(pc.or_(created, imports), x["payee"], kept("imported_payee")),
    }
    return pa.RecordBatch.from_arrays([made.get(f.name, x.get(f.name)).cast(f.type) for f in _SETTLED], schema=_SETTLED)


def _values_of(column: pa.Array) -> list:
    """A column's values; a struct's are made of its fields' values, which is much faster than row by row."""
    if not pa.types.is_struct(column.type):
        return column.to_pylist()
    names = [f.name for f in column.type]
    fields = zip(*[c.to_pylist() for c in column.flatten()], strict=True)
    return [dict(zip(names, v, strict=True)) if ok else None for ok, v in zip(column.is_valid().to_pylist(), fields, strict=True)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place. Keys of one row are told at once, the others are walked row by row; the last key of
    a batch may go on in the next one."""
    key, last = None, None
    same = ("feed_ord", "account", "status", "pending_key", "entry_ref", "date", "amount_cents")
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("pending_key")
        new = pc.invert(pc.equal(names[1:], names[:-1]))
        first, end = pa.array([last is None or names[0].as_py() != last]), pa.array([False])
        last = names[-1].as_py()
        alone = pc.and_(pa.concat_arrays([first, new]), pa.concat_arrays([new, end]))
        if alone.true_count:
            yield _alone(batch.filter(alone))
        rest, out = batch.filter(pc.invert(alone)), []
        for values in zip(*[_values_of(c) for c in rest.columns], strict=True):
            x = dict(zip(rest.schema.names, values, strict=True))
            r = SimpleNamespace(**x)
            if key is None or key.name != r.pending_key:
                key = Key(r.pending_key, r.ref_known, r.pending_row or {"id": r.pending_id, "account": None} if r.pending_id is not None else None)
            out.append({"changed": False, **{k: x[k] for k in same}, **key.step(r)})
        yield pa.RecordBatch.from_pylist(out, _SETTLED)


def settle(feed: DataFrame, refs: DataFrame, pending: DataFrame, ledger: DataFrame, payee_ids: DataFrame) -> DataFrame:
    """Every feed row with its branch, how its ledger row was found (pending, exact, created; null: not looked for),
    that row's id and values after it (amount_cents is the feed's if there is none), and the counters it moves.

    refs: ref; pending: key, txn_id ("id" or "id|day"); payee_ids: name, id. feed_ord is the order of the whole cycle."""
    known = _with_state(feed, refs, pending, ledger, payee_ids)
    x = known.repartition("pending_key").sortWithinPartitions("pending_key", "feed_ord").mapInArrow(_walk, _SETTLED_DDL)
    return with_counters(x)


def with_counters(x: DataFrame) -> DataFrame:
    """Settled rows with what each of them counts as."""
    b, touched = F.col("branch"), F.col("changed")
    added = b.isin("pending_new", "pending_gone", "booked") & touched
    skipped = b.isin("pending_known", "ref_known") | (b.isin("pending_new", "booked") & ~touched)
    new_ref = (F.col("entry_ref") != "") & (b.isin("confirmed", "pending_gone") | ((b == "booked") & touched))
    return x.select(
        "*", added.alias("added"), (b == "confirmed").alias("confirmed"), skipped.alias("skipped"), new_ref.alias("new_ref"), ((b == "pending_new") & touched).alias("sets_pending"),
        b.isin("confirmed", "pending_gone").alias("drops_pending"), (b.isin("confirmed", "pending_gone") | ((b == "booked") & touched)).alias("for_rules"),
    )


def counters(settled: DataFrame) -> DataFrame:
    """added, confirmed and skipped by account and in all (account null)."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return settled.rollup("account").agg(count("added"), count("confirmed"), count("skipped"))


def next_refs(refs: DataFrame, settled: DataFrame, as_of: Column, days: int = 21) -> DataFrame:
    """Refs (ref, date) after the cycle, pruned."""
    new = settled.where("new_ref").groupBy(F.col("entry_ref").alias("ref")).agg(F.max("date").alias("date"))
    merged = refs.select("ref", "date").join(new.select("ref"), "ref", "left_anti").unionByName(new)
    return merged.where(F.col("date") >= F.date_sub(as_of, days))


def next_pending(pending: DataFrame, settled: DataFrame) -> DataFrame:
    """Pending keys (key, txn_id as "id|day") after the cycle: the last row that set or dropped a key decides."""
    moved = settled.where("sets_pending OR drops_pending").groupBy(F.col("pending_key").alias("key")).agg(F.max_by(F.struct("sets_pending", F.concat_ws("|", "ledger_id", F.date_format("date", "yyyy-MM-dd")).alias("value")), "feed_ord").alias("last"))
    kept = pending.select("key", "txn_id").join(moved.select("key"), "key", "left_anti")
    return kept.unionByName(moved.where("last.sets_pending").select("key", F.col("last.value").alias("txn_id")))


def next_ledger(ledger: DataFrame, settled: DataFrame) -> DataFrame:
    """Ledger rows after the cycle: known ones with the values of the last feed row that met them, then the created ones,
    whose ``ord`` is behind all others' in feed order."""
    values = ("notes", "payee_id", "payee_name", "cleared", "imported_payee")
    met = settled.where("ledger_id IS NOT NULL").groupBy(F.col("ledger_id").alias("__id")).agg(
        F.max_by(F.struct(*values), "feed_ord").alias("__now"), F.min_by(F.struct("account", "date", "amount_cents", "entry_ref", "how", "feed_ord"), "feed_ord").alias("__first")
    )
    old = ledger.join(met, F.col("id") == F.col("__id"), "left").select(*[F.when(F.col("__id").isNotNull(), F.col(f"__now.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in ledger.columns])
    last = ledger.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("__last"))
    made = met.where("__first.how = 'created'").join(F.broadcast(last))  # one row is sent
    own = {"id": F.col("__id"), "ord": F.col("__last") + 1 + F.col("__first.feed_ord"), "financial_id": F.col("__first.entry_ref"), **{c: F.col(f"__first.{c}") for c in ("account", "date", "amount_cents")}, **{c: F.col(f"__now.{c}") for c in values}}
    return old.unionByName(made.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ledger.schema]))


def fetch_window(accounts: DataFrame, pending: DataFrame, last_sync: str | None, as_of: Column) -> DataFrame:
    """Each account's first day to fetch: its start date, else the last sync, else 30 days back; not after the earliest pending day."""
    earliest = pending.agg(F.min(fn.parse_date(fn.split_pending("txn_id")["date"])).alias("earliest"))
    start = F.coalesce(fn.parse_date("start_sync_date"), F.lit(last_sync).cast("date"), F.date_sub(as_of, 30))
    return accounts.join(F.broadcast(earliest)).select("account", F.least(start, F.coalesce("earliest", start)).alias("date_from"))  # one row is sent
