"""The sync cycle as a stream: every pending key keeps its own state between batches, beside the others of its bucket.

``settle_stream`` gives what ``lifecycle.settle`` gives for the same rows batch by batch, with the tables of the batch
form as initial state and the key's walk of the batch form as its step. A key's state is whether (and with which date)
its reference was booked, the row that waits, and by account the ledger row with its reference.

A booked reference is forgotten by the days of events, not by the clock of a machine: rows carry ``as_of``, the day of
their cycle, and when that moves on, a reference dated more than REF_DAYS before it is known no more. ``keep_days``
also lets the state of keys that no row has met for so many days go (state TTL), so that it stays bounded.
"""

import datetime as dt
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import lifecycle as lc
from . import buckets as bk
from .pipelines import REF_DAYS

_VALUES = ("id", "account", "amount_cents", "notes", "payee_id", "payee_name", "cleared", "imported_payee")
_ROW = "id string, account bigint, amount_cents bigint, notes string, payee_id string, payee_name string, cleared boolean, imported_payee string"
_OUT = lc._SETTLED_DDL

#: Stateful processors keep their state in RocksDB.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def _plain(x):
    """A value of a pandas column as Python's own; null for what pandas has for it."""
    return None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x


_LEDGER_ROW = pa.struct([("id", pa.string()), ("account", pa.int64()), ("amount_cents", pa.int64()), *[(c, pa.string()) for c in ("notes", "payee_id", "payee_name")], ("cleared", pa.bool_()), ("imported_payee", pa.string())])
_KEYS = pa.schema([("key", pa.string()), ("booked", pa.bool_()), ("ref_date", pa.date32()), ("as_of", pa.date32()), ("touched", pa.int64()), ("waits", _LEDGER_ROW), ("rows", pa.list_(_LEDGER_ROW))])
_WHOLE = ("feed_ord", "account", "amount_cents")


class _Key(lc.Key):
    """A key of the batch form with the dates it is forgotten by."""

    def __init__(self, name: str, x: dict | None):
        x = x or {"booked": False, "ref_date": None, "as_of": None, "waits": None, "rows": ()}
        super().__init__(name, x["booked"], x["waits"], {row["account"]: row for row in x["rows"]})
        self.ref_date, self.as_of = x["ref_date"], x["as_of"]

    def state(self, now: int | None) -> dict:
        return {"key": self.name, "booked": self.booked, "ref_date": self.ref_date, "as_of": self.as_of, "touched": now, "waits": self.waits, "rows": list(self.rows.values())}


class Settling(StatefulProcessor):
    """The walk of a bucket's keys (see ``buckets``)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getValueState("keys", "held binary", self.ttl_ms)

    def _open(self, names: set[str], timerValues) -> tuple[dict[str, _Key], pa.Table, int | None]:
        """The keys of ``names``, the states of the bucket's others, and the time of the batch if keys live for a time."""
        held, now = self.keys.get(), None
        table = bk.load(held[0] if held else None, _KEYS)
        if self.ttl_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            table = table.filter(pc.greater(table["touched"], now - self.ttl_ms))
        met, rest = bk.parted(table, names)
        return {n: _Key(n, met.get(n)) for n in names}, rest, now

    def _close(self, keys: dict[str, _Key], rest: pa.Table, now: int | None) -> None:
        self.keys.update((bk.saved(rest, (k.state(now) for k in keys.values())),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        told = bk.records([initialState], _WHOLE)
        keys, rest, now = self._open({x["pending_key"] for x in told}, timerValues)
        for x in told:
            k, row = keys[x["pending_key"]], {c: x[c] for c in _VALUES}
            if x["kind"] == "ref":
                k.booked, k.ref_date = True, max(filter(None, (k.ref_date, x["date"])), default=None)
            elif x["kind"] == "waiting":
                k.waits = row
            else:
                k.rows[row["account"]] = row
        self._close(keys, rest, now)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = bk.records(rows, _WHOLE)
        keys, rest, now = self._open({x["pending_key"] for x in batch}, timerValues)
        names = [c.split()[0] for c in _OUT.split(", ")]
        out = []
        for x in batch:
            k, r = keys[x["pending_key"]], SimpleNamespace(**x, ref_known=False, own=None)
            if r.as_of is not None and (k.as_of is None or r.as_of > k.as_of):
                k.as_of = r.as_of
                if k.booked and k.ref_date is not None and k.ref_date < k.as_of - dt.timedelta(days=REF_DAYS):
                    k.booked = False
            done = k.step(r)
            if r.entry_ref and (done["branch"] in ("confirmed", "pending_gone") or done["branch"] == "booked" and done["changed"]):
                k.ref_date = r.date
            told = {"changed": False, **{c: x[c] for c in ("feed_ord", "account", "status", "pending_key", "entry_ref", "date", "amount_cents")}, **done}
            out.append([told.get(c) for c in names])
        self._close(keys, rest, now)
        yield pd.DataFrame({c: pd.Series(v, dtype="Int64" if c in _WHOLE else object) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def initial_state(refs: DataFrame, pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the tables of the batch form say of each key: refs (ref, date), pending (key, txn_id), ledger."""
    none = {c: F.lit(None) for c in _VALUES}
    shape = lambda df, key, kind, date, row: df.select(F.col(key).alias("pending_key"), F.lit(kind).alias("kind"), date.cast("date").alias("date"), *[F.col(f"{row}.{c}").alias(c) if row else none[c].cast(t).alias(c) for c, t in (x.split() for x in _ROW.split(", "))])
    known = shape(refs.where("ref <> ''"), "ref", "ref", F.col("date"), None)
    waiting = lc._waiting(pending, ledger)
    gone = F.struct(F.col("pending_id").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _ROW.split(", ")[1:])])
    waiting = waiting.withColumn("pending_row", F.coalesce("pending_row", gone.cast(dict(waiting.dtypes)["pending_row"])))
    named = lc._named(ledger)
    return known.unionByName(shape(waiting, "pending_key", "waiting", F.lit(None), "pending_row")).unionByName(shape(named, "entry_ref", "named", F.lit(None), "own"))


def settle_stream(feed: DataFrame, payee_ids: DataFrame, initial: DataFrame | None = None, keep_days: int | None = None) -> DataFrame:
    """``lifecycle.settle`` of a stream of feed rows (``as_of``: the day of a row's cycle, null: none is forgotten).

    ``initial`` is ``initial_state`` of the tables before the stream. Late rows are judged like others."""
    if "as_of" not in feed.columns:
        feed = feed.withColumn("as_of", F.lit(None).cast("date"))
    x = lc.with_keys(feed.withColumn("entry_ref", lc._text("entry_ref"))).withColumn("title", lc.fn.title_case(lc._text("payee")))
    keyed = lc._with_ids(x, payee_ids).select(bk.bucket("pending_key").alias("bucket"), *bk.exact((*lc._OWN, "as_of"), _WHOLE)).groupBy("bucket")
    ttl = None if keep_days is None else keep_days * 86_400_000
    start = None if initial is None else initial.select(bk.bucket("pending_key").alias("bucket"), *bk.exact(initial.columns, _WHOLE)).groupBy("bucket")
    return lc.with_counters(keyed.transformWithStateInPandas(Settling(ttl), _OUT, "append", "None" if ttl is None else "ProcessingTime", initialState=start))
