"""Matching, reconciliation and the sync cycle over whole test tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import cycle as cy
from ..operators import lifecycle as lc
from ..operators import reconcile as rc
from ..operators import rules as ru
from ..operators import store as st
from ..operators.commit import State
from ..session import scratch
from ..sources import feed as feed_source
from ..sources import testdata as td
from .registry import query
from .rule_queries import RULE_ROWS

_WITH = f"WITH feed AS ({td.FEED_SQL}), ledger AS ({td.LEDGER_SQL})"


def _refs(spark, sf_dir):
    return td.feed(spark, sf_dir).where("feed_ord % 5 = 0").select(F.col("entry_ref").alias("ref"), "date")


def _pending(spark, sf_dir):
    f = td.feed(spark, sf_dir).where("feed_ord % 7 = 0")
    return f.select(F.col("entry_ref").alias("key"), F.concat(F.lit("T"), "feed_ord").alias("txn_id"))


def _payees(spark, sf_dir):
    return td.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("P-"), "c_name").alias("id"))


def _row(id_, conditions, actions, op="and"):
    return {"id": id_, "conditions_op": op, "conditions": json.dumps(conditions), "actions": json.dumps(actions), "tombstone": 0}


CYCLE_RULES = [
    _row("band", [{"type": "number", "field": "amount", "op": "isbetween", "value": {"num1": -1000000, "num2": -30000000}}], [{"field": "category", "op": "set", "value": "housing"}, {"field": "notes", "op": "append-notes", "value": " #b"}]),
    _row("words", [{"type": "string", "field": "notes", "op": "contains", "value": "URGENT"}, {"type": "string", "field": "notes", "op": "matches", "value": "^line \\d+ second$"}], [{"field": "cleared", "op": "set", "value": True}], "or"),
]


def _cycle(spark, sf_dir):
    """Landed pages through the whole cycle: refs pruned, rows settled, rules applied to what was booked. Returns the
    pruned refs, the pending keys, and the settled rows with their matched rules and messages."""
    pages = td.feed_pages(spark, sf_dir)
    feed = feed_source.feed_scan(pages, ["own name"])
    # the cycle's order: account by account, page by page (50 records each here)
    feed = feed.withColumn("feed_ord", (F.col("account") * 10_000_000 + F.col("page_no")) * 64 + F.col("position")).drop("position", "page_no")
    refs = st.prune_refs(_refs(spark, sf_dir), F.lit("1996-01-01").cast("date"))
    settled = lc.settle(feed, refs, _pending(spark, sf_dir), td.ledger(spark, sf_dir), _payees(spark, sf_dir))
    rows = settled.withColumns({c: F.when(F.col("for_rules"), F.col(c)) for c in ("notes", "payee_id", "payee_name", "imported_payee")}).withColumn("category", F.lit(""))
    applied = ru.apply_rules(rows, ru.load_rules(CYCLE_RULES), _payees(spark, sf_dir).select("id", "name"), messages="messages")
    on = F.col("for_rules")
    return refs, applied.withColumns({"matched_rules": F.when(on, F.col("matched_rules")).otherwise(F.array().cast("array<string>")), "messages": F.when(on, F.col("messages")).otherwise(F.filter("messages", lambda _: F.lit(False)))})


CYCLE_SQL = """
WITH f AS (
  SELECT o_orderkey AS k, o_custkey % 50 AS account, o_orderdate::DATE AS date, o_orderpriority AS priority, c_name AS name, o_orderkey % 3 <> 0 AS debit,
         CASE WHEN o_orderkey % 5 = 0 THEN 'BOOK' WHEN o_orderstatus = 'O' THEN 'PDNG' ELSE 'BOOK' END AS status,
         CASE WHEN o_orderkey % 3 <> 0 THEN -1 ELSE 1 END * round(round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR::DOUBLE * 100)::BIGINT AS cents,
         CASE WHEN o_orderkey % 3 <> 0 THEN -1 ELSE 1 END * round(o_totalprice * 100)::BIGINT AS ledger_cents, o_orderkey % 6 <> 0 AS named
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 17 <> 0
), b AS (
  SELECT *, CASE WHEN status = 'PDNG' AND named AND k % 7 = 0 THEN 'pending_known' WHEN status = 'PDNG' THEN 'pending_new' WHEN named AND k % 5 = 0 AND date >= DATE '1995-12-11' THEN 'ref_known'
                 WHEN named AND k % 14 = 0 THEN 'confirmed' WHEN named AND k % 7 = 0 THEN 'pending_gone' ELSE 'booked' END AS branch,
         CASE WHEN k % 2 = 0 THEN priority ELSE 'line ' || k || ' second' END AS feed_notes FROM f
), r AS (
  SELECT *, branch IN ('confirmed', 'pending_gone', 'booked') AS touched,
         CASE WHEN branch <> 'confirmed' THEN feed_notes WHEN k % 10 = 0 THEN 'edited' ELSE 'order ' || priority END AS notes,
         CASE WHEN branch = 'confirmed' OR named AND k % 4 = 0 THEN ledger_cents ELSE cents END AS amount FROM b
), m AS (
  SELECT *, touched AND amount BETWEEN -30000000 AND -1000000 AS band, touched AND (contains(lower(notes), 'urgent') OR regexp_matches(notes, '^line [0-9]+ second$')) AS words FROM r
)
"""


@query(
    "sync_cycle",
    CYCLE_SQL
    + """
SELECT account, count(*) AS rows_in, count(*) FILTER (WHERE branch IN ('pending_new', 'pending_gone', 'booked')) AS added, count(*) FILTER (WHERE branch = 'confirmed') AS confirmed,
       count(*) FILTER (WHERE branch IN ('pending_known', 'ref_known')) AS skipped, count(*) FILTER (WHERE touched) AS touched, sum(band::INT + words::INT)::BIGINT AS rules_applied,
       sum(2 * band::INT + words::INT)::BIGINT AS rule_messages, coalesce(sum(amount) FILTER (WHERE touched), 0)::BIGINT AS touched_cents, count(*) FILTER (WHERE touched) AS new_refs
FROM m GROUP BY account
""",
)
def sync_cycle(spark, sf_dir):
    _, x = _cycle(spark, sf_dir)
    on = F.col("for_rules")
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return x.groupBy("account").agg(
        F.count(F.lit(1)).alias("rows_in"), count("added"), count("confirmed"), count("skipped"), F.count_if(on).alias("touched"), F.sum(F.size("matched_rules")).alias("rules_applied"),
        F.sum(F.size("messages")).alias("rule_messages"), F.coalesce(F.sum(F.when(on, F.col("amount_cents"))), F.lit(0)).alias("touched_cents"), F.count_if(F.col("new_ref")).alias("new_refs"),
    )


@query(
    "cycle_messages",
    CYCLE_SQL
    + """
SELECT 'category' AS "column", 'S:housing' AS value, count(*) AS n FROM m WHERE band HAVING count(*) > 0
UNION ALL SELECT 'notes', 'S:' || notes || ' #b', count(*) FROM m WHERE band GROUP BY notes
UNION ALL SELECT 'cleared', 'N:1', count(*) FROM m WHERE words HAVING count(*) > 0
""",
)
def cycle_messages(spark, sf_dir):
    _, x = _cycle(spark, sf_dir)
    sent = ru.action_messages(x, "ledger_id", "feed_ord")
    return sent.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cycle_refs",
    CYCLE_SQL
    + """
SELECT ref, max(date) AS date FROM (SELECT CASE WHEN named THEN 'REF-' ELSE 'TX-' END || k AS ref, date FROM m WHERE touched UNION ALL
  SELECT 'REF-' || o_orderkey, o_orderdate::DATE FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate::DATE >= DATE '1995-12-11') GROUP BY ref HAVING max(date) >= DATE '1995-12-11'
""",
    dates=("date",),
)
def cycle_refs(spark, sf_dir):
    refs, x = _cycle(spark, sf_dir)
    return lc.next_refs(refs, x, F.lit("1996-01-01").cast("date"))


@query(
    "cycle_commit",
    CYCLE_SQL.replace("c_custkey WHERE o_orderkey % 17 <> 0", "c_custkey WHERE o_orderkey % 17 <> 0 AND (o_custkey % 50) % 10 NOT IN (3, 5, 7, 9)")
    + """, told AS (
  SELECT count(*) FILTER (WHERE branch IN ('pending_new', 'pending_gone', 'booked')) AS added, count(*) FILTER (WHERE branch = 'confirmed') AS confirmed, count(*) FILTER (WHERE branch IN ('pending_known', 'ref_known')) AS skipped,
         sum(band::INT + words::INT)::BIGINT AS rules_applied, sum(2 * band::INT + words::INT)::BIGINT AS outbox, count(*) FILTER (WHERE branch IN ('confirmed', 'pending_gone')) AS dropped, count(*) FILTER (WHERE branch = 'pending_new') AS put,
         count(*) FILTER (WHERE branch IN ('pending_new', 'pending_gone', 'booked') AND NOT (named AND k % 4 = 0)) AS created FROM m
), kept_refs AS (
  SELECT ref FROM (SELECT CASE WHEN named THEN 'REF-' ELSE 'TX-' END || k AS ref, date FROM m WHERE touched UNION ALL
    SELECT 'REF-' || o_orderkey, o_orderdate::DATE FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0 AND o_orderdate::DATE >= DATE '1995-12-11') GROUP BY ref HAVING max(date) >= DATE '1995-12-11'
), start_ AS (
  SELECT count(*) FILTER (WHERE o_orderkey % 7 = 0) AS waiting, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS held FROM orders JOIN customer ON o_custkey = c_custkey
)
SELECT 2 AS version, 'success' AS status, added, confirmed, skipped, rules_applied, outbox, outbox AS counter, (SELECT count(*) FROM kept_refs) AS refs, waiting - dropped + put AS pending, held + created AS ledger FROM told, start_
""",
)
def cycle_commit(spark, sf_dir):
    """Scans of landed pages, some of them broken, through the whole cycle into the second version of a state."""
    folder = scratch(spark, "state")
    rules = spark.createDataFrame([(r["id"], r["conditions_op"], r["conditions"], r["actions"], r["tombstone"]) for r in CYCLE_RULES], cy.TABLES["rules"])
    start = {"refs": _refs(spark, sf_dir), "pending": _pending(spark, sf_dir), "ledger": td.ledger(spark, sf_dir).withColumn("category", F.lit("").cast("string")), "payees": _payees(spark, sf_dir).select("name", "id"), "rules": rules}
    State(spark, folder).commit(start)
    rows, scans = feed_source.scan_accounts(td.landed_pages(spark, sf_dir), ["own name"])
    feed = rows.withColumn("feed_ord", (F.col("account") * 10_000_000 + F.col("page_no")) * 64 + F.col("position")).drop("position", "page_no")
    state = State(spark, folder)
    cy.run(state, feed, scans, dt.date(1996, 1, 1))
    after = State(spark, folder)
    n = lambda name: after.read(name).count()
    log = after.read("log").select("status", "added", "confirmed", "skipped", "rules_applied")  # one row
    clock = after.read("clock").select(fn.parse_clock("clock")["counter"].cast("long").alias("counter"))  # one row
    sizes = {name: F.lit(n(name)).cast("long") for name in ("outbox", "refs", "pending", "ledger")}
    return log.join(clock).withColumns({"version": F.lit(after.version)} | sizes)


@query("ref_anti_join", f"{_WITH} SELECT feed_ord FROM feed WHERE NOT (status = 'BOOK' AND feed_ord % 5 = 0)")
def ref_anti_join(spark, sf_dir):
    f = td.feed(spark, sf_dir)
    refs = _refs(spark, sf_dir).select(F.col("ref").alias("entry_ref"))
    booked = f.where("status = 'BOOK' AND coalesce(entry_ref, '') <> ''").join(refs, "entry_ref", "left_anti").select("feed_ord")
    return booked.unionByName(f.where("status <> 'BOOK' OR coalesce(entry_ref, '') = ''").select("feed_ord"))


@query("exact_id_match", f"{_WITH} SELECT feed_ord, 'T' || feed_ord AS ledger_id FROM feed WHERE feed_ord % 4 = 0")
def exact_id_match(spark, sf_dir):
    return rc.exact_matches(td.feed(spark, sf_dir), td.ledger(spark, sf_dir))


def _coarse(spark, sf_dir, odd: int):
    """Feed rows (odd) or ledger rows (even) on coarse accounts and amounts, so that many compete."""
    f = td.feed(spark, sf_dir).where(f"feed_ord % 2 = {odd}")
    o = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feed_ord"), (F.col("o_custkey") % 20).alias("acct"), F.round(F.col("o_totalprice") / 100000).cast("long").alias("coarse"))
    f = f.join(o, "feed_ord").select("feed_ord", F.col("acct").alias("account"), "date", F.col("coarse").alias("amount_cents"), "payee")
    return f if odd else f.select(F.concat(F.lit("T"), "feed_ord").alias("id"), F.col("feed_ord").alias("ord"), "account", "date", "amount_cents", F.col("payee").alias("payee_name"))


COARSE_SQL = """
WITH c AS (SELECT o_orderkey AS k, o_custkey % 20 AS account, o_orderdate::DATE AS date, round(o_totalprice / 100000)::BIGINT AS cents, c_name AS payee FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (
  SELECT f.k AS feed_ord, 'T' || l.k AS ledger_id, abs(strftime(f.date, '%Y%m%d')::INT - strftime(l.date, '%Y%m%d')::INT) AS distance, lower(f.payee) = lower(l.payee) AS same_payee, l.k AS l_ord
  FROM c f JOIN c l ON f.account = l.account AND f.cents = l.cents AND l.date BETWEEN f.date - 7 AND f.date + 7 WHERE f.k % 2 = 1 AND l.k % 2 = 0)
"""


@query("interval_match", COARSE_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY feed_ord ORDER BY CASE WHEN same_payee THEN 0 ELSE 1 END, distance, l_ord) AS n FROM p) SELECT feed_ord, ledger_id, distance, same_payee FROM b WHERE n = 1")
def interval_match(spark, sf_dir):
    return rc.window_matches(_coarse(spark, sf_dir, 1), _coarse(spark, sf_dir, 0))


@query(
    "greedy_assignment",
    COARSE_SQL.replace("WITH c AS", "WITH RECURSIVE c AS")
    + """, wants AS (
  SELECT f.account, f.cents, p.feed_ord, list(p.ledger_id ORDER BY CASE WHEN p.same_payee THEN 0 ELSE 1 END, p.distance, p.l_ord) AS wanted FROM p JOIN c f ON f.k = p.feed_ord GROUP BY ALL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY account, cents ORDER BY feed_ord) AS turn FROM wants
), served AS (
  SELECT DISTINCT account, cents, 0::BIGINT AS turn, 0::BIGINT AS feed_ord, ''::VARCHAR AS ledger_id, []::VARCHAR[] AS taken FROM turns
  UNION ALL
  SELECT account, cents, turn, feed_ord, free[1], CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END
  FROM (SELECT t.account, t.cents, t.turn, t.feed_ord, s.taken, list_filter(t.wanted, lambda x: NOT list_contains(s.taken, x)) AS free FROM served s JOIN turns t ON t.account = s.account AND t.cents = s.cents AND t.turn = s.turn + 1)
)
SELECT feed_ord, ledger_id FROM served WHERE turn > 0 AND ledger_id IS NOT NULL
""",
)
def greedy_assignment(spark, sf_dir):
    return rc.greedy_matches(_coarse(spark, sf_dir, 1), _coarse(spark, sf_dir, 0))


@query(
    "reconcile_patch",
    f"""
{_WITH}
SELECT f.feed_ord, l.id, l.financial_id, CASE WHEN l.notes <> f.notes THEN f.notes ELSE l.notes END AS notes, f.cleared, l.payee_id, l.payee_name,
       f.payee AS imported_payee, l.notes <> f.notes OR l.cleared <> f.cleared OR l.imported_payee = '' AS changed
FROM feed f JOIN ledger l ON l.financial_id = f.entry_ref AND l.account = f.account
""",
)
def reconcile_patch(spark, sf_dir):
    f, l = td.feed(spark, sf_dir), td.ledger(spark, sf_dir)
    return rc.patch(f, l, rc.exact_matches(f, l), _payees(spark, sf_dir))


@query(
    "reconcile_counts",
    f"""
{_WITH}, x AS (
  SELECT f.account, CASE WHEN l.id IS NULL THEN 'created' ELSE 'exact' END AS how, coalesce(l.notes <> f.notes OR l.cleared <> f.cleared OR l.imported_payee = '', false) AS changed
  FROM feed f LEFT JOIN ledger l ON l.financial_id = f.entry_ref AND l.account = f.account)
SELECT account, how, count(*) AS n, count(*) FILTER (WHERE changed) AS changed FROM x GROUP BY account, how
""",
)
def reconcile_counts(spark, sf_dir):
    x = rc.reconcile(td.feed(spark, sf_dir), td.ledger(spark, sf_dir), _payees(spark, sf_dir), fuzzy=False)
    return x.groupBy("account", "how").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("changed")).alias("changed"))


BRANCH_SQL = """, b AS (
  SELECT *, CASE WHEN status = 'PDNG' AND feed_ord % 7 = 0 THEN 'pending_known' WHEN status = 'PDNG' THEN 'pending_new' WHEN feed_ord % 5 = 0 THEN 'ref_known'
                 WHEN feed_ord % 14 = 0 THEN 'confirmed' WHEN feed_ord % 7 = 0 THEN 'pending_gone' ELSE 'booked' END AS branch FROM feed)
"""


@query("pending_confirm", f"{_WITH}{BRANCH_SQL} SELECT feed_ord, branch FROM b")
def pending_confirm(spark, sf_dir):
    return _settled(spark, sf_dir).select("feed_ord", "branch")


SETTLED_SQL = BRANCH_SQL + """, s AS (
  SELECT b.account, branch, l.id IS NULL OR l.notes <> b.notes OR l.cleared <> b.cleared OR l.imported_payee = '' AS touched
  FROM b LEFT JOIN ledger l ON l.financial_id = b.entry_ref AND l.account = b.account), t AS (
  SELECT account, branch IN ('pending_new', 'pending_gone', 'booked') AND touched AS added, branch = 'confirmed' AS confirmed,
         branch IN ('pending_known', 'ref_known') OR branch IN ('pending_new', 'booked') AND NOT touched AS skipped FROM s)
"""


def _settled(spark, sf_dir):
    return lc.settle(td.feed(spark, sf_dir), _refs(spark, sf_dir), _pending(spark, sf_dir), td.ledger(spark, sf_dir), _payees(spark, sf_dir))


LIFECYCLE_SQL = f"{_WITH}{SETTLED_SQL} SELECT coalesce(account, -1) AS account, sum(added::INT)::BIGINT AS added, sum(confirmed::INT)::BIGINT AS confirmed, sum(skipped::INT)::BIGINT AS skipped FROM t GROUP BY ROLLUP (account)"


@query("lifecycle_counts", LIFECYCLE_SQL)
def lifecycle_counts(spark, sf_dir):
    return lc.counters(_settled(spark, sf_dir)).withColumn("account", F.coalesce("account", F.lit(-1)))


@query("next_refs", f"{_WITH}{BRANCH_SQL}, s AS (SELECT b.*, l.id IS NULL OR l.notes <> b.notes OR l.cleared <> b.cleared OR l.imported_payee = '' AS touched FROM b LEFT JOIN ledger l ON l.financial_id = b.entry_ref AND l.account = b.account) SELECT entry_ref AS ref, date FROM s WHERE date >= DATE '2001-07-11' AND (feed_ord % 5 = 0 OR branch IN ('confirmed', 'pending_gone') OR branch = 'booked' AND touched)", dates=('date',))
def next_refs(spark, sf_dir):
    return lc.next_refs(_refs(spark, sf_dir), _settled(spark, sf_dir), F.lit("2001-08-01").cast("date"))


_NEW_ID = "substr(sha256('txn' || chr(1) || b.account || chr(1) || entry_ref || chr(1) || strftime(b.date, '%Y-%m-%d') || chr(1) || b.amount_cents || chr(1) || feed_ord), 1, 32)"


@query(
    "next_pending",
    f"""{_WITH}{BRANCH_SQL}
SELECT entry_ref AS key, 'T' || feed_ord AS txn_id FROM b WHERE feed_ord % 7 = 0 AND branch NOT IN ('confirmed', 'pending_gone')
UNION ALL
SELECT entry_ref, coalesce(l.id, {_NEW_ID}) || '|' || strftime(b.date, '%Y-%m-%d')
FROM b LEFT JOIN ledger l ON l.financial_id = b.entry_ref AND l.account = b.account
WHERE branch = 'pending_new' AND (l.id IS NULL OR l.notes <> b.notes OR l.cleared <> b.cleared OR l.imported_payee = '')
""",
)
def next_pending(spark, sf_dir):
    return lc.next_pending(_pending(spark, sf_dir), _settled(spark, sf_dir))


def colliding(spark, sf_dir):
    """Feed rows on few keys: every second has no reference, the others share one by tens; keys are shared by three accounts."""
    f = td.feed(spark, sf_dir)
    ref = F.when(F.col("feed_ord") % 2 == 0, "").otherwise(F.concat(F.lit("R"), F.floor(F.col("feed_ord") / 10)))
    return f.withColumns({"entry_ref": ref, "amount_cents": F.col("amount_cents") % 3, "account": F.col("feed_ord") % 3, "notes": F.concat(F.lit("n"), "feed_ord")})


def fold_sql(prior: bool) -> str:
    """The branches of colliding rows, with or without known references and waiting rows before them."""
    return f"""
WITH feed AS ({td.FEED_SQL}), k AS (
  SELECT feed_ord, status, feed_ord % 3 AS account, CASE WHEN feed_ord % 2 = 0 THEN '' ELSE 'R' || (feed_ord // 10) END AS ref,
         CASE WHEN feed_ord % 2 = 0 THEN strftime(date, '%Y-%m-%d') || '|' || printf('%.2f', (amount_cents % 3) / 100.0) ELSE 'R' || (feed_ord // 10) END AS key FROM feed
), prior AS (
  SELECT DISTINCT key, ref, hash_key % 4 = 0 AS was_booked, hash_key % 3 = 0 AS was_waiting, hash_key % 5 AS waits_for
  FROM (SELECT key, ref, CASE WHEN ref = '' THEN 1 ELSE substr(ref, 2)::BIGINT END AS hash_key FROM k)
), rows_ AS (
  SELECT feed_ord, status, account, ref, key, false AS given FROM k
  UNION ALL SELECT -2, 'BOOK', -1, ref, key, true FROM prior WHERE was_booked AND {prior}
  UNION ALL SELECT -1, 'PDNG', waits_for, ref, key, true FROM prior WHERE was_waiting AND {prior}
), b AS (
  SELECT *, coalesce(sum((status <> 'PDNG')::INT) OVER (PARTITION BY key ORDER BY feed_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS booked FROM rows_
), s AS (
  SELECT *, CASE WHEN ref = '' THEN booked ELSE least(booked, 1) END AS seg FROM b
), o AS (
  SELECT *, first_value(CASE WHEN status = 'PDNG' THEN account END IGNORE NULLS) OVER (PARTITION BY key, seg ORDER BY feed_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_for FROM s
)
SELECT feed_ord, CASE WHEN status = 'PDNG' THEN CASE WHEN open_for IS NOT NULL THEN 'pending_known' ELSE 'pending_new' END WHEN ref <> '' AND booked > 0 THEN 'ref_known'
                      WHEN open_for = account THEN 'confirmed' WHEN open_for IS NOT NULL THEN 'pending_gone' ELSE 'booked' END AS branch
FROM o WHERE NOT given
"""


@query("batch_fold", fold_sql(prior=True))
def batch_fold(spark, sf_dir):
    """Keys that repeat in a batch and over accounts, on top of known references and waiting rows of five accounts."""
    feed = colliding(spark, sf_dir)
    refs = feed.where("entry_ref <> ''").select("entry_ref", F.substring("entry_ref", 2, 20).cast("long").alias("k")).distinct()
    pending = refs.where("k % 3 = 0").select(F.col("entry_ref").alias("key"), F.concat(F.lit("W"), "k", F.lit("|2000-01-01")).alias("txn_id"), "k")
    nothing = td.ledger(spark, sf_dir).limit(0)
    held = pending.select(F.concat(F.lit("W"), "k").alias("id"), F.lit(0).cast("long").alias("ord"), (F.col("k") % 5).alias("account"), F.lit("2000-01-01").cast("date").alias("date"), F.lit(1).cast("long").alias("amount_cents"), F.lit(False).alias("cleared"))
    ledger = nothing.unionByName(held, allowMissingColumns=True)
    known = refs.where("k % 4 = 0").select(F.col("entry_ref").alias("ref"))
    return lc.settle(feed, known, pending.select("key", "txn_id"), ledger, _payees(spark, sf_dir)).select("feed_ord", "branch")


@query("fetch_window", f"WITH a AS ({td.BANK_ACCOUNTS_SQL}) SELECT id AS account, least(CASE WHEN start_sync_date <> '' THEN start_sync_date::DATE ELSE DATE '2024-03-01' END, DATE '2024-02-20') AS date_from FROM a", dates=('date_from',))
def fetch_window(spark, sf_dir):
    accounts = td.bank_accounts(spark, sf_dir).select(F.col("id").alias("account"), "start_sync_date")
    pending = accounts.select(F.col("account").cast("string").alias("key"), F.when(F.col("account") % 3 == 0, "T|bad").otherwise("T|2024-02-20").alias("txn_id"))
    return lc.fetch_window(accounts, pending, "2024-03-01", F.lit("2024-03-05").cast("date"))


@query("cycle_rules", f"WITH feed AS ({td.FEED_SQL}) SELECT count(*) FILTER (WHERE status = 'BOOK') AS touched, sum(1 + contains(lower(payee), 'customer#00000001')::INT + (amount_cents > 15000000 AND contains(lower(notes), 'urgent'))::INT + (amount_cents BETWEEN -30000000 AND -1000000 OR lower(notes) = 'order 3-medium')::INT + (lower(notes) IN ('order 1-urgent', 'order 2-high'))::INT) FILTER (WHERE status = 'BOOK')::BIGINT AS rules_applied FROM feed")
def cycle_rules(spark, sf_dir):
    f = td.feed(spark, sf_dir).where("status = 'BOOK'")
    rows = f.select("feed_ord", "account", "amount_cents", "notes", F.col("payee").alias("payee_id"), F.col("payee").alias("payee_name"), F.col("payee").alias("imported_payee"), F.lit("").alias("category"))
    return ru.matched_rules(rows, ru.load_rules(RULE_ROWS)).agg(F.count(F.lit(1)).alias("touched"), F.sum(F.size("matched_rules")).cast("long").alias("rules_applied"))
