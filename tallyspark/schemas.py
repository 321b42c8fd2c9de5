"""Fixed schemas of feed records, the ledger and the engine's own store."""

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

#: Every key a feed record may hold. Values that may be text, number or list stay raw JSON text.
FEED_JSON = _of(
    status=S, transaction_date=S, booking_date=S, value_date=S, transaction_amount=_of(amount=S), credit_debit_indicator=S, credit_debit_indic=S,
    creditor=_of(name=S), creditor_name=S, debtor=_of(name=S), debtor_name=S, remittance_information=S, remittance_information_unstructured=S,
    entry_reference=S, transaction_id=S,
)
FEED_PAGE = _of(transactions=T.ArrayType(S), continuation_key=S)
FEED_TXN = _of(status=S, date=T.DateType(), amount_cents=L, payee=S, notes=S, entry_ref=S)

LEDGER_ACCOUNTS = _of(id=S, name=S, offbudget=I, closed=I, tombstone=I)
LEDGER_PAYEES = _of(id=S, name=S, tombstone=I, transfer_acct=S)
LEDGER_PAYEE_MAPPING = _of(id=S, targetId=S)
LEDGER_TRANSACTIONS = _of(id=S, acct=S, date=I, amount=L, description=S, notes=S, financial_id=S, cleared=I, tombstone=I, isParent=I, isChild=I, reconciled=I, sort_order=D, imported_description=S, category=S)
LEDGER_RULES = _of(id=S, stage=S, conditions_op=S, conditions=S, actions=S, tombstone=I)
LEDGER_CLOCK = _of(id=S, clock=S)

STORE_SETTINGS = _of(key=S, value=S)
STORE_BANK_ACCOUNTS = _of(id=L, session_id=S, account_uid=S, bank_name=S, bank_country=S, actual_account=S, start_sync_date=S, session_expiry=S, created_at=S)
STORE_IMPORTED_REFS = _of(ref=S, date=S)
STORE_PENDING = _of(key=S, txn_id=S)
STORE_SYNC_LOG = _of(id=L, ran_at=S, status=S, tx_added=I, tx_confirmed=I, tx_skipped=I, duration_sec=D, message=S)

MESSAGE = _of(dataset=S, row=S, column=S, value=S, ord=L)

CONDITION = _of(field=S, op=S, value=S, type=S)
ACTION = _of(field=S, op=S, value=S, type=S)

INVENTORY = _of(components=T.ArrayType(_of(name=S, version=S, purl=S, licenses=T.ArrayType(_of(license=_of(id=S, name=S))))))
LEGACY_STATE = _of(session_id=S, account_uid=S, session_expiry=S, last_sync_date=S, pending_map=T.MapType(S, S), imported_refs=T.MapType(S, S))
