"""The batch operators on the sf0.001 fixture batches against a plain request-by-request
replay of the reference's rules (collected to the test process; small fixture only)."""

import re
from decimal import Decimal, InvalidOperation

from tallyframe.operators import changes as CH
from tallyframe.plans.catalog import registry
from conftest import SF_SMALL


def _key(name):
    return name.lower().replace(" ", "_")


def test_creates_replay(spark, books):
    parties = books.parties.collect()
    keys = {p.normalized_name for p in parties}
    bank = any((p.type or "").lower() == "bank" for p in parties)
    want = {}
    for r in sorted(books.batch("creates").collect(), key=lambda r: r.seq):
        if r.name is None:
            want[r.seq] = "Missing name"
        elif r.ptype == "Bank" and bank:
            want[r.seq] = CH.BANK_MSG
        elif _key(r.name) in keys:
            want[r.seq] = CH.DUP_PARTY_MSG
        else:
            keys.add(_key(r.name))
            bank = bank or r.ptype.lower() == "bank"
            want[r.seq] = None
    got = {r.seq: r.reason for r in registry()["create_parties"](spark, SF_SMALL).collect()}
    assert got == want


def _text(v):
    return "None" if v is None else str(v)


def test_edits_replay(spark, books):
    table = {t.txn_id: t.asDict() for t in books.transactions.collect()}
    audit = []
    for e in sorted(books.batch("edits").collect(), key=lambda r: r.seq):
        if e.field not in ("txn_date", "bill_no", "txn_type", "payment_mode", "amount"):
            continue
        if e.txn_id not in table or not e.new_value:
            continue
        value = e.new_value
        if e.field == "amount":
            if "\u00a0" in value:  # an edit's text is cast by the database, which takes no such blank
                continue
            try:
                value = Decimal(value).quantize(Decimal("0.01"))
            except InvalidOperation:
                continue
            if abs(value) >= 10**16:  # more than the column holds
                continue
        if e.field == "txn_date":
            import datetime as dt
            parts = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})([ T].*)?", value)
            if not parts:
                continue
            value = dt.date(*map(int, parts.groups()[:3]))
        old = table[e.txn_id][e.field]
        audit.append(f"Changed {e.field} from {_text(old)} to {e.new_value} for Txn ID {e.txn_id}")
        table[e.txn_id][e.field] = value
    got_audit = sorted(r.details for r in registry()["edit_audit"](spark, SF_SMALL).collect())
    assert got_audit == sorted(audit)
    got = {r.txn_id: r for r in registry()["edit_transactions"](spark, SF_SMALL).collect()}
    for tid, row in table.items():
        g = got[tid]
        assert (g.txn_date, g.bill_no, g.txn_type, g.payment_mode) == (
            None if row["txn_date"] is None else row["txn_date"].isoformat(), row["bill_no"], row["txn_type"],
            row["payment_mode"])
        assert g.amount == (None if row["amount"] is None else float(row["amount"]))
