"""Batch change operators against a request-by-request replay of the reference's rules."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import changes as CH
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS


def _key(name):
    return name.lower().replace(" ", "_")


def _replay_creates(existing, creates):
    keys = {_key(n) for n, _ in existing}
    bank = any((t or "").lower() == "bank" for _, t in existing)
    out = {}
    for seq, name, ptype in sorted(creates):
        if name is None:
            out[seq] = "Missing name"
            continue
        if ptype == "Bank" and bank:
            out[seq] = CH.BANK_MSG
            continue
        if _key(name) in keys:
            out[seq] = CH.DUP_PARTY_MSG
            continue
        keys.add(_key(name))
        if ptype.lower() == "bank":
            bank = True
        out[seq] = None
    return out


def _parties(spark, existing):
    rows = [(i + 1, n, _key(n), t, False) for i, (n, t) in enumerate(existing)]
    return spark.createDataFrame(rows, PARTIES)


def test_create_parties_matches_replay(spark):
    rnd = random.Random(11)
    names = ["Acme", "Beta Co", "beta co", "Gamma", "Delta", "Bank One", "bank one", "Zeta"]
    types = ["Customer", "Bank", "bank", "Supplier", "Credit Customer"]
    for trial in range(6):
        existing = [("Acme", "Customer")] + ([("Old Bank", "Bank")] if trial % 2 else [])
        creates = [(s, rnd.choice(names + [None]), rnd.choice(types)) for s in rnd.sample(range(1000), 25)]
        df = spark.createDataFrame([(s, n, t, False) for s, n, t in creates],
                                   "seq long, name string, ptype string, credit boolean")
        res = CH.create_parties(_parties(spark, existing), df)
        got = {r.seq: r.reason for r in res.outcome.collect()}
        assert got == _replay_creates(existing, creates)
        assert res.table.count() == len(existing) + sum(v is None for v in got.values())



def test_create_after_blocked_bank_of_same_key(spark):
    # Beta's first create is a blocked Bank; its later Customer create is the one kept.
    # Only the exact type "Bank" is blocked; "bank" passes (as in the replay).
    creates = [(1, "Alpha", "Bank"), (2, "Beta", "Bank"), (3, "Beta", "Customer"),
               (4, "Gamma", "bank"), (5, "Beta", "Supplier")]
    for existing, expected in [
        ([("Acme", "Customer")], {1: None, 2: CH.BANK_MSG, 3: None, 4: None, 5: CH.DUP_PARTY_MSG}),
        ([("Old Bank", "Bank")], {1: CH.BANK_MSG, 2: CH.BANK_MSG, 3: None, 4: None, 5: CH.DUP_PARTY_MSG}),
    ]:
        df = spark.createDataFrame([(s, n, t, False) for s, n, t in creates],
                                   "seq long, name string, ptype string, credit boolean")
        got = {r.seq: r.reason for r in CH.create_parties(_parties(spark, existing), df).outcome.collect()}
        assert got == expected == _replay_creates(existing, creates)

def _tx(spark, n=6):
    import datetime as dt
    from decimal import Decimal

    rows = [(i, dt.date(2024, 1, 1 + i), f"B{i}", 1, "Sale", "Cash", Decimal(f"{i}0.00")) for i in range(n)]
    rows.append((n, None, None, None, None, None, None))
    return spark.createDataFrame(rows, TRANSACTIONS)


def test_edits_are_sequential(spark):
    tx = _tx(spark)
    edits = spark.createDataFrame([
        (1, 2, "a", "amount", "5.5"), (2, 2, "a", "amount", "7"), (3, 2, "a", "amount", "x"),
        (4, 99, "a", "amount", "1"), (5, 2, "a", "party_id", "3"), (6, 3, "a", "bill_no", ""),
        (7, 6, "a", "bill_no", "NEW"), (8, 1, "a", "txn_date", "2025-02-03"),
    ], "seq long, txn_id long, admin_user string, field string, new_value string")
    res = CH.edit_transactions(tx, edits, hot_rows=1, parts=2)
    reasons = {r.seq: r.reason for r in res.outcome.collect()}
    assert reasons == {1: None, 2: None, 3: "Invalid value for amount", 4: CH.NOT_FOUND, 5: CH.INVALID_FIELD,
                       6: CH.EMPTY_VALUE, 7: None, 8: None}
    audit = sorted(r.details for r in res.audit.collect())
    assert audit == ["Changed amount from 20.00 to 5.5 for Txn ID 2", "Changed amount from 5.50 to 7 for Txn ID 2",
                     "Changed bill_no from None to NEW for Txn ID 6",
                     "Changed txn_date from 2024-01-02 to 2025-02-03 for Txn ID 1"]
    t = {r.txn_id: r for r in res.table.collect()}
    assert str(t[2].amount) == "7.00" and t[6].bill_no == "NEW" and str(t[1].txn_date) == "2025-02-03"


def test_deletes_first_wins_and_audit(spark):
    tx = _tx(spark)
    deletes = spark.createDataFrame([(1, 2, "a"), (2, 2, "b"), (3, 42, "c"), (4, 6, "d")],
                                    "seq long, txn_id long, admin_user string")
    res = CH.delete_transactions(tx, deletes)
    assert {r.seq: r.reason for r in res.outcome.collect()} == {1: None, 2: CH.NOT_FOUND, 3: CH.NOT_FOUND, 4: None}
    assert sorted(r.details for r in res.audit.collect()) == [
        "Deleted Txn ID 2. Date: 2024-01-03, Bill: B2, Amount: 20.00",
        "Deleted Txn ID 6. Date: None, Bill: None, Amount: None"]
    assert res.table.count() == 5


def test_renames(spark):
    parties = _parties(spark, [("Acme", "Customer"), ("Beta", "Supplier"), ("Gamma", "Customer")])
    renames = spark.createDataFrame([
        (1, "acme", "Acme Ltd", "u"), (2, "Acme", "Acme Two", "u"), (3, "Beta", "gamma", "u"),
        (4, "Nope", "X", "u"), (5, "Gamma", "Acme Ltd", "u"), (6, "Beta", "Beta", "u"),
    ], "seq long, old_name string, new_name string, admin_user string")
    res = CH.rename_parties(parties, renames)
    reasons = {r.seq: r.reason for r in res.outcome.collect()}
    assert reasons == {1: None, 2: CH.PARTY_NOT_FOUND, 3: CH.NEW_NAME_TAKEN, 4: CH.PARTY_NOT_FOUND,
                       5: CH.NEW_NAME_TAKEN, 6: None}
    names = {r.party_id: r.name for r in res.table.collect()}
    assert names == {1: "Acme Ltd", 2: "Beta", 3: "Gamma"}


def test_renames_equal_a_replay_in_request_order(spark):
    """Random batches, many at once (each batch has its own parties), with chains of losers and rejected first requests."""
    import random

    rng = random.Random(5)
    names, requests, want = [], [], {}
    for batch in range(20):
        own = [f"b{batch} p{k}" for k in range(6)]
        fresh = [f"b{batch} n{k}" for k in range(5)]
        names += own
        renamed, given = set(), set()
        for k in range(30):
            seq = batch * 1000 + k
            old = rng.choice([*own, f"b{batch} nobody"])
            new = rng.choice([*fresh, *own])
            requests.append((seq, old, new.upper(), "u"))
            if old not in own or old in renamed:
                want[seq] = CH.PARTY_NOT_FOUND
            elif (new in own and new != old) or new in given:
                want[seq] = CH.NEW_NAME_TAKEN
            else:
                want[seq] = None
                renamed.add(old)
                given.add(new)
    parties = _parties(spark, [(n, "Customer") for n in names])
    renames = spark.createDataFrame(requests, "seq long, old_name string, new_name string, admin_user string")
    res = CH.rename_parties(parties, renames)
    assert {r.seq: r.reason for r in res.outcome.collect()} == want
    new_name = {old: new for seq, old, new, _ in requests if want[seq] is None}
    assert sorted(r.name for r in res.table.collect()) == sorted(new_name.get(n, n) for n in names)


def test_a_last_change_to_null_counts(spark):
    settings = spark.createDataFrame([("a", "1"), ("b", "2")], "setting_key string, setting_value string")
    changes = spark.createDataFrame([(1, "a", "5"), (2, "a", None)], "seq long, setting_key string, setting_value string")
    got = {r.setting_key: r.setting_value for r in CH.upsert_settings(settings, changes).collect()}
    assert got == {"a": None, "b": "2"}


def test_upsert_twice_is_once(spark):
    import datetime as dt

    cash = spark.createDataFrame([(dt.date(2024, 1, 1), 10), (dt.date(2024, 1, 2), 20)],
                                 "cash_date date, cash_in_hand int").withColumn("cash_in_hand", F.col("cash_in_hand").cast("decimal(18,2)"))
    counts = spark.createDataFrame([(1, "2024-01-02", "25", "a"), (2, "2024-01-03", "30", "a"),
                                    (3, "2024-01-02", "26.5", "a"), (4, "2024-01-04", "abc", "a")],
                                   "seq long, date string, cash_in_hand string, admin_user string")
    once = CH.upsert_cash(cash, counts)
    twice = CH.upsert_cash(once.table, counts)
    as_set = lambda d: sorted((str(r.cash_date), str(r.cash_in_hand)) for r in d.collect())
    assert as_set(once.table) == as_set(twice.table) == [("2024-01-01", "10.00"), ("2024-01-02", "26.50"),
                                                         ("2024-01-03", "30.00")]
    assert {r.seq: r.reason for r in once.outcome.collect()}[4] == "Enter valid Cash In Hand"


def test_settings_read_and_seed(spark):
    s = spark.createDataFrame([("company_name", "Alpha Traders"), ("opening_cash_seed", "abc")],
                              "setting_key string, setting_value string")
    assert CH.setting_value(s, "opening_cash_seed", 7.0).first()[0] == 7.0
    assert CH.setting_value(s, "missing", 1.5).first()[0] == 1.5
    seeds = spark.createDataFrame([(2, "company_name", "Other"), (1, "x", "first"), (3, "x", "second")],
                                  "seq long, setting_key string, setting_value string")
    got = {r.setting_key: r.setting_value for r in CH.seed_if_absent(s, seeds).collect()}
    assert got == {"company_name": "Alpha Traders", "opening_cash_seed": "abc", "x": "first"}
    assert tuple(CH.company_list(s).first()) == ("Alpha Traders", "alpha_traders")


def test_opening_cash_and_float_text(spark):
    from tallyframe.functions.money import py_float_text

    vals = spark.createDataFrame([(25.0,), (1234.5,), (0.1,), (-3.0,), (None,)], "x double")
    assert [r[0] for r in vals.select(py_float_text("x")).collect()] == ["25.0", "1234.5", "0.1", "-3.0", None]
    s = spark.createDataFrame([("opening_cash_seed", "50000.0")], "setting_key string, setting_value string")
    req = spark.createDataFrame([(1, "75000", "admin"), (2, "abc", "admin"), (3, "80000.5", "admin")],
                                "seq long, amount string, admin_user string")
    res = CH.set_opening_cash(s, req)
    assert CH.setting_value(res.table, "opening_cash_seed").first()[0] == 80000.5
    assert sorted(r.details for r in res.audit.collect()) == ["Opening Cash Seed set to 75000.0",
                                                             "Opening Cash Seed set to 80000.5"]
    assert {r.seq: r.reason for r in res.outcome.collect()}[2] == "Enter valid opening cash"


def test_cash_counts_set_their_time(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    table = spark.createDataFrame([(dt.date(2026, 1, k), 5, dt.datetime(2026, 1, k)) for k in (1, 2)],
                                  "cash_date date, cash_in_hand long, updated_at timestamp_ntz").withColumn("cash_in_hand", F.col("cash_in_hand").cast("decimal(18,2)"))
    counts = spark.createDataFrame([(1, "2026-01-02", "7", "a"), (2, "2026-01-03", "8", "a"), (3, "2026-01-01", "x", "a")],
                                   "seq long, date string, cash_in_hand string, admin_user string")
    now = F.lit("2026-02-01 10:00:00").cast("timestamp_ntz")
    rows = CH.upsert_cash(table, counts, now).table.orderBy("cash_date").collect()
    assert [(r.cash_date.day, float(r.cash_in_hand), str(r.updated_at)) for r in rows] == [
        (1, 5.0, "2026-01-01 00:00:00"), (2, 7.0, "2026-02-01 10:00:00"), (3, 8.0, "2026-02-01 10:00:00")]
    assert CH.upsert_cash(table.drop("updated_at"), counts).table.columns == ["cash_date", "cash_in_hand"]
