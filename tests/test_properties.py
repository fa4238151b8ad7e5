"""Cross-report properties on the sf0.001 tables."""

from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.operators import cash as C
from tallyframe.operators import ledgers as L
from tallyframe.operators import lists as R
from tallyframe.plans.catalog import registry
from conftest import SF_SMALL


def test_last_balance_is_signed_total(books):
    led = L.party_ledger(books.transactions, books.parties, hot_rows=20, parts=8)
    last = led.groupBy("party_id").agg(F.max_by("balance", F.struct("date", "id")).alias("b"))
    tot = books.transactions.join(books.parties.select("party_id"), "party_id", "left_semi").groupBy("party_id").agg(
        F.sum(F.when(F.col("txn_type") == "Sale", F.coalesce("amount", F.lit(0)))
               .otherwise(-F.coalesce("amount", F.lit(0)))).cast("double").alias("t"))
    bad = last.join(tot, "party_id").where(F.abs(F.col("b") - F.col("t")) > 1e-6)
    assert bad.count() == 0


def test_trial_balance_agrees_with_pnl(books):
    tb = {r.account: r for r in A.trial_balance(books.transactions, books.parties).collect()}
    pnl = A.pnl(books.transactions).first()
    assert tb["Sales Account"].credit == pnl.sales
    assert tb["Expense Account"].debit == pnl.expenses
    assert abs(tb["TOTAL"].debit - sum(r.debit for k, r in tb.items() if k != "TOTAL")) < 1e-6


def test_monthly_net_sums_to_daily(books):
    daily = C.short_excess(books.transactions, books.parties, books.daily_cash, 50000)
    monthly = C.short_excess_monthly(books.transactions, books.parties, books.daily_cash, 50000)
    a = daily.agg(F.sum("cash_short_excess")).first()[0]
    b = monthly.agg(F.sum("net")).first()[0]
    assert abs(a - b) < 1e-6


def test_import_conserves_rows(spark, books):
    q = registry()
    n_in = books.raw_import.count()
    n_ok = q["import_accepted"](spark, SF_SMALL).count()
    n_bad = q["import_rejected"](spark, SF_SMALL).count()
    assert n_ok + n_bad == n_in


def test_pages_concatenate_to_full_list(books):
    full = R.joined_list(books.transactions, books.parties).count()
    limit = 250
    pages = (full + limit - 1) // limit
    seen = []
    for p in range(1, pages + 1):
        seen += [r.id for r in R.transactions_page(books.transactions, books.parties, p, limit).collect()]
    assert len(seen) == full == len(set(seen))


def test_account_statement_is_ordered_running_sum(books):
    st = L.account_statement(books.transactions, books.parties, "Cash", hot_rows=5, parts=16).orderBy("date", "id").collect()
    run = 0.0
    for r in st:
        run += r.debit - r.credit
        assert abs(run - r.balance) < 1e-6


def test_keyset_pages_equal_offset_pages(books):
    a = [tuple(r) for r in R.transactions_page(books.transactions, books.parties, 2, 50).collect()]
    first = R.transactions_page(books.transactions, books.parties, 1, 50).collect()
    b = [tuple(r) for r in R.transactions_page_after(books.transactions, books.parties, first[-1].date,
                                                     first[-1].id, 50).collect()]
    assert a == b and len(a) == 50


def test_single_party_ledger_is_a_slice_of_all(books):
    key = books.parties.where(F.col("party_id") == 7).first().normalized_name
    one = L.party_ledger(books.transactions, books.parties, party_key=key).collect()
    every = L.party_ledger(books.transactions, books.parties).where(F.col("party_id") == 7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, every)) and len(one) > 0
    assert L.party_ledger(books.transactions, books.parties, party_key="no_such_party").count() == 0
    st = L.ledger_statement(books.transactions, books.parties, party_key=key).collect()
    assert len(st) == len(one)


def test_orders_of_reports(spark, books):
    from tallyframe.operators import aggregates as A
    from tallyframe.operators import lists as R

    day = [r.id for r in R.day_book(books.transactions, books.parties, "1998-06-15").collect()]
    assert day and day == sorted(day, reverse=True)
    names = [r.name for r in R.party_list(books.parties).collect()]
    assert names == sorted(names)
    log = books.audit_logs.where("company = 'default'").select("timestamp", "id").collect()
    want = [r.timestamp for r in sorted(log, key=lambda r: (r.timestamp, r.id), reverse=True)]
    shown = [r.timestamp for r in R.audit_trail(books.audit_logs).collect()]
    assert [s[:19] for s in shown] == [str(w)[:19] for w in want]
    days = [r.date for r in A.daily_mode_summary(books.transactions).collect()]
    assert days == sorted(days, reverse=True)
    page = [(r.date, r.id) for r in R.transactions_page_after(books.transactions, books.parties, "1997-01-01", 700, 50).collect()]
    assert page == sorted(page, reverse=True) and all(p < ("1997-01-01", 700) for p in page)


def test_whole_account_window_sees_days_not_rows(spark, books):
    """Ids shuffled against dates: the window without a partition runs over one row a day."""
    import re

    from pyspark.sql import functions as F

    from tallyframe.operators.running import running_total

    tx = books.transactions.withColumn("txn_id", F.xxhash64("txn_id")).where("txn_date IS NOT NULL")
    out = running_total(tx, F.lit(1).cast("long"), "n", [], "txn_date", "txn_id", hot_rows=5, parts=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    alone = [i for i, line in enumerate(lines) if re.search(r"Window \[.*\], \[__dated#\d+ ASC", line)]
    assert len(alone) == 1  # ordered by day, no partition
    below = "\n".join(lines[alone[0] : alone[0] + 3])
    assert re.search(r"Relation \[__dated#\d+,__day#\d+,__sum#\d+L?,__n#\d+L\] parquet", below)  # the day totals that were written
    got = sorted(r.n for r in out.select("n").collect())
    assert got == list(range(1, len(got) + 1))
