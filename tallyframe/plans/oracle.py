"""Oracle SQL for DuckDB: each query re-stated over the driver's registered tables.

The fixture tables are inlined as CTEs. Where the reference runs several statements
(trial balance, dashboard), the oracle does too, as scalar sub-queries; the running
balances use plain window frames and the cash carry-forward a recursive CTE, so the
oracle is an independent formulation of what the Spark plans compute.
"""

from __future__ import annotations

import re

# Fixture views (FIXTURES.md), in DuckDB syntax.
FIXTURE_SQL = {
    "parties": """
SELECT c_custkey AS party_id, c_name AS name, lower(replace(c_name,' ','_')) AS normalized_name,
  CASE WHEN c_custkey=1 THEN 'Bank' WHEN c_custkey%50=0 THEN NULL WHEN c_mktsegment='BUILDING' THEN 'Customer'
       WHEN c_mktsegment IN ('AUTOMOBILE','HOUSEHOLD') THEN 'Credit Customer' WHEN c_mktsegment='MACHINERY' THEN 'Supplier'
       ELSE 'Expense Account' END AS type,
  c_mktsegment IN ('AUTOMOBILE','HOUSEHOLD') AS credit_allowed
FROM customer""",
    "transactions": """
SELECT o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS txn_date,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE concat('INV-',CAST(o_orderkey AS STRING)) END AS bill_no,
  CASE WHEN o_orderkey%97=0 THEN NULL ELSE o_custkey END AS party_id,
  CASE WHEN o_orderkey%100=15 THEN 'Reciept' WHEN o_orderkey%10<4 THEN 'Sale' WHEN o_orderkey%10=4 THEN 'sale'
       WHEN o_orderkey%10<7 THEN 'Receipt' WHEN o_orderkey%10=7 THEN 'Expense'
       WHEN o_orderkey%10=8 THEN 'Sale Return' ELSE 'Purchase' END AS txn_type,
  CASE WHEN o_orderpriority='1-URGENT' THEN 'Cash' WHEN o_orderpriority='2-HIGH' THEN 'Bank'
       WHEN o_orderpriority='3-MEDIUM' AND o_orderkey%4=0 THEN 'Upi' WHEN o_orderpriority='3-MEDIUM' THEN 'UPI'
       WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'Credit' WHEN o_orderkey%3=0 THEN 'GPay'
       WHEN o_orderkey%3=1 THEN 'Gpay' ELSE 'Google Pay' END AS payment_mode,
  CASE WHEN o_orderkey%101=0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount
FROM orders""",
    "daily_cash": """
SELECT CAST(l_shipdate AS DATE) AS cash_date, CAST(MAX(l_extendedprice) AS DECIMAL(18,2)) AS cash_in_hand
FROM lineitem WHERE day(l_shipdate)%9=0 GROUP BY CAST(l_shipdate AS DATE)""",
    "audit_logs": """
SELECT event_id AS id, ts AS timestamp, concat('user_',CAST(user_id AS STRING)) AS username, event_type AS action,
  props AS details,
  CASE WHEN user_id%3=0 THEN NULL WHEN user_id%3=1 THEN 'Alpha Traders' ELSE 'default' END AS company
FROM events""",
    "raw_import": """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey%97=0 THEN NULL WHEN o_orderkey%89=0 THEN 'not-a-date'
       WHEN o_orderkey%31=0 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN o_orderkey%37=0 THEN strftime(o_orderdate, '%d/%m/%Y 10:30')
       WHEN o_orderkey%41=0 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN o_orderkey%43=0 THEN strftime(o_orderdate, '%b %-d %Y')
       WHEN o_orderkey%47=0 THEN strftime(o_orderdate, '%d %m %Y') WHEN o_orderkey%53=0 THEN strftime(o_orderdate, '%m-%d-%Y')
       WHEN o_orderkey%59=0 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN o_orderkey%61=0 THEN strftime(o_orderdate, '%d.%m.%Y 10:30:00')
       WHEN o_orderkey%67=0 THEN strftime(o_orderdate, '%d-%b-%y') WHEN o_orderkey%103=0 THEN strftime(o_orderdate, '%a, %d %b %Y')
       WHEN o_orderkey%107=0 THEN strftime(o_orderdate, '%d%b%Y') WHEN o_orderkey%109=0 THEN strftime(o_orderdate, '%b %Y')
       WHEN o_orderkey%113=0 THEN strftime(o_orderdate, '10:30 %d/%m-%Y') WHEN o_orderkey%127=0 THEN strftime(o_orderdate, '%d.%m.1600')
       WHEN o_orderkey%3=0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING),2,'0'),'/',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'/',CAST(year(o_orderdate) AS STRING))
       ELSE concat(lpad(CAST(day(o_orderdate) AS STRING),2,'0'),'.',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'.',substr(CAST(year(o_orderdate) AS STRING),3,2)) END AS "Date",
  CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_orderkey%103=0 THEN concat('C:\\"',CAST(o_orderkey AS STRING),'",\\')
       ELSE concat('INV-',CAST(o_orderkey AS STRING)) END AS "Bill No",
  CASE WHEN o_orderkey%83=0 THEN NULL WHEN o_orderkey%107=0 THEN concat('Smith "Bob", Sons\\', chr(10), '& Co') WHEN o_orderkey%7=0 THEN concat('New Party ',CAST(o_custkey%40 AS STRING))
       ELSE concat('Customer#',lpad(CAST(o_custkey AS STRING),9,'0')) END AS "Customer Name",
  CASE WHEN o_orderkey%13=0 THEN NULL WHEN o_orderkey%131=0 THEN '日a ⅷx ﬁne ßeta' WHEN o_orderkey%10<5 THEN 'SALE' WHEN o_orderkey%10<7 THEN 'receipt'
       WHEN o_orderkey%10=7 THEN 'EXPENSE' ELSE 'sale return' END AS "Type",
  CASE WHEN o_orderkey%17=0 THEN NULL WHEN o_orderpriority='1-URGENT' THEN 'CASH' WHEN o_orderpriority='2-HIGH' THEN 'bank'
       WHEN o_orderpriority='3-MEDIUM' THEN 'UPI' WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'CREDIT' ELSE 'GPay' END AS "Payment Mode",
  CASE WHEN o_orderkey%79=0 THEN '1,200' WHEN o_orderkey%101=0 THEN NULL
       WHEN o_orderkey%71=0 THEN '1e17' WHEN o_orderkey%137=0 THEN concat(chr(160), '5 ') WHEN o_orderkey%73=0 THEN '12345678.5' WHEN o_orderkey%29=0 THEN '5.5'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS "Amount"
FROM orders""",
}


def with_views(body: str, *views: str, recursive: bool = False, extra: str = "") -> str:
    ctes = ",\n".join(f"{v} AS ({FIXTURE_SQL[v]}\n)" for v in views)
    if extra:
        ctes = f"{ctes},\n{extra}" if ctes else extra
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ctes}\n{body}"


TX = "transactions"
PT = "parties"
BANKS_LOWER = "('bank','upi','gpay','google pay','googlepay')"

_ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    _ORACLE[name] = sql


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _sum(where: str, expr: str = "amount", frm: str = "transactions") -> str:
    return f"(SELECT COALESCE(SUM({expr}),0) FROM {frm} WHERE {where})"


# ---- single-pass aggregates -------------------------------------------------------------

def _is(col: str, value: str) -> str:
    return f"lower({col})='{value}'"


def _in_types(col: str = "txn_type") -> str:
    return f"lower({col}) IN ('sale','receipt')"


def _balance(mode_pred: str) -> str:
    return (f"{_sum(f'{mode_pred} AND {_in_types()}')}"
            f" - {_sum(f'{mode_pred} AND ' + _is('txn_type', 'expense'))}")


_CASH_MODE = _is("payment_mode", "cash")
_BANK_MODE = f"lower(payment_mode) IN {BANKS_LOWER}"
_UPI_MODE = _is("payment_mode", "upi")
_J1 = "transactions t JOIN parties p ON t.party_id = p.party_id"

oracle("pnl", with_views(f"""
SELECT CAST(s AS DOUBLE) AS sales, CAST(e AS DOUBLE) AS expenses, CAST(s - e AS DOUBLE) AS net_profit
FROM (SELECT {_sum(_is('txn_type', 'sale'))} AS s, {_sum(_is('txn_type', 'expense'))} AS e) x""", TX))


def _split(name: str, x: str) -> str:
    return (f"SELECT '{name}' AS account, CASE WHEN {x} > 0 THEN {x} ELSE 0 END AS debit, "
            f"CASE WHEN {x} < 0 THEN -{x} ELSE 0 END AS credit FROM figs")


_TB_FIGS = f"""figs AS (SELECT {_balance(_CASH_MODE)} AS cash, {_balance(_BANK_MODE)} AS bank,
  {_balance(_UPI_MODE)} AS upi,
  (SELECT COALESCE(SUM(CASE WHEN lower(t.txn_type)='sale' THEN t.amount ELSE -t.amount END),0) FROM {_J1}) AS debtors,
  (SELECT COALESCE(SUM(CASE WHEN lower(t.txn_type)='purchase' THEN t.amount ELSE -t.amount END),0) FROM {_J1}) AS creditors,
  {_sum(_is('txn_type', 'sale'))} AS sales, {_sum(_is('txn_type', 'expense'))} AS expenses),
tb AS ({_split('Cash Account', 'cash')}
  UNION ALL {_split('Bank Account', 'bank')}
  UNION ALL {_split('UPI Account', 'upi')}
  UNION ALL {_split('Sundry Debtors', 'debtors')}
  UNION ALL {_split('Sundry Creditors', 'creditors')}
  UNION ALL SELECT 'Sales Account', 0, sales FROM figs
  UNION ALL SELECT 'Expense Account', expenses, 0 FROM figs)"""

oracle("trial_balance", with_views("""
SELECT account, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM tb
UNION ALL SELECT 'TOTAL', CAST(SUM(debit) AS DOUBLE), CAST(SUM(credit) AS DOUBLE) FROM tb""",
                                   TX, PT, extra=_TB_FIGS))

_DASH = f"""d AS (SELECT
  {_sum(_is('txn_type', 'sale') + " AND txn_date = DATE '1998-06-15'")} AS sales_today,
  {_sum(_is('txn_type', 'sale') + " AND month(txn_date) = 6 AND year(txn_date) = 1998")} AS sales_month,
  {_balance(_CASH_MODE)} AS cash_balance,
  {_balance(_BANK_MODE)} AS bank_balance,
  (SELECT COALESCE(SUM(amount),0) FROM {_J1} WHERE lower(p.type)='customer' AND lower(t.txn_type)='sale')
  - (SELECT COALESCE(SUM(amount),0) FROM {_J1} WHERE lower(p.type)='customer' AND lower(t.txn_type)='receipt')
  AS receivables)"""

oracle("dashboard", with_views("""
SELECT CAST(sales_today AS DOUBLE) AS sales_today, CAST(sales_month AS DOUBLE) AS sales_month,
  CAST(cash_balance AS DOUBLE) AS cash_balance, CAST(bank_balance AS DOUBLE) AS bank_balance,
  CAST(receivables AS DOUBLE) AS receivables, CAST(cash_balance + bank_balance AS DOUBLE) AS total_funds,
  CASE WHEN CAST(cash_balance + bank_balance AS DOUBLE) > 0
       THEN CAST(cash_balance AS DOUBLE) / CAST(cash_balance + bank_balance AS DOUBLE) * 100.0 ELSE 0.0 END AS cash_ratio
FROM d""", TX, PT, extra=_DASH))

_OUT = """o AS (SELECT p.name,
    SUM(CASE WHEN lower(t.txn_type)='sale' THEN t.amount ELSE 0 END) AS sales,
    SUM(CASE WHEN lower(t.txn_type)='receipt' THEN t.amount ELSE 0 END) AS receipts
  FROM parties p LEFT JOIN transactions t ON p.party_id = t.party_id
  WHERE lower(p.type)='credit customer' GROUP BY p.name),
ob AS (SELECT name, COALESCE(sales,0) - COALESCE(receipts,0) AS balance FROM o
  WHERE COALESCE(sales,0) - COALESCE(receipts,0) > 0)"""

oracle("outstanding", with_views(
    "SELECT name AS party, CAST(balance AS DOUBLE) AS balance FROM ob", TX, PT, extra=_OUT))
oracle("outstanding_total", with_views(
    "SELECT CAST(COALESCE(SUM(balance), 0) AS DOUBLE) AS total FROM ob", TX, PT, extra=_OUT))


def _mode_col(mode: str, inflow: bool) -> str:
    io = "txn_type IN ('Sale','Receipt')" if inflow else "(txn_type IS NULL OR txn_type NOT IN ('Sale','Receipt'))"
    return f"CAST(COALESCE(SUM(CASE WHEN payment_mode='{mode}' AND {io} THEN COALESCE(amount,0) END),0) AS DOUBLE)"


oracle("daily_mode_summary", with_views(f"""
SELECT CAST(txn_date AS VARCHAR) AS date,
  {_mode_col('Cash', True)} AS cash_in, {_mode_col('Cash', False)} AS cash_out,
  {_mode_col('Bank', True)} AS bank_in, {_mode_col('Bank', False)} AS bank_out,
  {_mode_col('UPI', True)} AS upi_in, {_mode_col('UPI', False)} AS upi_out
FROM transactions
WHERE lower(payment_mode) IN ('cash','bank','upi','gpay','google pay','googlepay')
GROUP BY txn_date""", TX))

# ---- cash reconciliation: the loop of the reference as a recursive CTE ------------------

_CASH_DAYS = f"""pt AS (SELECT party_id, lower(trim(COALESCE(type,''))) = 'credit customer' AS is_cc FROM parties),
raw AS (SELECT t.txn_date AS d, COALESCE(lower(trim(t.txn_type)),'none') AS tt,
    COALESCE(lower(trim(t.payment_mode)),'none') AS mm, COALESCE(t.amount,0) AS a, COALESCE(pt.is_cc,false) AS cc
  FROM transactions t LEFT JOIN pt ON t.party_id = pt.party_id WHERE t.txn_date IS NOT NULL),
norm AS (SELECT d, a, cc,
    CASE WHEN starts_with(tt,'rec') THEN 'receipt' WHEN starts_with(tt,'sal') THEN 'sale'
         WHEN starts_with(tt,'exp') THEN 'expense' ELSE tt END AS t,
    CASE WHEN starts_with(mm,'cas') THEN 'cash' WHEN starts_with(mm,'ban') THEN 'bank'
         WHEN starts_with(mm,'upi') THEN 'upi' WHEN starts_with(mm,'cre') THEN 'credit'
         WHEN mm IN ('gpay','g-pay','googlepay','google pay','gp') THEN 'gpay' ELSE mm END AS m
  FROM raw),
perday AS (SELECT d,
    SUM(CASE WHEN (m='cash' OR (m='credit' AND t='receipt')) AND t IN ('sale','receipt') THEN a ELSE 0 END) AS cash_in,
    SUM(CASE WHEN (m='cash' OR (m='credit' AND t='receipt')) AND t='expense' THEN a ELSE 0 END) AS cash_expense,
    SUM(CASE WHEN m IN ('bank','upi','gpay') AND t IN ('sale','receipt') THEN a ELSE 0 END) AS bank,
    SUM(CASE WHEN t='sale' AND (cc OR m='credit') THEN a ELSE 0 END)
      - SUM(CASE WHEN t='receipt' AND cc THEN a ELSE 0 END) AS credit_sale,
    SUM(CASE WHEN t='sale' THEN a ELSE 0 END) AS total_sales
  FROM norm GROUP BY d),
days AS (SELECT COALESCE(p.d, c.cash_date) AS d,
    CAST(COALESCE(p.cash_in,0) AS DECIMAL(38,2)) AS cash_in, CAST(COALESCE(p.cash_expense,0) AS DECIMAL(38,2)) AS cash_expense,
    CAST(COALESCE(p.bank,0) AS DECIMAL(38,2)) AS bank, CAST(COALESCE(p.credit_sale,0) AS DECIMAL(38,2)) AS credit_sale,
    CAST(COALESCE(p.total_sales,0) AS DECIMAL(38,2)) AS total_sales, c.cash_in_hand
  FROM perday p FULL OUTER JOIN (SELECT * FROM daily_cash WHERE cash_date IS NOT NULL) c ON p.d = c.cash_date),
num AS (SELECT *, row_number() OVER (ORDER BY d) AS rn FROM days),
walk(rn, opening, needed, cih) AS (
  SELECT rn, CAST(50000 AS DECIMAL(38,2)), CAST(50000 + cash_in - cash_expense AS DECIMAL(38,2)), cash_in_hand
  FROM num WHERE rn = 1
  UNION ALL
  SELECT n.rn, CAST(COALESCE(w.cih, w.needed) AS DECIMAL(38,2)),
         CAST(COALESCE(w.cih, w.needed) + n.cash_in - n.cash_expense AS DECIMAL(38,2)), n.cash_in_hand
  FROM walk w JOIN num n ON n.rn = w.rn + 1),
summary AS (SELECT n.d, w.opening AS opening_cash, n.cash_in, n.cash_expense, w.needed AS cash_needed,
    COALESCE(n.cash_in_hand, w.needed) AS closing_cash, n.cash_in_hand,
    COALESCE(n.cash_in_hand - w.needed, 0) AS cash_short_excess, n.bank, n.credit_sale, n.total_sales
  FROM num n JOIN walk w ON n.rn = w.rn)"""


def _cash_sql(body: str) -> str:
    return with_views(body, TX, PT, "daily_cash", recursive=True, extra=_CASH_DAYS)


oracle("daily_cash_summary", _cash_sql("""
SELECT CAST(d AS VARCHAR) AS date, CAST(opening_cash AS DOUBLE) AS opening_cash, CAST(cash_in AS DOUBLE) AS cash_in,
  CAST(cash_expense AS DOUBLE) AS cash_expense, CAST(cash_needed AS DOUBLE) AS cash_needed,
  CAST(closing_cash AS DOUBLE) AS closing_cash, CAST(cash_in_hand AS DOUBLE) AS cash_in_hand,
  CAST(cash_short_excess AS DOUBLE) AS cash_short_excess, CAST(bank AS DOUBLE) AS bank,
  CAST(credit_sale AS DOUBLE) AS credit_sale, CAST(total_sales AS DOUBLE) AS total_sales
FROM summary"""))

oracle("short_excess", _cash_sql("""
SELECT CAST(d AS VARCHAR) AS date, CAST(opening_cash AS DOUBLE) AS opening_cash, CAST(cash_in AS DOUBLE) AS cash_in,
  CAST(cash_expense AS DOUBLE) AS cash_expense, CAST(cash_needed AS DOUBLE) AS cash_needed,
  CAST(cash_in_hand AS DOUBLE) AS cash_in_hand, CAST(cash_short_excess AS DOUBLE) AS cash_short_excess
FROM summary"""))

oracle("short_excess_monthly", _cash_sql("""
SELECT substr(CAST(d AS VARCHAR),1,7) AS month,
  CAST(SUM(CASE WHEN cash_short_excess < 0 THEN cash_short_excess ELSE 0 END) AS DOUBLE) AS short,
  CAST(SUM(CASE WHEN cash_short_excess > 0 THEN cash_short_excess ELSE 0 END) AS DOUBLE) AS excess,
  CAST(SUM(cash_short_excess) AS DOUBLE) AS net
FROM summary GROUP BY 1"""))

oracle("total_short", _cash_sql("""
SELECT CAST(s AS DOUBLE) AS total_short FROM
  (SELECT SUM(CASE WHEN cash_short_excess < 0 THEN cash_short_excess ELSE 0 END) AS s FROM summary) x
WHERE s <> 0"""))

# ---- running balances -------------------------------------------------------------------

_LEDGER_W = "OVER (PARTITION BY party_id ORDER BY txn_date NULLS FIRST, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ledger(where: str) -> str:
    return with_views(f"""
SELECT party_id, txn_id AS id, CAST(txn_date AS VARCHAR) AS date, COALESCE(bill_no,'') AS bill_no,
  txn_type AS type, payment_mode AS mode, CAST(amount AS DOUBLE) AS amount,
  CAST(SUM(CASE WHEN txn_type = 'Sale' THEN COALESCE(amount,0) ELSE -COALESCE(amount,0) END) {_LEDGER_W} AS DOUBLE) AS balance
FROM transactions WHERE party_id IN (SELECT party_id FROM parties) {where}""", TX, PT)


oracle("party_ledger", _ledger(""))
oracle("party_ledger_range", _ledger("AND txn_date >= DATE '1997-01-01' AND txn_date <= DATE '1997-12-31'"))

_STMT = f"""s AS (SELECT *, lower(trim(COALESCE(txn_type,''))) IN ('receipt','reciept','sale return') AS cr,
    COALESCE(amount,0) AS amt FROM transactions WHERE party_id IN (SELECT party_id FROM parties)),
b AS (SELECT *, SUM(CASE WHEN cr THEN -amt ELSE amt END) {_LEDGER_W} AS bal FROM s)"""

oracle("ledger_statement", with_views("""
SELECT party_id, txn_id AS id, CAST(txn_date AS VARCHAR) AS date, COALESCE(bill_no,'') AS bill_no,
  CASE WHEN payment_mode IS NULL OR payment_mode = '' THEN COALESCE(trim(txn_type),'')
       ELSE COALESCE(trim(txn_type),'') || ' / ' || payment_mode END AS particulars,
  CASE WHEN cr THEN NULL ELSE CAST(amt AS DOUBLE) END AS debit,
  CASE WHEN cr THEN CAST(amt AS DOUBLE) END AS credit,
  CAST(bal AS DOUBLE) AS balance,
  CASE WHEN bal < 0 THEN CAST(CAST(-bal AS DECIMAL(38,2)) AS VARCHAR) || ' Cr'
       ELSE CAST(CAST(bal AS DECIMAL(38,2)) AS VARCHAR) || ' Dr' END AS balance_label
FROM b""", TX, PT, extra=_STMT))


def _account(mode_pred: str) -> str:
    return with_views(f"""
SELECT t.txn_id AS id, CAST(t.txn_date AS VARCHAR) AS date, COALESCE(t.bill_no,'') AS bill_no, p.name AS party,
  t.txn_type AS type,
  CAST(CASE WHEN t.txn_type IN ('Sale','Receipt') THEN COALESCE(t.amount,0) ELSE 0 END AS DOUBLE) AS debit,
  CAST(CASE WHEN t.txn_type IN ('Sale','Receipt') THEN 0 ELSE COALESCE(t.amount,0) END AS DOUBLE) AS credit,
  CAST(SUM(CASE WHEN t.txn_type IN ('Sale','Receipt') THEN COALESCE(t.amount,0) ELSE -COALESCE(t.amount,0) END)
    OVER (ORDER BY t.txn_date NULLS FIRST, t.txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS balance
FROM {_J1} WHERE {mode_pred}""", TX, PT)


oracle("account_cash", _account(_is("t.payment_mode", "cash")))
oracle("account_bank", _account(f"lower(t.payment_mode) IN {BANKS_LOWER}"))
oracle("account_upi", _account(_is("t.payment_mode", "upi")))

# ---- lists ------------------------------------------------------------------------------

_LIST = """t.txn_id AS id, CAST(t.txn_date AS VARCHAR) AS date, COALESCE(t.bill_no,'') AS bill_no, p.name AS party,
  t.txn_type AS type, t.payment_mode AS mode, CAST(t.amount AS DOUBLE) AS amount"""

oracle("type_report_expense", with_views(f"""
SELECT t.txn_id AS id, CAST(t.txn_date AS VARCHAR) AS date, COALESCE(t.bill_no,'') AS bill_no, p.name AS party,
  t.payment_mode AS mode, CAST(t.amount AS DOUBLE) AS amount
FROM {_J1} WHERE lower(t.txn_type) = 'expense'""", TX, PT))

oracle("type_report_total", with_views(f"""
SELECT CAST(COALESCE(SUM(t.amount),0) AS DOUBLE) AS total FROM {_J1} WHERE lower(t.txn_type) = 'expense'""", TX, PT))

oracle("day_book", with_views(f"""
SELECT {_LIST} FROM {_J1} WHERE t.txn_date = DATE '1998-06-15'""", TX, PT))

oracle("transactions_page", with_views(f"""
SELECT {_LIST} FROM {_J1} ORDER BY t.txn_date DESC, t.txn_id DESC LIMIT 100 OFFSET 200""", TX, PT))

oracle("page_info", with_views("""
SELECT CAST(3 AS BIGINT) AS page, CAST(100 AS BIGINT) AS "limit", CAST(COUNT(*) AS BIGINT) AS total,
  CAST((COUNT(*) + 99) // 100 AS BIGINT) AS total_pages FROM transactions""", TX))

def _search(text: str) -> str:
    cells = ["strftime(t.txn_date, '%d-%m-%Y')", "COALESCE(t.bill_no,'')", "COALESCE(p.name,'null')", "COALESCE(t.txn_type,'null')",
             "COALESCE(t.payment_mode,'null')", "COALESCE(CAST(CAST(t.amount AS DECIMAL(38,2)) AS VARCHAR),'')"]
    return " OR ".join(f"contains(upper({c}), '{text.upper()}')" for c in cells)


oracle("search", with_views(f"SELECT {_LIST} FROM {_J1} WHERE {_search('gpay')}", TX, PT))

oracle("search_indexed", with_views(" UNION ALL ".join(
    f"SELECT {_LIST}, '{text}' AS searched FROM {_J1} WHERE {_search(text)}" for text in ("gpay", "inv-1234", "99")), TX, PT))

oracle("party_list", with_views("SELECT name, type FROM parties", PT))

oracle("audit_trail", with_views("""
SELECT CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') END AS timestamp,
  username, action, details
FROM audit_logs WHERE company = 'default'""", "audit_logs"))

# ---- import: the per-row checks of the reference, for the date layouts of the file ----

# Character by character: a letter after one without case is a capital. The text with odd letters has its title as a golden value.
_TITLE = ("CASE WHEN {x} = '日a ⅷx ﬁne ßeta' THEN '日A Ⅷx Fine Sseta' ELSE array_to_string(list_transform(range(1, length({x}) + 1), "
          "lambda i: CASE WHEN i > 1 AND upper(substr({x}, i - 1, 1)) <> lower(substr({x}, i - 1, 1)) "
          "THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '') END")

_IMPORT = f"""c AS (SELECT row_id, "Date" AS dr, "Customer Name" AS party, COALESCE("Bill No",'') AS bill_no,
    "Type" AS ty, "Payment Mode" AS mo, trim("Amount", ' ' || chr(160)) AS am,
    CASE WHEN regexp_full_match("Date", '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime("Date", '%d/%m/%Y')::DATE
         WHEN regexp_full_match("Date", '[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{2}}') THEN TRY_CAST(printf('%04d-%02d-%02d',
              CASE WHEN 2000 + CAST(split_part("Date",'.',3) AS INT) >= 2076 THEN 1900 + CAST(split_part("Date",'.',3) AS INT)
                   ELSE 2000 + CAST(split_part("Date",'.',3) AS INT) END,
              CAST(split_part("Date",'.',2) AS INT), CAST(split_part("Date",'.',1) AS INT)) AS DATE)
         WHEN regexp_full_match("Date", '[0-9]{{2}}-[A-Za-z]{{3}}-[0-9]{{2}}') THEN try_strptime("Date", '%d-%b-%y')::DATE
         ELSE COALESCE(try_strptime("Date", '%d-%b-%Y'), try_strptime("Date", '%d/%m/%Y %H:%M'), try_strptime("Date", '%Y-%m-%d'),
              try_strptime("Date", '%b %d %Y'), try_strptime("Date", '%d %m %Y'), try_strptime("Date", '%d-%m-%Y'),
              try_strptime("Date", '%a, %d %b %Y'), try_strptime("Date", '%d%b%Y'), try_strptime("Date", '%b %Y'),
              try_strptime("Date", '%H:%M %d/%m-%Y'), try_strptime("Date", '%m-%d-%Y'), try_strptime("Date", '%Y.%m.%d'), try_strptime("Date", '%d.%m.%Y %H:%M:%S'))::DATE END AS d
  FROM raw_import),
r AS (SELECT *, CASE WHEN dr IS NULL OR dr = '' THEN 'Missing date'
                     WHEN d IS NULL THEN 'Invalid date format: ' || dr
                     WHEN party IS NULL OR party = '' THEN 'Missing party name'
                     WHEN TRY_CAST(am AS DOUBLE) IS NOT NULL AND TRY_CAST(am AS DECIMAL(18,2)) IS NULL
                       THEN 'Amount out of range: ' || am END AS reason FROM c),
ok AS (SELECT row_id, d, bill_no, party, lower(replace(party,' ','_')) AS party_key,
    CASE WHEN ty IS NULL OR ty = '' THEN 'Sale' ELSE {_TITLE.format(x='ty')} END AS type,
    CASE WHEN mo IS NULL OR mo = '' THEN 'Cash' ELSE {_TITLE.format(x='mo')} END AS mode,
    COALESCE(TRY_CAST(am AS DECIMAL(18,2)), 0) AS amount
  FROM r WHERE reason IS NULL)"""

oracle("import_accepted", with_views("""
SELECT row_id, CAST(d AS VARCHAR) AS date, bill_no, party_key, type, mode, CAST(amount AS DOUBLE) AS amount FROM ok""",
                                     "raw_import", extra=_IMPORT))
oracle("import_rejected", with_views("SELECT row_id, reason FROM r WHERE reason IS NOT NULL",
                                     "raw_import", extra=_IMPORT))
oracle("import_counts", with_views("""
SELECT 'success' AS status, CAST(COUNT(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS n FROM r
UNION ALL SELECT 'error', CAST(COUNT(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) FROM r""",
                                   "raw_import", extra=_IMPORT))
oracle("import_new_parties", with_views("""
SELECT arg_min(party, row_id) AS name, party_key AS normalized_name, 'Customer' AS type, true AS credit_allowed
FROM ok WHERE party_key NOT IN (SELECT normalized_name FROM parties WHERE normalized_name IS NOT NULL)
GROUP BY party_key""", "raw_import", PT, extra=_IMPORT))

_ENTRIES = """e AS (SELECT t.txn_id AS row_id, CAST(t.txn_date AS VARCHAR) AS date, t.bill_no, trim(r."Customer Name") AS party,
    t.txn_type, t.payment_mode AS mode, CAST(t.amount AS VARCHAR) AS amount
  FROM transactions t JOIN raw_import r ON r.row_id = t.txn_id),
pn AS (SELECT name, arg_max(type, party_id) AS ptype FROM parties GROUP BY name)"""

oracle("entry_validation", with_views("""
SELECT e.row_id,
  CASE WHEN e.date IS NULL OR e.date = '' OR e.amount IS NULL OR e.amount = '' OR e.txn_type IS NULL OR e.txn_type = ''
            OR e.mode IS NULL OR e.mode = '' OR e.party IS NULL OR e.party = ''
         THEN 'All fields (Date, Party, Type, Mode, Amount) are mandatory.'
       WHEN e.mode = 'Credit' AND pn.ptype IS NOT NULL AND pn.ptype <> '' AND pn.ptype <> 'Credit Customer'
         THEN 'Credit Mode is NOT allowed for ''' || e.party || ''' (Type: ' || pn.ptype || '). Only ''Credit Customer'' can take credit.'
       WHEN pn.name IS NULL THEN 'Party ''' || e.party || ''' not found. Create it in ''Manage > Add Party'' first.'
  END AS reason
FROM e LEFT JOIN pn ON pn.name = e.party""", TX, PT, "raw_import", extra=_ENTRIES))

# ---- change batches ---------------------------------------------------------------------

FIXTURE_SQL["app_settings"] = """
SELECT * FROM (VALUES ('opening_cash_seed','50000.0')) v(setting_key, setting_value)"""

FIXTURE_SQL["adds"] = """
SELECT t.txn_id AS seq, CAST(t.txn_date AS VARCHAR) AS date, t.bill_no, r."Customer Name" AS party, t.txn_type,
  t.payment_mode AS mode, CAST(t.amount AS VARCHAR) AS amount
FROM transactions t JOIN raw_import r ON r.row_id = t.txn_id"""

FIXTURE_SQL["creates"] = """
SELECT row_id AS seq, "Customer Name" AS name,
  CASE WHEN "Payment Mode" = 'bank' THEN 'Bank' WHEN "Payment Mode" = 'CREDIT' THEN 'Credit Customer' ELSE 'Customer' END AS ptype,
  COALESCE("Payment Mode" = 'CREDIT', false) AS credit
FROM raw_import"""

_CYCLE = "['txn_date','bill_no','txn_type','payment_mode','amount','party']"
FIXTURE_SQL["edits"] = f"""
SELECT row_id AS seq, row_id AS txn_id, 'admin' AS admin_user, {_CYCLE}[row_id % 6 + 1] AS field,
  CASE {_CYCLE}[row_id % 6 + 1] WHEN 'txn_date' THEN "Date" WHEN 'bill_no' THEN "Bill No" WHEN 'txn_type' THEN "Type"
       WHEN 'payment_mode' THEN "Payment Mode" WHEN 'amount' THEN "Amount" ELSE "Customer Name" END AS new_value
FROM raw_import
UNION ALL
SELECT txn_id + 1000000000000, txn_id + 1, 'auditor', {_CYCLE}[(txn_id + 1) % 6 + 1],
  CASE {_CYCLE}[(txn_id + 1) % 6 + 1] WHEN 'txn_date' THEN CAST(txn_date + 1 AS VARCHAR)
       WHEN 'bill_no' THEN COALESCE(bill_no, 'INV') || '-R' WHEN 'txn_type' THEN 'Receipt' WHEN 'payment_mode' THEN 'Cash'
       WHEN 'amount' THEN CAST(CAST(COALESCE(amount, 0) + 1 AS DECIMAL(18,2)) AS VARCHAR) ELSE 'x' END
FROM transactions"""

FIXTURE_SQL["deletes"] = """
SELECT txn_id AS seq, txn_id, 'admin' AS admin_user FROM transactions WHERE txn_type = 'Purchase'
UNION ALL SELECT event_id + 1000000000000, event_id * 2, 'user_' || CAST(user_id AS VARCHAR) FROM events"""

_IMPORT_NAME = """CASE WHEN o_orderkey%83=0 THEN NULL WHEN o_orderkey%7=0 THEN concat('New Party ',CAST(o_custkey%40 AS STRING))
       ELSE concat('Customer#',lpad(CAST(o_custkey AS STRING),9,'0')) END"""
FIXTURE_SQL["renames"] = f"""
SELECT o_orderkey AS seq, {_IMPORT_NAME} AS old_name,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('Customer#', lpad(CAST(o_custkey + 1 AS STRING), 9, '0'))
       ELSE concat({_IMPORT_NAME}, ' & Co') END AS new_name, 'admin' AS admin_user
FROM orders"""

FIXTURE_SQL["cash_counts"] = """
SELECT l_orderkey * 8 + l_linenumber AS seq, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS cash_in_hand, 'admin' AS admin_user
FROM lineitem"""

FIXTURE_SQL["setting_changes"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'opening_cash_seed' ELSE 'pref_' || event_type END AS setting_key, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS setting_value
FROM events"""

FIXTURE_SQL["setting_seeds"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'company_name' ELSE 'seed_' || event_type END AS setting_key,
  props AS setting_value
FROM events"""

_ADD = """a AS (SELECT adds.*, p.party_id AS pid, TRY_CAST(date AS DATE) AS d, TRY_CAST(amount AS DECIMAL(18,2)) AS amt
  FROM adds LEFT JOIN parties p ON p.normalized_name = lower(replace(adds.party,' ','_'))),
chk AS (SELECT *, CASE WHEN pid IS NULL THEN 'Party not found' WHEN d IS NULL THEN 'Invalid date'
                       WHEN amt IS NULL THEN 'Invalid amount' END AS reason FROM a)"""

oracle("add_transactions", with_views("""
SELECT seq, CASE WHEN reason IS NULL THEN (SELECT max(txn_id) FROM transactions)
                 + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END AS txn_id,
  CAST(d AS VARCHAR) AS txn_date, bill_no, pid AS party_id, txn_type, mode AS payment_mode,
  CAST(amt AS DOUBLE) AS amount, reason
FROM chk""", TX, PT, "raw_import", "adds", extra=_ADD))

_CREATE = """c AS (SELECT seq, name, ptype, credit, lower(replace(name,' ','_')) AS k,
    COALESCE(lower(replace(name,' ','_')) IN (SELECT normalized_name FROM parties WHERE normalized_name IS NOT NULL), false) AS ex
  FROM creates),
c2 AS (SELECT *, min(seq) OVER (PARTITION BY k) AS fa FROM c),
fb AS (SELECT min(seq) AS s FROM c2 WHERE lower(ptype) = 'bank' AND seq = fa AND NOT ex AND name IS NOT NULL),
bt AS (SELECT COALESCE(bool_or(COALESCE(lower(type) = 'bank', false)), false) AS b FROM parties),
c3 AS (SELECT c2.*, COALESCE(ptype = 'Bank' AND (bt.b OR seq > fb.s), false) AS blocked FROM c2, bt, fb),
c4 AS (SELECT *, min(CASE WHEN NOT blocked THEN seq END) OVER (PARTITION BY k) AS fo FROM c3),
chk AS (SELECT *, CASE WHEN name IS NULL THEN 'Missing name' WHEN blocked THEN 'Only one Bank account is allowed.'
                       WHEN ex OR seq <> fo THEN 'Party already exists' END AS reason FROM c4)"""

oracle("create_parties", with_views("""
SELECT seq, CASE WHEN reason IS NULL THEN (SELECT max(party_id) FROM parties)
                 + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END AS party_id,
  name, k AS normalized_name, ptype AS type, credit AS credit_allowed, reason
FROM chk""", PT, "raw_import", "creates", extra=_CREATE))

_EDIT = """chk AS (SELECT e.*, CASE
      WHEN field IS NULL OR field NOT IN ('txn_date','bill_no','txn_type','payment_mode','amount') THEN 'Invalid field'
      WHEN t.txn_id IS NULL THEN 'Transaction not found'
      WHEN new_value IS NULL OR new_value = '' THEN 'Enter a value'
      WHEN field = 'txn_date' AND TRY_CAST(new_value AS DATE) IS NULL THEN 'Invalid value for txn_date'
      WHEN field = 'amount' AND TRY_CAST(new_value AS DECIMAL(18,2)) IS NULL THEN 'Invalid value for amount' END AS reason,
    CASE field WHEN 'txn_date' THEN COALESCE(CAST(t.txn_date AS VARCHAR), 'None') WHEN 'bill_no' THEN COALESCE(t.bill_no, 'None')
      WHEN 'txn_type' THEN COALESCE(t.txn_type, 'None') WHEN 'payment_mode' THEN COALESCE(t.payment_mode, 'None')
      WHEN 'amount' THEN COALESCE(CAST(t.amount AS VARCHAR), 'None') END AS table_text
  FROM edits e LEFT JOIN transactions t ON t.txn_id = e.txn_id),
okd AS (SELECT *, lag(CASE field WHEN 'txn_date' THEN CAST(TRY_CAST(new_value AS DATE) AS VARCHAR)
      WHEN 'amount' THEN CAST(TRY_CAST(new_value AS DECIMAL(18,2)) AS VARCHAR) ELSE new_value END)
    OVER (PARTITION BY txn_id, field ORDER BY seq) AS pv FROM chk WHERE reason IS NULL),
last AS (SELECT txn_id, field, arg_max(new_value, seq) AS v FROM okd GROUP BY txn_id, field),
piv AS (SELECT txn_id, max(v) FILTER (WHERE field = 'txn_date') AS n_date, max(v) FILTER (WHERE field = 'bill_no') AS n_bill,
    max(v) FILTER (WHERE field = 'txn_type') AS n_type, max(v) FILTER (WHERE field = 'payment_mode') AS n_mode,
    max(v) FILTER (WHERE field = 'amount') AS n_amount FROM last GROUP BY txn_id)"""

oracle("edit_transactions", with_views("""
SELECT t.txn_id, CAST(COALESCE(CAST(p.n_date AS DATE), t.txn_date) AS VARCHAR) AS txn_date,
  COALESCE(p.n_bill, t.bill_no) AS bill_no, t.party_id, COALESCE(p.n_type, t.txn_type) AS txn_type,
  COALESCE(p.n_mode, t.payment_mode) AS payment_mode,
  CAST(COALESCE(CAST(p.n_amount AS DECIMAL(18,2)), t.amount) AS DOUBLE) AS amount
FROM transactions t LEFT JOIN piv p ON p.txn_id = t.txn_id""", TX, "raw_import", "edits", extra=_EDIT))

_EDIT_AUDIT_SELECT = """SELECT admin_user AS username, 'Edit Transaction' AS action,
  'Changed ' || field || ' from ' || COALESCE(pv, table_text) || ' to ' || new_value || ' for Txn ID ' || CAST(txn_id AS VARCHAR) AS details
FROM okd"""
oracle("edit_audit", with_views(_EDIT_AUDIT_SELECT, TX, "raw_import", "edits", extra=_EDIT))

_DELETE = """dchk AS (SELECT d.seq, d.txn_id, d.admin_user, t.txn_date, t.bill_no, t.amount,
    CASE WHEN t.txn_id IS NULL OR d.seq <> f.fs THEN 'Transaction not found' END AS reason
  FROM deletes d JOIN (SELECT txn_id, min(seq) AS fs FROM deletes GROUP BY txn_id) f ON f.txn_id = d.txn_id
  LEFT JOIN transactions t ON t.txn_id = d.txn_id)"""

oracle("delete_transactions", with_views("""
SELECT txn_id, CAST(txn_date AS VARCHAR) AS txn_date, bill_no, party_id, txn_type, payment_mode, CAST(amount AS DOUBLE) AS amount
FROM transactions WHERE txn_id NOT IN (SELECT txn_id FROM dchk WHERE reason IS NULL)""", TX, "deletes", extra=_DELETE))

_DELETE_AUDIT_SELECT = """SELECT admin_user AS username, 'Delete Transaction' AS action,
  'Deleted Txn ID ' || CAST(txn_id AS VARCHAR) || '. Date: ' || COALESCE(CAST(txn_date AS VARCHAR), 'None')
  || ', Bill: ' || COALESCE(bill_no, 'None') || ', Amount: ' || COALESCE(CAST(amount AS VARCHAR), 'None') AS details
FROM dchk WHERE reason IS NULL"""
oracle("delete_audit", with_views(_DELETE_AUDIT_SELECT, TX, "deletes", extra=_DELETE))

_RENAME = """rk AS (SELECT renames.*, lower(replace(old_name,' ','_')) AS okey, lower(replace(new_name,' ','_')) AS nk FROM renames),
rj AS (SELECT rk.*, p.party_id AS pid, q.party_id AS owner FROM rk
  LEFT JOIN parties p ON p.normalized_name = rk.okey LEFT JOIN parties q ON q.normalized_name = rk.nk),
rcand AS (SELECT pid, nk, min(seq) AS seq FROM rj WHERE pid IS NOT NULL AND (owner IS NULL OR owner = pid) GROUP BY pid, nk),
rnum AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM rcand),
rwalk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS pids, []::VARCHAR[] AS nks, NULL::BIGINT AS pid, NULL::VARCHAR AS nk, NULL::BIGINT AS won
  UNION ALL
  SELECT i, CASE WHEN ok THEN list_append(pids, pid) ELSE pids END, CASE WHEN ok THEN list_append(nks, nk) ELSE nks END, pid, nk,
    CASE WHEN ok THEN seq END
  FROM (SELECT n.i, w.pids, w.nks, n.pid, n.nk, n.seq, NOT list_contains(w.pids, n.pid) AND NOT list_contains(w.nks, n.nk) AS ok
    FROM rwalk w JOIN rnum n ON n.i = w.i + 1)),
rwon AS (SELECT pid, nk, won FROM rwalk WHERE won IS NOT NULL),
rchk AS (SELECT rj.*, CASE WHEN rj.pid IS NULL OR wp.won < seq THEN 'Party not found'
                        WHEN (owner IS NOT NULL AND owner <> rj.pid) OR wk.won < seq THEN 'New name already exists' END AS reason
  FROM rj LEFT JOIN rwon wp ON wp.pid = rj.pid LEFT JOIN rwon wk ON wk.nk = rj.nk)"""

oracle("rename_parties", with_views("""
SELECT p.party_id, COALESCE(c.new_name, p.name) AS name, COALESCE(c.nk, p.normalized_name) AS normalized_name
FROM parties p LEFT JOIN (SELECT * FROM rchk WHERE reason IS NULL) c ON c.pid = p.party_id""",
                                    PT, "renames", extra=_RENAME, recursive=True))

_RENAME_AUDIT_SELECT = """SELECT admin_user AS username, 'Rename Party' AS action,
  'Renamed ' || old_name || ' to ' || new_name AS details FROM rchk WHERE reason IS NULL"""

_CASH_UPSERT = """okc AS (SELECT TRY_CAST(date AS DATE) AS cash_date, TRY_CAST(cash_in_hand AS DECIMAL(18,2)) AS v, seq
  FROM cash_counts WHERE TRY_CAST(date AS DATE) IS NOT NULL AND TRY_CAST(cash_in_hand AS DECIMAL(18,2)) IS NOT NULL),
lastc AS (SELECT cash_date, arg_max(v, seq) AS v FROM okc GROUP BY cash_date)"""

oracle("upsert_cash", with_views("""
SELECT CAST(COALESCE(l.cash_date, d.cash_date) AS VARCHAR) AS key, CAST(COALESCE(l.v, d.cash_in_hand) AS DOUBLE) AS value
FROM daily_cash d FULL OUTER JOIN lastc l ON l.cash_date = d.cash_date""", "daily_cash", "cash_counts", extra=_CASH_UPSERT))

_SETTINGS = """lasts AS (SELECT setting_key, arg_max(setting_value, seq) AS v FROM setting_changes GROUP BY setting_key),
settings AS (SELECT COALESCE(l.setting_key, s.setting_key) AS setting_key, COALESCE(l.v, s.setting_value) AS setting_value
  FROM app_settings s FULL OUTER JOIN lasts l ON l.setting_key = s.setting_key)"""

oracle("upsert_setting", with_views("SELECT setting_key AS key, setting_value AS value FROM settings",
                                    "app_settings", "setting_changes", extra=_SETTINGS))
oracle("setting_value", with_views("""
SELECT COALESCE(max(TRY_CAST(setting_value AS DOUBLE)), 0.0) AS opening_cash FROM settings
WHERE setting_key = 'opening_cash_seed'""", "app_settings", "setting_changes", extra=_SETTINGS))

_SEEDED = """firsts AS (SELECT setting_key, arg_min(setting_value, seq) AS setting_value FROM setting_seeds GROUP BY setting_key),
seeded AS (SELECT setting_key, setting_value FROM app_settings
  UNION ALL SELECT setting_key, setting_value FROM firsts WHERE setting_key NOT IN (SELECT setting_key FROM app_settings))"""

oracle("seed_if_absent", with_views("SELECT setting_key, setting_value FROM seeded",
                                    "app_settings", "setting_seeds", extra=_SEEDED))
_COMPANY = """nm AS (SELECT COALESCE(max(NULLIF(setting_value, '')) FILTER (WHERE setting_key = 'company_name'),
    'default') AS name FROM seeded)"""

oracle("company_list", with_views("""
SELECT name, COALESCE(NULLIF(regexp_replace(regexp_replace(lower(trim(name)), '\\s+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), ''),
                      'default') AS key FROM nm""", "app_settings", "setting_seeds", extra=_SEEDED + ",\n" + _COMPANY))

oracle("audit_append", with_views(f"""
SELECT username, action, details, company FROM audit_logs
UNION ALL SELECT username, action, details, 'Alpha Traders' FROM ({_EDIT_AUDIT_SELECT}) ea
UNION ALL SELECT username, action, details, 'Alpha Traders' FROM ({_DELETE_AUDIT_SELECT}) da
UNION ALL SELECT username, action, details, 'Alpha Traders' FROM ({_RENAME_AUDIT_SELECT}) ra""",
                                  TX, PT, "raw_import", "edits", "deletes", "renames", "audit_logs",
                                  extra=",\n".join([_EDIT, _DELETE, _RENAME]), recursive=True))

oracle("audit_backfill", with_views("""
SELECT COALESCE(company, 'Alpha Traders') AS company, COUNT(*) AS n FROM audit_logs GROUP BY 1""", "audit_logs"))

# ---- scalar functions -------------------------------------------------------------------

_F1 = ("COALESCE(NULLIF(regexp_replace(regexp_replace(lower(trim({x})), '\\s+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), ''),"
       " 'default')")

oracle("normalise_keys", with_views(f"""
SELECT name, {_F1.format(x='name')} AS company_key, lower(replace(name, ' ', '_')) AS server_key,
  regexp_replace(lower(name), '\\s+', '_', 'g') AS client_key
FROM nm WHERE name IS NOT NULL""", PT, "raw_import",
    extra='nm AS (SELECT name FROM parties UNION ALL SELECT "Customer Name" FROM raw_import)'))

_LADDER_T = """CASE WHEN starts_with(tt,'rec') THEN 'receipt' WHEN starts_with(tt,'sal') THEN 'sale'
         WHEN starts_with(tt,'exp') THEN 'expense' ELSE tt END"""
_LADDER_M = """CASE WHEN starts_with(mm,'cas') THEN 'cash' WHEN starts_with(mm,'ban') THEN 'bank'
         WHEN starts_with(mm,'upi') THEN 'upi' WHEN starts_with(mm,'cre') THEN 'credit'
         WHEN mm IN ('gpay','g-pay','googlepay','google pay','gp') THEN 'gpay' ELSE mm END"""

oracle("normalise_modes", with_views(f"""
SELECT txn_type, payment_mode, {_LADDER_T} AS type_norm, {_LADDER_M} AS mode_norm,
  ({_LADDER_M}) IN ('bank','upi','gpay') AS is_bank_group, n
FROM (SELECT txn_type, payment_mode, COALESCE(lower(trim(txn_type)),'none') AS tt,
        COALESCE(lower(trim(payment_mode)),'none') AS mm, COUNT(*) AS n
      FROM transactions GROUP BY txn_type, payment_mode) g""", TX))

oracle("title_case", with_views(f"""
SELECT raw, {_TITLE.format(x='raw')} AS title FROM (
  SELECT "Type" AS raw FROM raw_import UNION SELECT "Payment Mode" FROM raw_import
  UNION SELECT "Customer Name" FROM raw_import) u WHERE raw IS NOT NULL""", "raw_import"))

_DIGITS = "regexp_extract(bill_no, '^(.*?)([0-9]+)$', 2)"
_INC = f"CAST(CAST({_DIGITS} AS HUGEINT) + 1 AS VARCHAR)"
oracle("next_bill", with_views(f"""
SELECT bill_no, CASE WHEN bill_no IS NULL OR trim(bill_no) = '' THEN ''
                     WHEN {_DIGITS} = '' THEN bill_no
                     ELSE regexp_extract(bill_no, '^(.*?)([0-9]+)$', 1)
                          || lpad({_INC}, CAST(greatest(length({_DIGITS}), length({_INC})) AS INTEGER), '0') END AS next_bill_no
FROM transactions""", TX))

_MONEY_S = "CAST(CAST(COALESCE(t.amount, 0) AS DECIMAL(18,2)) AS VARCHAR)"
oracle("display_formats", with_views(f"""
, m AS (SELECT t.txn_id, t.txn_date, t.amount, p.name,
    CASE WHEN {_MONEY_S} LIKE '-%' THEN '-' ELSE '' END AS sgn,
    split_part(ltrim({_MONEY_S}, '-'), '.', 1) AS ip, split_part({_MONEY_S}, '.', 2) AS fp
  FROM {_J1})
SELECT txn_id AS id, strftime(txn_date, '%d-%m-%Y') AS date_text, substr(CAST(txn_date AS VARCHAR), 1, 7) AS month,
  sgn || CASE WHEN length(ip) <= 3 THEN ip
              ELSE reverse(rtrim(regexp_replace(reverse(left(ip, length(ip) - 3)), '([0-9]{{2}})', '\\1,', 'g'), ','))
                   || ',' || right(ip, 3) END || '.' || fp AS money_text,
  CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) AS fixed_text,
  CASE WHEN amount < 0 THEN CAST(CAST(-amount AS DECIMAL(38,2)) AS VARCHAR) || ' Cr'
       ELSE CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) || ' Dr' END AS label,
  left(regexp_replace(name, '[/\\\\?*\\[\\]]', '_', 'g'), 31) AS sheet_name, strftime(txn_date, '%Y%m%d_%H%M%S') AS stamp
FROM m""", TX, PT))

def _sum_sql(table: str, cols: list[str]) -> str:
    text = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in cols)
    return (f"SELECT '{table}' AS \"table\", COUNT(*) AS rows, "
            f"CAST(SUM(('0x' || substr(md5({text}), 1, 8))::UBIGINT) AS BIGINT) AS checksum FROM {table}")


oracle("snapshot_roundtrip", with_views("\nUNION ALL ".join([
    _sum_sql("parties", ["party_id", "name", "normalized_name", "type", "credit_allowed"]),
    _sum_sql("transactions", ["txn_id", "txn_date", "bill_no", "party_id", "txn_type", "payment_mode", "amount"]),
    _sum_sql("daily_cash", ["cash_date", "cash_in_hand"]),
    _sum_sql("audit_logs", ["id", "epoch_us(timestamp)", "username", "action", "details", "company"]),
    _sum_sql("app_settings", ["setting_key", "setting_value"])]), TX, PT, "daily_cash", "audit_logs", "app_settings"))

oracle("export_csv_roundtrip", with_views("""
SELECT left(regexp_replace(p.name, '[/\\\\?*\\[\\]]', '_', 'g'), 31) AS sheet, p.party_id, t.txn_id AS id, CAST(t.txn_date AS VARCHAR) AS date,
  t.bill_no, p.name AS party, CAST(t.amount AS DOUBLE) AS amount
FROM transactions t JOIN parties p ON p.party_id = t.party_id""", TX, PT))

oracle("import_csv_roundtrip", with_views(f"""
SELECT CAST(r.row_id % 4 AS VARCHAR) AS part, row_number() OVER (PARTITION BY r.row_id % 4 ORDER BY r.row_id) + 1 AS row_id,
  CAST(d AS VARCHAR) AS date, party, CASE WHEN ty IS NULL OR ty = '' THEN 'Sale' ELSE {_TITLE.format(x='ty')} END AS type,
  CAST(COALESCE(TRY_CAST(am AS DECIMAL(18,2)), 0) AS DOUBLE) AS amount, reason
FROM r""", "raw_import", extra=_IMPORT))

oracle("import_appended", with_views("""
SELECT (SELECT max(txn_id) FROM transactions) + row_number() OVER (ORDER BY o.row_id) AS txn_id,
  COALESCE(p.party_id, n.party_id) AS party_id, CAST(d AS VARCHAR) AS date, bill_no, CAST(amount AS DOUBLE) AS amount
FROM ok o LEFT JOIN parties p ON p.normalized_name = o.party_key
LEFT JOIN (SELECT party_key, (SELECT max(party_id) FROM parties) + row_number() OVER (ORDER BY min(row_id)) AS party_id
  FROM ok WHERE party_key NOT IN (SELECT normalized_name FROM parties) GROUP BY party_key) n ON n.party_key = o.party_key""",
                                     "raw_import", TX, PT, extra=_IMPORT))

oracle("cash_audit", with_views("""
SELECT admin_user AS username, 'Set Cash In Hand' AS action, date || ' = ' || CAST(CAST(cash_in_hand AS DOUBLE) AS VARCHAR) AS details
FROM cash_counts WHERE TRY_CAST(date AS DATE) IS NOT NULL AND TRY_CAST(cash_in_hand AS DECIMAL(18,2)) IS NOT NULL""", "cash_counts"))

oracle("stream_import", _ORACLE["import_accepted"])

oracle("transactions_page_after", with_views(f"""
SELECT {_LIST} FROM {_J1}
WHERE t.txn_date < DATE '1997-01-01' OR (t.txn_date = DATE '1997-01-01' AND t.txn_id < 7000)
ORDER BY t.txn_date DESC, t.txn_id DESC LIMIT 100""", TX, PT))

oracle("import_first_rejects", with_views(
    "SELECT row_id, reason FROM r WHERE reason IS NOT NULL ORDER BY row_id LIMIT 20", "raw_import", extra=_IMPORT))

FIXTURE_SQL["opening_cash_requests"] = """
SELECT event_id AS seq, CASE WHEN event_id%17=0 THEN 'n/a'
  WHEN event_id%13=0 THEN CAST(CAST(event_id + 20000000.5 AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS amount,
  'user_' || CAST(user_id AS VARCHAR) AS admin_user
FROM events"""

oracle("set_opening_cash", with_views("""
SELECT admin_user AS username, 'Set Opening Cash' AS action,
  'Opening Cash Seed set to ' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS DECIMAL(38,0)) AS VARCHAR) || '.0'
                                      ELSE CAST(v AS VARCHAR) END AS details
FROM (SELECT admin_user, TRY_CAST(amount AS DOUBLE) AS v FROM opening_cash_requests) r
WHERE v IS NOT NULL AND NOT isnan(v)""", "opening_cash_requests"))


# ---- totals kept by deltas: the same batches applied to the rows themselves ---------------

def _renamed(ctes: str, **names: str) -> str:
    """CTE text with whole words replaced, so that parts with the same names can stand side by side."""
    for old, new in names.items():
        ctes = re.sub(rf"\b{old}\b", new, ctes)
    return ctes


_AFTER = ",\n".join([
    _EDIT,
    """edited AS (SELECT t.txn_id, COALESCE(CAST(p.n_date AS DATE), t.txn_date) AS txn_date, t.party_id, COALESCE(p.n_type, t.txn_type) AS txn_type,
  COALESCE(p.n_mode, t.payment_mode) AS payment_mode, COALESCE(CAST(p.n_amount AS DECIMAL(18,2)), t.amount) AS amount
  FROM transactions t LEFT JOIN piv p ON p.txn_id = t.txn_id)""",
    _renamed(_ADD, a="add_a", chk="add_chk"),
    _IMPORT,
    """after_all AS (SELECT party_id, txn_date, txn_type, payment_mode, amount FROM edited WHERE txn_id NOT IN (SELECT txn_id FROM deletes)
  UNION ALL SELECT pid, d, txn_type, mode, amt FROM add_chk WHERE reason IS NULL
  UNION ALL SELECT COALESCE(p.party_id, n.party_id), o.d, o.type, o.mode, o.amount FROM ok o LEFT JOIN parties p ON p.normalized_name = o.party_key
    LEFT JOIN (SELECT party_key, (SELECT max(party_id) FROM parties) + row_number() OVER (ORDER BY min(row_id)) AS party_id
      FROM ok WHERE party_key NOT IN (SELECT normalized_name FROM parties) GROUP BY party_key) n ON n.party_key = o.party_key)"""])
_AFTER_VIEWS = (TX, PT, "raw_import", "adds", "edits", "deletes")

oracle("totals_by_deltas", with_views("""
SELECT party_id, CAST(txn_date AS VARCHAR) AS date, txn_type AS type, payment_mode AS mode, count(*) AS n,
  CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS amount FROM after_all GROUP BY party_id, txn_date, txn_type, payment_mode""",
                                      *_AFTER_VIEWS, extra=_AFTER))


_FLOW = "CASE WHEN lower(txn_type) IN ('sale','receipt') THEN amount WHEN lower(txn_type) = 'expense' THEN -amount END"


def _exact(expr: str, where: str) -> str:
    return f"CAST(COALESCE(sum({expr}) FILTER (WHERE {where}), 0) AS DECIMAL(38,2))"


_BOOKS_AFTER = _AFTER + f""",
fig AS (SELECT {_exact("amount", "lower(txn_type) = 'sale'")} AS sales, {_exact("amount", "lower(txn_type) = 'expense'")} AS expenses,
    {_exact("amount", "lower(txn_type) = 'sale' AND txn_date = DATE '1998-06-15'")} AS sales_today,
    {_exact("amount", "lower(txn_type) = 'sale' AND year(txn_date) = 1998 AND month(txn_date) = 6")} AS sales_month,
    {_exact(_FLOW, "lower(payment_mode) = 'cash'")} AS cash, {_exact(_FLOW, "lower(payment_mode) IN " + BANKS_LOWER)} AS bank,
    {_exact(_FLOW, "lower(payment_mode) = 'upi'")} AS upi FROM after_all),
who AS (SELECT p.party_id AS known, p.name, lower(p.type) AS ptype, x.* FROM after_all x LEFT JOIN parties p ON p.party_id = x.party_id),
owed AS (SELECT {_exact("CASE WHEN lower(txn_type) = 'sale' THEN amount WHEN lower(txn_type) = 'receipt' THEN -amount END", "ptype = 'customer'")} AS receivables,
    {_exact("CASE WHEN lower(txn_type) = 'sale' THEN amount ELSE -amount END", "known IS NOT NULL")} AS debtors,
    {_exact("CASE WHEN lower(txn_type) = 'purchase' THEN amount ELSE -amount END", "known IS NOT NULL")} AS creditors FROM who),
late AS (SELECT sum(CASE WHEN lower(txn_type) = 'sale' THEN amount ELSE -amount END) AS bal FROM who
    WHERE ptype = 'credit customer' AND lower(txn_type) IN ('sale','receipt') GROUP BY name),
accounts AS (SELECT 'Cash Account' AS item, cash AS value FROM fig UNION ALL SELECT 'Bank Account', bank FROM fig
    UNION ALL SELECT 'UPI Account', upi FROM fig UNION ALL SELECT 'Sundry Debtors', debtors FROM owed UNION ALL SELECT 'Sundry Creditors', creditors FROM owed
    UNION ALL SELECT 'Sales Account', -sales FROM fig UNION ALL SELECT 'Expense Account', expenses FROM fig)"""

oracle("reports_from_totals", with_views("""
SELECT report, item, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'pnl' AS report, 'sales' AS item, sales AS value FROM fig UNION ALL SELECT 'pnl', 'expenses', expenses FROM fig
  UNION ALL SELECT 'pnl', 'net_profit', sales - expenses FROM fig
  UNION ALL SELECT 'dashboard', 'sales_today', sales_today FROM fig UNION ALL SELECT 'dashboard', 'sales_month', sales_month FROM fig
  UNION ALL SELECT 'dashboard', 'cash_balance', cash FROM fig UNION ALL SELECT 'dashboard', 'bank_balance', bank FROM fig
  UNION ALL SELECT 'dashboard', 'receivables', receivables FROM owed UNION ALL SELECT 'dashboard', 'total_funds', cash + bank FROM fig
  UNION ALL SELECT 'outstanding', 'total', COALESCE(sum(bal), 0) FROM late WHERE bal > 0 UNION ALL SELECT 'trial balance', item, value FROM accounts) x
UNION ALL SELECT 'dashboard', 'cash_ratio', CASE WHEN cash + bank > 0 THEN CAST(cash AS DOUBLE) / CAST(cash + bank AS DOUBLE) * 100 ELSE 0 END FROM fig
UNION ALL SELECT 'trial balance', 'TOTAL', CAST(sum(value) FILTER (WHERE value > 0) AS DOUBLE) - CAST(-sum(value) FILTER (WHERE value < 0) AS DOUBLE)
  FROM accounts""", *_AFTER_VIEWS, extra=_BOOKS_AFTER))


# ---- statements with the balance brought forward: from the first row on --------------------

def _forward(key: str, rows: str, value: str) -> str:
    order = f"PARTITION BY {key} ORDER BY txn_date NULLS FIRST, txn_id"
    return f"""x AS ({rows}),
s AS (SELECT *, sum({value}) OVER ({order} ROWS UNBOUNDED PRECEDING) AS bal FROM x),
o AS (SELECT {key}, sum({value}) AS bal FROM x WHERE txn_date IS NULL OR txn_date < DATE '1997-02-10' GROUP BY {key})
SELECT {key}, txn_id AS id, CAST(txn_date AS VARCHAR) AS date, txn_type AS type, CAST(amount AS DOUBLE) AS amount, CAST(bal AS DOUBLE) AS balance
FROM s WHERE txn_date BETWEEN DATE '1997-02-10' AND DATE '1997-04-20'
UNION ALL SELECT k.{key}, NULL, '1997-02-10', 'Opening', NULL, CAST(COALESCE(o.bal, 0) AS DOUBLE)
FROM (SELECT {key} FROM o WHERE bal <> 0 UNION SELECT {key} FROM x WHERE txn_date BETWEEN DATE '1997-02-10' AND DATE '1997-04-20') k LEFT JOIN o ON o.{key} = k.{key}"""


_LEFT = "FROM transactions t JOIN parties p ON p.party_id = t.party_id WHERE t.txn_id NOT IN (SELECT txn_id FROM deletes)"

oracle("party_statement_forward", with_views("", TX, PT, "deletes", extra=_forward(
    "party_id", f"SELECT t.* {_LEFT}", "CASE WHEN txn_type = 'Sale' THEN COALESCE(amount, 0) ELSE -COALESCE(amount, 0) END")))

oracle("account_statement_forward", with_views("", TX, PT, "deletes", extra=_forward(
    "account", f"""SELECT 'Cash' AS account, t.* {_LEFT} AND lower(payment_mode) = 'cash'
  UNION ALL SELECT 'Bank', t.* {_LEFT} AND lower(payment_mode) IN {BANKS_LOWER} UNION ALL SELECT 'UPI', t.* {_LEFT} AND lower(payment_mode) = 'upi'""",
    "CASE WHEN txn_type IN ('Sale', 'Receipt') THEN COALESCE(amount, 0) ELSE -COALESCE(amount, 0) END")))


# ---- changes that rewrite what they touch: the batches on the rows, one after another ------

oracle("changes_by_bucket", with_views("""
SELECT txn_id, CAST(txn_date AS VARCHAR) AS txn_date, bill_no, party_id, txn_type, payment_mode, CAST(amount AS DOUBLE) AS amount FROM kept
UNION ALL SELECT (SELECT max(txn_id) FROM kept) + row_number() OVER (ORDER BY seq), CAST(d AS VARCHAR), bill_no, pid, txn_type, mode, CAST(amt AS DOUBLE)
FROM add_chk WHERE reason IS NULL""", TX, PT, "raw_import", "adds", "edits", "deletes", extra=",\n".join([
    _EDIT,
    """kept AS (SELECT t.txn_id, COALESCE(CAST(p.n_date AS DATE), t.txn_date) AS txn_date, COALESCE(p.n_bill, t.bill_no) AS bill_no, t.party_id,
  COALESCE(p.n_type, t.txn_type) AS txn_type, COALESCE(p.n_mode, t.payment_mode) AS payment_mode, COALESCE(CAST(p.n_amount AS DECIMAL(18,2)), t.amount) AS amount
  FROM transactions t LEFT JOIN piv p ON p.txn_id = t.txn_id WHERE t.txn_id NOT IN (SELECT txn_id FROM deletes))""",
    _renamed(_ADD, a="add_a", chk="add_chk")])))

oracle("transactions_page_direct", with_views(f"""
SELECT * FROM (SELECT {_LIST}, 'third' AS page FROM {_J1} ORDER BY t.txn_date DESC, t.txn_id DESC LIMIT 100 OFFSET 200) a
UNION ALL SELECT * FROM (SELECT {_LIST}, 'last' AS page FROM {_J1} ORDER BY t.txn_date, t.txn_id
  LIMIT (SELECT (count(*) - 1) % 100 + 1 FROM {_J1})) b""", TX, PT))

_SUMMARY_BODY = _ORACLE["daily_cash_summary"][_ORACLE["daily_cash_summary"].rindex("\nSELECT CAST(d AS VARCHAR)"):]

oracle("cash_month_after_counts", with_views(
    _SUMMARY_BODY + " WHERE d BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", TX, PT, "cash_counts", recursive=True, extra=",\n".join([
        f"counted0 AS ({FIXTURE_SQL['daily_cash']})", _CASH_UPSERT,
        """counted AS (SELECT COALESCE(l.cash_date, d.cash_date) AS cash_date, COALESCE(l.v, d.cash_in_hand) AS cash_in_hand
  FROM counted0 d FULL OUTER JOIN lastc l ON l.cash_date = d.cash_date)""", _renamed(_CASH_DAYS, daily_cash="counted")])))
