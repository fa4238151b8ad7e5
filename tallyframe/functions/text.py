"""Text scalars: name keys, type / mode ladders, title case, bill numbers.

Every function maps Column -> Column and stays inside Catalyst (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
# Payment modes that make up the bank group in SQL filters.
BANK_GROUP_MODES = ["Bank", "UPI", "GPay", "GPAY", "Google Pay", "GooglePay"]
# Spellings the cash-summary mode ladder maps to "gpay".
GPAY_SPELLINGS = ["gpay", "g-pay", "googlepay", "google pay", "gp"]
# Whitelisted fields of a transaction edit.
EDITABLE_FIELDS = ["txn_date", "bill_no", "txn_type", "payment_mode", "amount"]
# Client ledger statement: types written on the credit side.
CREDIT_SIDE_TYPES = ["receipt", "reciept", "sale return"]

_WS = r"(?U)\s"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ci_eq(col, value: str) -> Column:
    """Case-insensitive equality, as the SQL predicates behave under the default collation."""
    return F.lower(_c(col)) == F.lit(value.lower())


def ci_in(col, values) -> Column:
    return F.lower(_c(col)).isin(sorted({v.lower() for v in values}))


def is_bank_group(mode) -> Column:
    """``payment_mode IN BANKS`` under a case-insensitive collation."""
    return ci_in(mode, BANK_GROUP_MODES)


# The characters Python's ``str.strip()`` removes (``str.isspace``).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(col) -> Column:
    """Python ``str.strip()``: drop leading and trailing white space (no regex)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def company_key(name) -> Column:
    """trim, lower, runs of white space -> ``_``, drop other characters, empty -> ``default``."""
    base = F.regexp_replace(F.lower(py_strip(name)), rf"{_WS}+", "_")
    key = F.regexp_replace(base, "[^a-z0-9_]+", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("default"))


def server_key(name) -> Column:
    """the party key of the service: lower case, each space -> ``_`` (no trim)."""
    return F.lower(F.replace(_c(name), F.lit(" "), F.lit("_")))


def client_key(name) -> Column:
    """the party key the client sends: lower case, each run of white space -> ``_``."""
    return F.regexp_replace(F.lower(_c(name)), rf"{_WS}+", "_")


def _py_str_lower(col) -> Column:
    # str(None).strip().lower() is "none" in the reference's loop.
    return F.coalesce(F.lower(py_strip(col)), F.lit("none"))


def type_norm(txn_type) -> Column:
    """``rec*`` -> receipt, ``sal*`` -> sale, ``exp*`` -> expense, else lower-trimmed text."""
    t = _py_str_lower(txn_type)
    return (F.when(t.startswith("rec"), F.lit("receipt"))
             .when(t.startswith("sal"), F.lit("sale"))
             .when(t.startswith("exp"), F.lit("expense"))
             .otherwise(t))


def mode_norm(mode) -> Column:
    """``cas*``, ``ban*``, ``upi*``, ``cre*`` prefixes and the GPay spellings."""
    m = _py_str_lower(mode)
    return (F.when(m.startswith("cas"), F.lit("cash"))
             .when(m.startswith("ban"), F.lit("bank"))
             .when(m.startswith("upi"), F.lit("upi"))
             .when(m.startswith("cre"), F.lit("credit"))
             .when(m.isin(GPAY_SPELLINGS), F.lit("gpay"))
             .otherwise(m))


def is_bank_norm(mode_normed: Column) -> Column:
    """F6 after the ladder: bank, upi or gpay."""
    return mode_normed.isin("bank", "upi", "gpay")


#: Characters with case, in Java's terms: a word of ``str.title`` is a run of these.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
# Fixed values of Unicode: the letters whose title case is another character than their upper case.
_DIGRAPHS = ("ǄǆǇǉǊǌǱǳ", "ǅǅǈǈǋǋǲǲ")
_IOTA_RANGES = (range(0x1F80, 0x1F88), range(0x1F90, 0x1F98), range(0x1FA0, 0x1FA8))  # eight further on
_IOTA_SINGLE = (0x1FB3, 0x1FC3, 0x1FF3)  # nine further on
_IOTA_OPEN = "ᾲᾴᾷῂῄῇῲῴῷ"  # upper case ends in a capital iota, title case in a combining one
_OWN_TITLE = "[ა-ჺჽ-ჿ]"  # has capitals, but none in title case


def _title_letter(x: Column) -> Column:
    """The title case of one character: of several letters only the first is a capital."""
    iota = "".join(chr(p) for r in _IOTA_RANGES for p in r) + "".join(map(chr, _IOTA_SINGLE))
    to = "".join(chr(p + 8) for r in _IOTA_RANGES for p in r) + "".join(chr(p + 9) for p in _IOTA_SINGLE)
    up = F.upper(x)
    return (F.when(x.rlike(f"[{_DIGRAPHS[0]}{iota}]"), F.translate(x, _DIGRAPHS[0] + iota, _DIGRAPHS[1] + to))
             .when(x.rlike(rf"{_OWN_TITLE}|[\p{{IsUppercase}}\p{{IsTitlecase}}]"), x)
             .when(x == "ŉ", F.lit("ʼN"))
             .when(x.rlike(f"[{_IOTA_OPEN}]"), F.concat(F.left(up, F.length(up) - 1), F.lit("ͅ")))
             .when(F.length(up) > 1, F.concat(F.left(up, F.lit(1)), F.lower(F.substring(up, 2, 9)))).otherwise(up))


def title_case(col) -> Column:
    """Python ``str.title()``: a cased character after one without case takes its title case, other ones lower case."""
    c = _c(col)
    runs = F.regexp_extract_all(c, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), 1)

    def word(w: Column) -> Column:
        first = F.left(w, F.lit(1))
        # Lower-cased as a whole, for a sigma at the end has a form of its own.
        rest = F.substring(F.lower(w), F.length(F.lower(first)) + 1, F.length(w) * 3)
        return F.when(w.rlike(f"^[{_CASED}]"), F.concat(_title_letter(first), rest)).otherwise(w)

    general = F.array_join(F.transform(runs, word), "")
    # Fast path: ASCII letters and spaces only, where word starts are exactly what initcap sees.
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(general)


def next_bill_number(bill) -> Column:
    """add one to the trailing digits, keeping their width; no trailing digits -> unchanged.

    The increment is done on the digit text (carry through trailing nines), so it is
    exact for any length.
    """
    b = _c(bill)
    prefix = F.regexp_extract(b, r"^(.*?)([0-9]+)$", 1)
    digits = F.regexp_extract(b, r"^(.*?)([0-9]+)$", 2)
    nines = F.regexp_extract(digits, r"(9*)$", 1)
    head_len = F.length(digits) - F.length(nines)
    head = F.substring(digits, F.lit(1), head_len)
    zeros = F.repeat(F.lit("0"), F.length(nines))
    last = F.substring(head, head_len, F.lit(1)).cast("int") + 1
    bumped = F.when(head_len == 0, F.concat(F.lit("1"), zeros)).otherwise(
        F.concat(F.substring(head, F.lit(1), head_len - 1), last.cast("string"), zeros))
    return (F.when(b.isNull() | (py_strip(b) == ""), F.lit(""))
             .when(digits == "", b)
             .otherwise(F.concat(prefix, bumped)))


def sheet_name(col) -> Column:
    """``/ \\ ? * [ ]`` -> ``_``, at most 31 characters."""
    return F.substring(F.regexp_replace(_c(col), r"[/\\?*\[\]]", "_"), 1, 31)


def particulars(txn_type, mode) -> Column:
    """``type`` or ``type / mode`` when the mode is not empty."""
    t = F.coalesce(py_strip(txn_type), F.lit(""))
    m = _c(mode)
    return F.when(m.isNull() | (m == ""), t).otherwise(F.concat(t, F.lit(" / "), m))


def py_str(col) -> Column:
    """Python ``str(x)`` of a value read back from a table: ``None`` for null."""
    return F.coalesce(_c(col).cast("string"), F.lit("None"))
