"""tallyframe: bookkeeping reports and batch ledger changes as Spark DataFrame operators."""

__version__ = "0.1.0"
