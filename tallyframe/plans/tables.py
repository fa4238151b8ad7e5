"""The bookkeeping tables of one data set, read lazily from the driver's parquet.

Every ``Books`` builds its frames anew, so a query lists the files as they are when it runs; within
one ``Books`` a table is built once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures


class Books:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    @property
    def parties(self) -> DataFrame:
        return self._get("parties", lambda: fixtures.parties(self.spark, self.sf_dir))

    @property
    def transactions(self) -> DataFrame:
        return self._get("transactions", lambda: fixtures.transactions(self.spark, self.sf_dir))

    @property
    def daily_cash(self) -> DataFrame:
        return self._get("daily_cash", lambda: fixtures.daily_cash(self.spark, self.sf_dir))

    @property
    def audit_logs(self) -> DataFrame:
        return self._get("audit_logs", lambda: fixtures.audit_logs(self.spark, self.sf_dir))

    @property
    def raw_import(self) -> DataFrame:
        return self._get("raw_import", lambda: fixtures.raw_import(self.spark, self.sf_dir))

    @property
    def entries(self) -> DataFrame:
        return self._get("entries", lambda: fixtures.entries(self.spark, self.sf_dir))

    def batch(self, name: str) -> DataFrame:
        return self._get(f"batch:{name}", lambda: getattr(fixtures, name)(self.spark, self.sf_dir))

    @property
    def app_settings(self) -> DataFrame:
        return self._get("app_settings", lambda: fixtures.app_settings(self.spark))
