"""The dropped import files grow in number with the rows; the import of many files is that of few."""

import glob
import tempfile

from pyspark.sql import functions as F

from tallyframe.plans import catalog
from tallyframe.plans.tables import Books

from conftest import SF_SMALL


def test_parts_are_several_files_in_order(spark, monkeypatch):
    want = sorted(map(tuple, catalog.q_import_csv_roundtrip(spark, SF_SMALL).collect()), key=str)
    monkeypatch.setattr(catalog, "IMPORT_FILE_ROWS", 100)
    path = tempfile.mkdtemp(prefix="tf-drop-")
    raw = Books(spark, SF_SMALL).raw_import.withColumn("part", F.col("row_id") % 4)
    folders = catalog._drop_import_files(raw, path)
    n = {r.part: r.n for r in raw.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p, folder in enumerate(folders):
        files = sorted(glob.glob(f"{folder}/*.csv"))
        assert len(files) >= n[p] / 100 > 1
    got = sorted(map(tuple, catalog.q_import_csv_roundtrip(spark, SF_SMALL).collect()), key=str)
    assert got == want and len(want) == sum(n.values())
