"""Staged tables."""

import os

from corvane.durable import discard, shared_folder, staged


def test_staged_tables_live_in_the_shared_folder(spark):
    discard(spark)
    df = staged(spark.range(10).selectExpr("id", "id % 2 AS k"), "t")
    folder = shared_folder(spark).removeprefix("file://")
    assert df.count() == 10 and df.schema.names == ["id", "k"] and any(f.startswith("corvane-t-") for f in os.listdir(folder))
    assert discard(spark) == 1 and not any(f.startswith("corvane-t-") for f in os.listdir(folder))
