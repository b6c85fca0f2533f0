import os

from caseweave.session import freeze, shared_dir, temporary_tables


def test_frozen_tables_live_in_the_shared_folder(spark):
    df = spark.range(3)
    kept = freeze(df)
    assert kept.inputFiles()[0].startswith("file://" + shared_dir(spark).removeprefix("file:").removeprefix("//"))
    with temporary_tables(spark):
        inner = freeze(df)
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.count() == 3
    assert not os.path.exists(path) and kept.count() == 3
