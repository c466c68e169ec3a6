"""The shared folder and who removes what is in it."""

from pathlib import Path

from drillsight.session import settle, shared_dir, stage, staging


def test_staged_tables_go_with_their_scope(spark):
    outer = shared_dir(spark, "mine")
    spark.range(3).write.parquet(outer)
    with staging(spark):
        staged = stage(spark.range(5), "inside")
        path = Path(staged.inputFiles()[0].removeprefix("file:")).parent
        assert staged.count() == 5 and path.exists()
    assert not path.exists()
    assert spark.read.parquet(outer).count() == 3


def test_a_settled_table_outlives_what_it_was_made_of(spark):
    inner = []

    def build():
        staged = stage(spark.range(7), "inner")
        inner.append(Path(staged.inputFiles()[0].removeprefix("file:")).parent)
        return staged.filter("id > 2")

    path = shared_dir(spark, "settled")
    assert settle(spark, path, build).count() == 4
    assert not inner[0].exists()
