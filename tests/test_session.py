from quirefold.session import materialize, release, shared_dir


def test_written_tables_end_lineage_and_go(spark):
    import os

    df = materialize(spark.range(10).withColumnRenamed("id", "x"), "numbers")
    assert df.count() == 10 and df.columns == ["x"]
    folder = shared_dir(spark)
    assert any("numbers" in d for _, ds, _ in os.walk(folder) for d in ds)
    release(df)
    assert not any("numbers" in d for _, ds, _ in os.walk(folder) for d in ds)
