import os

from lodestrata.session import materialize, shared_dir, spread


def test_spread_moves_small_scans_only(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t")).where("id > 3")
    assert scan.rdd.getNumPartitions() == 1 and spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(scan).count() == 46
    grouped = scan.groupBy("id").count()
    assert spread(grouped) is grouped
    wide = spark.range(10, numPartitions=40)
    assert spread(wide) is wide


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(7).withColumnRenamed("id", "a b"))
    assert df.count() == 7 and df.columns == ["a b"]
    assert any(x.startswith("table-") for x in os.listdir(shared_dir(spark).removeprefix("file:")))
    assert materialize(df.where("false")).count() == 0
