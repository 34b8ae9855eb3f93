import time

from dailyfolio.session import CLEANUP_CONF, written


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    held, before = shuffled(), spark.conf.get(CLEANUP_CONF)
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    table = written(rows, "counts")
    until = time.time() + 20
    while shuffled() - held and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - held
    assert spark.conf.get(CLEANUP_CONF) == before
    assert table.count() == 7 and rows.count() == 7
