import os
import time

import pytest

from blockloom.scratch import discard, materialize, shared_root

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "/shuffle_" in x}


def test_tables_are_written_and_removed(spark):
    table = materialize(spark.range(5), "five")
    path = table._scratch_path.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    discard(table)
    assert not os.path.exists(path)


def test_a_cluster_must_name_the_folder(spark):
    class Context:
        applicationId, master = "app-1", "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_root(Session())


def test_shuffle_files_of_a_table_go_when_it_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    numbers = spark.range(1000).repartition(3)
    table = materialize(numbers.join(numbers.selectExpr("id * 2 as id"), "id").groupBy("id").count(), "shuffled")
    left = time.time() + 5  # removal is told to the executors and not waited for
    while shuffle_files(spark) - before and time.time() < left:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert table.count() == 500 and spark.conf.get(CLEANUP) == setting


def test_the_setting_comes_back_after_a_failed_write(spark):
    setting = spark.conf.get(CLEANUP)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        materialize(spark.range(3).selectExpr("raise_error('no') as x"), "failed")
    assert spark.conf.get(CLEANUP) == setting
