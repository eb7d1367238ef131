"""What a session does with files of stages that are over."""

import glob
import time

from textloom.session import materialize, ship


def test_shuffle_files_go_with_their_execution(spark):
    ship(spark)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in folders)
    before = count()
    table = materialize(spark.range(200_000).repartition(8, "id"), "t")
    until = time.time() + 10
    while count() > before and time.time() < until:
        time.sleep(0.2)
    left = count()
    assert left <= before and table.count() == 200_000
