import threading

import pytest

from corvane.sources import shared


def test_tables_on_the_way_go(spark):
    way = []

    def make():
        first, path = shared.written(spark.range(5), "first")
        way.append(path)
        return first.where("id > 1")

    before = shared.materialize(spark.range(2), "before")
    made = shared.settled(spark, make, "made")
    assert made.count() == 3 and before.count() == 2 and way[0] not in shared.shared_paths()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(way[0])


def test_other_threads_keep_theirs(spark):
    there = shared.shared_paths()
    other = []
    thread = threading.Thread(target=lambda: other.append(shared.materialize(spark.range(7), "other")))
    thread.start()
    thread.join()
    mine = shared.materialize(spark.range(3), "mine")
    shared.drop_since(spark, there)
    assert other[0].count() == 7
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        mine.collect()
