import gc
import os
import time

import pytest

from factloom import storage


def test_tables_go_when_no_plan_reads_them(spark):
    path = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kept = storage.cut(spark.range(10))
    derived = storage.cut(spark.range(5)).where("id > 1")
    lost = path(storage.cut(spark.range(3)))
    for _ in range(50):
        gc.collect()
        spark._jvm.System.gc()
        storage.sweep()
        if not os.path.exists(lost):
            break
        time.sleep(0.1)
    assert not os.path.exists(lost)
    assert kept.count() == 10 and derived.count() == 3


def test_scope_deletes_what_was_cut_inside(spark):
    with storage.scope():
        df = storage.cut(spark.range(4))
        files = df.inputFiles()
        assert df.count() == 4
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
