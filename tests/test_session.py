from types import SimpleNamespace

import pytest

from signalgrid import session


def fake(setting, master, warehouse="/house"):
    named = {"spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": warehouse}
    conf = SimpleNamespace(get=lambda key, default=None: named.get(key) or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_folder_uses_the_shared_folder():
    path = session.work_folder(fake("hdfs://x/shared/", "yarn"), "state")
    assert path.startswith("hdfs://x/shared/state-")
    assert path != session.work_folder(fake("hdfs://x/shared/", "yarn"), "state")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.work_folder(fake(None, "yarn"), "state")
    assert session.work_folder(fake(None, "local[8]"), "state").startswith("/house/state-")
    with pytest.raises(RuntimeError):
        session.work_folder(fake(None, "local[8]", None), "state")


def test_local_tables_have_known_size(spark, capsys):
    frame = session.local_table(spark, [(1, "a", 2.0), (2, None, None)], "i int, s string, d double")
    assert sorted(map(tuple, frame.collect())) == [(1, "a", 2.0), (2, None, None)]
    frame.explain()
    assert "LocalTableScan" in capsys.readouterr().out
    assert session.local_table(spark, [], "i int, s string").count() == 0


def test_size_check(spark):
    assert session.fits_broadcast(spark.range(10), 10)
    assert not session.fits_broadcast(spark.range(11), 10)


def test_written_frames_do_not_follow_their_input(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    kept = session.written(spark.read.parquet(path), "kept")
    spark.range(9).write.mode("overwrite").parquet(path)
    assert kept.count() == 3
