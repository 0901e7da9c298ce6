"""Stored intermediate tables lie under the folder that the session names."""

from pyspark.sql import functions as F

from tallyworks import session
from tallyworks.functions.ordering import with_global_order


def test_the_named_folder_holds_stored_tables(spark, tmp_path, monkeypatch):
    named = (tmp_path / "shared").as_uri()
    monkeypatch.setattr(session, "_named_folder", lambda s: named)
    df = session.durable(spark.range(10))
    assert df.count() == 10 and all(f.startswith(named) for f in df.inputFiles())
    out = with_global_order(spark.range(50), [F.col("id")], [F.col("id")], "at")
    assert sorted(r["at"] for r in out.collect()) == list(range(1, 51)) and all(f.startswith(named) for f in out.inputFiles())


def test_a_cluster_without_a_folder_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(session, "_named_folder", lambda s: None)
    monkeypatch.setattr(session, "_is_local", lambda s: False)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(spark, "x")


def test_stored_tables_go_when_their_scope_ends(spark, tmp_path, monkeypatch):
    import pytest

    shared, out = tmp_path / "shared", str(tmp_path / "out")
    monkeypatch.setattr(session, "_named_folder", lambda s: shared.as_uri())
    outside = session.durable(spark.range(3))
    with session.stored_tables(spark):
        ordered = with_global_order(spark.range(50), [F.col("id")], [F.col("id")], "at")
        with session.stored_tables(spark):
            inner = session.durable(spark.range(4))
            assert inner.count() == 4
        # Nothing of the outer scope has gone; a second run of the same plan reads the same slices.
        assert len(list(shared.iterdir())) == 3
        ordered.write.parquet(out)
        assert ordered.count() == 50
    assert len(list(shared.iterdir())) == 1 and outside.count() == 3
    assert spark.read.parquet(out).count() == 50
    with pytest.raises(RuntimeError), session.stored_tables(spark):
        session.durable(spark.range(3))
        raise RuntimeError
    assert len(list(shared.iterdir())) == 1


def test_a_report_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from tallyworks.catalog import registered

    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "_named_folder", lambda s: shared.as_uri())
    with session.stored_tables(spark):
        registered()[0]["R14_repeat_by_first"](spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out"))
        assert list(shared.iterdir())
    assert not list(shared.iterdir()) and spark.read.parquet(str(tmp_path / "out")).count()
