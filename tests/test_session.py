import os
from types import SimpleNamespace

import pytest

from textquarry.errors import InvalidInput
from textquarry.session import drop_table, materialize, shared_folder, spread


def fake(master, folder=None):
    """A session of which only the settings are asked."""
    held = []
    found = SimpleNamespace(isDefined=lambda: bool(held), get=lambda: held[-1])
    context = SimpleNamespace(master=master, setCheckpointDir=held.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found)))
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_names_its_folder(master, monkeypatch):
    monkeypatch.setattr("tempfile.mkdtemp", lambda **_: pytest.fail("no folder on one machine"))
    with pytest.raises(InvalidInput):
        shared_folder(fake(master))
    assert shared_folder(fake(master, "hdfs://x/shared/")) == "hdfs://x/shared"


def test_local_masters_get_one_folder():
    session = fake("local[4]")
    assert shared_folder(session).startswith("file:///") and shared_folder(session) == shared_folder(session)


def test_tables_are_written_to_the_named_folder(spark, monkeypatch):
    monkeypatch.setattr("tempfile.mkdtemp", lambda **_: pytest.fail("no folder on one machine"))
    folder = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/textquarry"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    table = materialize(spark.range(10).toDF("n"), "numbers")
    assert [f.split("-")[0] for f in set(os.listdir(folder)) - before] == ["numbers"] and table.count() == 10
    drop_table(table)
    drop_table(table)
    assert set(os.listdir(folder)) == before


def test_spread_moves_only_few_parts(spark):
    assert spread(spark.range(0, 8, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 80, 1, 9)).rdd.getNumPartitions() == 9
