import pytest

from signpost import checks
from signpost.session import materialize, scratch, shared_folder, spread
from signpost.sources import files


class _Stub:
    """A session without the setting."""

    def __init__(self, master, folder=None):
        self.conf = {}
        self.sparkContext = self
        self.master = master
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_folder_comes_from_the_session(spark):
    stub = _Stub("spark://host:7077")
    stub.conf = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert shared_folder(stub) == "hdfs://shared/x"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        shared_folder(_Stub("spark://host:7077"))
    assert shared_folder(_Stub("yarn", "hdfs://check")) == "hdfs://check"
    local = _Stub("local[2]")
    assert shared_folder(local) == local.folder


def test_materialize_reads_back_what_was_written(spark):
    df = spark.sql("select 1 a, array(1.5D, null) b, map('x', 2) c, cast(null as string) d")
    assert materialize(df).collect() == df.collect()
    assert materialize(df).schema.simpleString() == df.schema.simpleString()


def test_written_tables_have_an_owner(spark):
    folder = f"{shared_folder(spark)}/signpost"
    before = set(files.names(spark, folder))
    with scratch(spark) as mine:
        kept = [materialize(spark.range(3)), materialize(spark.range(4))]
        with scratch(spark) as inner:
            materialize(spark.range(5))
            assert len(files.names(spark, inner)) == 1
        assert not files.exists(spark, inner)
        assert sorted(t.count() for t in kept) == [3, 4] and len(files.names(spark, mine)) == 2
    assert set(files.names(spark, folder)) == before
    with pytest.raises(RuntimeError), scratch(spark) as mine:
        materialize(spark.range(3))
        raise RuntimeError
    assert not files.exists(spark, mine) and set(files.names(spark, folder)) == before
    assert materialize(spark.range(2)).count() == 2
    assert len(set(files.names(spark, folder)) - before) == 1


def test_spread_moves_small_tables_only(spark):
    few = spark.range(0, 100, 1, 2)
    cores = spark.sparkContext.defaultParallelism
    assert spread(few, "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many, "id") is many


def test_checks():
    checks.positive("n", 1)
    checks.fraction("x", 0.0)
    checks.fraction("x", 1)
    for bad in (0, -1, None):
        with pytest.raises(ValueError):
            checks.positive("n", bad)
    for bad in (-0.1, 1.1, None):
        with pytest.raises(ValueError):
            checks.fraction("x", bad)
    with pytest.raises(ValueError):
        checks.one_of("x", "c", ("a", "b"))
