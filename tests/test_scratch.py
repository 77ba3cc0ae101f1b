import os

import pytest

from corpusloom.sources import scratch


def test_swept(spark):
    with scratch.swept(spark):
        a = scratch.written(spark.range(3), "a")
        path = a.inputFiles()[0].removeprefix("file://")
        assert a.count() == 3 and os.path.exists(path)
        with scratch.swept(spark):
            inner = scratch.fresh_path(spark, "b")
            spark.range(2).write.parquet(inner)
        assert not os.path.exists(inner.removeprefix("file://")) and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(Session())
