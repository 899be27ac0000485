"""Where intermediate tables go."""

import pytest

from linkloom.scratch import work_dir, written


class _Session:
    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_named_folder_is_used():
    session = _Session(spark_checkpoint_dir="s3://shared/x/", spark_master="yarn")
    first, second = work_dir(session, "a"), work_dir(session, "a")
    assert first.startswith("s3://shared/x/a-") and first != second


def test_local_session_without_setting():
    first, second = (work_dir(_Session(spark_master="local[2]"), "a") for _ in range(2))
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_cluster_needs_the_setting():
    for master in ("yarn", "spark://h:7077"):
        with pytest.raises(ValueError):
            work_dir(_Session(spark_master=master), "a")


def test_written(spark):
    df = written(spark.range(5), "rows")
    assert sorted(r.id for r in df.collect()) == list(range(5))
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()
