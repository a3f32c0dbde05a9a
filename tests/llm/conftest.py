import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The folder that the operators write to, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture
def documents(shared):
    """Documents from (doc_id, text) pairs, with columns that operators might use themselves."""

    def make(rows):
        full = [(k, t, "x", "y", 1, None) for k, t in rows]
        return shared.createDataFrame(full, "doc_id long, text string, k string, h string, keep_id int, _row string").repartition(3)

    return make
