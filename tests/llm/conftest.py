import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster names in spark.checkpoint.dir."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of texts, with ids from 0 and columns whose names clash with those of the operators."""

    def build(texts, ids=None, extra="n"):
        rows = [(i if ids is None else ids[i], t, "en" if i % 3 else None, f"s{i % 2}", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words bigint")

    return build
