import pytest

from eventrail.llm.common import table


@pytest.fixture(scope="session")
def sample(spark, tmp_path_factory):
    """A folder with a part of the smallest tables, for brute-force comparisons."""
    folder = tmp_path_factory.mktemp("sample")
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        table(spark, source, name).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def folder_of(spark, tmp_path):
    """A function that writes frames as the tables of a folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
