"""Queries against their SQL twins, over whole small tables and over awkward rows."""

import pytest

from eventrail.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import differences
from tests.llm.frames import awkward


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sample, name):
    assert differences(QUERIES[name](spark, sample), connect(sample), ORACLE_SQL[name]) is None


def test_awkward_rows(spark, folder_of):
    texts = [
        (0, "Zeta eta THETA iota kappa lambda mu nu xi omicron pi"),
        (1, "tau"),
        (2, None),
        (3, ""),
        (4, "sigma, 0 alpha"),
        (4, "gamma delta"),
    ]
    turns = [
        (1, 1, "assistant", "b <| \\ <|im_end|>"),
        (1, 0, "user", None),
        (2, 0, None, "lone"),
        (3, 0, "sys\ntem", "x"),
        (3, 0, "sys\ntem", "x"),
        (4, 0, "system", "s"),
        (4, 1, "user", "u"),
        (4, 2, "assistant", ""),
    ]
    # Vectors above and below the threshold, equal, scaled, opposite, and unusable ones.
    base = [1.0, 0.0, 0.0, 0.0]
    vectors = [
        (1, base),
        (2, base),
        (3, [2.0, 0.0, 0.0, 0.0]),
        (4, [0.95, 0.3, 0.0, 0.0]),
        (5, [0.0, 1.0, 0.0, 0.0]),
        (6, [-1.0, 0.0, 0.0, 0.0]),
        (7, None),
        (8, [0.0, 0.0, 0.0, 0.0]),
        (9, [1.0, None, 0.0, 0.0]),
        (10, [1.0, float("nan"), 0.0, 0.0]),
        (11, [1.0, float("inf"), 0.0, 0.0]),
        (12, []),
        (13, [1.0, 0.0]),
    ]
    once = awkward(spark).where("doc_id is null or doc_id <> 1").unionByName(awkward(spark).limit(1))
    folder = folder_of(
        # The twin of op5 carries the words of a text along with each of them, so none is very long
        # here; test_brute_force and test_operators have the long ones.
        documents=once.where("text is null or length(text) < 10000"),
        benchmark=spark.createDataFrame(texts, "item_id long, text string"),
        conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
    )
    sql = dict(ORACLE_SQL)
    # The two engines refuse vectors of different length in one comparison; the length is checked first.
    for name in sorted(sql):
        if name.startswith("op10"):
            got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES[name](spark, folder).collect()}
            assert got[1] == got[2] == got[3] == got[4] == (3, 1)
            assert all(got[n] == (0, n) for n in range(5, 14))
        elif name.startswith("op3"):
            # A null key joins nothing in SQL; its row is checked in test_secrets.
            found = QUERIES[name](spark, folder).where("doc_id is not null")
            assert differences(found, connect(folder), sql[name] + " WHERE doc_id IS NOT NULL") is None
        elif name.startswith("op5"):
            found = QUERIES[name](spark, folder).where("doc_id is not null")
            assert differences(found, connect(folder), sql[name] + " WHERE doc_id IS NOT NULL") is None
        else:
            assert differences(QUERIES[name](spark, folder), connect(folder), sql[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder_of, sample, name):
    """Empty tables give no rows, or only what the query adds."""
    from eventrail.llm.common import table

    tables = ("documents", "labels", "benchmark", "conversations", "embeddings")
    folder = folder_of(**{t: table(spark, sample, t).limit(0) for t in tables})
    assert QUERIES[name](spark, folder).count() == (1 if name.startswith("op1_") else 0)
