from pyspark.sql import functions as F

from eventrail.operators import lookups
from eventrail.operators.config import missing_default_bindings, project_scripts
from eventrail.operators.lookups import fits_broadcast, lookup_join, measured_bytes
from eventrail.operators.metrics import node_status


def test_both_ways_of_joining_agree(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    lookup = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("left", "inner"):
        small = lookup_join(facts, lookup, ["k"], how)
        salted = lookup_join(facts, lookup, ["k"], how, spread=[F.col("id")], limit=0)
        plain = lookup_join(facts, lookup, ["k"], how, limit=0)
        rows = sorted(small.select("k", "id", "v").collect())
        assert sorted(salted.select("k", "id", "v").collect()) == rows
        assert sorted(plain.select("k", "id", "v").collect()) == rows


def test_only_hot_keys_of_a_large_lookup_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_ROWS", 500)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50)
    facts = spark.range(3000).select(key.alias("k"), "id")
    table = spark.range(40).unionByName(spark.range(7, 9))
    table = table.select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    salted, repeated = lookups._spread_hot(facts, table, ["k"], [F.col("id")])
    assert repeated.count() == 42 + 2 * (lookups.SALTS - 1)
    # Records of the hot key and those without a key lie on all salts, the others on one.
    salts = {r["k"]: r["n"] for r in salted.groupBy("k").agg(F.countDistinct("__salt").alias("n")).collect()}
    assert {k for k, n in salts.items() if n == lookups.SALTS} == {7, None}
    assert {n for k, n in salts.items() if k not in (7, None)} == {1}
    for how in ("left", "inner"):
        found = lookup_join(facts, table, ["k"], how, spread=[F.col("id")], limit=0)
        wanted = facts.join(table, ["k"], how)
        assert found.columns == wanted.columns
        order = ["id", "v"]
        assert found.orderBy(*order).collect() == wanted.orderBy(*order).collect()


def test_size_is_checked(spark):
    table = spark.range(1000).withColumn("t", F.lit("x" * 100))
    assert 100_000 < measured_bytes(table) < 200_000
    assert fits_broadcast(table) and not fits_broadcast(table, 1000)


def test_project_scripts_and_default_bindings(spark):
    projects = spark.createDataFrame(
        [(1, True), (2, True), (3, False), (4, True)], "id int, enabled boolean"
    )
    scripts = spark.createDataFrame(
        [(10, "default", "active"), (11, "a", "active"), (12, "b", "draft")],
        "id int, script_key string, status string",
    )
    bindings = spark.createDataFrame(
        [(1, 1, 10, True), (2, 1, 11, True), (3, 1, 12, True), (4, 2, 11, False), (5, 3, 11, True)],
        "id int, project_id int, processor_script_id int, enabled boolean",
    )
    chosen = project_scripts(projects, scripts, bindings).collect()
    assert {r["project_id"]: r["script_key"] for r in chosen} == {1: "a", 2: "default", 4: "default"}
    added = missing_default_bindings(projects, scripts, bindings).collect()
    assert [(r["project_id"], r["processor_script_id"]) for r in added] == [(4, 10)]


def test_stale_nodes(spark):
    beats = spark.createDataFrame(
        [("a", "running", "1", 100), ("a", "running", "2", 1000), ("b", "running", "1", 990_000),
         ("c", "stopped", "1", 5)],
        "node_id string, status string, version string, last_seen_at bigint",
    )
    rows = {r["node_id"]: (r["status"], r["version"]) for r in node_status(beats, 995_000).collect()}
    assert rows == {"a": ("stale", "2"), "b": ("running", "1"), "c": ("stopped", "1")}
