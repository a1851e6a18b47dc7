"""Joins over the configuration tables: projects, processors, targets and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx, names
from eventrail.operators.lookups import lookup_join

DEFAULT_SCRIPT = "default"


def enabled(table: DataFrame) -> DataFrame:
    return table.filter(F.col("enabled"))


def admission_projects(projects: DataFrame) -> DataFrame:
    """Enabled projects with what admission needs to know of them."""
    entries = F.transform(F.from_json("allowed_ips", "array<string>"), jsonx.strip)
    allowed = F.filter(entries, lambda ip: ip != "")
    return enabled(projects).select(
        F.col("id").alias("project_id"),
        "project_key",
        "ingest_token",
        F.when(F.col("auth_mode") == "public", "public").otherwise("token").alias("auth_mode"),
        F.coalesce(allowed, F.array().cast("array<string>")).alias("allowed_ips"),
    )


def project_scripts(
    projects: DataFrame, scripts: DataFrame, bindings: DataFrame
) -> DataFrame:
    """Script of every enabled project: its enabled binding to an active script, or the default.

    Of several bindings of one project the latest decides.
    """
    active = scripts.filter(F.col("status") == "active").select(
        F.col("id").alias("processor_script_id"), "script_key"
    )
    bound = (
        enabled(bindings)
        .join(active, "processor_script_id")
        .groupBy("project_id")
        .agg(F.max_by("script_key", "id").alias("script_key"))
    )
    known = enabled(projects).select(F.col("id").alias("project_id"))
    return known.join(bound, "project_id", "left").select(
        "project_id", F.coalesce("script_key", F.lit(DEFAULT_SCRIPT)).alias("script_key")
    )


def missing_default_bindings(
    projects: DataFrame, scripts: DataFrame, bindings: DataFrame
) -> DataFrame:
    """Default bindings to add for projects that have no binding at all."""
    default = scripts.filter(F.col("script_key") == DEFAULT_SCRIPT).agg(F.min("id").alias("id"))
    unbound = projects.select(F.col("id").alias("project_id")).join(
        bindings.select("project_id"), "project_id", "left_anti"
    )
    return unbound.select(
        "project_id", default.scalar().alias("processor_script_id"), F.lit(True).alias("enabled")
    )


def runtime_sinks(sinks: DataFrame, targets: DataFrame) -> DataFrame:
    """Enabled sinks on enabled targets."""
    live = enabled(targets).select(
        F.col("id").alias("delivery_target_id"), "target_id", "target_type", "config_json"
    )
    return (
        enabled(sinks)
        .join(live, "delivery_target_id")
        .select(
            "sink_id", "destination_json", "auto_offset_reset",
            "target_id", "target_type", "config_json",
        )
    )


def dangling_sinks(sinks: DataFrame, targets: DataFrame) -> DataFrame:
    """Enabled sinks whose target is not: processors may name them, replay cannot deliver."""
    live = enabled(targets).select(F.col("id").alias("delivery_target_id"))
    return (
        enabled(sinks)
        .join(live, "delivery_target_id", "left_anti")
        .select("sink_id", "delivery_target_id")
    )


def match_targets(deliveries: DataFrame, runtime: DataFrame) -> DataFrame:
    """Deliveries with the ``code`` of an undeliverable target, for sink tables of any size."""
    known = runtime.select("sink_id", F.lit(True).alias("__known")).distinct()
    matched = lookup_join(
        deliveries, known, ["sink_id"], "left", spread=[F.col("node_id"), F.col("lsn")]
    )
    code = F.when(jsonx.strip(F.col("sink_id")) == "", "replay_empty_sink_target").when(
        F.col("__known").isNull(), "replay_unknown_sink_target"
    )
    return matched.withColumn("code", code).drop("__known")


def sink_constants(sinks: DataFrame) -> DataFrame:
    """Constant per enabled sink, and whether it is empty or shared with another sink."""
    named = enabled(sinks).select("sink_id", names.sink_constant(F.col("sink_id")).alias("constant"))
    shared = named.groupBy("constant").agg(F.count(F.lit(1)).alias("sinks"))
    return named.join(shared, "constant").select(
        "sink_id",
        "constant",
        (F.col("constant") == "SINK").alias("is_empty"),
        (F.col("sinks") > 1).alias("collides"),
    )
