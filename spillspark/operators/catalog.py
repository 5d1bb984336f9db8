"""Incident catalogue: which inputs are there, what is missing, what is still to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Input classes by file extension.
FORMATS = (((".zip",), "ZIP"), ((".tif", ".tiff"), "GeoTIFF"), ((".nc", ".nc4"), "NetCDF"), ((".csv",), "CSV"), ((".json",), "JSON"))


def format_class(path: Column) -> Column:
    out = None
    for endings, name in FORMATS:
        hit = F.lit(False)
        for ending in endings:
            hit = hit | F.lower(path).endswith(ending)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNKNOWN")


def files_present(incidents: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected files (map of kind to name) with ``present``; kind ``ais`` may also be ais.csv.

    ``listing``: incident_id, name.
    """
    wanted = incidents.select("incident_id", F.explode("expected_files").alias("kind", "name"))
    names = wanted.withColumn("option", F.explode(F.when(F.col("kind") == "ais", F.array_distinct(F.array("name", F.lit("ais.csv")))).otherwise(F.array("name"))))
    there = listing.select("incident_id", F.col("name").alias("option"), F.lit(True).alias("hit")).distinct()
    return names.join(there, ["incident_id", "option"], "left").groupBy("incident_id", "kind", "name").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("present"))


def readiness(files: DataFrame, models: DataFrame) -> DataFrame:
    """Per incident: ready if all files are present and a model is, else missing_inputs, with the list.

    ``models``: incident_id, model_present.
    """
    by = files.groupBy("incident_id").agg(F.bool_and("present").alias("complete"), F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("kind")))).alias("missing"))
    both = by.join(models, "incident_id", "left")
    ready = F.col("complete") & F.coalesce("model_present", F.lit(False))
    return both.select("incident_id", F.when(ready, "ready").otherwise("missing_inputs").alias("status"), "missing", F.size("missing").cast("bigint").alias("n_missing"))


def validate_inputs(uploads: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors and warnings per analysis: required or optional inputs that are absent or invalid.

    ``rules``: mode, category, severity. ``uploads``: analysis_id, mode, category, valid.
    """
    analyses = uploads.select("analysis_id", "mode").distinct()
    state = uploads.groupBy("analysis_id", "category").agg(F.max("valid").alias("valid"))
    lacking = analyses.join(rules, "mode").join(state, ["analysis_id", "category"], "left").where(~F.coalesce("valid", F.lit(False)))
    lists = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("category")))).alias(s + "s")
    found = lacking.groupBy("analysis_id").agg(lists("error"), lists("warning"))
    none = F.array().cast("array<string>")
    out = analyses.join(found, "analysis_id", "left")
    return out.select("analysis_id", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings")).withColumn("can_run", F.size("errors") == 0)


def pending(incidents: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Incidents without a stored result (all of them with ``force``)."""
    return incidents if force else incidents.join(done.select("incident_id").distinct(), "incident_id", "left_anti")
