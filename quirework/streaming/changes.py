"""File events to bursts, and requests to runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The files whose change means that dependencies may have changed.
MANIFESTS = {
    "go": ("go.mod", "go.sum"),
    "python": ("pyproject.toml", "requirements.txt", "uv.lock", "poetry.lock", "Pipfile.lock"),
    "node": ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock"),
}
OPERATIONS = ("create", "write", "remove", "rename")


def manifest_events(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (project, path, op) on a manifest that is a direct child of the project's root (project, root)."""
    names = [n for group in MANIFESTS.values() for n in group]
    kept = events.filter(F.col("op").isin(*OPERATIONS)).join(roots, "project")
    parent, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    return kept.filter((parent == F.regexp_replace("root", "/$", "")) & name.isin(*names)).drop("root")


def debounced(events: DataFrame, by: str, at: str, path: str, gap: str = "2 seconds", lateness: str | None = None) -> DataFrame:
    """One row per burst: events of a key with gaps of at most ``gap``, and their distinct paths, sorted.

    For batches and streams alike; a stream needs ``lateness`` for its watermark.
    """
    if events.isStreaming:
        events = events.withWatermark(at, lateness or gap)
    burst = F.session_window(F.col(at), gap)
    out = events.groupBy(by, burst.alias("burst")).agg(F.count("*").alias("events"), F.array_sort(F.collect_set(path)).alias("paths"))
    return out.select(by, F.col("burst.start").alias("started"), "events", "paths")


def merge_requests(requests: DataFrame) -> DataFrame:
    """Pending requests of a project as runs, by rebuild flag: offline only if all are, forced or resolving if one is.

    ``names`` unite; a request without names wants all, and so does its run.
    """
    names = F.when(F.min(F.size("names")) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))))
    return requests.groupBy("project", "rebuild").agg(
        F.min("offline").alias("offline"), F.max("force").alias("force"), F.max("resolve").alias("resolve"), names.alias("names"), F.count("*").alias("requests")
    )


def coalesced(requests: DataFrame, at: str, wait: str = "1 second", lateness: str | None = None) -> DataFrame:
    """Runs of a queue: requests of a project and rebuild flag gather until none came for ``wait``, then merge as in :func:`merge_requests`.

    For batches and streams alike. A stream keeps the open runs as its state and sends one
    on when the watermark (``lateness`` behind the newest request) has passed its end, so
    late requests within it and a restart from a checkpoint give the batch's runs.
    """
    if requests.isStreaming:
        requests = requests.withWatermark(at, lateness or wait)
    names = F.when(F.min(F.size("names")) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))))
    merged = requests.groupBy("project", "rebuild", F.session_window(F.col(at), wait).alias("run")).agg(
        F.min("offline").alias("offline"), F.max("force").alias("force"), F.max("resolve").alias("resolve"), names.alias("names"), F.count("*").alias("requests")
    )
    return merged.select("project", "rebuild", F.col("run.start").alias("started"), "offline", "force", "resolve", "names", "requests")
