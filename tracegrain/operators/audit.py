"""Audit logs and catalogues: delegations with their fields brought up to date, entries found by pattern, completions by rank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The event that delegates, its fields (in the log: under the second name), and the older names of its times.
DELEGATION = "subagent.delegation"
FIELDS = (("run_id", "run_id"), ("delegation_id", "delegation_id"), ("subagent_type", "subagent_type"), ("task_description", "task_description_raw"), ("status", "status"), ("duration_ms", "duration_ms"), ("result", "result_raw"), ("error", "error"))
OLDER = {"start_time": ("delegated_at", "started_at"), "end_time": ("completed_at", "ended_at")}


def current(text: Column, name: str) -> Column:
    """Value of a time field of a JSON object: under its own name, though it be null there, else under the first older name that is there."""
    # presence counts, not value: a key whose value is null is there
    keys = F.json_object_keys(text)
    value = lambda key: F.get_json_object(text, f"$.{key}")
    found = F.lit(None).cast("string")
    for key in reversed((name, *OLDER[name])):
        found = F.when(F.array_contains(keys, key), value(key)).otherwise(found)
    return found


def delegations(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Delegations of a log of JSON objects, with the columns `keep`; events without an id, and texts that are no object, are left out."""
    t = F.col(text)
    ident = F.get_json_object(t, "$.delegation_id")
    x = rows.filter((F.get_json_object(t, "$.event") == DELEGATION) & (ident != ""))
    return x.select(*keep, *(F.get_json_object(t, f"$.{source}").alias(name) for name, source in FIELDS), *(current(t, name).alias(name) for name in OLDER))


def catalogue(rows: DataFrame, name: str, description: str, pattern: str) -> DataFrame:
    """Entries whose name or description a regular expression fits anywhere; one that is none is an error at once."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no regular expression: {pattern}") from e
    return rows.filter(F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))).rlike(pattern))


def completions(rows: DataFrame, path: str, fragment: str, most: int) -> DataFrame:
    """The best `most` different paths for what was typed: path, category (0 to 4, 0 is best) and whether it is a folder.

    Base names that begin with the fragment come first, then those that hold it, paths that begin with it, paths that hold it, the others;
    of a category folders first, then by path, whatever the case. A top-k of Spark: no task sorts all rows.
    """
    typed = fragment.lower()
    small = F.lower(path)
    base = F.element_at(F.split(F.regexp_replace(small, "/+$", ""), "/"), -1)
    rank = F.when(base.startswith(typed), 0).when(base.contains(typed), 1).when(small.startswith(typed), 2).when(small.contains(typed), 3).otherwise(4) if typed else F.lit(0)
    x = rows.filter(F.col(path).isNotNull()).select(path).distinct().select(path, rank.alias("category"), F.col(path).endswith("/").alias("folder"))
    return x.orderBy("category", F.desc("folder"), F.lower(path), path).limit(most)


def tool_counts(events: DataFrame, tool: str) -> DataFrame:
    """Calls of each tool; a call without one counts as unknown."""
    named = F.coalesce(F.nullif(F.col(tool), F.lit("")), F.lit("unknown"))
    return events.groupBy(named.alias("tool")).agg(F.count("*").alias("calls"))
