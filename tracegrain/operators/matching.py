"""Tables matched with tables: filters by rule, merges, sets of keys, mappings, edges, rules over keys and values, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.scalars import glob_pattern

# ---- filters ----


def unless(rows: DataFrame, keep_all: bool, column: str, value: object) -> DataFrame:
    """All rows, or those whose column is not the value; the comparison drops nulls too."""
    return rows if keep_all else rows.filter(F.col(column) != value)


def in_steps(rows: DataFrame, step: str, steps: list[str]) -> DataFrame:
    """Rows whose step is among those given as text; all where none is given."""
    return rows.filter(F.col(step).cast("string").isin(steps)) if steps else rows


def without_rules(rows: DataFrame, rules: DataFrame, name: str, direction: str, index: str) -> DataFrame:
    """Rows that no rule (prefix, direction, index) excludes: name begins with the prefix, direction and index are the rule's.

    Joined on direction and index, so a row meets only the rules of its own place.
    """
    own = rules.select("prefix", F.col("direction").alias(direction), F.col("index").alias(index)).alias("rule")
    on = (rows[direction] == F.col(f"rule.{direction}")) & (rows[index] == F.col(f"rule.{index}")) & rows[name].startswith(F.col("rule.prefix"))
    return rows.join(own, on, "left_anti")


def is_collective(name: Column, words: list[str], prefix: str = "Distributed.") -> Column:
    """Whether a name begins with the prefix and contains one of the words."""
    return name.startswith(prefix) & F.array_contains(F.transform(F.array(*(F.lit(w) for w in words)), lambda w: name.contains(w)), True)


def found_by(rows: DataFrame, column: str, text: str, how: str = "exact") -> DataFrame:
    """Rows whose column fits the text: exact, contains, starts_with, ends_with or glob."""
    c = F.col(column)
    if how == "glob":
        return rows.filter(c.rlike(glob_pattern(text)))
    fits = {"exact": c == text, "contains": c.contains(text), "starts_with": c.startswith(text), "ends_with": c.endswith(text)}
    return rows.filter(fits[how])


def slices(rows: DataFrame, name: str, text: str, how: str, start: str, end: str, first: int | None = None, last: int | None = None, more: Column | None = None) -> DataFrame:
    """Slices found by name that overlap the time range [first, last], and whatever else `more` asks of them."""
    out = found_by(rows, name, text, how)
    for asked in ([] if first is None else [F.col(end) >= first]) + ([] if last is None else [F.col(start) <= last]) + ([] if more is None else [more]):
        out = out.filter(asked)
    return out


# ---- joins and merges ----


def filled(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full merge on a key that only fills: left values stay unless null or empty; keys of the right side are added."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    b = right.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return left.join(b, key, "full").select(key, *(F.coalesce(empty(c), F.col(f"_{c}"), F.col(c)).alias(c) for c in columns))


def mapped(train: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Each key with what it maps to and the kind of its mapping: 1:0, 1:1 or 1:N. mapping: key, peers (an array of keys).

    Lists of several mappings of one key are joined into one flat list.
    """
    peers = mapping.select(key, F.explode("peers").alias("peer")).distinct()
    n = peers.groupBy(key).agg(F.count("*").alias("_n"))
    out = train.select(key).join(n, key, "left").join(peers, key, "left")
    return out.select(key, "peer", F.when(F.col("_n").isNull(), "1:0").when(F.col("_n") == 1, "1:1").otherwise("1:N").alias("mapping"))


def undirected(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """One row for each pair of ends, whichever way it points: the first by order, with its ends sorted."""
    x = edges.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))
    first = x.groupBy("low", "high").agg(F.min(order).alias(order))
    return x.join(first, ["low", "high", order], "left_semi")


def nodes_of_cpus(nodes: DataFrame, node: str, cpus: str, position: str) -> DataFrame:
    """cpu and node from each node's list of CPUs; of nodes that claim one CPU the later counts, null lists are skipped."""
    x = nodes.select(node, position, F.explode(cpus).alias("cpu"))
    return x.groupBy("cpu").agg(F.max_by(node, position).alias(node))


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Metrics that stand in both tables: before, after, difference and gain in percent (cut to two digits before times 100)."""
    b = after.select(key, F.col(value).alias("after"))
    x = before.select(key, F.col(value).alias("before")).join(b, key).withColumn("diff", F.col("before") - F.col("after"))
    cut = F.col("diff") / F.nullif("before", F.lit(0.0)) * 100
    return x.withColumn("gain_pct", F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)).cast("bigint"))


# ---- sets ----


def names_compared(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Every name of two lists, once: both, only_left or only_right."""
    a, b = (df.select(name).distinct().withColumn(f, F.lit(True)) for df, f in ((left, "_a"), (right, "_b")))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_left").otherwise("only_right")
    return a.join(b, name, "full").select(name, side.alias("side"))


def key_sets(left: Column, right: Column) -> Column:
    """Sorted keys that both maps have, that the left one lacks and that the right one lacks."""
    a, b = F.map_keys(left), F.map_keys(right)
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("shared"), F.array_sort(F.array_except(b, a)).alias("missing_left"), F.array_sort(F.array_except(a, b)).alias("missing_right"))


def merged(left: Column, right: Column) -> Column:
    """Union of two maps; where both have a key, the right value counts."""
    own = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(own, F.coalesce(right, F.create_map().cast("map<string,string>")))


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of both tables, of one only, and whether the sets of keys are equal."""
    n = names_compared(left, right, key).agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("both", "only_left", "only_right")))
    return n.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


# ---- rules and counters ----


def keyword_rules(entries: DataFrame, rules: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    """Rules (keyword, expected) over keys and values: keys that hold the keyword are checked; passes if there is one and none differs.

    Rules without a keyword or an expected value are skipped. An entry gives a row for each rule that checks it, so
    entries are read once and counted before the shuffle.
    """
    valid = sorted({r for r in rules if r[0] and r[1] is not None})
    own = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(v).alias("expected")) for k, v in valid))
    hits = entries.select(F.col(value).alias("_value"), F.explode(F.filter(own, lambda r: F.col(key).contains(r["keyword"]))).alias("r")).select("r.*", "_value")
    counts = hits.groupBy("keyword", "expected").agg(F.count("*").alias("checked"), F.count_if(~F.col("_value").eqNullSafe(F.col("expected"))).alias("failed"))
    listed = entries.sparkSession.createDataFrame(valid, "keyword string, expected string")
    return listed.join(counts, ["keyword", "expected"], "left").na.fill(0, ["checked", "failed"]).withColumn("passed", (F.col("checked") > 0) & (F.col("failed") == 0))


def physical_cores(cpus: DataFrame, socket: str, core: str, cpu: str, node: str) -> DataFrame:
    """Logical CPUs of each physical core, in order, with the first known node; rows without socket or core are left out."""
    x = cpus.filter(F.col(socket).isNotNull() & F.col(core).isNotNull() & F.col(cpu).isNotNull()).groupBy(socket, core)
    return x.agg(F.array_join(F.sort_array(F.collect_list(cpu)), ",").alias("cpus"), F.min_by(node, F.when(F.col(node).isNotNull(), F.col(cpu))).alias(node))


def severity_report(findings: DataFrame, keys: list[str], severity: str, text: str, order: str, n: int = 3) -> DataFrame:
    """Findings of each severity and, as one text, the first n different ones by order."""
    counts = findings.groupBy(*keys, severity).agg(F.count("*").alias("n"))
    firsts = findings.groupBy(*keys, severity, text).agg(F.min(order).alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys, severity).orderBy("_at", text))
    top = firsts.withColumn("_r", place).filter(F.col("_r") <= n).groupBy(*keys, severity).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text))), lambda x: x[text]), "; ").alias("examples"))
    return counts.join(top, [*keys, severity])


def token_totals(messages: DataFrame, ident: str, fallback: list[str], keys: list[str], counts: list[str]) -> DataFrame:
    """Sums of token counts by keys; a message counts once: by its id, or by the fallback columns where it has none. A count that is null throughout stays null."""
    mark = F.coalesce(F.concat(F.lit("id:"), F.col(ident).cast("string")), F.concat(F.lit("key:"), F.to_json(F.struct(*fallback))))
    once = messages.withColumn("_mark", mark).groupBy(*keys, "_mark").agg(*(F.max(c).alias(c) for c in counts))
    return once.groupBy(*keys).agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in counts))


# ---- places ----


def strictly_between(rows: DataFrame, bounds: DataFrame, keys: list[str], position: str, low: str, high: str) -> DataFrame:
    """Rows that stand strictly between two positions of their group; groups that lack a bound have none."""
    return rows.join(bounds.select(*keys, low, high), keys).filter((F.col(position) > F.col(low)) & (F.col(position) < F.col(high))).drop(low, high)


def first_hit_step(rows: DataFrame, keys: list[str], step: str, hit: Column) -> DataFrame:
    """All hits of the first step that has one; later steps are skipped."""
    hits = rows.filter(hit)
    return hits.join(hits.groupBy(*keys).agg(F.min(step).alias(step)), [*keys, step], "left_semi")


def top_of_groups(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def chunks_merged(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Streamed pieces of each message put together in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(text, F.lit("")).alias("text"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("pieces"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def first_over(rows: DataFrame, keys: list[str], order: str, value: str, limit: float) -> DataFrame:
    """Where each group's value first reaches the limit: the point of compaction."""
    return rows.filter(F.col(value) >= limit).groupBy(*keys).agg(F.min(order).alias("at"))
