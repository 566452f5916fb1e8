"""CPU binding: process and thread tables against NUMA nodes, cgroups and each other, as rules that give findings.

processes: pid, allowed (array<int>), cgroup (array<int>), threads, npu_node, throttled, torch_threads, omp_threads, workers
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import scalars


def effective(cgroup: Column, allowed: Column) -> Column:
    """The cgroup's CPUs if it names any, else the process's own."""
    return F.when(F.size(F.coalesce(cgroup, F.array().cast("array<int>"))) > 0, cgroup).otherwise(allowed)


def nodes_of(cpus: Column, nodes: Column) -> Column:
    """Ids of the NUMA nodes (array of struct<id, cpus>) that a set of CPUs touches."""
    return F.transform(F.filter(nodes, lambda n: F.arrays_overlap(n["cpus"], cpus)), lambda n: n["id"])


def findings(processes: DataFrame, nodes: DataFrame, online: int) -> DataFrame:
    """Rule and evidence for each process. nodes (id, cpus) are few: one row for each NUMA node of a machine."""
    layout = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "cpus"))).alias("nodes"))
    wide = max(1, int(0.8 * online))
    x = processes.join(F.broadcast(layout)).withColumn("eff", effective(F.col("cgroup"), F.col("allowed"))).withColumn("touched", nodes_of(F.col("eff"), F.col("nodes")))
    count = F.size("allowed")
    demand = F.greatest(F.coalesce("torch_threads", F.lit(0)), F.coalesce("omp_threads", F.lit(0)), F.coalesce("workers", F.lit(0)) + 1, F.coalesce("threads", F.lit(0)))
    rules = {
        "R001": (F.size("nodes") > 1) & (count >= wide),
        "R003": F.col("npu_node").isNotNull() & ~F.array_contains("touched", F.col("npu_node")),
        "R004": count >= wide,
        "R005": count < F.greatest(F.lit(1), F.floor(F.col("threads") / 2)),
        "R006": demand > F.size("eff"),
        "R007": ((F.size("cgroup") > 0) & (F.size(F.array_except("allowed", "cgroup")) > 0)) | (F.coalesce("throttled", F.lit(0)) > 0),
        "R010": F.col("allowed").isNull() | F.col("threads").isNull(),
    }
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())))
    return x.select("pid", F.explode(hits).alias("rule"), F.array_join("touched", ",").alias("touched_nodes"))


def cross_numa(threads: DataFrame) -> DataFrame:
    """R002: processes whose threads (pid, tid, node) run on more than one NUMA node."""
    return threads.filter("node is not null").groupBy("pid").agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias("touched_nodes"), F.count_distinct("node").alias("n")).filter("n > 1").select("pid", F.lit("R002").alias("rule"), "touched_nodes")


def partial_siblings(processes: DataFrame, groups: DataFrame) -> DataFrame:
    """R009: processes that hold part of an SMT sibling group (siblings: array<int>)."""
    cpu = processes.select("pid", "allowed", F.explode("allowed").alias("cpu"))
    hit = cpu.join(groups.select("siblings", F.explode("siblings").alias("cpu")), "cpu")
    return hit.filter(~scalars.is_subset(F.col("siblings"), F.col("allowed"))).select("pid").distinct().withColumn("rule", F.lit("R009"))


#: Sets of one item that a task pairs with the others of the item.
TOGETHER = 1000
#: Rows that a task looks for shared items in.
ROWS = 1 << 18


def sharing(rows: DataFrame, key: str, item: str, scope: list[str]) -> DataFrame:
    """Pairs of keys of one scope that share an item, with how many: joined on the items, so keys without one in common never meet.

    Rows are dealt once, by item, into as many parts as their number asks for, and items of one key only are left out there, so what a task
    holds does not grow with the table. An item of many keys is cut into parts on one side and repeated for each part on the other, so its
    pairs are many tasks.
    """
    x = rows.select(*scope, key, F.col(item).alias("item")).filter(F.col("item").isNotNull() & F.col(key).isNotNull())
    dealt = x.repartition(max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-x.count() // ROWS)), *scope, "item")
    shared = dealt.groupBy(*scope, "item").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).filter("_a < _b").select(*scope, "item")
    x = dealt.join(shared, [*scope, "item"], "left_semi").distinct()
    parts = x.groupBy(*scope, "item").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).filter("parts > 1")
    x = x.join(parts, [*scope, "item"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = x.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")
    whole = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts").withColumnRenamed(key, "other")
    return cut.join(whole, [*scope, "item", "part"]).filter(F.col(key) < F.col("other")).groupBy(*scope, key, "other").agg(F.count("*").alias("shared"))


def overlaps(sets: DataFrame, key: str, items: str, scope: list[str]) -> DataFrame:
    """Pairs of sets (arrays) of one scope that share an item, with how many."""
    return sharing(sets.select(*scope, key, F.explode(items).alias("item")), key, "item", scope)


def plan(processes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Target CPUs of each process: its effective set within its NPU's node, or all of it; left out if that changes nothing."""
    local = nodes.select(F.col("id").alias("npu_node"), F.col("cpus").alias("node_cpus"))
    x = processes.join(F.broadcast(local), "npu_node", "left").withColumn("eff", F.array_sort(effective(F.col("cgroup"), F.col("allowed"))))
    inside = F.array_sort(F.array_intersect("eff", F.coalesce("node_cpus", F.array().cast("array<int>"))))
    target = F.when(F.size(inside) > 0, inside).otherwise(F.col("eff"))
    return x.withColumn("target", target).filter(F.col("target") != F.array_sort("allowed")).select("pid", scalars.cpu_text(F.col("target")).alias("target"))


def thread_usage(before: DataFrame, after: DataFrame, seconds: float, ticks: int = 100) -> DataFrame:
    """CPU share of each thread (pid, tid, cpu, used) between two samples; a thread that is gone is partial."""
    b = after.select("pid", "tid", F.col("used").alias("used_after"), F.col("cpu").alias("cpu_after"))
    x = before.join(b, ["pid", "tid"], "left")
    share = scalars.cpu_percent(F.col("used"), F.col("used_after"), F.lit(seconds), ticks)
    return x.select("pid", "tid", share.alias("cpu_pct"), (F.col("cpu") != F.col("cpu_after")).alias("migrated"), F.col("used_after").isNull().alias("partial"))


def process_tree(processes: DataFrame) -> DataFrame:
    """pid, its children and whether it is a root of the candidate processes (pid, ppid)."""
    children = processes.groupBy(F.col("ppid").alias("pid")).agg(F.sort_array(F.collect_list("pid")).alias("children"))
    known = processes.select(F.col("pid").alias("ppid"), F.lit(True).alias("_known"))
    return processes.join(children, "pid", "left").join(known, "ppid", "left").select("pid", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), F.col("_known").isNull().alias("is_root"))
