"""Queries on compared values, bindings, audit logs, catalogues and names. Line items stand in for tensors and threads, suppliers for processes, orders for modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions import scalars as s
from tracegrain.operators import affinity, audit, matching, runlog, sequences, values
from tracegrain.plans.catalogue import query, table

# ---- values of two runs ----

TENSORS = """base AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_extendedprice) AS price, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
pr AS (SELECT o_orderkey AS o, o_custkey % 10 AS run, 'Module.layers.' || o_orderkey || CASE WHEN o_orderkey % 6 = 0 THEN '.linear_q_down_proj' ELSE '.fc' END AS train_key, 'model.' || o_orderkey || CASE WHEN o_orderkey % 6 = 0 THEN '.fused_qkv_a_proj' ELSE '.fc' END AS rollout_key FROM orders),
nm AS (SELECT pr.*, p, s, price, q, d, t, flag, CASE l_linenumber WHEN 1 THEN 'output.0' WHEN 2 THEN 'parameters.weight' WHEN 3 THEN 'input_args.0' ELSE 'input_kwargs' END AS target, CASE WHEN l_linenumber > 3 THEN 'k' || l_linenumber ELSE '' END AS name FROM pr JOIN base ON l_orderkey = o),
tr AS (SELECT *, [CAST(q AS BIGINT), p % 3 + 1] AS shape, CASE WHEN p % 5 = 0 THEN 'bf16' ELSE 'fp32' END AS dtype FROM nm WHERE p % 17 <> 0),
ro AS (SELECT *, CASE s % 4 WHEN 0 THEN [CAST(q AS BIGINT), p % 3 + 1] WHEN 1 THEN [CAST(q AS BIGINT), 1, p % 3 + 1] WHEN 2 THEN [p % 3 + 1, CAST(q AS BIGINT)] ELSE [CAST(q AS BIGINT) + 1, p % 3 + 1] END AS shape, 'fp32' AS dtype,
price * CASE flag WHEN 'R' THEN 1.001 WHEN 'A' THEN 1.1 ELSE 1.0 END AS r_max, CASE WHEN p % 7 = 0 THEN NULL ELSE q END AS r_min, CASE WHEN p % 11 = 0 THEN d + 0.02 ELSE d END AS r_mean FROM nm WHERE p % 13 <> 0),
er AS (SELECT coalesce(tr.run, ro.run) AS run, coalesce(tr.train_key, ro.train_key) AS train_key, coalesce(tr.rollout_key, ro.rollout_key) AS rollout_key, coalesce(tr.target, ro.target) AS target, coalesce(tr.name, ro.name) AS name, tr.o IS NOT NULL AS a, ro.o IS NOT NULL AS b,
tr.dtype = ro.dtype AS same, tr.shape AS x, ro.shape AS y, greatest(abs(tr.price - r_max) / greatest(abs(r_max), 1e-12), coalesce(abs(tr.q - r_min) / greatest(abs(r_min), 1e-12), 0), abs(tr.d - r_mean) / greatest(abs(r_mean), 1e-12)) AS e FROM tr FULL JOIN ro ON tr.o = ro.o AND tr.target = ro.target AND tr.name = ro.name),
cm AS (SELECT *, CASE WHEN NOT (a AND b) THEN 'missing' WHEN e > 1e-2 THEN 'alert' WHEN e > 1e-4 THEN 'warn' ELSE 'ok' END AS worst_metric, CASE WHEN NOT (a AND b) THEN 'missing' WHEN e > 1e-4 THEN 'mismatch' ELSE 'match' END AS consistency,
CASE WHEN NOT (a AND b) THEN 'unknown' WHEN x = y THEN 'exact_match' WHEN list_filter(x, lambda i: i <> 1) = list_filter(y, lambda i: i <> 1) THEN 'singleton_compatible_numel_match' WHEN list_product(x) = list_product(y) THEN 'numel_match' ELSE 'numel_mismatch' END AS relation FROM er),
hm AS (SELECT *, target = 'parameters.weight' AND consistency = 'mismatch' AND bool_or(target = 'output.0' AND consistency = 'match') OVER (PARTITION BY run, train_key, rollout_key) AS harmless FROM cm),
va AS (SELECT run, train_key, rollout_key, target, name, consistency, relation, coalesce(same, false) AS same_dtype, worst_metric,
CASE WHEN harmless THEN 5 WHEN consistency = 'missing' THEN NULL WHEN consistency = 'mismatch' AND relation <> 'numel_mismatch' THEN 1 WHEN consistency = 'mismatch' THEN 2 WHEN relation = 'exact_match' THEN 4 ELSE 3 END AS rank,
CASE WHEN harmless THEN 'parameter_mismatch_output_aligned' WHEN consistency = 'missing' THEN 'missing_compare_target' WHEN consistency = 'mismatch' THEN CASE relation WHEN 'exact_match' THEN 'value_mismatch_shape_match' WHEN 'numel_mismatch' THEN 'value_mismatch_shape_mismatch' ELSE 'value_mismatch_numel_match' END
WHEN relation = 'exact_match' THEN 'value_match_shape_match' ELSE 'value_match_shape_mismatch' END AS bucket,
CASE WHEN harmless THEN 'info' WHEN NOT a THEN 'missing_on_train' WHEN NOT b THEN 'missing_on_rollout' WHEN consistency = 'mismatch' AND relation <> 'numel_mismatch' THEN 'alert' WHEN consistency = 'match' AND relation = 'exact_match' THEN 'ok' ELSE 'warn' END AS status FROM hm)"""

STATUSES = f"""{TENSORS}, st AS (SELECT run, train_key, rollout_key, CASE WHEN consistency = 'match' THEN 'aligned' ELSE consistency END AS state, target FROM va),
ag AS (SELECT pr.run, pr.train_key, pr.rollout_key, coalesce(max(state) FILTER (target = 'output.0'), 'missing') AS output, coalesce(max(state) FILTER (target = 'parameters.weight'), 'missing') AS parameter, coalesce(max(state) FILTER (target = 'input_args.0'), 'missing') AS arguments,
CASE WHEN count(*) FILTER (target = 'input_kwargs') = 0 THEN 'not_applicable' WHEN count(*) FILTER (target = 'input_kwargs' AND state <> 'missing') = 0 THEN 'missing' WHEN count(*) FILTER (target = 'input_kwargs' AND state = 'mismatch') > 0 THEN 'mismatch'
WHEN count(*) FILTER (target = 'input_kwargs' AND state = 'missing') > 0 THEN 'partial' ELSE 'aligned' END AS named FROM pr LEFT JOIN st USING (run, train_key, rollout_key) GROUP BY ALL),
ip AS (SELECT *, CASE WHEN arguments = 'mismatch' OR named = 'mismatch' THEN 'mismatch' WHEN arguments = 'aligned' OR named IN ('aligned', 'partial') THEN 'aligned' ELSE 'missing' END AS i, train_key LIKE '%linear_q_down_proj' AS fused FROM ag),
mo AS (SELECT run, train_key, rollout_key, output, parameter, arguments, named, CASE WHEN output = 'mismatch' AND i = 'aligned' AND fused THEN 'fused_qkv_structural_mismatch' WHEN output = 'aligned' AND parameter = 'aligned' AND i = 'aligned' THEN 'normal_aligned'
WHEN output = 'aligned' AND (parameter = 'missing' OR named IN ('missing', 'partial')) THEN 'comparison_premise_abnormal_but_output_aligned' WHEN output = 'aligned' THEN 'internal_difference_but_output_aligned' WHEN output = 'missing' THEN 'insufficient_output_evidence'
WHEN i = 'aligned' AND parameter = 'aligned' THEN 'module_impl_mismatch' WHEN i = 'aligned' THEN 'parameter_sync_mismatch' WHEN parameter = 'aligned' THEN 'upstream_propagation_or_amplification' ELSE 'systemic_misalignment' END AS bucket FROM ip),
md AS (SELECT *, CASE WHEN bucket = 'normal_aligned' THEN 4 WHEN bucket LIKE '%aligned' OR bucket LIKE 'fused%' THEN 5 WHEN output = 'missing' THEN 3 WHEN bucket IN ('module_impl_mismatch', 'parameter_sync_mismatch') THEN 1 ELSE 2 END AS module_rank FROM mo)"""


def sides(spark, d):
    """Pairs of modules, the tensors of both runs, made from one reading of the lines, and into how many parts they are dealt."""
    o = F.col("o_orderkey")
    fused = o % 6 == 0
    train_key = F.concat(F.lit("Module.layers."), o.cast("string"), F.when(fused, ".linear_q_down_proj").otherwise(".fc"))
    rollout_key = F.concat(F.lit("model."), o.cast("string"), F.when(fused, ".fused_qkv_a_proj").otherwise(".fc"))
    pairs = table(spark, d, "orders").select(o, (F.col("o_custkey") % 10).alias("run"), train_key.alias("train_key"), rollout_key.alias("rollout_key"))
    k = F.col("l_linenumber")
    target = F.when(k == 1, values.OUTPUT).when(k == 2, values.PARAMETER).when(k == 3, values.ARGUMENT).otherwise(values.NAMED)
    own = {"l_partkey": "p", "l_suppkey": "s", "l_extendedprice": "price", "l_quantity": "q", "l_discount": "d", "l_tax": "t", "l_returnflag": "flag"}
    read = table(spark, d, "lineitem")
    n = values.parts(spark, read.count())
    # dealt by order, lines are grouped and meet their order where they are
    lines = read.repartition(*([n] if n else []), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), k).agg(*(F.max(c).alias(name) for c, name in own.items()))
    x = lines.join(values.dealt(pairs, n, "o_orderkey"), "o_orderkey")
    p, q, flag, rows = F.col("p"), F.col("q").cast("bigint"), F.col("flag"), F.col("p") % 3 + 1
    shape = F.when(F.col("s") % 4 == 0, F.array(q, rows)).when(F.col("s") % 4 == 1, F.array(q, F.lit(1).cast("bigint"), rows)).when(F.col("s") % 4 == 2, F.array(rows, q)).otherwise(F.array(q + 1, rows))
    factor = F.when(flag == "R", 1.001).when(flag == "A", 1.1).otherwise(1.0)
    tensor = lambda **columns: F.struct(*(c.alias(name) for name, c in columns.items()))
    train = tensor(trained=F.lit(True), key=F.col("train_key"), dtype=F.when(p % 5 == 0, "bf16").otherwise("fp32"), shape=F.array(q, rows), Max=F.col("price"), Min=F.col("q"), Mean=F.col("d"), Norm=F.col("t"))
    rollout = tensor(
        trained=F.lit(False), key=F.col("rollout_key"), dtype=F.lit("fp32"), shape=shape, Max=F.col("price") * factor,
        Min=F.when(p % 7 != 0, F.col("q")), Mean=F.when(p % 11 == 0, F.col("d") + 0.02).otherwise(F.col("d")), Norm=F.col("t"),
    )
    both = F.array_compact(F.array(F.when(p % 17 != 0, train), F.when(p % 13 != 0, rollout)))
    tensors = x.select("run", target.alias("target"), F.when(k > 3, F.concat(F.lit("k"), k.cast("string"))).otherwise("").alias("name"), F.inline(both))
    return pairs.drop("o_orderkey"), tensors, n


@query(f"WITH {TENSORS} SELECT * FROM va")
def value_compare(spark, d):
    return values.met(*sides(spark, d))


@query(f"WITH {STATUSES} SELECT * FROM md")
def module_values(spark, d):
    pairs, tensors, n = sides(spark, d)
    return values.module_statuses(pairs, values.met(pairs, tensors, n), n)


@query(f"WITH {STATUSES} SELECT 'value' AS kind, bucket, count(*) AS n FROM va GROUP BY ALL UNION ALL SELECT 'module', bucket, count(*) FROM md GROUP BY ALL")
def value_buckets(spark, d):
    pairs, tensors, n = sides(spark, d)
    return values.bucket_counts(pairs, values.met(pairs, tensors, n), n)


# ---- bindings ----

#: Suppliers as processes of a machine with 4 nodes of 16 CPUs: a range of CPUs, some within a cgroup, some throttled, some unknown.
BOUND = """pc AS (SELECT s_suppkey AS pid, s_suppkey % 8 AS lo, s_suppkey % 8 + s_nationkey * 2 + s_nationkey % 2 + s_suppkey % 3 * 4 AS hi, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 8 + 4 END AS glo, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 8 + 23 END AS ghi,
CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 60 END AS threads, s_nationkey % 4 AS node, CASE WHEN s_suppkey % 14 = 0 THEN 3 ELSE 0 END AS throttled FROM supplier),
ef AS (SELECT *, hi - lo + 1 AS n, coalesce(glo, lo) AS elo, coalesce(ghi, hi) AS ehi FROM pc)"""


def processes(spark, d):
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    low = (k % 8).cast("int")
    spread = F.sequence(low, (low + nation * 2 + nation % 2 + k % 3 * 4).cast("int"))
    grouped = F.when(k % 5 == 0, F.sequence(low + 4, low + 23)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "supplier").select(
        k.alias("pid"), spread.alias("allowed"), grouped.alias("cgroup"), F.when(k % 9 != 0, k % 60).cast("int").alias("threads"), (nation % 4).cast("int").alias("npu_node"),
        F.when(k % 14 == 0, 3).otherwise(0).alias("throttled"), *(F.lit(None).cast("int").alias(c) for c in ("torch_threads", "omp_threads", "workers")),
    )


def machine(spark):
    return spark.range(4).select(F.col("id").cast("int").alias("id"), F.sequence((F.col("id") * 16).cast("int"), (F.col("id") * 16 + 15).cast("int")).alias("cpus"))


TOUCHED = "array_to_string(list_filter([0, 1, 2, 3], lambda i: elo <= i * 16 + 15 AND ehi >= i * 16), ',')"


@query(f"""WITH {BOUND} SELECT pid, rule, {TOUCHED} AS touched_nodes FROM (SELECT *, unnest(list_filter([CASE WHEN n >= 51 THEN 'R001' END, CASE WHEN elo > node * 16 + 15 OR ehi < node * 16 THEN 'R003' END, CASE WHEN n >= 51 THEN 'R004' END,
CASE WHEN n < greatest(1, threads // 2) THEN 'R005' END, CASE WHEN coalesce(threads, 1) > ehi - elo + 1 THEN 'R006' END, CASE WHEN (glo IS NOT NULL AND (lo < glo OR hi > ghi)) OR throttled > 0 THEN 'R007' END, CASE WHEN threads IS NULL THEN 'R010' END], lambda r: r IS NOT NULL)) AS rule FROM ef)""")
def binding_findings(spark, d):
    """Every rule but R002, R008 and R009, which have queries of their own."""
    return affinity.findings(processes(spark, d), machine(spark), 64)


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS pid, l_partkey % 64 // 16 AS node FROM lineitem WHERE l_partkey % 10 <> 0 AND l_partkey % 64 // 16 <= l_suppkey % 4)
SELECT pid, 'R002' AS rule, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS touched_nodes FROM x GROUP BY 1 HAVING count(*) > 1""")
def cross_node_threads(spark, d):
    node = F.floor(F.col("l_partkey") % 64 / 16).cast("int")
    x = table(spark, d, "lineitem").filter(node <= F.col("l_suppkey") % 4)
    return affinity.cross_numa(x.select(F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("tid"), F.when(F.col("l_partkey") % 10 != 0, node).alias("node")))


@query(f"WITH {BOUND} SELECT pid, 'R009' AS rule FROM pc WHERE lo % 2 = 1 OR hi % 2 = 0")
def partial_sibling_groups(spark, d):
    """Siblings are neighbours, so a range that begins on an odd CPU or ends on an even one cuts a group."""
    groups = spark.range(40).select(F.array((F.col("id") * 2).cast("int"), (F.col("id") * 2 + 1).cast("int")).alias("siblings"))
    return affinity.partial_siblings(processes(spark, d), groups)


RANGE = "CASE WHEN {0} = {1} THEN CAST({0} AS VARCHAR) ELSE {0} || '-' || {1} END"


@query(f"""WITH {BOUND}, tg AS (SELECT *, greatest(elo, node * 16) AS a, least(ehi, node * 16 + 15) AS b FROM ef), ch AS (SELECT pid, lo, hi, CASE WHEN a <= b THEN a ELSE elo END AS x, CASE WHEN a <= b THEN b ELSE ehi END AS y FROM tg)
SELECT pid, {RANGE.format('x', 'y')} AS target FROM ch WHERE x <> lo OR y <> hi""")
def binding_plan(spark, d):
    return affinity.plan(processes(spark, d), machine(spark))


@query("""WITH b AS (SELECT l_suppkey AS pid, l_orderkey * 10 + l_linenumber AS tid, max(l_partkey % 64) AS cpu, max(CAST(l_quantity AS BIGINT)) AS used FROM lineitem GROUP BY ALL),
a AS (SELECT l_suppkey AS pid, l_orderkey * 10 + l_linenumber AS tid, max((l_partkey + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 64) AS cpu, max(CAST(l_quantity AS BIGINT) + l_partkey % 40 - 5) AS used FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY ALL)
SELECT pid, tid, CASE WHEN a.pid IS NULL THEN 0.0 ELSE greatest(0.0, (a.used - b.used) * 100.0 / 100 / 0.5) END AS cpu_pct, b.cpu <> a.cpu AS migrated, a.pid IS NULL AS partial FROM b LEFT JOIN a USING (pid, tid)""")
def thread_shares(spark, d):
    own = [F.col("l_suppkey").alias("pid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid")]
    p, used, lines = F.col("l_partkey"), F.col("l_quantity").cast("bigint"), table(spark, d, "lineitem")
    before = lines.groupBy(*own).agg(F.max(p % 64).alias("cpu"), F.max(used).alias("used"))
    moved = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    after = lines.filter("l_orderkey % 7 <> 0").groupBy(*own).agg(F.max((p + moved) % 64).alias("cpu"), F.max(used + p % 40 - 5).alias("used"))
    return affinity.thread_usage(before, after, 0.5)


@query("""WITH p AS (SELECT c_custkey AS pid, c_custkey // 3 - CASE WHEN c_custkey % 10 = 1 THEN 1000000 ELSE 0 END AS ppid FROM customer WHERE c_custkey > 0), ch AS (SELECT ppid AS pid, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS children FROM p GROUP BY 1)
SELECT pid, coalesce(children, '') AS children, ppid NOT IN (SELECT pid FROM p) AS is_root FROM p LEFT JOIN ch USING (pid)""")
def process_trees(spark, d):
    k = F.col("c_custkey")
    x = table(spark, d, "customer").filter(k > 0).select(k.alias("pid"), (F.floor(k / 3) - F.when(k % 10 == 1, 1_000_000).otherwise(0)).alias("ppid"))
    return affinity.process_tree(x).withColumn("children", F.array_join("children", ","))


# ---- checksums and ways ----

CHECKSUMS = """js AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
le AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([{'k': 'a', 'v': CAST(p % 9 AS VARCHAR)}, {'k': 'b', 'v': CASE WHEN p % 2 = 0 THEN CAST(s AS VARCHAR) END}], lambda e: e.v IS NOT NULL)) AS e FROM js WHERE p % 6 <> 0),
ri AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([{'k': 'a', 'v': CAST(s % 3 AS VARCHAR)}, {'k': 'b', 'v': CASE WHEN s % 2 = 0 THEN CAST(s AS VARCHAR) END}], lambda e: e.v IS NOT NULL)) AS e FROM js)"""


@query(f"""WITH {CHECKSUMS} SELECT * FROM (SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.l_linenumber, y.l_linenumber) AS l_linenumber, coalesce(x.e.k, y.e.k) AS key, coalesce(x.e.v, '<MISSING>') AS left_value, coalesce(y.e.v, '<MISSING>') AS right_value
FROM le x FULL JOIN ri y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber AND x.e.k = y.e.k) WHERE left_value <> right_value""")
def checksum_differences(spark, d):
    """Checksums within JSON texts; every sixth left text is cut short and has none."""
    p, k = F.col("p"), F.col("s")
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    member = lambda v: F.struct(v.cast("string").alias("md5"), F.lit(1).alias("size"))
    text = lambda a, b, on: F.to_json(F.struct(member(a).alias("a"), F.when(on, member(b)).alias("b"), F.lit(5).alias("n"), F.struct(F.lit("x").alias("other")).alias("c")))
    whole = text(p % 9, k, p % 2 == 0)
    side = lambda t: x.select("l_orderkey", "l_linenumber", F.explode(sequences.json_md5(t)).alias("key", "value"))
    cut = F.when(p % 6 == 0, F.left(whole, F.char_length(whole) - 4)).otherwise(whole)
    return sequences.map_differences(side(cut), side(text(k % 3, k, k % 2 == 0)), ["l_orderkey", "l_linenumber"], "key", "value")


@query("""WITH n AS (SELECT l_orderkey, list({'k': l_partkey % 4, 'n': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS way FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, list_filter(way, lambda e: e.k < 2) AS w FROM n)
SELECT l_orderkey, array_to_string(list_transform(w, lambda e, i: repeat('  ', CAST(i - 1 AS INTEGER)) || CASE WHEN i > 1 THEN '→ ' ELSE '' END || 'node' || e.n || CASE e.k WHEN 0 THEN ' [Module]' ELSE ' [API]' END), chr(10)) AS lines FROM f""")
def drawn_ways(spark, d):
    node = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(node)).alias("way"))
    way = F.transform("way", lambda n: F.struct((n["l_partkey"] % 4).cast("string").alias("kind"), F.concat(F.lit("node"), n["l_suppkey"].cast("string")).alias("name")))
    return x.select("l_orderkey", sequences.drawn(way).alias("lines"))


# ---- logs and catalogues ----


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, 'd' || event_id AS delegation_id, event_type AS subagent_type, 'task ' || event_type AS task_description, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'completed' END AS status, CAST(event_id % 1000 AS VARCHAR) AS duration_ms, 'done' AS result, CAST(NULL AS VARCHAR) AS error,
CASE event_id % 4 WHEN 0 THEN 's' || user_id WHEN 1 THEN 'd' || user_id WHEN 2 THEN 'o' || user_id END AS start_time, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'e' || user_id END AS end_time FROM events WHERE event_type IN ('click', 'view') AND event_id % 8 <> 7""")
def audit_delegations(spark, d):
    """Log texts written from events: times under their own or older names, some without an id, some of other kinds."""
    k, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    on = lambda c, x: F.when(c, x)
    payload = F.struct(
        F.when(kind.isin("click", "view"), audit.DELEGATION).otherwise("user.turn").alias("event"), user.alias("run_id"), F.when(k % 8 != 7, F.concat(F.lit("d"), k.cast("string"))).otherwise("").alias("delegation_id"),
        kind.alias("subagent_type"), F.concat(F.lit("task "), kind).alias("task_description_raw"), on(k % 3 != 0, F.lit("completed")).alias("status"), (k % 1000).alias("duration_ms"), F.lit("done").alias("result_raw"),
        on(k % 4 == 0, F.concat(F.lit("s"), user)).alias("start_time"), on((k % 4).isin(0, 1), F.concat(F.lit("d"), user)).alias("delegated_at"), on(k % 4 != 3, F.concat(F.lit("o"), user)).alias("started_at"),
        on(k % 5 != 0, F.concat(F.lit("e"), user)).alias("ended_at"), F.lit("t").alias("thread_id"),
    )
    return audit.delegations(table(spark, d, "events").withColumn("text", F.to_json(payload)), "text", ["event_id"])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name || chr(10) || p_type, '(bolt|gear)\\s+PRO|^large')")
def catalogue_search(spark, d):
    return audit.catalogue(table(spark, d, "part"), "p_name", "p_type", r"(bolt|gear)\s+PRO|^large").select("p_partkey", "p_name", "p_type")


PATHS = "pa AS (SELECT p_brand || '/' || p_type || CASE WHEN p_size % 3 = 0 THEN '/' ELSE '/' || p_name END AS path FROM part)"


@query(f"""WITH {PATHS}, ca AS (SELECT DISTINCT path, regexp_extract(regexp_replace(lower(path), '/+$', ''), '[^/]*$') AS base, path LIKE '%/' AS folder FROM pa),
ra AS (SELECT path, CASE WHEN base LIKE 'st%' THEN 0 WHEN base LIKE '%st%' THEN 1 WHEN lower(path) LIKE 'st%' THEN 2 WHEN lower(path) LIKE '%st%' THEN 3 ELSE 4 END AS category, folder FROM ca) SELECT path, category, folder FROM ra ORDER BY category, folder DESC, lower(path), path LIMIT 40""")
def best_completions(spark, d):
    path = F.concat_ws("/", "p_brand", "p_type", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")))
    return audit.completions(table(spark, d, "part").select(path.alias("path")), "path", "St", 40)


@query("SELECT coalesce(nullif(CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN NULL ELSE event_type END, ''), 'unknown') AS tool, count(*) AS calls FROM events GROUP BY 1")
def tool_calls(spark, d):
    k = F.col("event_id") % 6
    return audit.tool_counts(table(spark, d, "events").withColumn("tool", F.when(k == 0, "").when(k > 1, F.col("event_type"))), "tool")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def last_turns(spark, d):
    return runlog.last_k(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 2)


# ---- names and sizes ----


@query("""SELECT p_partkey, p_name AS op, p_brand || '@' || p_type AS suffix, CASE WHEN p_size % 3 < 2 THEN p_type || '.' || p_name END AS api, CASE p_size % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'output' END AS direction, CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS place,
CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS INTEGER) END AS layer, CASE WHEN length(p_name) > 9 THEN left(p_name, 6) || '...' ELSE p_name END AS short, regexp_replace(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(p_size AS INTEGER) END AS rank FROM part""")
def parsed_names(spark, d):
    size, name, kind, brand = F.col("p_size"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    number = size.cast("string")
    op, suffix = s.op_and_suffix(F.concat_ws("@", name, brand, kind))
    way = F.when(size % 3 == 0, "input").when(size % 3 == 1, "output").otherwise("grad")
    parts = s.api_parts(F.concat_ws(".", kind, name, way, number))
    layer = s.layer_index(F.concat(F.lit("model"), F.when(size % 4 == 0, ".layer.").otherwise(".layers."), number, F.lit("."), name))
    rank = s.number_after(F.concat(F.when(size % 5 == 0, "dev").otherwise("rank"), number, F.lit(".json")), "rank")
    return table(spark, d, "part").select("p_partkey", op.alias("op"), suffix.alias("suffix"), parts["api"].alias("api"), parts["direction"].alias("direction"), parts["index"].alias("place"), layer.alias("layer"), s.shortened(name, 9).alias("short"), s.file_name(F.concat(F.lit(" "), name, F.lit("/ "), brand, F.lit("#"))).alias("file"), rank.alias("rank"))


SIZES = "sz AS (SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN o_orderkey * 256 % 1048576 + 1024 WHEN 2 THEN o_orderkey * 65536 % 1073741824 + 1048576 ELSE o_orderkey * 2097152 + 1073741824 END AS BIGINT) AS size FROM orders)"


@query(f"""WITH {SIZES} SELECT o_orderkey, CASE WHEN size < 1024 THEN printf('%.0f B', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.2f GB', size / 1073741824.0::DOUBLE) END AS size FROM sz""")
def byte_sizes(spark, d):
    """Among the sizes are many whose last digit is a half."""
    k = F.col("o_orderkey")
    size = F.when(k % 4 == 0, k % 1024).when(k % 4 == 1, k * 256 % 1024**2 + 1024).when(k % 4 == 2, k * 65536 % 1024**3 + 1024**2).otherwise(k * 2097152 + 1024**3)
    return table(spark, d, "orders").select(k, s.bytes_text(size).alias("size"))


@query("SELECT p_partkey, (p_name LIKE 'cold%' OR p_name LIKE '%bolt') AND NOT regexp_matches(p_name, '^la..e .*$') AS wanted, p_name LIKE 'small%' OR p_name LIKE 'large%' AS barred FROM part")
def globbed_names(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", s.matches_globs(name, ["cold*", "*bolt", "!la??e *"]).alias("wanted"), s.starts_with_any(name, ["small", "large"]).alias("barred"))


@query("""SELECT p_partkey, 'run --api-token REDACTED --size ' || p_size || ' db_password=REDACTED --name ' || p_brand AS command FROM part""")
def redacted_commands(spark, d):
    command = F.concat(F.lit("run --api-token "), F.col("p_type"), F.lit(" --size "), F.col("p_size").cast("string"), F.lit(" db_password="), F.col("p_brand"), F.lit(" --name "), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", s.redacted_command(command).alias("command"))


@query("""WITH x AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(q, ',') AS lengths FROM x""")
def sequence_lengths(spark, d):
    """Lengths from the cumulative ends that a packed batch carries."""
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(order, lambda r: r["q"]).alias("q"))
    ends = F.transform("q", lambda _, i: F.aggregate(F.slice("q", 1, i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b))
    return x.select("l_orderkey", F.array_join(F.transform(s.deltas(ends), lambda v: v.cast("string")), ",").alias("lengths"))


@query("""SELECT how, p_name, count(*) AS n FROM (SELECT 'exact' AS how, p_name FROM part WHERE p_name = 'cold bolt' UNION ALL SELECT 'contains', p_name FROM part WHERE p_name LIKE '%ol%' UNION ALL SELECT 'starts_with', p_name FROM part WHERE p_name LIKE 'la%'
UNION ALL SELECT 'ends_with', p_name FROM part WHERE p_name LIKE '%et' UNION ALL SELECT 'glob', p_name FROM part WHERE regexp_matches(p_name, '^s.* b..t$')) GROUP BY ALL""")
def field_search(spark, d):
    """All five ways to look for a text in a field."""
    part, out = table(spark, d, "part").select("p_name"), None
    for how, text in (("exact", "cold bolt"), ("contains", "ol"), ("starts_with", "la"), ("ends_with", "et"), ("glob", "s* b??t")):
        found = matching.found_by(part, "p_name", text, how).select(F.lit(how).alias("how"), "p_name")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("how", "p_name").agg(F.count("*").alias("n"))
