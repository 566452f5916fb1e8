"""More queries by name, with SQL: step metrics, collectives, verdicts, filters, merges, sets, rules and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions import scalars as s
from tracegrain.functions import textual as t
from tracegrain.operators import cluster, matching, memory, runlog, steps, verdicts
from tracegrain.operators.memory import exact_sum
from tracegrain.plans.catalogue import EV, RUN, SEG, SUM, dec, query, reserved, segments, table, traces

DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"
big = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def tasks(spark, d):
    """Events as tasks of a rank and a step."""
    length = F.floor(F.col("value") * 100).cast("bigint") * 100_000
    kind = F.when(F.col("event_type") == "click", "computation").when(F.col("event_type").isin("view", "error"), "communication").when(F.col("event_type") == "purchase", "memory").otherwise("host")
    x = traces(spark, d).select((F.col("user_id") % 10).alias("rank"), F.to_date("ts").cast("string").alias("step"), "event_type", "value", kind.alias("kind"), F.col("us").alias("a"), (F.col("us") + length).alias("b"), "event_id", "user_id")
    return x.withColumn("wait", F.floor((F.col("b") - F.col("a")) / 4)).withColumn("launched", F.col("a") - F.col("user_id") * 7 - 1)


TASKS = f"""tk AS (SELECT user_id % 10 AS rank, {DAY} AS step, event_type, value, event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 100000 AS b FROM events),
tl AS (SELECT *, CAST(event_type = 'click' AS INTEGER) AS c, CAST(event_type IN ('view', 'error') AS INTEGER) AS m, CAST(event_type = 'purchase' AS INTEGER) AS y, CAST(event_type = 'error' AS INTEGER) AS r, (b - a) // 4 AS wait, a - user_id * 7 - 1 AS launched FROM tk)"""
METRICS = f"""{TASKS}, pt AS (SELECT rank, step, t, sum(c) AS c, sum(m) AS m, sum(y) AS y, sum(r) AS r FROM (SELECT rank, step, a AS t, c, m, y, r FROM tl UNION ALL SELECT rank, step, b, -c, -m, -y, -r FROM tl) GROUP BY ALL),
sw AS (SELECT rank, step, lead(t) OVER w - t AS d, sum(c) OVER w > 0 AS c, sum(m) OVER w > 0 AS m, sum(y) OVER w > 0 AS y, sum(r) OVER w > 0 AS r FROM pt WINDOW w AS (PARTITION BY rank, step ORDER BY t)),
sa AS (SELECT rank, step, {big('d * CAST(c AS INTEGER)')} AS computation, {big('CASE WHEN m AND NOT c THEN d END')} AS communication_not_overlapped, {big('CASE WHEN m AND c THEN d END')} AS overlapped, {big('CASE WHEN m THEN d END')} AS communication,
{big('CASE WHEN NOT (c OR m OR y) THEN d END')} AS free, {big('CASE WHEN y THEN d END')} AS memory, {big('CASE WHEN y AND NOT c AND NOT m THEN d END')} AS memory_not_overlapped, {big('CASE WHEN r THEN d END')} AS bubble,
{big('CASE WHEN m AND NOT c AND NOT r THEN d END')} AS communication_without_receive FROM sw GROUP BY ALL),
ow AS (SELECT rank, step, max(b) - min(a) AS step_time, min(CASE WHEN c + m > 0 THEN a END) - min(a) AS preparing, max(b) - max(CASE WHEN c + m > 0 THEN b END) AS tail, {big('wait * m')} AS wait, {big('(b - a - wait) * m')} AS transmit, avg(a - launched) AS launch_delay_avg FROM tl GROUP BY ALL),
sm AS (SELECT *, step_time - bubble AS stage FROM ow JOIN sa USING (rank, step))"""


def metrics(spark, d):
    return steps.step_metrics(tasks(spark, d), ["rank", "step"], "a", "b", "kind", F.col("event_type") == "error", "wait", "launched")


@query(f"WITH {METRICS} SELECT * FROM sm")
def step_metrics(spark, d):
    return metrics(spark, d)


@query(f"WITH {METRICS} SELECT 'rank' AS type, CAST(rank AS VARCHAR) AS index, step, computation, free, bubble FROM sm UNION ALL SELECT 'stage', CAST(rank % 3 AS VARCHAR), step, max(computation), max(free), max(bubble) FROM sm GROUP BY step, rank % 3")
def stage_rows(spark, d):
    return steps.with_stages(metrics(spark, d).withColumn("stage", F.col("rank") % 3), "step", "rank", "stage", ["computation", "free", "bubble"])


@query(f"""WITH {METRICS}, c AS (SELECT rank, computation, free FROM sm WHERE step = '2024-01-02'), p AS (SELECT rank, computation, free FROM sm WHERE step = '2024-01-01')
SELECT rank, c.computation AS computation_current, p.computation AS computation_base, c.computation - p.computation AS computation_diff, c.free AS free_current, p.free AS free_base, c.free - p.free AS free_diff FROM c FULL JOIN p USING (rank)""")
def step_compare(spark, d):
    x = metrics(spark, d)
    return steps.compared(x.filter("step = '2024-01-02'"), x.filter("step = '2024-01-01'"), ["rank"], ["computation", "free"])


@query(f"WITH {METRICS} SELECT rank, step, free, step_time, free / nullif(step_time, 0) AS free_share, coalesce(free / nullif(step_time, 0) > 0.1, false) AS host_bound FROM sm")
def host_bound_steps(spark, d):
    return steps.host_bound(metrics(spark, d)).select("rank", "step", "free", "step_time", "free_share", "host_bound")


COLL = "co AS (SELECT 'hcom_' || event_type || '__' || (user_id % 30) || '_0_1' AS op, event_type AS kind, user_id % 10 AS rank, value AS v, event_id FROM events)"


def collectives(spark, d):
    op = F.concat(F.lit("hcom_"), "event_type", F.lit("__"), (F.col("user_id") % 30).cast("string"), F.lit("_0_1"))
    return table(spark, d, "events").select(op.alias("op"), F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("rank"), F.col("value").alias("v"), "event_id")


@query(f"""WITH {COLL}, g AS (SELECT op, {SUM} FROM co GROUP BY 1), e AS (SELECT op, first(rank ORDER BY v, rank) AS min_rank, first(rank ORDER BY v DESC, rank) AS max_rank FROM co GROUP BY 1) SELECT * FROM g JOIN e USING (op) ORDER BY mean_value DESC, op LIMIT 15""")
def top_collectives(spark, d):
    return steps.top_ops(collectives(spark, d), "op", "v", "rank")


@query(f"WITH {COLL} SELECT rank, kind, {SUM} FROM co GROUP BY ALL")
def collective_summary_rank(spark, d):
    return cluster.summary(collectives(spark, d), ["rank", "kind"], "v")


@query("WITH x AS (SELECT DISTINCT 'net%' || event_type || '_' || (user_id % 7) AS g, user_id % 10 AS r FROM events) SELECT g AS group_name, right(g, 3) AS group_id, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS ranks FROM x GROUP BY 1")
def rank_groups(spark, d):
    name = F.concat(F.lit("net%"), "event_type", F.lit("_"), (F.col("user_id") % 7).cast("string"))
    return steps.group_map(table(spark, d, "events").select(name.alias("g"), (F.col("user_id") % 10).alias("r")), "g", "r")


@query(f"""WITH x AS (SELECT event_type AS name, user_id % 3 AS step, value AS framework, value * 0.5 AS runtime, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 2 END AS device FROM events),
y AS (SELECT 'framework' AS level, name, step, framework AS v FROM x UNION ALL SELECT 'runtime', name, step, runtime FROM x UNION ALL SELECT 'device', name, step, device FROM x) SELECT level, name, step, {SUM} FROM y WHERE v IS NOT NULL GROUP BY ALL""")
def marker_stats(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("step"), F.col("value").alias("framework"), (F.col("value") * 0.5).alias("runtime"), F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("device"))
    return steps.marks(x, ["name", "step"], ["framework", "runtime", "device"])


STAT = f"count(*) AS n, {dec('value')} AS total, min(value) AS min_value, max(value) AS max_value, {dec('value')} / count(*) AS mean_value"


@query(f"WITH a AS (SELECT user_id, event_type, {STAT} FROM events GROUP BY ALL), w AS (SELECT user_id, {dec('total')} AS al FROM a GROUP BY 1) SELECT a.*, total * 100.0 / nullif(al, 0) AS share_pct FROM a JOIN w USING (user_id)")
def api_rank_share(spark, d):
    return steps.shares(table(spark, d, "events"), ["user_id", "event_type"], ["user_id"], "value")


@query(f"WITH a AS (SELECT event_type, {STAT} FROM events GROUP BY ALL) SELECT *, total * 100.0 / (SELECT {dec('total')} FROM a) AS share_pct FROM a")
def api_statistic(spark, d):
    return steps.shares(table(spark, d, "events"), ["event_type"], [], "value")


@query(f"WITH x AS (SELECT p_type, p_brand, l_extendedprice AS value FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT p_brand, p_type, {STAT} FROM x GROUP BY ALL), w AS (SELECT p_brand, {dec('total')} AS al FROM a GROUP BY 1) SELECT a.*, total * 100.0 / nullif(al, 0) AS share_pct FROM a JOIN w USING (p_brand)")
def compute_overview(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return steps.shares(table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("value")).join(p, "l_partkey"), ["p_brand", "p_type"], ["p_brand"], "value")


@query(f"""WITH x AS (SELECT event_type, user_id % 10 AS rank, value AS e, value * 0.5 AS tr, value * 0.25 AS w, value * 0.125 AS sy, event_id * 1.5 AS sz FROM events),
a AS (SELECT event_type, rank, count(*) AS n, {dec('e')} AS elapsed, {dec('tr')} AS transit, {dec('w')} AS wait, {dec('sy')} AS sync, {dec('sz')} AS size FROM x GROUP BY ALL)
SELECT *, greatest(elapsed - transit - wait - sync, 0) AS idle, coalesce(wait / nullif(transit + wait, 0), 0) AS wait_ratio, size / nullif(transit, 0) AS bandwidth FROM a""")
def comm_time_split(spark, d):
    v = F.col("value")
    x = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("rank"), v.alias("e"), (v * 0.5).alias("tr"), (v * 0.25).alias("w"), (v * 0.125).alias("sy"), (F.col("event_id") * F.lit(1.5)).alias("sz"))
    return steps.time_split(x, ["event_type", "rank"], "e", "tr", "w", "sy", "sz")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'reduce' WHEN 2 THEN 'remote' ELSE 'other' END AS kind, p_partkey * 200000 AS size, p_size * 1.0 AS bw FROM part)
SELECT p_partkey, CASE kind WHEN 'copy' THEN CASE WHEN size <= 16777216 THEN 'small' WHEN bw < 19 * 0.8 THEN 'slow' ELSE 'normal' END WHEN 'reduce' THEN CASE WHEN size <= 16777216 THEN 'small' WHEN bw < 17 * 0.8 THEN 'slow' ELSE 'normal' END
WHEN 'remote' THEN CASE WHEN size <= 1048576 THEN 'small' WHEN bw < 21 * 0.8 THEN 'slow' ELSE 'normal' END ELSE 'unknown' END AS class FROM x""")
def transfer_diagnosis(spark, d):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "copy").when(k == 1, "reduce").when(k == 2, "remote").otherwise("other")
    return table(spark, d, "part").select("p_partkey", steps.transfer_class(kind, F.col("p_partkey") * 200000, F.col("p_size") * F.lit(1.0)).alias("class"))


@query(f"WITH x AS (SELECT event_type, user_id, {dec('value')} AS total FROM events GROUP BY ALL), m AS (SELECT event_type, {dec('total')} / count(*) AS mean_total FROM x GROUP BY 1) SELECT event_type, user_id, total, mean_total FROM x JOIN m USING (event_type) WHERE total > 1.3 * mean_total")
def rank_outliers(spark, d):
    return steps.rank_outliers(table(spark, d, "events"), ["event_type"], "user_id", "value", 1.3)


@query(f"WITH x AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS bw FROM lineitem), m AS (SELECT l_returnflag, {dec('bw')} / count(*) AS mean_bw FROM x GROUP BY 1) SELECT l_returnflag, l_orderkey, l_linenumber, bw, mean_bw FROM x JOIN m USING (l_returnflag) WHERE bw < mean_bw * 0.8")
def link_outliers(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("bw"))
    return cluster.outlier_links(x, "l_returnflag", "bw", 0.8)


@query(f"""WITH x AS (SELECT p_brand, 2e0 * p_size * l_quantity * 64 AS fl, l_extendedprice / 1e3 AS sec FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT p_brand, count(*) AS kernels, {dec('fl')} AS flops, {dec('sec')} AS seconds FROM x GROUP BY 1)
SELECT *, flops / nullif(seconds, 0) / 1e12 AS tflops, flops / nullif(seconds, 0) / 1e12 / 353.89 AS mfu FROM a""")
def module_mfu(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    x = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(p, "l_partkey")
    return steps.module_mfu(x, "p_brand", s.gemm_flops(F.col("p_size"), F.col("l_quantity"), F.lit(64)), F.col("l_extendedprice") / F.lit(1e3), 353.89)


# ---- verdicts ----

PEAK = f"""{EV}, {RUN}, pk AS (SELECT user_id, greatest(max(running), 0) AS peak, first(event_id ORDER BY greatest(running, 0) DESC, event_id) AS peak_at FROM run GROUP BY 1), ct AS (SELECT user_id, greatest(1, count(*) // 10) AS cut FROM run GROUP BY 1),
bl AS (SELECT ct.user_id, coalesce(max(running), 0) AS baseline FROM ct LEFT JOIN run ON run.user_id = ct.user_id AND idx = cut GROUP BY 1)"""


@query(f"WITH {PEAK} SELECT user_id, CAST(peak AS BIGINT) AS peak, peak_at, CAST(baseline AS BIGINT) AS baseline, CAST(peak - baseline AS BIGINT) AS growth, CASE WHEN baseline > 0 THEN (peak - baseline) * 100.0 / baseline END AS growth_pct FROM pk JOIN bl USING (user_id)")
def memory_peak(spark, d):
    return verdicts.peak(reserved(spark, d), "user_id", "event_id")


@query("WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events WHERE event_type = 'purchase') SELECT * FROM x WHERE place <= 10")
def peak_contributors(spark, d):
    return verdicts.contributors(table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query(f"""WITH {SEG}, a AS (SELECT {dec('l_extendedprice')} AS reserved, {dec('allocated')} AS allocated, coalesce({dec("CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END")}, 0) AS pending FROM segs),
b AS (SELECT *, reserved - allocated AS free, CASE WHEN reserved > 0 THEN round_even((reserved - allocated) / reserved * 100, 1) ELSE 0 END AS frag_pct, CASE WHEN reserved > allocated THEN round_even(pending / (reserved - allocated) * 100, 1) ELSE 0 END AS pending_pct FROM a)
SELECT *, CASE WHEN frag_pct > 15 THEN 'critical' WHEN frag_pct > 5 THEN 'attention' ELSE 'healthy' END AS status, pending_pct > 50 AS pseudo FROM b""")
def fragment_verdict(spark, d):
    x = segments(spark, d)
    return verdicts.fragmentation(x, x.withColumn("p", F.col("l_extendedprice") * F.col("l_discount")), "l_extendedprice", "allocated", "p", F.col("l_returnflag") == "R")


@query("WITH x AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_discount * 100.0 AS frag_pct, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount * 100.0 DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) SELECT * FROM x WHERE place <= 5")
def top_fragmented(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 100.0).alias("frag_pct"))
    return matching.top_of_groups(x, ["l_returnflag"], [F.desc("frag_pct"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5).drop("l_suppkey")


@query(f"""WITH {EV}, nt AS (SELECT user_id, event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS running FROM ev),
lg AS (SELECT *, lag(running) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM nt), mo AS (SELECT user_id, count(*) AS n, bool_and(b IS NULL OR running >= b) AND arg_max(running, event_id) > arg_min(running, event_id) AND count(*) >= 2 AS monotonic FROM lg GROUP BY 1),
fs AS (SELECT user_id, event_type, min(idx) AS f FROM ev GROUP BY ALL), ll AS (SELECT user_id, count(*) AS long_lived FROM fs WHERE f < 4 GROUP BY 1)
SELECT user_id, n, monotonic, coalesce(long_lived, 0) AS long_lived, CASE WHEN monotonic AND coalesce(long_lived, 0) >= 5 THEN 'high' WHEN monotonic OR coalesce(long_lived, 0) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM mo LEFT JOIN ll USING (user_id)""")
def leak_verdict(spark, d):
    x = traces(spark, d)
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    blocks = x.select("user_id", "event_type").distinct()
    return verdicts.leaks(memory.running(x, "user_id", "event_id", delta), memory.long_lived(blocks, x, ["user_id", "event_type"], "idx", 4), "user_id", "event_id")


@query(f"""WITH {EV}, p AS (SELECT f.user_id, f.idx AS failed_at, f.value AS free, a.value AS size, 's' || (CAST(floor(a.value) AS BIGINT) % 3) AS stack, row_number() OVER (PARTITION BY f.user_id, f.idx ORDER BY a.value DESC, a.idx) AS r
FROM ev f JOIN ev a ON a.user_id = f.user_id AND a.idx BETWEEN f.idx - 50 AND f.idx WHERE f.event_type = 'error' AND a.event_type = 'purchase'),
g AS (SELECT user_id || ':' || failed_at AS failure, stack, count(*) AS n, {dec('size')} AS s, max(free) AS free FROM p WHERE r <= 5 GROUP BY ALL), h AS (SELECT failure, CAST(sum(n) AS BIGINT) AS n, max(n) AS same, {dec('s')} AS total, max(free) AS free FROM g GROUP BY 1)
SELECT failure, n, total, CASE WHEN n < 3 THEN 'insufficient' WHEN same >= 3 THEN 'same_stack' WHEN total > 3 * free THEN 'burst' ELSE 'single_large' END AS cause FROM h""")
def failure_verdict(spark, d):
    x = traces(spark, d)
    near = memory.before_failures(x, "user_id", "idx", F.col("event_type") == "error", F.col("event_type") == "purchase", "value")
    free = x.filter("event_type = 'error'").select("user_id", F.col("idx").alias("failed_at"), F.col("value").alias("free"))
    rows = near.join(free, ["user_id", "failed_at"]).withColumn("failure", F.concat_ws(":", "user_id", "failed_at")).withColumn("stack", F.concat(F.lit("s"), (F.floor("size") % 3).cast("string")))
    return memory.failure_cause(rows, "failure", "stack", "size", "free")


@query(f"""WITH x AS (SELECT year(o_orderdate) >= 2000 AS late, {dec('o_totalprice')} AS reserved, count(*) * 1.0 AS segments FROM orders GROUP BY 1), y AS (SELECT 'reserved' AS metric, (SELECT reserved FROM x WHERE NOT late) AS "before", (SELECT reserved FROM x WHERE late) AS "after"
UNION ALL SELECT 'segments', (SELECT segments FROM x WHERE NOT late), (SELECT segments FROM x WHERE late)) SELECT metric, CAST("before" AS DOUBLE) AS "before", CAST("after" AS DOUBLE) AS "after", "after" - "before" AS diff, CASE WHEN "after" > "before" THEN '[+]' WHEN "after" < "before" THEN '[-]' ELSE '[=]' END AS trend FROM y""")
def snapshot_compare(spark, d):
    side = lambda late: table(spark, d, "orders").filter((F.year("o_orderdate") >= 2000) == late).agg(exact_sum("o_totalprice").alias("reserved"), F.count("*").cast("double").alias("segments"))
    return verdicts.snapshots_compared(side(False), side(True), ["reserved", "segments"])


# ---- filters ----


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view' AND CAST(user_id AS VARCHAR) IN ('3', '14', '15')")
def bound_filters(spark, d):
    x = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return matching.in_steps(matching.unless(x, False, "event_type", "view"), "user_id", ["3", "14", "15"]).drop("user_id")


@query("SELECT p_partkey, p_name FROM part WHERE NOT ((p_name LIKE 'small%' AND p_size = 7) OR (p_name LIKE 'cold%' AND p_size = 24))")
def rule_exclusions(spark, d):
    rules = spark.createDataFrame([("small", "x", 7), ("cold", "x", 24)], "prefix string, direction string, index int")
    x = table(spark, d, "part").select("p_partkey", "p_name", F.lit("x").alias("direction"), F.col("p_size").cast("int").alias("index"))
    return matching.without_rules(x, rules, "p_name", "direction", "index").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name LIKE 'small%' AND (contains(p_name, 'widget') OR contains(p_name, 'bolt')) AS collective, p_name FROM part WHERE p_name LIKE '%e%' AND p_partkey >= 5 AND p_partkey - 3 <= 900000")
def slice_search(spark, d):
    x = matching.slices(table(spark, d, "part").withColumn("start", F.col("p_partkey") - 3), "p_name", "*e*", "glob", "start", "p_partkey", 5, 900_000)
    return x.select("p_partkey", matching.is_collective(F.col("p_name"), ["widget", "bolt"], "small").alias("collective"), "p_name")


# ---- merges and sets ----


@query("""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS n FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_custkey AS k, c_mktsegment AS n FROM customer WHERE c_custkey % 5 <> 1)
SELECT k, coalesce(nullif(l.n, ''), r.n, l.n) AS n FROM l FULL JOIN r USING (k)""")
def fill_merge(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    left = c.filter("c_custkey % 2 = 0").select("k", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("n"))
    return matching.filled(left, c.filter("c_custkey % 5 <> 1").select("k", F.col("c_mktsegment").alias("n")), "k", ["n"])


@query("""WITH p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS peer FROM orders), n AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
SELECT c_custkey AS k, peer, CASE WHEN n IS NULL THEN '1:0' WHEN n = 1 THEN '1:1' ELSE '1:N' END AS mapping FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN p ON p.k = c_custkey""")
def key_mapping(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.array("o_orderpriority").alias("peers"))
    return matching.mapped(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), pairs, "k")


@query("""WITH x AS (SELECT c_nationkey, s_nationkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, least(c_nationkey, s_nationkey) AS low, greatest(c_nationkey, s_nationkey) AS high FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT low, high, min(o_orderkey) AS first FROM x GROUP BY ALL""")
def edge_dedup(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(u, "l_suppkey")
    return matching.undirected(edges, "c_nationkey", "s_nationkey", "l_orderkey").select("low", "high", F.col("l_orderkey").alias("first")).distinct()


@query("""WITH n AS (SELECT s_nationkey AS node, s_suppkey AS pos, range(s_suppkey % 64, s_suppkey % 64 + s_nationkey + 1) AS cpus FROM supplier), x AS (SELECT node, pos, unnest(cpus) AS cpu FROM n) SELECT cpu, first(node ORDER BY pos DESC) AS node FROM x GROUP BY 1""")
def cpu_nodes(spark, d):
    low = F.col("s_suppkey") % 64
    return matching.nodes_of_cpus(table(spark, d, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("pos"), F.sequence(low, low + F.col("s_nationkey")).alias("cpus")), "node", "cpus", "pos")


@query(f"""WITH x AS (SELECT event_type, {dec('value')} AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), y AS (SELECT event_type, {dec('value')} AS w FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT event_type, v AS "before", w AS "after", v - w AS diff, CAST(trunc((v - w) / v * 100) AS BIGINT) AS gain_pct FROM x JOIN y USING (event_type)""")
def before_after(spark, d):
    side = lambda odd, c: table(spark, d, "events").filter((F.col("user_id") % 2 == odd) & c).groupBy("event_type").agg(exact_sum("value").alias("v"))
    return matching.before_after(side(0, F.lit(True)), side(1, F.col("event_type") != "view"), "event_type", "v")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT k, CASE WHEN a.k IS NULL THEN 'only_right' WHEN b.k IS NULL THEN 'only_left' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)")
def names_compared(spark, d):
    side = lambda x: table(spark, d, "orders").filter(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k"))
    return matching.names_compared(side("O"), side("F"), "k")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NULL OR r IS NULL) = 0 AS equal FROM x""")
def weight_keys(spark, d):
    side = lambda x: table(spark, d, "orders").filter(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k"))
    return matching.key_counts(side("O"), side("F"), "k")


@query("""WITH x AS (SELECT l_orderkey, CAST(l_partkey % 6 AS VARCHAR) AS k, l_returnflag = 'N' AS r, CAST(max(l_suppkey) AS VARCHAR) AS v FROM lineitem GROUP BY ALL),
y AS (SELECT l_orderkey, k, max(v) FILTER (NOT r) AS a, max(v) FILTER (r) AS b FROM x GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(k, ',' ORDER BY k) FILTER (a IS NOT NULL AND b IS NOT NULL), '') AS shared, coalesce(string_agg(k, ',' ORDER BY k) FILTER (a IS NULL), '') AS missing_left,
coalesce(string_agg(k, ',' ORDER BY k) FILTER (b IS NULL), '') AS missing_right, string_agg(k || '=' || coalesce(b, a), ',' ORDER BY k) AS merged FROM y GROUP BY 1""")
def key_sets(spark, d):
    """Of each order, a map of the lines that came back or were kept against one of the lines that are on their way; an order has few lines."""
    side = F.when(F.col("l_returnflag") == "N", "right").otherwise("left")
    x = table(spark, d, "lineitem").groupBy("l_orderkey", side.alias("side"), (F.col("l_partkey") % 6).cast("string").alias("k")).agg(F.max("l_suppkey").cast("string").alias("v"))
    of = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("side") == name, F.struct("k", "v")))).alias(name)
    maps = x.groupBy("l_orderkey").agg(of("left"), of("right"))
    found = maps.select("l_orderkey", matching.key_sets(F.col("left"), F.col("right")).alias("k"), matching.merged(F.col("left"), F.col("right")).alias("m"))
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("l_orderkey", *(F.array_join(f"k.{c}", ",").alias(c) for c in ("shared", "missing_left", "missing_right")), F.array_join(pairs, ",").alias("merged"))


# ---- rules, counters, places ----


@query("""WITH r AS (SELECT * FROM (VALUES ('widget', 'Brand#13'), ('bolt', 'Brand#99'), ('nothing', 'x')) r(keyword, expected)) SELECT keyword, expected, count(p_partkey) AS checked, count(*) FILTER (p_brand IS DISTINCT FROM expected AND p_partkey IS NOT NULL) AS failed,
count(p_partkey) > 0 AND count(*) FILTER (p_brand IS DISTINCT FROM expected AND p_partkey IS NOT NULL) = 0 AS passed FROM r LEFT JOIN part ON contains(p_name, keyword) GROUP BY ALL""")
def keyword_rules(spark, d):
    return matching.keyword_rules(table(spark, d, "part"), [("widget", "Brand#13"), ("bolt", "Brand#99"), ("nothing", "x"), ("", "y")], "p_name", "p_brand")


@query("""WITH x AS (SELECT s_suppkey % 7 AS socket, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 13 END AS core, s_suppkey AS cpu, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS node FROM supplier)
SELECT socket, core, string_agg(CAST(cpu AS VARCHAR), ',' ORDER BY cpu) AS cpus, first(node ORDER BY cpu) FILTER (node IS NOT NULL) AS node FROM x WHERE core IS NOT NULL GROUP BY ALL""")
def physical_cores(spark, d):
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select((k % 7).alias("socket"), F.when(k % 11 != 0, k % 13).alias("core"), k.alias("cpu"), F.when(k % 3 != 0, F.col("s_nationkey")).alias("node"))
    return matching.physical_cores(x, "socket", "core", "cpu", "node")


@query("""WITH f AS (SELECT user_id, event_type, 'v' || CAST(floor(value) AS BIGINT) % 20 AS txt, event_id FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT user_id, event_type, txt, min(event_id) AS seen FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seen, txt) AS k FROM u) SELECT user_id, event_type, n, (SELECT string_agg(txt, '; ' ORDER BY k) FROM r WHERE r.user_id = c.user_id AND r.event_type = c.event_type AND k <= 3) AS examples FROM c""")
def severity_report(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", F.concat(F.lit("v"), (F.floor("value") % 20).cast("string")).alias("txt"), "event_id")
    return matching.severity_report(x, ["user_id"], "event_type", "txt", "event_id")


@query("""WITH x AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id // 3 END AS id, event_type, CAST(floor(value) AS BIGINT) AS tin, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 7 END AS tout FROM events),
o AS (SELECT user_id, id, CASE WHEN id IS NULL THEN event_type END AS t, max(tin) AS tin, max(tout) AS tout FROM x GROUP BY ALL) SELECT user_id, count(*) AS messages, CAST(sum(tin) AS BIGINT) AS tin, CAST(sum(tout) AS BIGINT) AS tout FROM o GROUP BY 1""")
def token_totals(spark, d):
    v = F.floor("value")
    x = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 3)).alias("id"), "event_type", v.alias("tin"), F.when(F.col("event_type") != "view", v % 7).alias("tout"))
    return matching.token_totals(x, "id", ["event_type"], ["user_id"], ["tin", "tout"])


@query(f"WITH {EV}, b AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN idx END) AS lo, max(CASE WHEN event_type = 'error' THEN idx END) AS hi FROM ev GROUP BY 1) SELECT user_id, idx, event_type FROM ev JOIN b USING (user_id) WHERE idx > lo AND idx < hi")
def between_failures(spark, d):
    x = traces(spark, d).select("user_id", "idx", "event_type")
    at = F.when(F.col("event_type") == "error", F.col("idx"))
    return matching.strictly_between(x, x.groupBy("user_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi")), ["user_id"], "idx", "lo", "hi")


@query(f"WITH x AS (SELECT user_id, {DAY} AS step, event_id FROM events WHERE event_type = 'error' AND value > 20), f AS (SELECT user_id, min(step) AS step FROM x GROUP BY 1) SELECT x.* FROM x JOIN f USING (user_id, step)")
def first_hit_step(spark, d):
    x = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("step"), "event_id", "event_type", "value")
    return matching.first_hit_step(x, ["user_id"], "step", (F.col("event_type") == "error") & (F.col("value") > 20)).select("user_id", "step", "event_id")


@query("SELECT conv_id, role, count(*) AS pieces, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY ALL")
def chunk_merge(spark, d):
    return matching.chunks_merged(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text")


@query(f"WITH {EV}, {RUN} SELECT user_id, min(event_id) AS at FROM run WHERE running >= 1000 GROUP BY 1")
def compaction_points(spark, d):
    return matching.first_over(reserved(spark, d), ["user_id"], "event_id", "running", 1000)


# ---- texts ----


@query("""WITH x AS (SELECT p_partkey, p_partkey * 7919 AS n, p_size FROM part) SELECT p_partkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.0fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS tokens,
CASE WHEN n < 60 THEN 'just now' WHEN n < 3600 THEN n // 60 || CASE WHEN n // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN n < 86400 THEN n // 3600 || CASE WHEN n // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
WHEN n < 604800 THEN n // 86400 || CASE WHEN n // 86400 = 1 THEN ' day ago' ELSE ' days ago' END ELSE n // 604800 || CASE WHEN n // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END END AS ago FROM x""")
def numbers_for_people(spark, d):
    n = F.col("p_partkey") * 7919
    return table(spark, d, "part").select("p_partkey", t.tokens_text(n).alias("tokens"), t.ago(n).alias("ago"))


@query("""WITH x AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: NOT starts_with(w, 'th')) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(w[1:5], lambda w: CASE WHEN length(w) % 4 = 0 THEN w ELSE w || ':' || length(w) % 4 END), ' → ') AS path FROM x""")
def call_paths(spark, d):
    """Words stand for frames: their length for the line, and those in th for frames to skip."""
    frame = lambda w: F.struct(F.when(w.startswith("th"), F.concat(F.lit("torch::unwind::"), w)).otherwise(w).alias("name"), (F.length(w) % 4).alias("line"))
    frames = F.to_json(F.transform(F.split("text", " "), frame))
    return table(spark, d, "conversations").select("conv_id", "turn", t.call_path(frames).alias("path"))


@query("""WITH x AS (SELECT *, CASE WHEN p_size % 5 = 1 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS a, CASE WHEN p_size % 5 = 2 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS b, CASE WHEN p_size % 5 = 3 THEN p_type ELSE replace(p_brand, 'Brand#', '') END AS c FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'format' WHEN try_cast(a AS INTEGER) IS NULL THEN 'rank' WHEN try_cast(b AS INTEGER) IS NULL THEN 'pid' WHEN try_cast(c AS INTEGER) IS NULL THEN 'npu' ELSE '' END AS error,
CASE WHEN p_size % 5 <> 4 AND try_cast(a AS INTEGER) IS NOT NULL AND try_cast(b AS INTEGER) IS NOT NULL AND try_cast(c AS INTEGER) IS NOT NULL THEN p_partkey END AS rank,
CASE WHEN p_size % 7 = 0 THEN 'minor' WHEN p_type = 'PROMO' THEN 'major' WHEN p_type = 'ECONOMY' THEN 'minor' ELSE 'error' END AS severity, upper(string_split(p_name, ' ')[1]) || '_' || p_size AS title FROM x""")
def parsed_texts(spark, d):
    """Rank maps, severities and titles written from the columns of parts, some with a word where a number belongs or without the equals sign."""
    size = F.col("p_size") % 5
    rank, pid = F.when(size == 1, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string")), F.when(size == 2, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    npu = F.when(size == 3, F.col("p_type")).otherwise(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    first = t.rank_map(F.concat(F.lit(" "), rank, F.when(size == 4, "~").otherwise("="), pid, F.lit(":"), npu, F.lit(" , ")))[0]
    given = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_type")))
    title = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("\\_"), F.col("p_size").cast("string"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(first["error"], F.lit("")).alias("error"), F.when(first["error"].isNull(), first["rank"]).cast("bigint").alias("rank"), t.severity(given, {"promo": "major", "economy": "minor"}, "minor").alias("severity"), t.table_title(title).alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 AND p_size BETWEEN 15 AND 30 THEN 'overlap' WHEN p_size BETWEEN 15 AND 30 THEN 'target' WHEN p_size BETWEEN 10 AND 20 THEN 'allowed' ELSE 'none' END AS cell, replace(p_name, ' ', ' ') AS name,
CASE p_size % 3 WHEN 0 THEN 'mlp' WHEN 1 THEN 'attn' ELSE 'other' END AS block FROM part""")
def cells_and_blocks(spark, d):
    cell = t.cell_state(F.col("p_size").cast("int"), F.sequence(F.lit(10), F.lit(20)), F.sequence(F.lit(15), F.lit(30)))
    name = F.concat(F.lit("  \x1b[31m"), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit("\x1b[0m "))
    key = F.when(F.col("p_size") % 3 == 0, "Module.layers.1.mlp.up").when(F.col("p_size") % 3 == 1, "Module.layers.1.self_attn.q_norm").otherwise("Module.layers.1.linear_attn.q")
    return table(spark, d, "part").select("p_partkey", cell.alias("cell"), t.squeezed(t.without_colours(name)).alias("name"), s.block_kind(key).alias("block"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), 'none') AS k, 'none' AS missing, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp FROM events")
def json_paths(spark, d):
    return table(spark, d, "events").select("event_id", t.json_path(F.col("props"), "k", "none").alias("k"), t.json_path(F.col("props"), "a.b", "none").alias("missing"), t.stamp(F.col("ts")).alias("stamp"))


@query("""WITH x AS (SELECT event_id, event_type, event_id % 11 = 0 AS cut, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN cut THEN 'malformed' END, CASE WHEN cut OR k % 3 = 0 THEN 'protocol' END, CASE WHEN cut OR event_type IN ('purchase', 'signup') THEN 'type' END,
CASE WHEN NOT cut AND event_type IN ('view', 'error') AND k % 4 IN (2, 3) THEN 'status' END, CASE WHEN NOT cut AND k % 5 = 1 THEN 'commands' END], lambda e: e IS NOT NULL), ',') AS errors FROM x""")
def envelope_codes(spark, d):
    """Envelopes written from events: some without a protocol, with an odd status or with commands that are no list, some no JSON at all."""
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    named = F.struct(
        F.when(k % 3 != 0, k).alias("protocol"), F.when(kind == "click", "delegation_input").when(kind.isin("view", "error"), "delegation_output").otherwise(kind).alias("type"),
        F.when(k % 4 == 0, "success").when(k % 4 == 1, "failed").when(k % 4 == 2, "odd").alias("status"), F.when(k % 5 != 1, F.array(kind)).alias("commands"), F.lit("it").alias("note"),
    )
    text = F.when(k % 5 == 1, F.replace(F.to_json(named), F.lit('"note"'), F.lit('"commands"'))).otherwise(F.to_json(named))
    return table(spark, d, "events").select("event_id", F.array_join(runlog.envelope_errors(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("#"), text)).otherwise(text)), ",").alias("errors"))


THREADS = ("dev0_sq_task", "acl_thread", "hccl_comm", "mkl_x", "omp1", "pt_data_x", "api-server", "task_manager", "tokenizer0", "engine3", "idle", "other")
CLASSES = ("sq_task", "npu_fixed", "communication", "blas_worker", "openmp_worker", "dataloader", "api_server", "scheduler", "tokenizer", "engine_worker", "main_scheduler", "unknown")


@query("SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END AS kind, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {s.THREAD_SCORES[c]}" for i, c in enumerate(CLASSES)) + " END AS score FROM part")
def thread_classes(spark, d):
    k = F.col("p_partkey") % 12
    kind = s.thread_class(F.element_at(F.array(*(F.lit(x) for x in THREADS)), (k + 1).cast("int")), F.col("p_partkey"), F.when(k == 10, F.col("p_partkey")).otherwise(-1))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind")).withColumn("score", s.thread_score(F.col("kind")))


TERMS = ("the", "DATA", "Benchmark", "query")


@query("SELECT doc_id, (" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{x.lower()}') AS INTEGER)" for x in TERMS) + f") / {len(TERMS)}.0 AS coverage FROM documents")
def coverage_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", t.coverage(F.col("text"), list(TERMS)).alias("coverage"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 3) THEN '{"conv_id":' || conv_id || ',"role":"' || role || '"}' END AS payload FROM conversations""")
def fenced_payloads(spark, d):
    """The first block of each turn's text: an object, none, a list, or an object with another block behind it."""
    kind, own = F.col("turn") % 4, F.to_json(F.struct("conv_id", "role"))
    block = lambda x: F.concat(F.lit("\n```Run-IO v1 \n"), x, F.lit("\n```"))
    behind = F.when(kind == 0, block(own)).when(kind == 1, F.lit("")).when(kind == 2, block(F.concat(F.lit("["), own, F.lit("]")))).otherwise(F.concat(block(own), F.col("text"), block(F.lit('{"other": 1}'))))
    return table(spark, d, "conversations").select("conv_id", "turn", t.fenced_object(F.concat(F.coalesce("text", F.lit("")), behind), r"run-io\s+v1").alias("payload"))
