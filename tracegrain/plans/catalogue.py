"""Queries by name over the star schema and the event table, and the SQL that DuckDB runs for the same rows.

The tables stand in for profiler data: nations are devices, line items are segments and blocks, parts are stacks and
dictionaries, events are traces, users are ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions import scalars as s
from tracegrain.operators import affinity, cluster, estimators, memory, runlog, sequences
from tracegrain.operators.memory import exact_sum

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their device; nations and suppliers are small, and Spark broadcasts them if they are."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    where = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(nations, "s_nationkey")
    return table(spark, d, "lineitem").withColumn("allocated", F.col("l_extendedprice") * (1 - F.col("l_discount"))).join(where, "l_suppkey")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Events with micros, and their index within their user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("idx", F.row_number().over(w) - 1).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


SEG = "segs AS (SELECT l.*, l_extendedprice * (1 - l_discount) AS allocated, n_name, n_regionkey, s_nationkey FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"
EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, epoch_us(ts) AS us FROM events)"
RUN = "run AS (SELECT *, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM ev)"
dec = lambda x: f"(CAST(sum(CAST({x} AS DECIMAL(38,8))) AS DOUBLE) + sum({x} - CAST(CAST({x} AS DECIMAL(38,8)) AS DOUBLE)))"


# ---- memory ----


@query(f"""WITH {SEG}, a AS (SELECT n_name, {dec('l_extendedprice')} AS total_size, {dec('allocated')} AS allocated_size, count(*) AS segment_count,
CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS expandable_count FROM segs GROUP BY n_name)
SELECT *, (total_size - allocated_size) * 100.0 / nullif(total_size, 0) AS frag_pct FROM a""")
def device_overview(spark, d):
    return memory.device_overview(segments(spark, d), "n_name", "l_extendedprice", "allocated", F.col("l_linestatus") == "O")


@query(f"WITH {SEG}, a AS (SELECT n_regionkey, l_linestatus, count(*) AS n, {dec('l_extendedprice')} AS total_size FROM segs GROUP BY ALL) SELECT *, total_size / n AS avg_size FROM a")
def block_state_dist(spark, d):
    return memory.distribution(segments(spark, d), ["n_regionkey", "l_linestatus"], "l_extendedprice")


@query(f"WITH a AS (SELECT o_orderpriority, count(*) AS n, {dec('o_totalprice')} AS total_size FROM orders GROUP BY ALL) SELECT *, total_size / n AS avg_size FROM a")
def segment_type_dist(spark, d):
    return memory.distribution(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("SELECT 'segments' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'blocks', count(*) FROM lineitem UNION ALL SELECT 'devices', count(*) FROM nation UNION ALL SELECT 'traces', count(*) FROM events")
def entity_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(e).alias("entity"), "n") for e, t in (("segments", "orders"), ("blocks", "lineitem"), ("devices", "nation"), ("traces", "events"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""WITH a AS (SELECT l_orderkey, {dec('l_extendedprice')} AS t, {dec('l_extendedprice * (1 - l_discount)')} AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, t AS total_size, a AS allocated_size, t - a AS waste, (t - a) * 100.0 / nullif(t, 0) AS frag_pct FROM a""")
def fragmentation_detail(spark, d):
    rows = table(spark, d, "lineitem").withColumn("allocated", F.col("l_extendedprice") * (1 - F.col("l_discount"))).groupBy("l_orderkey").agg(exact_sum("l_extendedprice").alias("t"), exact_sum("allocated").alias("a"))
    return memory.fragmentation_detail(rows, ["l_orderkey"], "t", "a")


TOP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"


@query(TOP + " WHERE l_linestatus = 'O' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def top_allocations(spark, d):
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    top = memory.top_by(rows, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 20)
    return top.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")


@query(f"""WITH a AS (SELECT l_partkey, {dec('l_extendedprice')} AS total_size, count(*) AS n FROM lineitem GROUP BY 1)
SELECT *, total_size * 100.0 / (SELECT {dec('l_extendedprice')} FROM lineitem) AS pct FROM a ORDER BY total_size DESC, l_partkey LIMIT 10""")
def stack_attribution(spark, d):
    return memory.stack_attribution(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND event_id BETWEEN 100 AND 5000")
def trace_range(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase") & F.col("event_id").between(100, 5000)).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def net_trend(spark, d):
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return memory.running(table(spark, d, "events"), "user_id", "event_id", delta).select("event_id", "user_id", "event_type", "running")


def reserved(spark, d):
    """Running value in hundredths."""
    sign = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return memory.running(traces(spark, d), "user_id", "event_id", sign * F.round(F.col("value") * 100).cast("bigint"))


@query(f"""WITH {EV}, {RUN}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY greatest(running, 0) DESC, event_id) AS k FROM run)
SELECT user_id, CAST(greatest(running, 0) AS BIGINT) AS peak, event_id AS peak_at FROM r WHERE k = 1""")
def peak_per_device(spark, d):
    return memory.peaks(reserved(spark, d), "user_id", "event_id")


@query(f"""WITH {EV}, {RUN}, n AS (SELECT user_id, greatest(1, count(*) // 10) AS cut FROM run GROUP BY 1)
SELECT n.user_id, CAST(coalesce(max(running), 0) AS BIGINT) AS baseline FROM n LEFT JOIN run ON run.user_id = n.user_id AND idx = cut GROUP BY 1""")
def baseline_per_device(spark, d):
    return memory.baselines(reserved(spark, d), "user_id", "event_id")


@query(f"""WITH {EV}, {RUN}, l AS (SELECT *, lag(running) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM run)
SELECT user_id, count(*) AS n, bool_and(b IS NULL OR running >= b) AND arg_max(running, event_id) > arg_min(running, event_id) AND count(*) >= 2 AS monotonic FROM l GROUP BY 1""")
def monotonic_growth(spark, d):
    return memory.monotonic(reserved(spark, d), "user_id", "event_id")


@query(f"""WITH {EV}, p AS (SELECT f.user_id, f.idx AS failed_at, a.idx AS alloc_at, a.value AS size, row_number() OVER (PARTITION BY f.user_id, f.idx ORDER BY a.value DESC, a.idx) AS r
FROM ev f JOIN ev a ON a.user_id = f.user_id AND a.idx BETWEEN f.idx - 50 AND f.idx WHERE f.event_type = 'error' AND a.event_type = 'purchase')
SELECT user_id, failed_at, r, alloc_at, size FROM p WHERE r <= 5""")
def oom_context_top5(spark, d):
    return memory.before_failures(traces(spark, d), "user_id", "idx", F.col("event_type") == "error", F.col("event_type") == "purchase", "value")


@query(f"""WITH {EV}, n AS (SELECT user_id, CAST(count(*) * 0.2 AS INTEGER) AS x, floor(count(*) * 0.2) AS cut FROM ev GROUP BY 1), f AS (SELECT user_id, event_type, min(idx) AS first_seen FROM ev GROUP BY ALL)
SELECT f.user_id, f.event_type, f.first_seen FROM f JOIN n USING (user_id) WHERE f.first_seen < n.cut""")
def long_lived_blocks(spark, d):
    x = traces(spark, d)
    cut = x.groupBy("user_id").agg(F.floor(F.count("*") * F.lit(0.2)).alias("cut"))
    return x.groupBy("user_id", "event_type").agg(F.min("idx").alias("first_seen")).join(cut, "user_id").filter("first_seen < cut").drop("cut")


def spend(spark, d, late: bool):
    rows = table(spark, d, "orders").filter((F.year("o_orderdate") >= 2000) == late)
    return rows.groupBy("o_custkey").agg(exact_sum("o_totalprice").alias("size"))


SPEND = f"b AS (SELECT o_custkey, {dec('o_totalprice')} AS size FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1), a AS (SELECT o_custkey, {dec('o_totalprice')} AS size FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY 1)"


@query(f"WITH {SPEND} SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)")
def snapshot_new(spark, d):
    return memory.new_rows(spend(spark, d, False), spend(spark, d, True), ["o_custkey"])


@query(f"WITH {SPEND} SELECT o_custkey, a.size AS new_size, b.size AS old_size, a.size - b.size AS growth FROM a JOIN b USING (o_custkey) WHERE a.size > b.size")
def snapshot_grown(spark, d):
    return memory.grown(spend(spark, d, False), spend(spark, d, True), "o_custkey", "size")


# ---- ranks ----


@query(f"""WITH x AS (SELECT l_linestatus, p_type AS op, {dec('l_extendedprice')} AS t, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT * FROM x WHERE l_linestatus = 'O'), f AS (SELECT * FROM x WHERE l_linestatus = 'F')
SELECT s.op, s.t AS slow_time, s.n AS slow_n, coalesce(f.t, 0) AS fast_time, coalesce(f.n, 0) AS fast_n, s.t - coalesce(f.t, 0) AS diff,
CASE WHEN coalesce(f.t, 0) <> 0 THEN s.t / f.t WHEN s.t <> 0 THEN 'inf'::DOUBLE ELSE 1 END AS ratio, s.t / s.n - coalesce(f.t / f.n, 0) AS avg_diff FROM s LEFT JOIN f USING (op) ORDER BY abs(s.t - coalesce(f.t, 0)) DESC, op LIMIT 20""")
def op_rank_diff(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    side = lambda status: cluster.op_stats(rows.filter(F.col("l_linestatus") == status), "p_type", "l_extendedprice")
    return cluster.rank_diff(side("O"), side("F"))


COMM = "c AS (SELECT 'hcom_' || event_type || '__' || (user_id % 10) || '_0_1' AS name, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'g' || (user_id % 3) END AS grp, value FROM events)"


@query(f"""WITH {COMM}, a AS (SELECT name, coalesce(grp, '') AS comm_group, {dec('value')} AS total, max(value) AS longest FROM c GROUP BY ALL),
b AS (SELECT comm_group, split_part(replace(name, 'hcom_', ''), '__', 1) AS op_type, count(*) AS op_count, {dec('total')} AS total_elapse, max(longest) AS max_elapse FROM a GROUP BY ALL)
SELECT *, total_elapse / (SELECT {dec('total_elapse')} FROM b) AS share, total_elapse / op_count AS avg_op_elapse FROM b""")
def comm_stats(spark, d):
    name = F.concat(F.lit("hcom_"), "event_type", F.lit("__"), (F.col("user_id") % 10).cast("string"), F.lit("_0_1"))
    rows = table(spark, d, "events").select(name.alias("name"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string"))).alias("grp"), "value")
    return cluster.communication_stats(rows, "name", "grp", "value")


@query(f"""WITH x AS (SELECT l_returnflag, p_type, c_nationkey, s_nationkey, l_quantity, l_extendedprice, l_extendedprice / nullif(l_quantity, 0) / 100 AS bw FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT l_returnflag, count(*) AS row_count, count(DISTINCT p_type) AS op_count, count(DISTINCT c_nationkey || '->' || s_nationkey) AS pair_count, {dec('l_quantity')} AS total_size, {dec('l_extendedprice')} AS total_time,
min(bw) AS min_bw, max(bw) AS max_bw, CAST(sum(CASE WHEN bw < 10 THEN 1 ELSE 0 END) AS BIGINT) AS low_count, {dec('bw')} / count(bw) AS avg_bw FROM x GROUP BY 1""")
def link_overview(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").join(p, "l_partkey").join(u, "l_suppkey")
    bw = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)) / 100
    return cluster.link_overview(rows, ["l_returnflag"], "p_type", "c_nationkey", "s_nationkey", "l_quantity", "l_extendedprice", bw)


@query(f"""WITH {EV}, x AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id AS rank, CAST(us AS DOUBLE) AS st, value AS el, value * 0.3 AS w, us + value * 1000 AS en FROM ev),
g AS (SELECT day, event_type, count(*) AS rank_count, {dec('w')} AS sum_wait, {dec('el')} AS sum_elapsed, max(w) AS max_wait, max(el) AS max_elapsed, min(el) AS min_elapsed, (max(st) - min(st)) / 1000 AS start_span, (max(en) - min(en)) / 1000 AS end_span,
first(rank ORDER BY st, rank) AS earliest_rank, first(rank ORDER BY st DESC, rank) AS latest_rank, first(rank ORDER BY el DESC, st, rank) AS longest_rank, first(rank ORDER BY el, st, rank) AS shortest_rank FROM x GROUP BY ALL), h AS (SELECT *, max_elapsed - min_elapsed AS skew FROM g)
SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day), sum_wait / sum_elapsed AS wait_ratio, max_elapsed / greatest(min_elapsed, 1e-9) AS duration_ratio,
CASE WHEN start_span > 0 AND end_span <= greatest(1, 0.1 * start_span) AND skew > 0 AND earliest_rank = longest_rank THEN 'strong_wait_like' WHEN end_span < start_span AND skew > 0 THEN 'weak_wait_like' ELSE 'not_obvious' END AS pattern FROM h""")
def wait_evidence(spark, d):
    rows = traces(spark, d).withColumn("day", F.to_date("ts").cast("string")).withColumn("wait", F.col("value") * 0.3)
    return cluster.wait_evidence(rows, ["day", "event_type"], "user_id", "us", "value", "wait")


@query(f"""WITH c AS (SELECT coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS op_name, l_extendedprice FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT op_name, count(*) AS calls, {dec('l_extendedprice')} AS total_duration, max(l_extendedprice) AS longest FROM c GROUP BY 1 ORDER BY total_duration DESC, op_name LIMIT 20""")
def compute_view_topk(spark, d):
    rows = cluster.decoded(table(spark, d, "lineitem").select("l_partkey", "l_extendedprice"), "l_partkey", table(spark, d, "part"), "p_partkey", "p_name", "op_name")
    return rows.groupBy("op_name").agg(F.count("*").alias("calls"), exact_sum("l_extendedprice").alias("total_duration"), F.max("l_extendedprice").alias("longest")).orderBy(F.desc("total_duration"), "op_name").limit(20)


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cn.n_name AS group_name, sn.n_name AS type_name, p_name AS op_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN part ON p_partkey = l_partkey""")
def comm_view(spark, d):
    n = table(spark, d, "nation")
    role = lambda key, to: n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(to))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(role("c_nationkey", "group_name"), "c_nationkey", "left")
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(role("s_nationkey", "type_name"), "s_nationkey", "left")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("l_orderkey"), "group_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("op_name"))
    x = table(spark, d, "lineitem").join(o, "l_orderkey").join(u, "l_suppkey", "left").join(p, "l_partkey", "left")
    return x.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "group_name", "type_name", "op_name")


@query("SELECT c_custkey, o_orderkey, count(l_orderkey) AS n_lines, date_diff('day', min(o_orderdate), min(l_shipdate)) AS delay FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def dispatch_view(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.min("l_shipdate").alias("shipped"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate").join(lines, "o_orderkey", "left")
    x = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return x.select("c_custkey", "o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.datediff("shipped", "o_orderdate").cast("bigint").alias("delay"))


SUM = f"count(v) AS n, {dec('v')} / count(v) AS mean_value, stddev_samp(v) AS std_value, min(v) AS min_value, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median_value, quantile_cont(v, 0.75) AS q3, max(v) AS max_value, {dec('v')} AS sum_value"


def typed(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("v")).join(p, "l_partkey")


@query(f"WITH x AS (SELECT p_type, l_returnflag, l_extendedprice AS v FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT p_type, l_returnflag, {SUM} FROM x GROUP BY ALL")
def op_summary_all(spark, d):
    return cluster.summary(typed(spark, d), ["p_type", "l_returnflag"], "v")


@query(f"WITH x AS (SELECT l_suppkey, p_type, l_extendedprice AS v FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_suppkey, p_type, {SUM} FROM x GROUP BY ALL")
def op_summary_rank(spark, d):
    return cluster.summary(typed(spark, d), ["l_suppkey", "p_type"], "v")


@query(f"""WITH x AS (SELECT event_type, user_id, {dec('value')} AS v FROM events GROUP BY ALL), e AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1)
SELECT event_type, string_agg(CASE WHEN v = lo THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id) AS min_ranks, string_agg(CASE WHEN v = hi THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id) AS max_ranks FROM x JOIN e USING (event_type) GROUP BY 1""")
def api_summary(spark, d):
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(exact_sum("value").alias("v"))
    return cluster.extreme_ranks(per, ["event_type"], "user_id", "v")


@query(f"""WITH x AS (SELECT event_type, count(*) AS n, {dec('value')} AS total, {dec('value')} / count(value) AS mean_value, min(value) AS min_value, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max_value, first(epoch_us(ts) ORDER BY value DESC, event_id) AS max_at FROM events GROUP BY 1) SELECT * FROM x""")
def api_percentiles(spark, d):
    return cluster.percentiles(traces(spark, d), "event_type", "value", "us", "event_id")


def intervals(spark, d):
    length = F.floor(F.col("value") * 100).cast("bigint") * 100_000
    return traces(spark, d).select(F.to_date("ts").cast("string").alias("day"), "event_type", F.col("us").alias("a"), (F.col("us") + length).alias("b"))


IV = "iv AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 100000 AS b FROM events)"


@query(f"""WITH {IV}, x AS (SELECT *, max(b) OVER (PARTITION BY day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv)
SELECT day, min(a) AS first_start, max(b) AS last_end, CAST(coalesce(sum(greatest(a - p, 0)), 0) AS BIGINT) AS free_time, CAST(sum(CASE WHEN a > p THEN 1 ELSE 0 END) AS BIGINT) AS gaps, coalesce(max(greatest(a - p, 0)), 0) AS largest_gap,
max(b) - min(a) AS span, CAST(max(b) - min(a) - coalesce(sum(greatest(a - p, 0)), 0) AS BIGINT) AS busy_time FROM x GROUP BY 1""")
def free_gaps(spark, d):
    return cluster.busy_time(intervals(spark, d), ["day"], "a", "b")


@query(f"""WITH {IV}, e AS (SELECT day, a AS t, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS c, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS v FROM iv WHERE event_type IN ('click', 'view')
UNION ALL SELECT day, b, CASE WHEN event_type = 'click' THEN -1 ELSE 0 END, CASE WHEN event_type = 'view' THEN -1 ELSE 0 END FROM iv WHERE event_type IN ('click', 'view')),
s AS (SELECT day, t, lead(t) OVER w AS n, sum(c) OVER w AS c, sum(v) OVER w AS v FROM (SELECT day, t, sum(c) AS c, sum(v) AS v FROM e GROUP BY ALL) WINDOW w AS (PARTITION BY day ORDER BY t))
SELECT day, CAST(coalesce(sum(n - t) FILTER (c > 0), 0) AS BIGINT) AS time_a, CAST(coalesce(sum(n - t) FILTER (v > 0), 0) AS BIGINT) AS time_b, CAST(coalesce(sum(n - t) FILTER (c > 0 AND v > 0), 0) AS BIGINT) AS time_both FROM s GROUP BY 1""")
def time_summary(spark, d):
    return cluster.overlap_time(intervals(spark, d), ["day"], "a", "b", "event_type", "click", "view")


@query("""WITH x AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a || '>' || b || '>' || c AS pattern, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY 1""")
def seq_ngrams(spark, d):
    return sequences.ngrams(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@query("SELECT p_brand, coalesce(string_agg(DISTINCT CASE WHEN p_size BETWEEN 8 AND 18 THEN CAST(p_size AS VARCHAR) END, ',' ORDER BY CASE WHEN p_size BETWEEN 8 AND 18 THEN CAST(p_size AS VARCHAR) END), '') AS normal_sizes, count(*) FILTER (p_size NOT BETWEEN 8 AND 18) AS abnormal FROM part GROUP BY 1")
def freq_sets(spark, d):
    normal = F.col("p_size").between(8, 18)
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set(F.when(normal, F.col("p_size").cast("string")))), ",").alias("normal_sizes"), F.count_if(~normal).alias("abnormal"))


@query(f"WITH {SEG}, x AS (SELECT n_regionkey, n_name, {dec('l_quantity')} AS q FROM segs GROUP BY ALL) SELECT n_regionkey, max(q) AS max_load, min(q) AS min_load, max(q) - min(q) AS spread FROM x GROUP BY 1")
def ep_load(spark, d):
    per = segments(spark, d).groupBy("n_regionkey", "n_name").agg(exact_sum("l_quantity").alias("q"))
    return per.groupBy("n_regionkey").agg(F.max("q").alias("max_load"), F.min("q").alias("min_load"), (F.max("q") - F.min("q")).alias("spread"))


@query(f"""WITH {EV}, x AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, first(user_id ORDER BY value, user_id) AS slow_rank FROM ev GROUP BY ALL) SELECT slow_rank, count(*) AS affected FROM x GROUP BY 1""")
def slow_rank_votes(spark, d):
    return cluster.slow_ranks(traces(spark, d).withColumn("day", F.to_date("ts").cast("string")), ["day", "event_type"], "user_id", "value")


# ---- sequences and comparison ----


@query(f"""WITH {EV}, x AS (SELECT a.user_id, a.idx, a.event_type = b.event_type AS i, CAST(a.value AS INTEGER) % 2 = CAST(b.value AS INTEGER) % 2 AS o FROM ev a JOIN ev b ON b.user_id = a.user_id + 1 AND b.idx = a.idx)
SELECT user_id, min(idx) AS at FROM x WHERE i AND NOT o GROUP BY 1""")
def first_diff(spark, d):
    x = traces(spark, d).select("user_id", "idx", "event_type", (F.rint("value").cast("int") % 2).alias("v"))
    y = x.select((F.col("user_id") - 1).alias("user_id"), "idx", F.col("event_type").alias("other_type"), F.col("v").alias("other_v"))
    return sequences.first_difference(x.join(y, ["user_id", "idx"]), ["user_id"], "idx", F.col("event_type") == F.col("other_type"), F.col("v") == F.col("other_v"))


@query("""WITH x AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n FROM y GROUP BY user_id, run""")
def rle_groups(spark, d):
    return sequences.runs(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query(f"""WITH {EV}, b AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN idx END) AS first_bad FROM ev GROUP BY 1),
g AS (SELECT ev.user_id, max(idx) AS last_good FROM ev JOIN b USING (user_id) WHERE event_type <> 'error' AND (first_bad IS NULL OR idx < first_bad) GROUP BY 1)
SELECT user_id, first_bad, last_good, CASE WHEN first_bad IS NULL OR last_good IS NULL THEN 0 ELSE greatest(first_bad - last_good - 1, 0) END AS "between" FROM b LEFT JOIN g USING (user_id)""")
def transition(spark, d):
    return sequences.transition(traces(spark, d), ["user_id"], "idx", F.col("event_type") != "error")


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT start, node // 2, depth + 1 FROM w WHERE node > 0 AND depth < 50) SELECT start, node, depth FROM w""")
def hierarchy_walk(spark, d):
    nodes = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("up"))
    return sequences.ancestors(nodes, nodes, "p_partkey", "up")


@query("""WITH x AS (SELECT event_type, user_id, bool_or(value > 450) AS i, bool_or(value > 400) AS o FROM events GROUP BY ALL)
SELECT event_type, coalesce(string_agg(CASE WHEN i THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id), '') AS source, coalesce(string_agg(CASE WHEN NOT i AND o THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id), '') AS propagated,
coalesce(string_agg(CASE WHEN NOT i AND NOT o THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id), '') AS normal, count(*) AS n_ranks FROM x GROUP BY 1 HAVING bool_or(i) OR bool_or(o)""")
def nan_sources(spark, d):
    return cluster.nan_sources(table(spark, d, "events"), "event_type", "user_id", F.col("value") > 450, F.col("value") > 400)


@query(f"""WITH m AS (SELECT l_partkey, {dec('l_extendedprice')} / {dec('l_quantity')} AS unit FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN unit IS NULL THEN 'missing' WHEN abs(p_retailprice - unit) / greatest(abs(unit), 1e-12) <= 0.0001 THEN 'ok' WHEN abs(p_retailprice - unit) / greatest(abs(unit), 1e-12) <= 0.01 THEN 'warn' ELSE 'alert' END AS bucket FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def rel_err_buckets(spark, d):
    unit = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((exact_sum("l_extendedprice") / exact_sum("l_quantity")).alias("unit"))
    return table(spark, d, "part").join(unit, "p_partkey", "left").select("p_partkey", s.error_bucket(F.col("p_retailprice"), F.col("unit")).alias("bucket"))


@query("""WITH x AS (SELECT p_partkey, [p_size % 3, p_size % 5] AS a, [p_size % 5, p_size % 3] AS b FROM part)
SELECT p_partkey, CASE WHEN a = b THEN 'exact_match' WHEN list_filter(a, lambda x: x <> 1) = list_filter(b, lambda x: x <> 1) THEN 'singleton_compatible_numel_match' WHEN a[1] * a[2] = b[1] * b[2] THEN 'numel_match' ELSE 'numel_mismatch' END AS relation FROM x""")
def shape_relation(spark, d):
    a, b = F.col("p_size") % 3, F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", s.shape_relation(F.array(a, b), F.array(b, a)).alias("relation"))


# ---- sets and affinity ----


@query("""SELECT p_partkey, p_size + 4 AS n_cpus, CAST(p_partkey % 50 AS VARCHAR) || '-' || CAST(p_partkey % 50 + p_size + 2 AS VARCHAR) || ',' || CAST(200 AS VARCHAR) AS text FROM part""")
def cpuset_ops(spark, d):
    low = F.col("p_partkey") % 50
    given = F.concat(F.lit("200,"), low.cast("string"), F.lit("-"), (low + F.col("p_size") + 1).cast("string"), F.lit(","), (low + F.col("p_size") + 2).cast("string"))
    cpus = s.cpu_list(given)
    return table(spark, d, "part").select("p_partkey", cpus.alias("cpus")).select("p_partkey", F.size("cpus").alias("n_cpus"), s.cpu_text(F.col("cpus")).alias("text"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), y AS (SELECT n_name, l_suppkey, l_orderkey FROM x JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT a.n_name, a.l_suppkey, b.l_suppkey AS other, count(*) AS shared FROM y a JOIN y b ON a.n_name = b.n_name AND a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def overlap_pairs(spark, d):
    return affinity.sharing(segments(spark, d), "l_suppkey", "l_orderkey", ["n_name"])


@query("""WITH p AS (SELECT s_suppkey AS pid, s_suppkey % 64 AS lo, s_suppkey % 64 + s_nationkey AS hi, s_nationkey + 1 AS n, s_nationkey % 4 AS node, s_suppkey % 40 AS threads FROM supplier)
SELECT pid, 'R004' AS rule FROM p WHERE n >= 51 UNION ALL SELECT pid, 'R005' FROM p WHERE n < greatest(1, threads // 2) UNION ALL SELECT pid, 'R006' FROM p WHERE threads > n
UNION ALL SELECT pid, 'R003' FROM p WHERE NOT (lo <= node * 16 + 15 AND hi >= node * 16)""")
def affinity_rules(spark, d):
    low = (F.col("s_suppkey") % 64).cast("int")
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), F.sequence(low, low + F.col("s_nationkey")).alias("allowed"), F.array().cast("array<int>").alias("cgroup"), (F.col("s_suppkey") % 40).cast("int").alias("threads"), (F.col("s_nationkey") % 4).cast("int").alias("npu_node"), *(F.lit(None).cast("int").alias(c) for c in ("throttled", "torch_threads", "omp_threads", "workers")))
    nodes = spark.range(4).select(F.col("id").cast("int").alias("id"), F.sequence((F.col("id") * 16).cast("int"), (F.col("id") * 16 + 15).cast("int")).alias("cpus"))
    return affinity.findings(p, nodes, 64).select("pid", "rule")


# ---- logs ----


@query("""WITH r AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') SELECT c.conv_id, c.turn, c.text, r.turn + 1 AS result_at, r.text AS result FROM conversations c LEFT JOIN r USING (conv_id, turn) WHERE c.role = 'user'""")
def tool_pairing(spark, d):
    c = table(spark, d, "conversations")
    results = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("at"), "text")
    return runlog.paired_calls(c.filter("role = 'user'").select("conv_id", "turn", "text"), results, ["conv_id", "turn"], "at")


@query("SELECT conv_id, max(turn) AS latest FROM conversations GROUP BY 1")
def latest_per_thread(spark, d):
    return runlog.latest(table(spark, d, "conversations"), "conv_id", "turn")


@query("""WITH x AS (SELECT conv_id, count(*) * 6 AS calls, bool_or(role = 'assistant') AS gates, least(5.0, max(turn) * 0.9) AS rubric FROM conversations GROUP BY 1),
y AS (SELECT *, greatest(0.5, least(1.0, 1.0 - greatest(calls - 20, 0) * 0.02)) AS efficiency, CASE WHEN gates THEN rubric / 5.0 ELSE 0.0 END AS score FROM x)
SELECT conv_id, calls, gates, CAST(rubric AS DOUBLE) AS rubric, CAST(efficiency AS DOUBLE) AS efficiency, CAST(score AS DOUBLE) AS score, CAST(score AS DOUBLE) * CAST(efficiency AS DOUBLE) AS final_score FROM y""")
def run_report(spark, d):
    runs = table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") * 6).alias("c"), F.bool_or(F.col("role") == "assistant").alias("g"), F.least(F.lit(5.0), F.max("turn") * F.lit(0.9)).alias("r"))
    return runlog.run_report(runs, "conv_id", F.col("c"), F.col("g"), F.col("r"))


@query("""WITH x AS (SELECT conv_id, length(text) // 4 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
y AS (SELECT conv_id, CAST(sum(t) AS BIGINT) AS tokens_before, CAST(sum(CASE WHEN r <= 2 THEN t ELSE 0 END) AS BIGINT) AS tokens_after, CAST(sum(CASE WHEN r > 2 THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM x GROUP BY 1)
SELECT *, (tokens_before - tokens_after) * 100.0 / nullif(tokens_before, 0) AS saved_pct FROM y""")
def history_offload(spark, d):
    return runlog.offload(table(spark, d, "conversations"), "conv_id", "turn", "text", 2)


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", s.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'widget|engine', 'i') THEN 'deny' WHEN regexp_matches(p_name, '^small') THEN 'allow' ELSE 'ask' END AS decision FROM part")
def first_rule(spark, d):
    return runlog.first_rule(table(spark, d, "part"), "p_name", [("(?i)widget|engine", "deny"), ("^small", "allow")]).select("p_partkey", "decision")


@query("SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'malformed' ELSE 'protocol,type' END AS errors FROM events")
def json_validate(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(runlog.envelope_errors(F.col("props")), ",").alias("errors"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'blas|mkl|openblas', 'i') THEN 'blas_worker' WHEN p_partkey % 3 = 0 THEN 'main_scheduler' ELSE 'unknown' END AS kind FROM part""")
def thread_class(spark, d):
    return table(spark, d, "part").select("p_partkey", s.thread_class(F.col("p_name"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).otherwise(-1)).alias("kind"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages")
def page_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"), F.trim(F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1)).alias("title"))


@query(r"""SELECT doc_id, regexp_replace(text, '\b(token|password|passwd|secret|api[_-]?key)(["'']?\s*[:=]\s*["'']?)([^\s"'']+)', '\1\2REDACTED', 'gi') AS text FROM documents""")
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", s.redacted_text(F.col("text")).alias("text"))


# ---- estimates ----


@query("""WITH x AS (SELECT p_partkey, 2.0 * p_size * 128 * 64 * 1 AS flops, p_retailprice / 1e9 AS sec FROM part), y AS (SELECT p_partkey, flops / nullif(sec, 0) / 1e12 / 353.89 AS mfu FROM x)
SELECT *, CASE WHEN mfu < 0.2 THEN 'low' WHEN mfu < 0.3 THEN 'between' WHEN mfu <= 0.6 THEN 'fair' WHEN mfu <= 0.7 THEN 'between' ELSE 'high' END AS band FROM y""")
def mfu_bands(spark, d):
    share = s.mfu(s.gemm_flops(F.col("p_size"), F.lit(128), F.lit(64)), F.col("p_retailprice") / F.lit(1e9), 353.89)
    return table(spark, d, "part").select("p_partkey", share.alias("mfu")).withColumn("band", s.mfu_band(F.col("mfu")))


@query("SELECT p_partkey, 2e0 * 2 * 8 * p_size * 64 * 128 AS dense, 2e0 * 2 * 8 * p_size * 64 * 128 * CASE WHEN p_size = 64 THEN 0.5 WHEN p_size > 64 THEN 0.5 * 64 / p_size ELSE 1 - 0.5 * p_size / 64 END AS causal FROM part")
def attn_flops(spark, d):
    f = lambda mode: s.attention_flops(F.lit(2), F.lit(8), F.col("p_size"), F.lit(64), F.lit(64), F.lit(64), mode)
    return table(spark, d, "part").select("p_partkey", f(0).alias("dense"), f(2).alias("causal"))


@query("""WITH x AS (SELECT p_partkey, (p_size % 8 + 1) AS cards FROM part), y AS (SELECT p_partkey, (SELECT max(n) FROM range(1, 9) r(n) WHERE cards % n = 0 AND 32 % n = 0) AS tp FROM x)
SELECT p_partkey, CAST(tp AS INTEGER) AS tp, CAST(floor(48 * 1073741824.0 / (2 * 32 * ceil(8.0 / tp) * 128 * 2.0 * 4608)) AS BIGINT) AS batch FROM y""")
def kv_capacity(spark, d):
    x = table(spark, d, "part").select("p_partkey", estimators.tensor_parallel(F.col("p_size") % 8 + 1, F.lit(32)).alias("tp"))
    per = estimators.cache_bytes_per_token(F.lit(32), F.lit(8), F.lit(128), F.col("tp"))
    return x.withColumn("batch", estimators.batch_capacity(F.lit(48 * estimators.GIB), per, F.lit(4608)))


@query("""WITH x AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)
SELECT vec_id, list_max(list_transform(list_zip(embedding, nxt), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS max_diff FROM x WHERE nxt IS NOT NULL""")
def weights_diff(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    x = table(spark, d, "embeddings").withColumn("nxt", F.lead("embedding").over(w)).filter("nxt is not null")
    apart = F.zip_with("embedding", "nxt", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return x.select("vec_id", F.array_max(apart).alias("max_diff"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events),
b AS (SELECT user_id, i, t, CASE WHEN value <= 500 THEN 500 - value ELSE 500 END AS level, CAST(value <= 500 AS BIGINT) AS passed, CAST(value > 500 AS BIGINT) AS refused FROM e WHERE i = 1
UNION ALL SELECT user_id, i, t, CASE WHEN now >= value THEN now - value ELSE now END, passed + CAST(now >= value AS BIGINT), refused + CAST(now < value AS BIGINT)
FROM (SELECT e.*, passed, refused, least(500, level + (e.t - b.t) * 0.01) AS now FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, arg_max(passed, i) AS passed, arg_max(refused, i) AS refused, arg_max(level, i) AS level FROM b GROUP BY 1""")
def token_bucket(spark, d):
    return runlog.token_bucket(traces(spark, d).withColumn("at", F.col("us") / 1e6), "user_id", "at", "value", 0.01, 500.0)


# ---- extensions: what the analyses above do not need themselves ----


@query(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {dec('o_totalprice')} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), exact_sum("o_totalprice").alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def ext_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(epoch_us(ts)) AS started, count(*) AS n FROM y GROUP BY user_id, k""")
def ext_sessions(spark, d):
    x = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return x.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros(F.col("session_window.start")).alias("started"), "n")
