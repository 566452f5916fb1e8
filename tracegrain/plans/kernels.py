"""Queries on kernels, marks, gaps, groups, serving limits and review texts. Line items stand in for kernels, the nations of their suppliers for devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions import textual as t
from tracegrain.operators import cluster, estimators, kernels
from tracegrain.plans.associations import LANES, STRINGS, lanes, strings
from tracegrain.plans.catalogue import SEG, dec, query, segments, table


def shares_sql(keys, device, value):
    return f"""a AS (SELECT {device}, {keys}, count(*) AS n, {dec(value)} AS total, min({value}) AS min_value, max({value}) AS max_value FROM segs GROUP BY ALL),
b AS (SELECT *, total / n AS mean_value FROM a), w AS (SELECT {device}, {dec('total')} AS whole FROM b GROUP BY 1)"""


@query(f"""WITH {SEG}, {shares_sql('l_partkey', 'n_name', 'l_quantity')},
r AS (SELECT b.*, total * 100.0 / nullif(whole, 0) AS share_pct, row_number() OVER (PARTITION BY n_name ORDER BY total DESC, l_partkey) AS place FROM b JOIN w USING (n_name)) SELECT * FROM r WHERE place <= 10""")
def top_kernels(spark, d):
    return kernels.top_kernels(segments(spark, d), ["n_name"], ["l_partkey"], "l_quantity")


def spread_sql(by):
    return f"a AS (SELECT {by}, count(*) AS kernels, {dec('allocated')} AS total FROM segs GROUP BY ALL), w AS (SELECT sum(kernels) AS k, {dec('total')} AS t FROM a) SELECT a.*, kernels * 100.0 / k AS kernels_pct, total * 100.0 / nullif(t, 0) AS total_pct FROM a, w"


@query(f"WITH {SEG}, {spread_sql('n_name')}")
def kernel_devices(spark, d):
    return kernels.spread(segments(spark, d), ["n_name"], "allocated")


@query(f"WITH {SEG}, {spread_sql('l_returnflag, l_linestatus')}")
def kernel_cores(spark, d):
    return kernels.spread(segments(spark, d), ["l_returnflag", "l_linestatus"], "allocated")


@query(f"""WITH {SEG}, s AS (SELECT *, l_returnflag = 'R' AS dyn FROM segs), a AS (SELECT n_name, l_linestatus, count(*) FILTER (dyn) AS dynamic, count(*) FILTER (NOT dyn) AS static, {dec("(CASE WHEN dyn THEN l_quantity ELSE 0.0 END)")} AS dynamic_time,
{dec("(CASE WHEN dyn THEN 0.0 ELSE l_quantity END)")} AS static_time FROM s GROUP BY ALL) SELECT *, dynamic / nullif(static, 0) AS dynamic_ratio FROM a""")
def kernel_shapes(spark, d):
    return kernels.dynamic_split(segments(spark, d), ["n_name", "l_linestatus"], F.col("l_returnflag") == "R", "l_quantity")


@query(f"""WITH {STRINGS} SELECT l_orderkey, l_linenumber, m.value AS text FROM lineitem JOIN s d ON d.id = l_suppkey % 30 JOIN s m ON m.id = 1000 + l_partkey WHERE d.value = (SELECT min(n_name) FROM nation)""")
def domain_marks(spark, d):
    """Marks of the domain whose name comes first; some messages and domains are in no dictionary."""
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]  # one value
    events = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 30).alias("domain"), (F.col("l_partkey") + 1000).alias("message"))
    return kernels.marks(events, strings(spark, d), "domain", "message", first).select("l_orderkey", "l_linenumber", "text")


@query(f"""WITH {LANES}, m AS (SELECT lane, event_id AS record, us AS a, until AS b, (1 + event_id % 97) * 1e13 AS flops FROM l WHERE event_type = 'signup'), k AS (SELECT lane, event_id AS kernel, us, until FROM l WHERE event_type = 'click'),
f AS (SELECT lane, record, arg_min(kernel, (us, kernel, until)) AS kernel, arg_min(until - us, (us, kernel, until)) / 1e6 AS seconds FROM m JOIN k USING (lane) WHERE us >= a AND us < b GROUP BY ALL),
x AS (SELECT m.lane, m.record, flops, f.kernel, seconds, flops / nullif(seconds, 0) / 1e12 AS tflops, flops / nullif(seconds, 0) / 1e12 / 80.0 AS mfu FROM m LEFT JOIN f USING (lane, record))
SELECT *, CASE WHEN mfu < 0.2 THEN 'low' WHEN mfu < 0.3 THEN 'between' WHEN mfu <= 0.6 THEN 'fair' WHEN mfu <= 0.7 THEN 'between' WHEN mfu IS NOT NULL THEN 'high' END AS band FROM x""")
def marked_work(spark, d):
    x = lanes(spark, d)
    records = x.filter("event_type = 'signup'").select("lane", F.col("event_id").alias("record"), F.col("us").alias("start"), F.col("until").alias("end"), ((1 + F.col("event_id") % 97) * F.lit(1e13)).alias("flops"))
    work = x.filter("event_type = 'click'").select("lane", F.col("event_id").alias("kernel"), F.col("us").alias("at"), "until")
    return kernels.marked_work(records, work, ["lane"], 600_000_000, 80.0)


@query(f"""WITH {LANES}, g AS (SELECT user_id % 7 AS track, e.event_id, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(e.value) AS BIGINT) * 10000000 AS until, 200000000 + e.event_id % 5 * 100000000 AS step FROM events e WHERE event_type IN ('purchase', 'signup')),
b AS (SELECT user_id % 7 AS track, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS until FROM events WHERE event_type IN ('click', 'view')),
q AS (SELECT g.*, NOT EXISTS (FROM b WHERE b.track = g.track AND b.us < b.until AND b.us < g.until AND b.until > g.us) AS quiet FROM g)
SELECT *, (until - us) / step AS share, quiet AND (until - us) / step > 0.1 AS host_bound FROM q""")
def schedule_gaps(spark, d):
    us, kind = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type")
    x = table(spark, d, "events").select((F.col("user_id") % 7).alias("track"), "event_id", "event_type", us.alias("us"), F.floor("value").cast("bigint").alias("long"))
    gaps = x.filter(kind.isin("purchase", "signup")).select("track", "event_id", "us", (F.col("us") + F.col("long") * 10_000_000).alias("until"), (200_000_000 + F.col("event_id") % 5 * 100_000_000).alias("step"))
    runs = x.select("event_type", "track", "us", (F.col("us") + F.col("long") * 1_000_000).alias("until"))
    return kernels.schedule_gaps(gaps, runs.filter(kind == "click"), runs.filter(kind == "view"), ["track"], "us", "until", "step")


@query(f"""WITH g AS (SELECT n_name AS group_name, n_nationkey AS group_id, r_name AS pg_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 6 <> 5),
t AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'Total Op Info' ELSE l_returnflag END AS op, CASE WHEN l_linenumber = 7 THEN NULL ELSE n_name END AS hash, l_quantity AS elapsed FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT op, coalesce(hash, '') AS group_name, coalesce(CAST(group_id AS VARCHAR), '') AS group_id, coalesce(pg_name, '') AS pg_name, {dec('elapsed')} AS total_elapse, {dec('elapsed')} / count(elapsed) AS avg_elapse, max(elapsed) AS max_elapse
FROM t LEFT JOIN g ON coalesce(t.hash, '') = g.group_name WHERE op <> 'Total Op Info' GROUP BY ALL""")
def group_stats(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("pg_name"))
    groups = table(spark, d, "nation").filter("n_nationkey % 6 <> 5").join(regions, "n_regionkey").select(F.col("n_name").alias("group_name"), F.col("n_nationkey").alias("group_id"), "pg_name")
    rows = segments(spark, d).select(F.when(F.col("l_returnflag") == "N", "Total Op Info").otherwise(F.col("l_returnflag")).alias("op"), F.when(F.col("l_linenumber") != 7, F.col("n_name")).alias("hash"), F.col("l_quantity").alias("elapsed"))
    return cluster.group_stats(rows, groups, "op", "hash", "elapsed")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gpu' ELSE 'npu' END AS platform, p_size % 2 = 0 AS moe, CASE WHEN p_partkey % 5 = 0 THEN p_size * 10 ELSE 0 END AS own, 1 + p_size % 32 AS kv, CASE WHEN p_size % 3 = 0 THEN 'int8' ELSE 'bfloat16' END AS dtype,
p_size * 150 AS tin, p_partkey % 4000 AS tout, CASE p_partkey % 4 WHEN 0 THEN 'throughput' WHEN 1 THEN 'ttft' WHEN 2 THEN 'balanced' ELSE 'other' END AS aim, p_partkey % 60 - 5 AS slo FROM part),
y AS (SELECT *, CASE WHEN platform = 'npu' AND own > 0 THEN own WHEN platform = 'npu' THEN CASE WHEN moe THEN 384 ELSE 512 END ELSE CASE WHEN moe THEN 512 ELSE 4096 END END AS sequences,
CASE WHEN platform = 'npu' AND own > 0 THEN own * 64 WHEN platform = 'npu' THEN 32768 ELSE 131072 END AS tokens, CASE WHEN kv < 32 AND dtype = 'int8' THEN 3192 WHEN kv < 32 OR dtype = 'int8' THEN 2048 ELSE 1024 END AS margin FROM x),
z AS (SELECT *, least(10240, CASE WHEN tin + tout < 5000 THEN 8192 ELSE (tin + tout + margin + 1023) // 1024 * 1024 END) AS length, kv * 1024.0 AS per FROM y)
SELECT p_partkey, sequences, tokens, margin, length, greatest(0.02, least(0.5, CASE aim WHEN 'throughput' THEN 0.22 WHEN 'ttft' THEN 0.08 ELSE 0.15 END * (tin / length) * (tin / length))) AS prefill,
CASE WHEN slo > 0 THEN greatest(1, CAST(floor(greatest(1.0, slo - 5.0) * CASE platform WHEN 'npu' THEN 1000.0 ELSE 1500.0 END / ((tin + tout) * per / 1e9 * 1000.0)) AS BIGINT)) ELSE 1000000000 END AS concurrent FROM z""")
def serving_limits(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = table(spark, d, "part").select(
        "p_partkey", F.when(k % 3 == 0, "gpu").otherwise("npu").alias("platform"), (size % 2 == 0).alias("moe"), F.when(k % 5 == 0, size * 10).otherwise(0).alias("own"), (1 + size % 32).alias("kv"),
        F.when(size % 3 == 0, "int8").otherwise("bfloat16").alias("dtype"), (size * 150).alias("tin"), (k % 4000).alias("tout"),
        F.when(k % 4 == 0, "throughput").when(k % 4 == 1, "ttft").when(k % 4 == 2, "balanced").otherwise("other").alias("aim"), (k % 60 - 5).alias("slo"),
    )
    c, e = F.col, estimators
    x = x.withColumn("margin", e.context_margin(F.lit(32), c("kv"), c("dtype"))).withColumn("length", e.model_length(F.lit(10240), c("tin"), c("tout"), c("margin")))
    return x.select(
        "p_partkey", e.sequences_ceiling(c("platform"), c("moe"), c("own")).alias("sequences"), e.tokens_ceiling(c("platform"), c("own") * 64).alias("tokens"), "margin", "length",
        e.prefill_share(c("aim"), c("tin"), c("length")).alias("prefill"), e.bandwidth_ceiling(c("platform"), c("slo"), c("tin") + c("tout"), c("kv") * F.lit(1024.0)).alias("concurrent"),
    )


@query(r"""WITH h AS (SELECT doc_id, source, text, md5(coalesce(text, '')) AS m, regexp_extract_all(coalesce(text, ''), '(?i)\b([0-9a-f]{7,40})\b', 1) AS found FROM documents),
x AS (SELECT *, list_filter(found, lambda w: length(w) = 40 OR regexp_matches(w, '(?i)[a-f]')) AS ids, substr(m, 1, 12) AS own FROM h)
SELECT doc_id, coalesce(ids[1], '') AS commit_id, CASE WHEN source IS NULL THEN '' WHEN regexp_matches(own, '[a-f]') THEN source ELSE source || ' ' || own END AS branch, doc_id % 101 || '/100' AS score FROM x""")
def review_marks(spark, d):
    """Commit ids in whole texts; branches from sources with a digest behind them (some of digits only, which are no commit ids); scores."""
    label = F.concat(F.col("source"), F.lit(" (commit id: "), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12), F.lit(")"))
    scored = F.concat(F.coalesce("source", F.lit("")), F.lit("\nscore： `"), (F.col("doc_id") % 101).cast("string"), F.lit("/100` or so"))
    return table(spark, d, "documents").select("doc_id", t.commit_of(F.col("text")).alias("commit_id"), t.branch_of(label).alias("branch"), t.score_of(scored, "score").alias("score"))


@query(r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> '') AS l FROM documents)
SELECT doc_id, len(l) AS lines, array_to_string(l, '|') AS risks FROM x""")
def numbered_risks(spark, d):
    """Each document's lines, numbered under a heading between two other lists, are found again."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(".  "), x)), "\n")
    report = F.concat(F.lit("1. before\n- Other\n2. other\n- Risks: \n"), body, F.lit("\n  - After\n3. after"))
    found = t.numbered_under(report, "Risks")
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("lines"), F.array_join(found, "|").alias("risks"))
