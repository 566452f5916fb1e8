"""Queries that compare two runs of a model, with SQL. Users stand in for runs or dumps, events for modules or tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.operators import comparison
from tracegrain.plans.catalogue import EV, query, table, traces

KEYS = f"""{EV}, t AS (SELECT user_id, event_id, idx, event_type, 'Module.layers.' || (idx % 3) || CASE event_type WHEN 'click' THEN '.mlp.fc' WHEN 'view' THEN '.self_attn.q' WHEN 'purchase' THEN '.act_fn' WHEN 'signup' THEN '.linear_q_down_proj' ELSE '.norm' END || event_id AS train_key,
'Module.model.' || CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'fused_qkv_a_proj' WHEN event_type = 'purchase' THEN 'act_fn' ELSE 'block' END || event_id AS rollout_key FROM ev),
st AS (SELECT *, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'aligned' WHEN 2 THEN 'aligned' ELSE 'mismatch' END AS output, CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' ELSE 'aligned' END AS parameter,
CASE WHEN event_id % 3 = 0 THEN 'mismatch' WHEN event_id % 11 = 0 THEN 'missing' ELSE 'aligned' END AS arguments, CASE event_id % 6 WHEN 0 THEN 'partial' WHEN 1 THEN 'not_applicable' WHEN 2 THEN NULL ELSE 'aligned' END AS named FROM t),
ip AS (SELECT *, CASE WHEN arguments = 'mismatch' OR named = 'mismatch' THEN 'mismatch' WHEN arguments IN ('aligned', 'partial') OR named IN ('aligned', 'partial') THEN 'aligned' ELSE 'missing' END AS inp,
lower(train_key) LIKE '%linear_q_down_proj%' AND lower(rollout_key) LIKE '%fused_qkv_a_proj%' AS fused FROM st),
bk AS (SELECT *, CASE WHEN output = 'mismatch' AND inp = 'aligned' AND fused THEN 'fused_qkv_structural_mismatch' WHEN output = 'aligned' AND parameter = 'aligned' AND inp = 'aligned' THEN 'normal_aligned'
WHEN output = 'aligned' AND (parameter = 'missing' OR named IS NULL OR named = 'partial') THEN 'comparison_premise_abnormal_but_output_aligned' WHEN output = 'aligned' THEN 'internal_difference_but_output_aligned' WHEN output IS NULL THEN 'insufficient_output_evidence'
WHEN inp = 'aligned' AND parameter = 'aligned' THEN 'module_impl_mismatch' WHEN inp = 'aligned' THEN 'parameter_sync_mismatch' WHEN parameter = 'aligned' THEN 'upstream_propagation_or_amplification' ELSE 'systemic_misalignment' END AS bucket FROM ip),
md AS (SELECT *, CASE WHEN bucket = 'normal_aligned' THEN 4 WHEN output = 'aligned' OR bucket LIKE 'fused%' THEN 5 WHEN bucket LIKE 'insufficient%' THEN 3 WHEN bucket IN ('module_impl_mismatch', 'parameter_sync_mismatch') THEN 1 ELSE 2 END AS module_rank,
CASE WHEN lower(train_key) LIKE '%.mlp.%' THEN 'mlp' WHEN lower(train_key) LIKE '%self_attn%' THEN 'attn' WHEN lower(train_key) LIKE '%norm%' THEN 'norm' ELSE 'other' END AS block FROM bk)"""


def modules(spark, d):
    """Events as modules of both sides, with their places, and what is aligned."""
    n, kind = F.col("event_id"), F.col("event_type")
    part = F.when(kind == "click", ".mlp.fc").when(kind == "view", ".self_attn.q").when(kind == "purchase", ".act_fn").when(kind == "signup", ".linear_q_down_proj").otherwise(".norm")
    other = F.when((kind == "signup") & (n % 2 == 0), "fused_qkv_a_proj").when(kind == "purchase", "act_fn").otherwise("block")
    x = traces(spark, d).select("user_id", "event_id", "idx", F.concat(F.lit("Module.layers."), (F.col("idx") % 3).cast("string"), part, n.cast("string")).alias("train_key"), F.concat(F.lit("Module.model."), other, n.cast("string")).alias("rollout_key"))
    x = x.withColumn("output", F.when(n % 7 == 0, None).when((n % 7).isin(1, 2), "aligned").otherwise("mismatch"))
    x = x.withColumn("parameter", F.when(n % 4 == 0, "missing").when(n % 4 == 1, "mismatch").otherwise("aligned"))
    x = x.withColumn("arguments", F.when(n % 3 == 0, "mismatch").when(n % 11 == 0, "missing").otherwise("aligned"))
    x = x.withColumn("named", F.when(n % 6 == 0, "partial").when(n % 6 == 1, "not_applicable").when(n % 6 == 2, None).otherwise("aligned"))
    found = comparison.module_bucket(F.col("train_key"), F.col("rollout_key"), F.col("output"), F.col("parameter"), F.col("arguments"), F.col("named"))
    return x.withColumn("_m", found).select("*", F.col("_m.bucket").alias("bucket"), F.col("_m.rank").alias("module_rank")).drop("_m")


@query(f"WITH {KEYS} SELECT bucket, module_rank, count(*) AS n, min(event_id) AS first_event FROM md GROUP BY ALL")
def module_buckets(spark, d):
    return modules(spark, d).groupBy("bucket", "module_rank").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH tr AS (SELECT DISTINCT o_custkey % 20 AS run, 'm' || (o_orderkey % 50) AS key FROM orders), mp AS (SELECT i AS k, CASE i % 4 WHEN 0 THEN [] WHEN 1 THEN ['r' || i] ELSE ['r' || i, 'r' || (i + 1), 'r' || i] END AS peers FROM range(40) x(i)),
ro AS (SELECT DISTINCT c_custkey % 20 AS run, 'r' || (c_custkey // 20 % 45) AS key FROM customer), ex AS (SELECT DISTINCT 'm' || k AS key, unnest(peers) AS peer FROM mp), fo AS (SELECT tr.run, tr.key, string_agg(peer, ',' ORDER BY peer) AS rollout_keys, count(*) AS n FROM tr JOIN ex USING (key) JOIN ro ON ro.run = tr.run AND ro.key = ex.peer GROUP BY ALL)
SELECT run, key, coalesce(rollout_keys, '') AS rollout_keys, CASE WHEN n IS NULL THEN '1:0' WHEN n = 1 THEN '1:1' ELSE '1:N' END AS cardinality, CASE WHEN n IS NULL THEN 'low' ELSE 'high' END AS confidence FROM tr LEFT JOIN fo USING (run, key)""")
def module_mapping(spark, d):
    train = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("run"), F.concat(F.lit("m"), (F.col("o_orderkey") % 50).cast("string")).alias("key")).distinct()
    rollout = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("run"), F.concat(F.lit("r"), (F.floor(F.col("c_custkey") / 20) % 45).cast("string")).alias("key"))
    i = F.col("id")
    of = lambda x: F.concat(F.lit("r"), x.cast("string"))
    peers = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(of(i))).otherwise(F.array(of(i), of(i + 1), of(i)))
    mapping = spark.range(40).select(F.concat(F.lit("m"), i.cast("string")).alias("key"), peers.alias("peers"))
    return comparison.mapped(train, mapping, rollout, "run", "key", "peers").withColumn("rollout_keys", F.array_join("rollout_keys", ","))


@query(f"""WITH {KEYS}, ma AS (SELECT *, max(CASE WHEN output = 'aligned' THEN idx END) OVER (PARTITION BY user_id, idx % 3, block ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS boundary_at FROM md WHERE event_id % 5 <> 0),
su AS (SELECT * FROM ma WHERE module_rank IN (1, 2) AND NOT fused),
gap AS (SELECT s.event_id, count(*) AS missing_train, count(*) FILTER (u.event_id % 10 = 0) AS missing_rollout, arg_min(u.train_key, u.idx) FILTER (u.event_type = 'purchase') AS first_train, arg_min(u.rollout_key, u.idx) FILTER (u.event_type = 'purchase' AND u.event_id % 10 = 0) AS first_rollout
FROM su s JOIN t u ON u.user_id = s.user_id AND u.idx > s.boundary_at AND u.idx < s.idx WHERE u.event_id % 5 = 0 GROUP BY 1),
cl AS (SELECT s.*, coalesce(missing_train, 0) AS missing_train, coalesce(missing_rollout, 0) AS missing_rollout, first_train, first_rollout, CASE WHEN first_train IS NOT NULL OR first_rollout IS NOT NULL THEN 'missing_or_extra_op_between_aligned_boundary' WHEN bucket = 'parameter_sync_mismatch' THEN 'parameter_or_checkpoint_issue' WHEN bucket = 'module_impl_mismatch' THEN 'in_module_impl_difference' ELSE 'upstream_propagation' END AS class FROM su s LEFT JOIN gap g USING (event_id))
SELECT cl.user_id, row_number() OVER (PARTITION BY cl.user_id ORDER BY CASE WHEN class LIKE 'missing%' THEN 0 ELSE 1 END, module_rank, cl.idx) AS place, cl.train_key, cl.rollout_key, module_rank, bucket, class, b.train_key AS boundary, missing_train, missing_rollout, first_train, first_rollout
FROM cl LEFT JOIN t b ON b.user_id = cl.user_id AND b.idx = cl.boundary_at""")
def root_cause_suspects(spark, d):
    x = modules(spark, d)
    pairs = x.filter("event_id % 5 <> 0").withColumns({"at": F.col("idx"), "train_pos": F.col("idx"), "rollout_pos": F.col("idx")})
    matched = (F.col("event_id") % 5 != 0).alias("matched")
    train = x.select("user_id", F.col("idx").alias("pos"), F.col("train_key").alias("key"), matched)
    rollout = x.filter("event_id % 10 <> 5").select("user_id", F.col("idx").alias("pos"), F.col("rollout_key").alias("key"), matched)
    return comparison.suspects(pairs, train, rollout, "user_id")


DUMP = f"""{EV}, du AS (SELECT user_id, idx // 6 AS part, idx, event_type AS api, event_id % 2 = 0 AS is_input, event_id % 6 <> 1 AND event_id % 10 <> 4 AS same FROM ev),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, part ORDER BY idx ROWS UNBOUNDED PRECEDING) AS place FROM (SELECT *, CASE WHEN lag(api) OVER (PARTITION BY user_id, part ORDER BY idx) = api THEN 0 ELSE 1 END AS nw FROM du)),
ap AS (SELECT user_id, part, CAST(place AS BIGINT) AS place, min(api) AS api, bool_and(NOT is_input OR same) AS input_match, bool_and(is_input OR same) AS output_match FROM gr GROUP BY user_id, part, place)"""
DUMPS = ["user_id", "part"]


def states(spark, d):
    n = F.col("event_id")
    rows = traces(spark, d).withColumn("api", F.col("event_type")).withColumn("part", F.floor(F.col("idx") / 6))
    return comparison.api_states(rows, DUMPS, "idx", "api", n % 2 == 0, (n % 6 != 1) & (n % 10 != 4))


@query(f"WITH {DUMP} SELECT * FROM ap")
def dump_api_states(spark, d):
    return states(spark, d)


@query(f"""WITH {DUMP}, us AS (SELECT * FROM ap WHERE api <> 'view'), mk AS (SELECT user_id, part, min(CASE WHEN input_match AND NOT output_match THEN place END) AS hit, min(CASE WHEN NOT input_match THEN place END) AS bad FROM us GROUP BY ALL),
gd AS (SELECT user_id, part, max(place) AS good FROM us JOIN mk USING (user_id, part) WHERE input_match AND output_match AND (bad IS NULL OR place < bad) GROUP BY ALL),
al AS (SELECT * FROM mk LEFT JOIN gd USING (user_id, part)), nm AS (SELECT user_id, part, place, api FROM ap)
SELECT al.user_id, al.part, h.api AS first_api, CASE WHEN hit IS NULL THEN g.api END AS last_good, CASE WHEN hit IS NULL THEN b.api END AS first_bad, CASE WHEN hit IS NULL AND bad IS NOT NULL AND good IS NOT NULL THEN greatest(bad - good - 1, 0) WHEN hit IS NULL THEN 0 END AS between
FROM al LEFT JOIN nm h ON h.user_id = al.user_id AND h.part = al.part AND h.place = hit LEFT JOIN nm b ON b.user_id = al.user_id AND b.part = al.part AND b.place = bad LEFT JOIN nm g ON g.user_id = al.user_id AND g.part = al.part AND g.place = good""")
def dump_first_problem(spark, d):
    return comparison.first_problem(states(spark, d), DUMPS, "api", F.col("api") == "view")


@query(f"""WITH {EV}, nm AS (SELECT user_id, idx, CASE WHEN event_id % 5 = 0 THEN '' WHEN user_id % 3 = 0 THEN 'Module.' || event_type WHEN event_type = 'error' THEN 'Functional.add' ELSE 'Cell.' || event_type END AS name FROM ev)
SELECT user_id, coalesce(bool_and(name LIKE 'Module.%' OR name LIKE 'Cell.%') FILTER (name <> ''), false) AS modules_only FROM nm WHERE idx < 100 GROUP BY 1""")
def dump_modules_only(spark, d):
    kind = F.col("event_type")
    name = F.when(F.col("event_id") % 5 == 0, "").when(F.col("user_id") % 3 == 0, F.concat(F.lit("Module."), kind)).when(kind == "error", "Functional.add").otherwise(F.concat(F.lit("Cell."), kind))
    return comparison.modules_only(traces(spark, d).withColumn("name", name), ["user_id"], "idx", "name")
