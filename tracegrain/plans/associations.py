"""Queries on flows, call chains, first anomalies, text places, closest names, decoded views, states, formulas and macros. Users stand in for ranks, events for calls and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions import formulas, windows
from tracegrain.operators import flows, names, profiler, sequences, states
from tracegrain.plans import macros
from tracegrain.plans.catalogue import EV, query, table, traces

#: Two lanes, so each holds half of all rows; a call lasts as its value says.
LANES = "l AS (SELECT event_id, event_type, value, user_id % 2 AS lane, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 100000 AS until FROM events)"


def lanes(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 2).alias("lane"), us.alias("us"), (us + F.floor(F.col("value") * 100).cast("bigint") * 100_000).alias("until"))


@query(f"""WITH {LANES}, x AS (SELECT t.event_id, arg_min(c.event_id, (-c.us, c.until, c.event_id)) AS call, count(*) AS depth FROM l t JOIN l c ON c.lane = t.lane AND c.us <= t.us AND t.us < c.until
WHERE t.event_type IN ('purchase', 'error') AND c.event_type IN ('click', 'view') GROUP BY 1)
SELECT lane, l.event_id, us, call, coalesce(depth, 0) AS depth FROM l LEFT JOIN x USING (event_id) WHERE event_type IN ('purchase', 'error')""")
def launched_by(spark, d):
    x = lanes(spark, d)
    tasks = x.filter(F.col("event_type").isin("purchase", "error")).select("lane", "event_id", "us")
    calls = x.filter(F.col("event_type").isin("click", "view")).select("lane", F.col("event_id").alias("call"), F.col("us").alias("begin"), "until")
    return flows.launched_by(tasks, calls, ["lane"], "event_id", "us", "call", "begin", "until")


@query(f"""WITH {LANES}, c AS (SELECT lane, us AS begin, max(event_id) AS call, arg_max(event_type, event_id) AS kind FROM l WHERE event_type IN ('click', 'view') GROUP BY ALL),
j AS (SELECT t.lane, t.event_id, t.us, c.call, c.kind, t.us - c.begin AS waited FROM (SELECT * FROM l WHERE event_type IN ('purchase', 'error')) t ASOF LEFT JOIN c ON c.lane = t.lane AND t.us >= c.begin)
SELECT lane, event_id, us, CASE WHEN waited <= 600000000 THEN call END AS call, CASE WHEN waited <= 600000000 THEN kind END AS kind, CASE WHEN waited <= 600000000 THEN waited END AS waited FROM j""")
def last_call_before(spark, d):
    x = lanes(spark, d)
    tasks = x.filter(F.col("event_type").isin("purchase", "error")).select("lane", "event_id", "us")
    calls = x.filter(F.col("event_type").isin("click", "view")).select("lane", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("us").alias("begin"))
    return flows.last_before(tasks, calls, ["lane"], "us", "begin", {"call": "id", "kind": "kind"}, "id", 600_000_000)


FLOW = """f AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS flow, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 100000 AS until FROM events),
p AS (SELECT s.flow, s.event_id AS start_name, s.us AS start_at, arg_min(e.event_id, (e.us, -e.event_id)) AS end_name, min(e.us) AS end_at FROM f s LEFT JOIN f e ON e.flow = s.flow AND e.us >= s.us AND e.event_type = 'purchase' WHERE s.event_type = 'view' GROUP BY ALL)"""


def flow_events(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    flow = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select("event_id", "event_type", flow.alias("flow"), us.alias("us"), (us + F.floor(F.col("value") * 100).cast("bigint") * 100_000).alias("until"))


def paired(x):
    return flows.flow_pairs(x.filter("event_type = 'view'"), x.filter("event_type = 'purchase'"), "flow", "us", "event_id")


@query(f"WITH {FLOW} SELECT * FROM p")
def flow_pairs(spark, d):
    return paired(flow_events(spark, d))


@query(f"""WITH {FLOW}, q AS (SELECT *, flow % 3 AS track FROM p), s AS (SELECT event_id, event_type, flow % 3 AS track, us, until FROM f),
h AS (SELECT flow, start_name, arg_min(s.event_id, (-s.us, s.until, s.event_id)) AS host_slice FROM q JOIN s ON s.track = q.track AND s.us <= start_at AND start_at < s.until WHERE event_type = 'click' GROUP BY ALL),
g AS (SELECT flow, start_name, arg_min(s.event_id, (-s.us, s.until, s.event_id)) AS device_slice FROM q JOIN s ON s.track = q.track AND s.us <= end_at AND end_at < s.until WHERE event_type = 'error' GROUP BY ALL)
SELECT q.*, host_slice, device_slice, end_at - start_at AS delay FROM q LEFT JOIN h USING (flow, start_name) LEFT JOIN g USING (flow, start_name)""")
def flow_details(spark, d):
    x = flow_events(spark, d).withColumn("track", F.col("flow") % 3)
    pairs = paired(x).withColumn("track", F.col("flow") % 3)
    return flows.flow_details(pairs, x.filter("event_type = 'click'"), x.filter("event_type = 'error'"), ["track"], "event_id", "us", "until")


#: Ops of a rank by event; a third of the values stand for texts that are no numbers. Every op but the first was called by the one at half its place.
OPS = f"""{EV}, o AS (SELECT user_id, event_id, idx, CASE event_type WHEN 'click' THEN 'Torch.matmul' WHEN 'view' THEN 'Tensor.masked_fill' WHEN 'purchase' THEN 'Tensor.clone' WHEN 'signup' THEN 'NPU.my_empty' ELSE 'Functional.linear' END || '.' || idx || '.forward' AS op,
CASE event_id % 17 WHEN 3 THEN ' NaN' WHEN 5 THEN 'inf' WHEN 7 THEN '-inf' ELSE CAST(event_id AS VARCHAR) END AS hi, CASE event_id % 23 WHEN 4 THEN 'nan' WHEN 9 THEN '-inf' ELSE '0' END AS lo FROM ev)"""
CALLER = "cc AS (SELECT a.user_id, a.op, b.op AS caller FROM o a LEFT JOIN o b ON b.user_id = a.user_id AND a.idx > 0 AND b.idx = a.idx // 2)"


def ops(spark, d):
    x = traces(spark, d)
    name = F.when(F.col("event_type") == "click", "Torch.matmul").when(F.col("event_type") == "view", "Tensor.masked_fill").when(F.col("event_type") == "purchase", "Tensor.clone").when(F.col("event_type") == "signup", "NPU.my_empty").otherwise("Functional.linear")
    a, b = F.col("event_id") % 17, F.col("event_id") % 23
    hi = F.when(a == 3, " NaN").when(a == 5, "inf").when(a == 7, "-inf").otherwise(F.col("event_id").cast("string"))
    lo = F.when(b == 4, "nan").when(b == 9, "-inf").otherwise("0")
    return x.select("user_id", "event_id", "idx", F.concat(name, F.lit("."), F.col("idx").cast("string"), F.lit(".forward")).alias("op"), hi.alias("hi"), lo.alias("lo"))


def callers(x):
    up = x.select("user_id", F.col("idx").alias("up"), F.col("op").alias("caller"))
    return x.select("user_id", "op", F.when(F.col("idx") > 0, F.floor(F.col("idx") / 2)).alias("up")).join(up, ["user_id", "up"], "left").select("user_id", "op", "caller")


CHAIN = f"WITH RECURSIVE {OPS}, {CALLER}"


@query(f"""{CHAIN}, bad AS (SELECT user_id, event_id, op, lower(trim(hi)) AS hi, lower(trim(lo)) AS lo, op LIKE 'Tensor.masked_fill%' AS legal FROM o WHERE op NOT LIKE 'Tensor.clone%' AND op NOT LIKE 'NPU.%'),
w AS (SELECT user_id, event_id, op, hi IN ('nan', 'inf') OR (hi = '-inf' AND NOT legal) AS i, lo IN ('nan', 'inf') OR (lo = '-inf' AND NOT legal) AS o FROM bad),
first AS (SELECT user_id, arg_min(op, event_id) AS op, min(event_id) AS exec_order, arg_min(CASE WHEN i AND o THEN 'both' WHEN i THEN 'input' ELSE 'output' END, event_id) AS kind FROM w WHERE i OR o GROUP BY 1),
up AS (SELECT user_id, op AS start, op, 0 AS depth FROM first UNION ALL SELECT up.user_id, start, caller, depth + 1 FROM up JOIN cc ON cc.user_id = up.user_id AND cc.op = up.op WHERE caller IS NOT NULL AND depth < 50)
SELECT first.user_id, first.op, exec_order, kind, chain, event_type AS stack FROM first JOIN (SELECT user_id, start, string_agg(op, ' < ' ORDER BY depth) AS chain FROM up GROUP BY ALL) u ON u.user_id = first.user_id AND u.start = first.op JOIN events ON event_id = exec_order""")
def first_anomaly(spark, d):
    x = ops(spark, d)
    stacks = x.join(table(spark, d, "events").select("event_id", F.col("event_type").alias("stack")), "event_id")
    bad = lambda c: sequences.anomalous(F.col("op"), F.col(c))
    found = sequences.first_anomalies(x, callers(x), stacks, "user_id", "op", "event_id", bad("hi"), bad("lo"), "caller", "stack")
    return found.withColumn("chain", F.array_join("chain", " < "))


@query(f"""{CHAIN}, up AS (SELECT user_id, op AS start, op, 0 AS depth FROM o WHERE idx % 5 = 4 UNION ALL SELECT up.user_id, start, caller, depth + 1 FROM up JOIN cc ON cc.user_id = up.user_id AND cc.op = up.op WHERE caller IS NOT NULL AND depth < 50)
SELECT user_id, start AS op, string_agg(op, ' < ' ORDER BY depth) AS chain FROM up GROUP BY ALL""")
def call_chains(spark, d):
    x = ops(spark, d)
    return sequences.chains(callers(x), x.filter("idx % 5 = 4"), ["user_id", "op"], "caller").withColumn("chain", F.array_join("chain", " < "))


@query()
def text_places(spark, d):
    """Where the middle third of each document's lines, with changed space or letters, stands in the document."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    lines = F.split("text", "\n")
    n = F.size(lines)
    part = F.array_join(F.slice(lines, F.floor(n / 3).cast("int") + 1, F.ceil(n / 3).cast("int")), "\n")
    kind = F.col("doc_id") % 3
    search = F.when(kind == 0, part).when(kind == 1, F.concat(F.replace(part, F.lit("\n"), F.lit("  \n")), F.lit("  "))).otherwise(F.translate(part, "ae", "ea"))
    found = docs.withColumn("place", windows.placed(F.col("text"), search))
    return found.select("doc_id", "place.*")


@query()
def closest_names(spark, d):
    """The five part names closest to each part type, and to each brand with its type, in capitals."""
    parts = table(spark, d, "part")
    known = parts.select(F.upper("p_name").alias("name"))
    asked = parts.select(F.upper("p_type").alias("asked")).unionByName(parts.select(F.upper(F.concat_ws(" ", "p_brand", "p_type")).alias("asked")))
    return names.closest(asked, known, "asked", "name")


# ---- profiler views: the dictionary is nations and, from 1000 on, parts ----

STRINGS = "s AS (SELECT n_nationkey AS id, n_name AS value FROM nation UNION ALL SELECT 1000 + p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0)"


def strings(spark, d):
    parts = table(spark, d, "part").filter("p_partkey % 7 <> 0").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_name").alias("value"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("value")).unionByName(parts)


def days(c):
    return F.datediff(F.col(c), F.lit("1992-01-01").cast("date")).cast("bigint")


@query(f"""WITH {STRINGS}, t AS (SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate) AS a, date_diff('day', DATE '1992-01-01', o_orderdate) + o_orderkey % 50 AS b FROM orders WHERE o_orderkey % 3 <> 1)
SELECT l_orderkey, l_linenumber, n.value AS op_name, k.value AS op_type, b - a AS duration FROM lineitem LEFT JOIN t ON t.id = l_orderkey LEFT JOIN s n ON n.id = 1000 + l_partkey LEFT JOIN s k ON k.id = l_suppkey % 30""")
def compute_decoded(spark, d):
    start = days("o_orderdate")
    tasks = table(spark, d, "orders").filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("globalTaskId"), start.alias("startNs"), (start + F.col("o_orderkey") % 50).alias("endNs"), F.lit(0).alias("deviceId"), F.lit(0).alias("streamId"))
    info = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("globalTaskId"), (F.col("l_partkey") + 1000).alias("name"), (F.col("l_suppkey") % 30).alias("opType"))
    return profiler.compute_view(tasks, info, strings(spark, d)).select("l_orderkey", "l_linenumber", "op_name", F.col("op_type"), F.col("durationNs").alias("duration"))


@query(f"""WITH {STRINGS} SELECT l_orderkey, l_linenumber, n.value AS op_name, k.value AS op_type_name, g.value AS group_name, date_diff('day', o_orderdate, l_shipdate) AS duration
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN s n ON n.id = 1000 + l_partkey LEFT JOIN s k ON k.id = l_suppkey % 30 LEFT JOIN s g ON g.id = o_custkey % 40""")
def communication_decoded(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    ops = x.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1000).alias("opName"), (F.col("l_suppkey") % 30).alias("opType"), (F.col("o_custkey") % 40).alias("groupName"), days("o_orderdate").alias("startNs"), days("l_shipdate").alias("endNs"))
    return profiler.communication_view(ops, strings(spark, d)).select("l_orderkey", "l_linenumber", "op_name", "op_type_name", "group_name", F.col("durationNs").alias("duration"))


@query(f"""WITH {STRINGS} SELECT l_orderkey * 10 + l_linenumber AS task, n.value AS task_name, k.value AS api_name, g.value AS framework_name, date_diff('day', o_orderdate, l_shipdate) AS delay
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 2) o ON o_orderkey = l_orderkey LEFT JOIN (SELECT o_custkey AS conn, o_orderkey AS c FROM orders WHERE o_orderkey % 5 <> 3) x ON x.c = l_orderkey
LEFT JOIN customer ON c_custkey = conn LEFT JOIN s n ON n.id = 1000 + l_partkey LEFT JOIN s k ON k.id = o_custkey % 25 LEFT JOIN s g ON g.id = c_nationkey""")
def dispatch_decoded(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    tasks = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("globalTaskId"), F.col("l_orderkey").alias("connectionId"), days("l_shipdate").alias("startNs"), days("l_shipdate").alias("endNs"), (F.col("l_partkey") + 1000).alias("taskType"))
    runtime = o.filter("o_orderkey % 4 <> 2").select(F.col("o_orderkey").alias("connectionId"), (F.col("o_custkey") % 25).alias("name"), days("o_orderdate").alias("startNs"))
    connections = o.filter("o_orderkey % 5 <> 3").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("connectionId"))
    framework = c.select(F.col("c_custkey").alias("connectionId"), F.col("c_nationkey").alias("name"), F.lit(0).alias("startNs"))
    return profiler.dispatch_view(tasks, runtime, connections, framework, strings(spark, d)).select(F.col("globalTaskId").alias("task"), "task_name", "api_name", "framework_name", F.col("dispatch_delay").alias("delay"))


@query(f"""WITH m AS (SELECT user_id, event_id AS record, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 1000000 AS b FROM events WHERE event_type = 'signup')
SELECT m.user_id, record, arg_min(event_id, (epoch_us(ts), event_id)) AS kernel, min(epoch_us(ts)) AS "at" FROM m JOIN events e ON e.user_id = m.user_id AND epoch_us(ts) >= a AND epoch_us(ts) < b AND event_type = 'click' GROUP BY ALL""")
def first_kernels(spark, d):
    """The first kernel that starts within each mark's time."""
    x = traces(spark, d)
    records = x.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("record"), F.col("us").alias("start"), (F.col("us") + F.floor(F.col("value") * 100).cast("bigint") * 1_000_000).alias("end"))
    kernels = x.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("kernel"), F.col("us").alias("at"))
    return profiler.first_within(records, kernels, ["user_id"], 3_600_000_000)


# ---- states, formulas and macros ----


@query("""WITH e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_id % 100 END AS tokens, CASE WHEN event_type = 'view' THEN event_id END AS seen, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS name FROM events),
m AS (SELECT user_id, name, arg_max(event_id, event_id) AS v FROM e GROUP BY ALL), j AS (SELECT user_id, string_agg(name || '=' || v, ',' ORDER BY name) AS files FROM m GROUP BY 1)
SELECT user_id, count(*) AS updates, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, coalesce(max(seen), 0) AS seen, any_value(files) AS files FROM e JOIN j USING (user_id) GROUP BY 1""")
def reduced_states(spark, d):
    name = (F.get_json_object("props", "$.k").cast("bigint") % 5).cast("string")
    x = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).alias("tokens"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("seen"), F.create_map(name, F.col("event_id")).alias("files"))
    found = states.reduced(x, "user_id", "event_id", ["tokens"], ["seen"], ["files"])
    return found.withColumn("files", F.array_join(F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_id % 3 AS item, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
l AS (SELECT user_id, max(run) AS last_run FROM e GROUP BY 1),
x AS (SELECT *, lead(event_type) OVER w AS nxt, lead(event_id) OVER w AS nxt_at FROM e WHERE event_type IN ('click', 'view', 'error') WINDOW w AS (PARTITION BY user_id, run, item ORDER BY event_id))
SELECT user_id, CAST(run AS BIGINT) AS run, item, event_id AS called_at, CASE WHEN nxt = 'error' THEN nxt_at END AS result_at, CASE WHEN nxt = 'error' THEN 'done' WHEN nxt IS NOT NULL THEN 'replaced' WHEN run < last_run THEN 'expired' ELSE 'pending' END AS state
FROM x JOIN l USING (user_id) WHERE event_type IN ('click', 'view')""")
def call_states(spark, d):
    kind = F.col("event_type")
    x = table(spark, d, "events").withColumn("item", F.col("event_id") % 3)
    return states.calls(x, "user_id", "event_id", "item", kind == "signup", kind.isin("click", "view"), kind == "error")


@query("""SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 2.0 * (p_size + 1) * 64 * 32 WHEN 1 THEN 2.0 * (p_partkey % 7 + 1) * (p_size + 1) * 64 * 32 ELSE CAST(p_size AS DOUBLE) * p_size * 12 END AS flops FROM part""")
def registered_flops(spark, d):
    """Standard formulas beside one that is registered for the query."""
    own = formulas.standard()
    own.register("Conv")(lambda m, n, k, batch: m.cast("double") * m * 12 / 1.0)
    part = table(spark, d, "part")
    kind = F.element_at(F.array(F.lit("MatMul"), F.lit("BatchMatMul"), F.lit("Conv")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = F.when(F.col("p_partkey") % 3 == 2, F.col("p_size")).otherwise(F.col("p_size") + 1)
    return part.select("p_partkey", "p_size", own.column(kind, m=rows, n=F.lit(64), k=F.lit(32), batch=F.col("p_partkey") % 7 + 1).alias("flops"))


def snapshot_tables(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    devices = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") % 5).cast("bigint").alias("device_index"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("device_id"))
    orders = table(spark, d, "orders").join(customers, "o_custkey")
    segments = orders.select(F.col("o_orderkey").alias("id"), "device_id", cents("o_totalprice").alias("total_size"), (cents("o_totalprice") - F.col("o_orderkey") % 1000).alias("allocated_size"), F.lit(0).cast("bigint").alias("active_size"), (F.col("o_orderstatus") == "O").cast("int").alias("is_expandable"))
    blocks = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("segment_id"), F.col("l_linestatus").alias("state"), cents("l_extendedprice").alias("size"))
    return {"devices": devices, "segments": segments, "blocks": blocks}


SNAPSHOT = "seg AS (SELECT o_orderkey AS id, n_nationkey % 5 AS device_index, CAST(round(o_totalprice * 100) AS BIGINT) AS t, o_orderkey % 1000 AS rest, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


@query(f"""WITH {SNAPSHOT} SELECT device_index, CAST(sum(t) AS BIGINT) AS reserved_bytes, CAST(sum(t - rest) AS BIGINT) AS allocated_bytes, CAST(0 AS BIGINT) AS active_bytes, round(CAST(sum(rest) * 100.0 / nullif(sum(t), 0) AS DOUBLE), 2) AS frag_pct, count(*) AS segment_count,
CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS expandable_segments FROM seg GROUP BY 1""")
def macro_overview(spark, d):
    macros.install(spark, **snapshot_tables(spark, d))
    return spark.sql("SELECT * FROM device_overview(NULL)")


@query(f"WITH {SNAPSHOT} SELECT device_index, l_linestatus AS state, count(*) AS block_count, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_size, avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS avg_size FROM lineitem JOIN seg ON id = l_orderkey WHERE device_index = 3 GROUP BY ALL")
def macro_blocks(spark, d):
    macros.install(spark, **snapshot_tables(spark, d))
    return spark.sql("SELECT * FROM block_state_dist(3)")
