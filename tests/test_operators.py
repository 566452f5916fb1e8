"""Hand-checked cases of the operators."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import guard, textual
from tracegrain.functions import scalars as s
from tracegrain.operators import affinity, cluster, estimators, memory, profiler, runlog, sequences

MB = 1024.0**2


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("values", [[1e-5] * 10, [1e18, 1e17, 1.0], [0.1, 0.2, 2.5], [1e30, 1.0]])
def test_sum_of_doubles(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(memory.exact_sum("v").alias("x")).first().x
    assert math.isclose(got, math.fsum(values), rel_tol=1e-12)


def lit(x):
    return F.lit(x)


def test_device_overview(spark):
    rows = spark.createDataFrame([(0, 1024 * MB, 800 * MB, 1), (1, 512 * MB, 400 * MB, 0)], "d int, t double, a double, e int")
    got = {r.d: r for r in memory.device_overview(rows, "d", "t", "a", F.col("e") == 1).collect()}
    assert got[0].frag_pct == got[1].frag_pct == 21.875
    assert (got[0].expandable_count, got[1].expandable_count) == (1, 0)


def traced(spark, changes):
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate(changes)], "d int, i int, c long")
    return memory.running(rows, "d", "i", F.col("c"))


def test_peak_and_baseline(spark):
    run = traced(spark, [1024, 512, -512])
    assert memory.peaks(run, "d", "i").first()[1:] == (1536, 1)
    assert memory.baselines(run, "d", "i").first().baseline == 1536
    assert memory.peaks(traced(spark, [5, -5, 5]), "d", "i").first()[1:] == (5, 0)
    assert memory.peaks(traced(spark, [-1, -1]), "d", "i").first()[1:] == (0, 0)
    assert memory.baselines(traced(spark, [7]), "d", "i").first().baseline == 0


def test_monotonic(spark):
    assert memory.monotonic(traced(spark, [1] * 10), "d", "i").first().monotonic
    assert not memory.monotonic(traced(spark, [1, 0, -1, 2]), "d", "i").first().monotonic
    assert not memory.monotonic(traced(spark, [1]), "d", "i").first().monotonic
    assert value(spark, memory.leak_risk(lit(True), lit(0))) == "medium"
    assert value(spark, memory.leak_risk(lit(True), lit(5))) == "high"


def test_before_failures(spark):
    events = spark.createDataFrame([(0, i, "alloc", 256, None) for i in range(50, 100)] + [(0, 100, "oom", 0, None), (0, 10, "alloc", 999, None)], "d int, i int, action string, size long, stack string")
    top = memory.before_failures(events, "d", "i", F.col("action") == "oom", F.col("action") == "alloc", "size")
    assert [(r.r, r.size) for r in top.orderBy("r").collect()] == [(i, 256) for i in range(1, 6)]
    causes = memory.failure_cause(top.withColumn("stack", F.lit(None).cast("string")).withColumn("free", F.lit(128)), "failed_at", "stack", "size", "free")
    assert causes.first().cause == "same_stack"


def test_compare_snapshots(spark):
    a = spark.createDataFrame([(0x1000, 1024)], "address long, size long")
    b = spark.createDataFrame([(0x1000, 2048), (0x2000, 512)], "address long, size long")
    assert memory.new_rows(a, b, ["address"]).first().address == 0x2000
    assert [tuple(r) for r in memory.grown(a, b, "address", "size").collect()] == [(0x1000, 2048, 1024, 1024)]


def test_stack_attribution(spark):
    rows = spark.createDataFrame([(1, 60.0), (2, 30.0), (None, 10.0)], "stack int, size double")
    assert [(r.stack, r.pct) for r in memory.stack_attribution(rows, "stack", "size").collect()] == [(1, 60.0), (2, 30.0), (None, 10.0)]


def test_long_lived(spark):
    traces = spark.createDataFrame([("x", 1), ("y", 2)], "addr string, i int")
    blocks = spark.createDataFrame([("x",), ("y",)], "addr string")
    assert [r.addr for r in memory.long_lived(blocks, traces, ["addr"], "i", 2).collect()] == ["x"]


def test_rank_diff(spark):
    schema = "op string, total_time double, n long"
    got = cluster.rank_diff(spark.createDataFrame([("A", 100.0, 10), ("B", 50.0, 5), ("C", 0.0, 0)], schema), spark.createDataFrame([("A", 40.0, 10), ("D", 99.0, 1)], schema)).collect()
    assert [(r.op, r["diff"], r["ratio"], r.avg_diff) for r in got] == [("A", 60.0, 2.5, 6.0), ("B", 50.0, math.inf, 10.0), ("C", 0.0, 1.0, 0.0)]


@pytest.mark.parametrize(("name", "kind"), [("hcom_allReduce__606_0_1", "allReduce"), ("hcom_allGather_@7", "allGather_"), ("Notify_Wait@3", "Notify"), ("", "unknown")])
def test_op_type(spark, name, kind):
    assert value(spark, s.op_type(lit(name))) == kind


def test_wait_evidence(spark):
    rows = spark.createDataFrame([("op", r, st, el, w) for r, st, el, w in ((0, 1000.0, 5.0, 4.0), (1, 3000.0, 3.0, 2.0), (2, 5000.0, 1.0, 0.0))], "op string, rank int, start double, el double, wait double")
    r = cluster.wait_evidence(rows, ["op"], "rank", "start", "el", "wait").first()
    assert (r.start_span, r.end_span, r.skew, r.duration_ratio) == (4.0, 0.0, 4.0, 5.0)
    assert r.wait_ratio == pytest.approx(6 / 9)
    assert (r.earliest_rank, r.longest_rank, r.pattern) == (0, 0, "strong_wait_like")


def test_communication_stats(spark):
    rows = spark.createDataFrame([("hcom_allReduce__1_0_1", "g", 30.0), ("hcom_allReduce__1_1_1", "g", 50.0), ("hcom_send__1_0_1", "g", 20.0)], "name string, grp string, t double")
    got = {r.op_type: r for r in cluster.communication_stats(rows, "name", "grp", "t").collect()}
    assert (got["allReduce"].op_count, got["allReduce"].total_elapse, got["allReduce"].share, got["allReduce"].avg_op_elapse) == (2, 80.0, 0.8, 40.0)
    assert (got["send"].op_count, got["send"].share) == (1, 0.2)


def test_runs_and_differences(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate("ABA")], "k int, i int, name string")
    assert sequences.runs(rows, ["k"], "i", "name").count() == 3
    pairs = spark.createDataFrame([(0, 0, True, True), (0, 1, True, False)], "k int, i int, a boolean, b boolean")
    assert sequences.first_difference(pairs, ["k"], "i", F.col("a"), F.col("b")).first().at == 1
    steps = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, False), (0, 3, True)], "k int, i int, ok boolean")
    r = sequences.transition(steps, ["k"], "i", F.col("ok")).first()
    assert (r.last_good, r.first_bad, r.between) == (1, 2, 0)
    left, right = (spark.createDataFrame([(1, k, v) for k, v in x], "n int, key string, value string") for x in ((("x", "1"), ("y", "2")), (("x", "1"), ("z", "3"))))
    assert sorted(map(tuple, sequences.map_differences(left, right, ["n"], "key", "value").collect())) == [(1, "y", "2", "<MISSING>"), (1, "z", "<MISSING>", "3")]


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, up string")
    got = sequences.ancestors(nodes, nodes.filter("id in ('c', 'x')"), "id", "up").collect()
    assert sorted((r.start, r.depth, r.node) for r in got) == [("c", 0, "c"), ("c", 1, "b"), ("c", 2, "a"), ("x", 0, "x"), ("x", 1, "y")]


def test_nan_sources(spark):
    rows = spark.createDataFrame([("op", 0, True, True), ("op", 1, False, True), ("op", 2, False, False), ("ok", 0, False, False)], "op string, rank int, i boolean, o boolean")
    assert [tuple(r) for r in cluster.nan_sources(rows, "op", "rank", F.col("i"), F.col("o")).collect()] == [("op", "0", "1", "2", 3)]


def test_numbers(spark):
    for a, b, bucket in ((1.0, 1.00005, "ok"), (1.0, 1.005, "warn"), (1.0, 1.5, "alert"), (None, 1.0, "missing")):
        assert value(spark, s.error_bucket(lit(a).cast("double"), lit(b))) == bucket
    for a, b, relation in (([2, 3], [2, 3], "exact_match"), ([1, 6], [6], "singleton_compatible_numel_match"), ([2, 3], [6], "numel_match"), ([2, 3], [7], "numel_mismatch"), (None, [1], "unknown")):
        assert value(spark, s.shape_relation(F.array(*map(lit, a)) if a else lit(None).cast("array<int>"), F.array(*map(lit, b)))) == relation
    assert value(spark, s.cpu_percent(lit(100), lit(150), lit(1.0))) == 50.0
    assert value(spark, s.efficiency(lit(36))) == pytest.approx(0.68)
    assert value(spark, s.efficiency(lit(60))) == 0.5
    assert (value(spark, s.gated_score(lit(4.5), lit(False))), value(spark, s.gated_score(lit(4.5), lit(True)))) == (0.0, 0.9)
    assert value(spark, s.attention_flops(*map(lit, (1, 2, 4, 4, 8, 8)), 0)) == 1024
    assert value(spark, s.attention_flops(*map(lit, (1, 2, 4, 4, 8, 8)), 2)) == 512
    assert value(spark, s.mfu(s.gemm_flops(*map(lit, (4096, 4096, 4096))), lit(1e-3), 353.89)) == pytest.approx(0.3884, abs=1e-4)
    assert [value(spark, s.safe_double(lit(x))) for x in ("", "x", "nan", "inf", "2.5")] == [0.0, 0.0, 0.0, 0.0, 2.5]
    assert value(spark, s.bytes_text(lit(1536))) == "1.5 KB"


def test_cpu_sets(spark):
    assert value(spark, s.cpu_list(lit("0-3,8,2"))) == [0, 1, 2, 3, 8]
    assert value(spark, s.cpu_text(s.cpu_list(lit("0-3,8,2")))) == "0-3,8"
    assert value(spark, s.cpu_list(lit(""))) == []
    with pytest.raises(Exception, match="reversed"):
        value(spark, s.cpu_list(lit("5-3")))
    assert value(spark, s.is_subset(s.cpu_list(lit("")), s.cpu_list(lit("0-3")))) is False


def test_affinity(spark):
    p = spark.createDataFrame([(1, [0, 1, 2, 3], [], 2, 1, 0), (2, [0], [], 9, 0, 0)], "pid long, allowed array<int>, cgroup array<int>, threads int, npu_node int, throttled int")
    p = p.withColumns({c: F.lit(None).cast("int") for c in ("torch_threads", "omp_threads", "workers")})
    nodes = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7])], "id int, cpus array<int>")
    assert sorted((r.pid, r.rule) for r in affinity.findings(p, nodes, 8).collect()) == [(1, "R003"), (2, "R005"), (2, "R006")]
    assert sorted(tuple(r) for r in affinity.overlaps(p.withColumn("g", F.lit(1)), "pid", "allowed", ["g"]).collect()) == [(1, 1, 2, 1)]
    assert affinity.partial_siblings(p, spark.createDataFrame([([0, 4],)], "siblings array<int>")).count() == 2


def test_names(spark):
    assert value(spark, s.redacted_command(lit("run --token abc --n 2 API_KEY=zzz"))) == "run --token REDACTED --n 2 API_KEY=REDACTED"
    for name, kind in (("dev3_sq_task", "sq_task"), ("acl_thread", "npu_fixed"), ("pt_data_worker0", "dataloader"), ("hccl_x", "communication"), ("python", "main_scheduler")):
        assert value(spark, s.thread_class(lit(name), lit(1), lit(1))) == kind
    assert [value(spark, s.matches_globs(lit(v), g)) for v, g in (("a:c", ["a:*", "!a:b"]), ("a:b", ["a:*", "!a:b"]), ("a:c", ["!a:b"]))] == [True, False, False]
    assert value(spark, sequences.counterpart(lit("NPU_NPU_x"))) == "Bench_NPU_x"
    assert tuple(value(spark, s.api_parts(lit("f.input.input.0")))) == ("f.input", "input", "0")


def test_guard(spark):
    for sql, ok in (("SELECT 1", True), ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", True), ("DROP TABLE t", False), ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", False), ("CREATE VIEW v AS SELECT 1", False), ("not sql", False)):
        assert guard.is_read_only(spark, sql) is ok, sql


def test_views(spark):
    strings = spark.createDataFrame([(1, "MatMul"), (2, "Cube")], "id long, value string")
    tasks = spark.createDataFrame([(7, 100, 160, 0, 3)], "globalTaskId long, startNs long, endNs long, deviceId int, streamId int")
    info = spark.createDataFrame([(7, 1, 2), (8, 1, 9)], "globalTaskId long, name long, opType long")
    got = {r.globalTaskId: (r.op_name, r.op_type, r.durationNs) for r in profiler.compute_view(tasks, info, strings).collect()}
    assert got == {7: ("MatMul", "Cube", 60), 8: ("MatMul", None, None)}
    records = spark.createDataFrame([(0, "r", 5, 25)], "k int, record string, start long, end long")
    kernels = spark.createDataFrame([(0, "a", 4), (0, "b", 24), (0, "c", 12)], "k int, kernel string, at long")
    assert profiler.first_within(records, kernels, ["k"], 10).first().kernel == "c"


def test_runlog(spark):
    bucket = runlog.token_bucket(spark.createDataFrame([(1, 0.0, 8.0), (1, 1.0, 8.0), (1, 10.0, 5.0)], "k int, at double, cost double"), "k", "at", "cost", 1.0, 10.0).first()
    assert (bucket.passed, bucket.refused) == (2, 1)
    assert value(spark, runlog.envelope_errors(lit('{"protocol": "v1", "type": "delegation_output", "status": "odd"}'))) == ["status"]


def test_estimates(spark):
    params = value(spark, estimators.parameters(*map(lit, (4096, 11008, 32, 32, 8, 151936))))
    assert params == 6_915_358_720
    assert value(spark, estimators.tensor_parallel(lit(8), lit(32))) == 8
    assert value(spark, estimators.cache_bytes_per_token(lit(32), lit(8), lit(128), lit(8))) == 16384


def test_range_text_is_linear(spark):
    # 1,000 sets of 2,000 CPUs: minutes if each CPU looks through its set
    cpus = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: (i + F.floor(i / 500)).cast("int"))
    began = time.perf_counter()
    rows = spark.range(1000).select(s.cpu_text(F.transform(cpus, lambda i: i + F.col("id").cast("int"))).alias("text"), "id").filter(F.col("text") != F.concat_ws(",", *(F.concat_ws("-", (F.col("id") + a).cast("string"), (F.col("id") + a + 499).cast("string")) for a in (0, 501, 1002, 1503))))
    assert rows.count() == 0 and time.perf_counter() - began < 20
    assert value(spark, s.cpu_text(F.array().cast("array<int>"))) == "" and value(spark, s.cpu_text(F.lit(None).cast("array<int>"))) is None


def test_numbers_are_rounded_as_printf_does(spark):
    ns = [*range(1_000, 1_000_000, 500), *range(1_000_000, 1_000_000_000, 449_950), *range(1_050_000, 2_000_000_000, 350_000), 395_950_000, 999, 999_499, 999_500, 999_999, 9_007_199_250_050_000, 7]
    text = lambda n: f"{n / 1e6:.1f}M" if n >= 1e6 else f"{n / 1e3:.0f}K" if n >= 1e3 else str(n)
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", textual.tokens_text(F.col("n")).alias("t")).collect()
    assert [(r.n, r.t) for r in got if r.t != text(r.n)] == []
