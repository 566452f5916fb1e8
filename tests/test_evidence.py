"""Hand-checked cases of compared values, audit logs, completions, drawn ways and sizes."""

import re

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import scalars
from tracegrain.operators import audit, sequences, values
from tracegrain.plans import evidence

TENSOR = "run long, key string, target string, name string, dtype string, shape array<bigint>, Max double, Min double, Mean double, Norm double"


def tensors(spark, key, rows):
    return spark.createDataFrame([(1, key, t, n, "fp32", shape, *stats) for t, n, shape, stats in rows], TENSOR)


@pytest.fixture
def both(spark):
    pairs = spark.createDataFrame([(1, "a.linear_q_down_proj", "b.fused_qkv_a_proj"), (1, "lone", "none")], "run long, train_key string, rollout_key string")
    train = [("output.0", None, [2, 3], (1.0, 0.0, 0.5, None)), ("parameters.weight", None, [4], (1.0, 1.0, 1.0, 1.0)), ("input_args.0", None, [1, 2], (float("nan"), 0.0, 0.0, 0.0)), ("input_kwargs", "x", None, (None,) * 4), ("input_kwargs", "y", [1], (1.0,) * 4)]
    rollout = [("output.0", None, [3, 2], (1.00005, 0.0, 0.5, 7.0)), ("parameters.weight", None, [4], (1.005, 1.0, 1.0, 1.0)), ("input_args.0", None, [2], (1.0, 0.0, 0.0, 0.0)), ("input_kwargs", "x", [1], (1.0,) * 4)]
    return pairs, tensors(spark, "a.linear_q_down_proj", train), tensors(spark, "b.fused_qkv_a_proj", rollout)


def test_values_of_two_runs(both):
    got = {(r.target, r.name): (r.consistency, r.relation, r.worst_metric, r["rank"], r.bucket, r.status) for r in values.compared(*both).collect()}
    assert got == {
        ("output.0", ""): ("match", "numel_match", "ok", 3, "value_match_shape_mismatch", "warn"),
        ("parameters.weight", ""): ("mismatch", "exact_match", "warn", 5, "parameter_mismatch_output_aligned", "info"),
        ("input_args.0", ""): ("mismatch", "singleton_compatible_numel_match", "alert", 1, "value_mismatch_numel_match", "alert"),
        ("input_kwargs", "x"): ("match", "unknown", "ok", 4, "value_match_shape_match", "ok"),
        ("input_kwargs", "y"): ("missing", "unknown", "missing", None, "missing_compare_target", "missing_on_rollout"),
    }


def test_statuses_of_modules(both):
    pairs, train, rollout = both
    modules = values.module_statuses(pairs, values.compared(pairs, train, rollout))
    got = {r.train_key: (r.output, r.parameter, r.arguments, r.named, r.bucket) for r in modules.collect()}
    assert got["lone"] == ("missing", "missing", "missing", "not_applicable", "insufficient_output_evidence")
    assert got["a.linear_q_down_proj"] == ("aligned", "mismatch", "mismatch", "partial", "comparison_premise_abnormal_but_output_aligned")
    assert {(r.kind, r.n) for r in values.counted(values.compared(pairs, train, rollout), modules).collect()} == {("value", 1), ("module", 1)}
    assert values.compared(pairs.limit(0), train, rollout).count() == 0


def test_delegations_take_older_names(spark):
    texts = [
        '{"event": "subagent.delegation", "delegation_id": "a", "start_time": null, "delegated_at": "1", "ended_at": "9"}',
        '{"event": "subagent.delegation", "delegation_id": "b", "started_at": "2", "delegated_at": "1", "completed_at": null, "ended_at": "9"}',
        '{"event": "subagent.delegation", "delegation_id": ""}', '{"event": "user.turn", "delegation_id": "c"}', "no json", None,
    ]
    rows = audit.delegations(spark.createDataFrame([(t,) for t in texts], "text string"), "text", []).collect()
    assert {(r.delegation_id, r.start_time, r.end_time) for r in rows} == {("a", None, "9"), ("b", "1", None)}
    with pytest.raises(ValueError, match="no regular expression"):
        audit.catalogue(spark.range(1), "id", "id", "(")


def test_completions_by_rank(spark):
    paths = ["src/Main.py", "main/", "x/domain.py", "main/other.py", "MAIN.py", "lib/main/", "remain/zz", "nothing", "main/", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [(r.path, r.category) for r in audit.completions(df, "path", "Main", 8).collect()] == [
        ("lib/main/", 0), ("main/", 0), ("MAIN.py", 0), ("src/Main.py", 0), ("x/domain.py", 1), ("main/other.py", 2), ("remain/zz", 3), ("nothing", 4),
    ]
    assert [r.path for r in audit.completions(df, "path", "", 2).collect()] == ["lib/main/", "main/"]


def test_drawn_ways_and_sizes(spark):
    way = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in (("0", "root"), ("2", "left out"), ("1", None), ("0", "leaf"))))
    row = spark.range(1).select(sequences.drawn(way).alias("lines")).first()
    assert row.lines == "root [Module]\n  → ? [API]\n    → leaf [Module]"
    sizes = [0, 1023, 1024, 1280, 1792, 3 * 2**19 + 2**18, 5 * 2**27 + 2**30]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(scalars.bytes_text(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.8 MB", "1.62 GB"]


def test_values_meet_in_one_shuffle_by_pair(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "run int, train_key string, rollout_key string")
    tensors = "run int, key string, target string, name string, dtype string, shape array<bigint>, Max double, Min double, Mean double, Norm double"
    train = spark.createDataFrame([(1, "a", "output.0", None, "fp32", [2, 3], 1.0, 0.0, 0.5, 1.0), (1, "a", None, None, "fp32", [2], 1.0, 0.0, 0.5, 1.0)], tensors)
    rollout = spark.createDataFrame([(1, "b", "output.0", "", "fp32", [2, 3], 1.0, 0.0, 0.5, 1.0), (1, "b", None, None, "fp32", [2], 1.0, 0.0, 0.5, 1.0)], tensors)
    found = values.compared(pairs, train, rollout)
    assert sorted((r.target or "", r.status) for r in found.collect()) == [("", "missing_on_rollout"), ("", "missing_on_train"), ("output.0", "ok")]
    plan = re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString())
    assert len(re.findall(r"Exchange hashpartitioning\(run, train_key, rollout_key", plan.split("Initial Plan")[-1])) == 1


def test_buckets_are_counted_in_one_pass(spark, both, monkeypatch):
    pairs, train, rollout = both
    pairs = pairs.unionByName(pairs)
    found = values.compared(pairs, train, rollout)
    want = {(r.kind, r.bucket, r.n) for r in values.counted(found, values.module_statuses(pairs, found)).collect()}
    counts = values.bucket_counts(pairs, found)
    assert {(r.kind, r.bucket, r.n) for r in counts.collect()} == want and len(want) == 7
    # one branch reads the tensors
    tensors = train.withColumn("trained", F.lit(True)).unionByName(rollout.withColumn("trained", F.lit(False)))
    for n in (None, 9):
        counts = values.bucket_counts(pairs, values.met(pairs, tensors, n), n)
        assert {(r.kind, r.bucket, r.n) for r in counts.collect()} == want
        plan = re.sub(r"#\d+L?", "", counts._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")[-1]
        assert len(re.findall(r"Exchange hashpartitioning\(run, train_key, rollout_key, \d+\), REPARTITION", plan)) == (2 if n else 1)
        assert n is None or "hashpartitioning(run, trained, key, 9)" in plan


def test_tensors_are_read_once_and_dealt_by_their_number(spark, tmp_path, monkeypatch):
    lines = "cast(id % 50 as bigint) l_orderkey, cast(id % 7 + 1 as int) l_linenumber, id l_partkey, id % 9 l_suppkey, id * 1.5D l_extendedprice, cast(id % 40 + 1 as double) l_quantity, 0.05D l_discount, 0.02D l_tax, 'R' l_returnflag"
    spark.range(700).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).selectExpr("id o_orderkey", "id * 3 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    queries = evidence.value_buckets, evidence.module_values, evidence.value_compare
    few = [sorted(map(str, q(spark, str(tmp_path)).collect())) for q in queries]
    monkeypatch.setattr(values, "ROWS", 100, raising=False)
    for q, rows in zip(queries, few, strict=True):
        found = q(spark, str(tmp_path))
        assert sorted(map(str, found.collect())) == rows
        plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")[-1]
        assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
        # a task's rows do not grow with the table
        assert "hashpartitioning(l_orderkey, 7)" in plan and "hashpartitioning(run, train_key, rollout_key, 7)" in plan
