"""Hand-checked cases of the comparison of two runs."""

from pyspark.sql import functions as F

from tracegrain.operators import comparison

PAIRS = "run int, at int, train_key string, rollout_key string, train_pos int, rollout_pos int, output string, bucket string, module_rank int"
SIDE = "run int, pos int, key string, matched boolean"


def test_suspects(spark):
    pairs = [
        (1, 0, "m.layers.0.mlp.a", "r.a", 0, 0, "aligned", "normal_aligned", 4),
        (1, 1, "m.layers.0.norm.b", "r.b", 1, 1, "mismatch", "parameter_sync_mismatch", 1),  # no boundary in its block
        (1, 2, "m.layers.0.mlp.c", "r.c", 3, 4, "mismatch", "systemic_misalignment", 2),
        (1, 3, "m.layers.0.mlp.linear_q_down_proj", "r.fused_qkv_a_proj", 4, 5, "mismatch", "module_impl_mismatch", 1),
    ]
    train = [(1, 0, "a", True), (1, 1, "b", True), (1, 2, "plain", False), (1, 3, "c", True), (1, 4, "q", True)]
    rollout = [(1, 0, "a", True), (1, 1, "b", True), (1, 2, "other", False), (1, 3, "SiLU.1", False), (1, 4, "c", True), (1, 5, "q", True), (1, 6, "gelu", False)]
    frames = spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(train, SIDE), spark.createDataFrame(rollout, SIDE)
    got = [tuple(r) for r in comparison.suspects(*frames, "run").orderBy("place").select("train_key", "class", "boundary", "missing_train", "missing_rollout", "first_rollout").collect()]
    assert got == [
        ("m.layers.0.mlp.c", "missing_or_extra_op_between_aligned_boundary", "m.layers.0.mlp.a", 1, 2, "SiLU.1"),
        ("m.layers.0.norm.b", "parameter_or_checkpoint_issue", None, 0, 0, None),
    ]
    assert comparison.suspects(*(x.limit(0) for x in frames), "run").count() == 0


def test_first_problem(spark):
    rows = [(1, 0, "a", True, True), (1, 1, "a", False, True), (1, 2, "skip", False, False), (1, 3, "b", True, None), (2, 0, "a", True, True), (2, 1, "a", False, False)]
    states = comparison.api_states(spark.createDataFrame(rows, "file int, at int, api string, is_in boolean, same boolean"), ["file"], "at", "api", F.col("is_in"), F.col("same"))
    got = {r.file: tuple(r)[1:] for r in comparison.first_problem(states, ["file"], "api", F.col("api") == "skip").collect()}
    assert got == {1: (None, "a", "b", 1), 2: ("a", None, None, None)}


def test_statuses_that_are_missing(spark):
    none = F.lit(None).cast("string")
    x = spark.range(1).select(comparison.input_status(none, none).alias("a"), comparison.input_status(F.lit("aligned"), none).alias("b"), comparison.module_bucket(none, none, F.lit("mismatch"), none, none, none).alias("c")).first()
    assert (x.a, x.b, tuple(x.c)) == ("missing", "aligned", ("systemic_misalignment", 2))
