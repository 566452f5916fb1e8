"""Hand-checked cases of kernels, marks, gaps, limits, review texts, CPU topology and the recorder."""

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import textual as t
from tracegrain.operators import cluster, estimators, kernels
from tracegrain.sources import files
from tracegrain.streaming import recorder


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_top_kernels_ties_and_nulls(spark):
    x = spark.createDataFrame([("d", "b", 2.0), ("d", "a", 2.0), ("d", None, 5.0), ("d", "c", None), (None, "a", 1.0)], "device string, op string, us double")
    found = kernels.top_kernels(x, ["device"], ["op"], "us", 3).filter("device is not null").select("op", "n", "total", "place")
    assert rows(found, "place") == [(None, 1, 5.0, 1), ("a", 1, 2.0, 2), ("b", 1, 2.0, 3)]


def test_kernels_of_empty_tables(spark):
    x = spark.createDataFrame([], "device string, op string, us double")
    assert kernels.top_kernels(x, ["device"], ["op"], "us").count() == 0
    assert kernels.spread(x, ["device"], "us").count() == 0
    assert kernels.dynamic_split(x, ["device"], F.col("op") == "dynamic", "us").count() == 0


def test_dynamic_split(spark):
    x = spark.createDataFrame([("d", "dynamic", 2.0), ("d", None, 1.0), ("d", "static", 4.0), ("e", "dynamic", 3.0)], "device string, state string, us double")
    assert rows(kernels.dynamic_split(x, ["device"], F.col("state") == "dynamic", "us"), "device") == [("d", 1, 2, 2.0, 5.0, 0.5), ("e", 1, 0, 3.0, 0.0, None)]


def test_marks(spark):
    events = spark.createDataFrame([(1, 7, 10), (2, 8, 10), (3, 7, 11), (4, None, 10)], "mark int, domainId int, message int")
    strings = spark.createDataFrame([(7, "work"), (8, "other"), (10, "m")], "id int, value string")
    assert rows(kernels.marks(events, strings, "domainId", "message", "work").select("mark", "text"), "mark") == [(1, "m")]


def test_marked_work(spark):
    records = spark.createDataFrame([(0, 1, 100, 200, 5e12), (0, 2, 200, 300, 1e12), (1, 3, 100, 200, 1e12)], "rank int, record int, start long, end long, flops double")
    work = spark.createDataFrame([(0, 11, 150, 500150), (0, 10, 120, 500120), (0, 12, 300, 400), (1, 13, 99, 150)], "rank int, kernel int, at long, until long")
    found = kernels.marked_work(records, work, ["rank"], 64, 20.0).select("record", "kernel", "tflops", "mfu", "band")
    assert rows(found, "record") == [(1, 10, 10.0, 0.5, "fair"), (2, None, None, None, None), (3, None, None, None, None)]


def test_quiet_gaps_at_edges(spark):
    gaps = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 20, 30), ("a", 3, 40, 50), ("b", 4, 10, 20), (None, 5, 0, 9)], "track string, gap int, start long, end long")
    # the first ends where gap 1 begins, the next lasts over gap 2, and an empty one lies in gap 3
    busy = spark.createDataFrame([("a", 0, 10), ("a", 20, 31), ("a", 45, 45), ("b", 5, 25), (None, 8, 10)], "track string, start long, end long")
    assert [r[-1] for r in rows(kernels.quiet(gaps, busy, ["track"], "start", "end"), "gap")] == [True, False, True, False, False]
    assert [r[-1] for r in rows(kernels.quiet(gaps, busy.limit(0), ["track"], "start", "end"), "gap")] == [True] * 5


def test_group_stats(spark):
    x = spark.createDataFrame([("x", None, 1.0), ("x", "", 3.0), ("x", "g", 2.0), ("Total Op Info", "g", 9.0)], "op string, hash string, ms double")
    groups = spark.createDataFrame([("g", "1", "tp")], "group_name string, group_id string, pg_name string")
    assert rows(cluster.group_stats(x, groups, "op", "hash", "ms"), "group_name") == [("x", "", "", "", 4.0, 3.0, 2.0), ("x", "g", "1", "tp", 2.0, 2.0, 2.0)]


@pytest.mark.parametrize("tokens_in, tokens_out, margin, expected", [(3000, 1999, 3192, 8192), (3500, 1500, 3192, 8192), (3500, 1501, 3192, 9216), (30000, 5000, 1024, 32768)])
def test_model_length(spark, tokens_in, tokens_out, margin, expected):
    got = spark.range(1).select(estimators.model_length(F.lit(32768), F.lit(tokens_in), F.lit(tokens_out), F.lit(margin))).first()[0]
    assert got == expected


def test_ceilings(spark):
    e, one = estimators, spark.range(1)
    got = one.select(
        e.sequences_ceiling(F.lit("npu"), F.lit(True), F.lit(None).cast("int")), e.sequences_ceiling(F.lit("npu"), F.lit(False), F.lit(64)), e.sequences_ceiling(F.lit("gpu"), F.lit(False), F.lit(64)), e.tokens_ceiling(F.lit("gpu"), F.lit(1)),
        e.bandwidth_ceiling(F.lit("npu"), F.lit(55.0), F.lit(5000), F.lit(100_000.0)), e.bandwidth_ceiling(F.lit("npu"), F.lit(0.0), F.lit(5000), F.lit(1.0)), e.context_margin(F.lit(32), F.lit(8), F.lit("int8")), e.context_margin(F.lit(8), F.lit(8), F.lit("float32")),
    ).first()
    assert tuple(got) == (384, 64, 4096, 131072, 100, 10**9, 3192, 1024)


@pytest.mark.parametrize("text, commit, branch", [("main (commit: 0a1b2c3d)", "0a1b2c3d", "main"), ("1234567 dev", "", "1234567 dev"), ("release/2.1 @ " + "1" * 40, "1" * 40, "release 2.1"), ("NA", "", ""), ("N/A", "", "N A"), (None, "", ""), ("dev，sha ABCDEF1", "ABCDEF1", "dev")])
def test_commit_and_branch(spark, text, commit, branch):
    x = spark.createDataFrame([(text,)], "text string").select(t.commit_of(F.col("text")), t.branch_of(F.col("text"))).first()
    assert tuple(x) == (commit, branch)


def test_scores_and_risks(spark):
    text = "- Score\nscore: `91.5/100`\n1. no\n- Risks:\n  1. first\nplain\n22.  second\n- Next\n3. no"
    x = spark.createDataFrame([(text,), ("",), (None,), ("- Risks\n- Risks\n1. a\n-b",)], "text string")
    assert [tuple(r) for r in x.select(t.score_of(F.col("text"), "score"), t.numbered_under(F.col("text"), "Risks")).collect()] == [("91.5/100", ["first", "second"]), ("", []), ("", []), ("", ["a"])]


def test_cpu_topology(spark, tmp_path):
    for node, text in ((0, "10 21\n"), (10, "21 10"), (2, "10 x"), (3, "")):
        (tmp_path / f"devices/system/node/node{node}").mkdir(parents=True)
        (tmp_path / f"devices/system/node/node{node}/distance").write_text(text)
    for cpu, text in ((0, "0,4\n"), (1, "what"), (2, "5-2"), (9, "9")):
        (tmp_path / f"devices/system/cpu/cpu{cpu}/topology").mkdir(parents=True)
        (tmp_path / f"devices/system/cpu/cpu{cpu}/topology/thread_siblings_list").write_text(text)
    (tmp_path / "devices/system/cpu/online").write_text("0-3\n")
    root = f"file://{tmp_path}"
    assert rows(files.node_distances(spark, root), "node") == [(0, [10, 21]), (10, [21, 10])]
    assert rows(files.thread_siblings(spark, root), "cpu") == [(0, [0, 4]), (1, [1]), (2, [2]), (3, [3])]


def test_recorder_goes_on_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/record"
    record = recorder.recorder(path, ["at", "kind"])
    batches = [[(3, "c"), (1, "a"), (2, "b")], [], [(5, "e"), (4, "d")]]
    for number, batch in enumerate(batches):
        record(spark.createDataFrame(batch, "at long, kind string"), number)
    expected = list(zip(range(5), "abcde"))
    assert rows(spark.read.parquet(path).select("index", "kind"), "index") == expected
    record(spark.createDataFrame(batches[2], "at long, kind string"), 2)  # run again after a failure
    assert rows(spark.read.parquet(path).select("index", "kind"), "index") == expected


def test_recorder_of_a_stream(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/record"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).withColumn("kind", F.lit("k")).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long, kind string").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream.writeStream.foreachBatch(recorder.recorder(path, ["id"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(path)
    assert rows(got.select("index"), "index") == [(i,) for i in range(30)]
    assert got.select("id").distinct().count() == 30
