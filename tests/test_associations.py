"""Scans over blocks, flows, chains, text places and closest names against brute force."""

import difflib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.functions import formulas, windows
from tracegrain.operators import affinity, flows, memory, names, profiler, scans, sequences, states
from tracegrain.plans import macros
from tracegrain.plans.associations import text_places


@pytest.fixture(autouse=True, scope="module")
def many_blocks(spark):
    """Small tables would be one block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(n=600, seed=4):
    rng = random.Random(seed)
    # one key holds most rows, null is a key
    return [(rng.choice(["hot"] * 8 + ["cold", None]), i, rng.choice([None, *range(-5, 6)])) for i in range(n)]


def test_scans_carry_over_blocks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(3)
    found = scans.scanned(df, ["k"], ["t"], {"s": ("sum", F.col("v"), True), "before": ("sum", F.col("v"), False), "n": ("count", F.lit(1), True), "top": ("max", F.col("v"), False), "low": ("min", F.col("v"), True), "last": ("last", F.col("v"), False)})
    got = {(r.k, r.t): (r.s, r.before, r.n, r.top, r.low, r.last) for r in found.collect()}
    some = lambda f, x: f(x) if x else None
    for k in ("hot", "cold", None):
        own = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == k]
        for i, (_, t, _) in enumerate(own):
            upto, before = ([v for _, _, v in own[:j] if v is not None] for j in (i + 1, i))
            assert got[k, t] == (some(sum, upto), some(sum, before), i + 1, some(max, before), some(min, upto), some(lambda x: x[-1], before))
    assert scans.scanned(df.limit(0), ["k"], ["t"], {"s": ("sum", F.col("v"), True)}).count() == 0


def test_a_hot_key_spans_blocks(spark):
    df = scans.blocked(spark.range(4000).withColumn("k", F.lit(1)), ["k"], ["id"])
    assert df.groupBy(scans.BLOCK).count().agg(F.max("count")).first()[0] < 2500


def test_as_of_takes_the_latest(spark):
    rng = random.Random(8)
    left = [(rng.choice("ab"), rng.randrange(50), i) for i in range(200)] + [(None, 10, 900), ("c", 5, 901)]
    right = [(rng.choice("ab"), rng.randrange(50), i, f"n{i}") for i in range(60)] + [(None, 9, 70, "n70")]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, u int, rid int, name string")
    found = {r.id: (r.x, r.y) for r in scans.as_of(a, b, ["k"], "t", "u", {"x": "rid", "y": "name"}, "rid").collect()}
    for k, t, i in left:
        best = max(((u, rid) for q, u, rid, _ in right if q == k and u <= t), default=None)
        assert found[i] == ((best[1], f"n{best[1]}") if best else (None, None))


def test_innermost_of_nested_and_overlapping_intervals(spark):
    rng = random.Random(2)
    base = 1_700_000_000_000_000_000  # nanoseconds, beyond what doubles tell apart
    calls = [(rng.choice([1, 1, 1, 2]), i, base + (a := rng.randrange(3000)), base + a + rng.choice([0, 1, 2, 9, 100, 1500])) for i in range(150)]
    tasks = [(rng.choice([1, 1, 2, 3]), i, base + rng.randrange(-5, 3200)) for i in range(300)]
    found = flows.launched_by(spark.createDataFrame(tasks, "lane int, task int, at long"), spark.createDataFrame(calls, "lane int, call int, a long, b long"), ["lane"], "task", "at", "call", "a", "b")
    got = {r.task: (r.call, r.depth) for r in found.collect()}
    for lane, task, at in tasks:
        around = [(-a, b, call) for q, call, a, b in calls if q == lane and a <= at < b]
        assert got[task] == (min(around)[2] if around else None, len(around))
    none = flows.launched_by(spark.createDataFrame(tasks, "lane int, task int, at long"), spark.createDataFrame([], "lane int, call int, a long, b long"), ["lane"], "task", "at", "call", "a", "b")
    assert none.filter("depth <> 0 or call is not null").count() == 0


def test_flow_ids_that_are_used_again(spark):
    starts = spark.createDataFrame([(1, 10, "s1"), (1, 30, "s2"), (2, 5, "s3"), (1, 50, "s4")], "flow int, at long, name string")
    ends = spark.createDataFrame([(1, 20, "e1"), (1, 35, "e2"), (1, 36, "e3"), (2, 4, "e4")], "flow int, at long, name string")
    got = sorted((r.start_name, r.end_name, r.end_at) for r in flows.flow_pairs(starts, ends, "flow", "at", "name").collect())
    assert got == [("s1", "e1", 20), ("s2", "e2", 35), ("s3", None, None), ("s4", None, None)]


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[round(rng.gauss(0, 9), 1) for _ in range(5)]])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "low": 0.0, "top": 1.0}
    got = {r.k: r for r in scans.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    assert "none" not in got
    for k in ("a", "b", None, "one"):
        own = [v for q, v in rows if q == k and v is not None]
        assert [got[k][n] for n in shares] == pytest.approx([float(np.percentile(own, s * 100)) for s in shares.values()])
    whole = scans.percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


def test_sums_lose_nothing(spark):
    total = lambda values: spark.createDataFrame([(v,) for v in values], "v double").agg(memory.exact_sum("v").alias("x")).first().x
    values = [4e-9] * 1000 + [1.0, 1e18, -1e18, 2.5e-12, 1e30, -1e30, 0.1]
    assert total(values) == pytest.approx(math.fsum(values), rel=1e-12)
    assert total([]) is None and total([None]) is None and total([1e300, 1e300]) == 2e300 and math.isnan(total([float("nan"), 1.0])) and total([float("inf"), 1.0]) == math.inf
    assert total([6e29] * 4) == pytest.approx(2.4e30) and total([9e29, -9e29, 5.0]) == 5.0


def test_a_chain_of_ten_thousand_and_a_circle(spark):
    n = 10_000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    found = sequences.ancestors(nodes, nodes.filter(f"node = {n - 1}"), "node", "up", n)
    assert found.agg(F.count("*"), F.sum("depth"), F.max(F.col("node") + F.col("depth")), F.min("node")).first() == (n, n * (n - 1) // 2, n - 1, 0)
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "node int, up int")
    got = sorted(map(tuple, sequences.ancestors(circle, circle.filter("node > 3"), "node", "up").collect()))
    assert got == [(4, 1, 1), (4, 2, 2), (4, 3, 3), (4, 4, 0), (5, 5, 0)]
    assert sorted(r.depth for r in sequences.ancestors(nodes, nodes.filter("node = 90"), "node", "up", 5).collect()) == list(range(6))


def test_first_anomaly_with_chain_and_stack(spark):
    rows = [
        (0, "Torch.zeros.0.forward", 0, "nan", "0"), (0, "Tensor.masked_fill.1.forward", 1, "0", "-inf"), (0, "Torch.matmul.2.forward", 2, "1", "2"), (0, "Functional.linear.3.forward", 3, "\tNaN ", "inf"), (0, "Torch.add.4.forward", 4, "nan", "nan"),
        (1, "NPU.my_empty.0", 0, "inf", "inf"), (1, "Torch.where.0.forward", 1, "0", "inf"), (2, "Torch.add.0.forward", 0, "1", "2"), (2, "Tensor.to.0.forward", 1, "nan", "nan"),
    ]
    x = spark.createDataFrame(rows, "rank int, op string, n int, i string, o string")
    links = spark.createDataFrame([(0, "Functional.linear.3.forward", "Module.attn.0"), (0, "Module.attn.0", "Module.layer.0"), (1, "Functional.linear.3.forward", "Module.other")], "rank int, op string, caller string")
    stacks = spark.createDataFrame([(0, "Functional.linear.3.forward", "linear, forward.py, 123")], "rank int, op string, stack string")
    bad = lambda c: sequences.anomalous(F.col("op"), F.col(c))
    got = {r["rank"]: (r.op, r.exec_order, r.kind, r.chain, r.stack) for r in sequences.first_anomalies(x, links, stacks, "rank", "op", "n", bad("i"), bad("o"), "caller", "stack").collect()}
    assert got == {
        0: ("Functional.linear.3.forward", 3, "both", ["Functional.linear.3.forward", "Module.attn.0", "Module.layer.0"], "linear, forward.py, 123"),
        1: ("Torch.where.0.forward", 1, "output", ["Torch.where.0.forward"], None),
    }


def _window(content, search, threshold):
    """Every window compared."""
    a, b = search.split("\n"), content.split("\n")
    best, found = 0.0, None
    for i in range(len(b) - len(a) + 1):
        ratio = difflib.SequenceMatcher(None, search, "\n".join(b[i : i + len(a)])).ratio()
        if ratio > best:
            best, found = ratio, i
    return (found + 1, best) if best >= threshold and found is not None else None


def test_places_of_texts(spark):
    rng = random.Random(6)
    line = lambda: "  " * rng.randrange(3) + " ".join(rng.choice(["def", "call", "x = 1", "return y", "loop", "é"]) for _ in range(rng.randrange(5)))
    pairs = []
    for i in range(120):
        lines = [line() for _ in range(rng.randrange(1, 14))]
        at = rng.randrange(len(lines))
        search = "\n".join(lines[at : at + rng.randrange(1, 4)])
        how = i % 4
        if how == 1:
            search = "\n".join("    " + x + "  " for x in search.split("\n"))
        elif how == 2 and search:
            search = search.replace("call", "cell").replace("e", "", 1)
        elif how == 3:
            search = search + "\n" + line()
        pairs.append((i, "\n".join(lines), search))
    df = spark.createDataFrame([*pairs, (900, None, "x"), (901, "x", None), (902, "", "abc"), (903, "ab", "")], "id int, content string, search string")
    got = {r.id: r.p for r in df.withColumn("p", windows.placed(F.col("content"), F.col("search"), 0.6)).collect()}
    kinds = set()
    for i, content, search in pairs:
        found = got[i]
        kinds.add(found.kind if found else None)
        if search in content:
            assert (found.kind, found.start, found.end) == ("exact", content.find(search), content.find(search) + len(search))
            continue
        wanted = windows._plain(search).rstrip("\n")
        lines, size = content.split("\n"), wanted.count("\n") + 1
        same = [j for j in range(len(lines) - size + 1) if windows._plain("\n".join(lines[j : j + size])).rstrip("\n") == wanted]
        if same:
            assert found.kind == "normalised" and found.line == same[0] + 1 and content[found.start : found.end] == "\n".join(lines[same[0] : same[0] + size])
            continue
        best = _window(content, search, 0.6)
        assert (found.line, found.ratio) == best if best else found is None
        if best:
            assert content[found.start : found.end].count("\n") == search.count("\n")
    assert kinds >= {"exact", "normalised", "fuzzy"} and got[900] is None and got[901] is None and got[902] is None and got[903].kind == "exact"


def test_closest_names(spark):
    rng = random.Random(3)
    words = ["TASK", "COMPUTE", "INFO", "API", "COMM", "OP", "MEM", "NPU", "STRING", "IDS", "TIME", "HOST"]
    known = sorted({"_".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(150)}) + ["A", "AB", "ÉÉ"]
    asked = [*("".join(rng.sample(w, len(w))) for w in rng.sample(known, 15)), "TSAK", "COMPUTE_TASKINFO", "ZZZ", "A", "ÉÉÉ", "NPU_MEN", "AAAAAAAAAAAAAAAAAA"]
    df = lambda rows, c: spark.createDataFrame([(x,) for x in [*rows, None, ""]], f"{c} string")
    got = {}
    for r in names.closest(df(asked, "a"), df(known + known[:5], "b"), "a", "b").orderBy("a", "place").collect():
        got.setdefault(r.a, []).append(r.b)
    for word in asked:
        assert got.get(word, []) == difflib.get_close_matches(word, known, 5, 0.5), word


def test_calls_expire_at_a_new_run(spark):
    log = [(1, "begin", None), (2, "call", "a"), (3, "call", "b"), (4, "result", "a"), (5, "result", "a"), (6, "call", "c"), (7, "call", "c"), (8, "result", "c"), (9, "begin", None), (10, "result", "b"), (11, "call", "d")]
    df = spark.createDataFrame([("k", *r) for r in log], "k string, n int, kind string, id string")
    kind = F.col("kind")
    got = sorted((r.called_at, r.run, r.result_at, r.state) for r in states.calls(df, "k", "n", "id", kind == "begin", kind == "call", kind == "result").collect())
    assert got == [(2, 1, 4, "done"), (3, 1, None, "expired"), (6, 1, None, "replaced"), (7, 1, 8, "done"), (11, 2, None, "pending")]


def test_reduced_states(spark):
    rows = [("a", 1, 5, 7, {"x": 1, "y": 1}), ("a", 3, None, None, {"x": None}), ("a", 2, 2, 9, {"y": 2, "z": 3}), ("b", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, n int, tokens int, left int, files map<string,int>")
    got = {r.k: (r.updates, r.tokens, r.left, r.files) for r in states.reduced(df, "k", "n", ["tokens"], ["left"], ["files"]).collect()}
    assert got == {"a": (3, 7, 9, {"x": None, "y": 2, "z": 3}), "b": (1, 0, 0, {})}


def test_formulas_refuse_unknown_types(spark):
    own = formulas.standard()
    df = spark.createDataFrame([("MatMul", 2), ("Other", 3)], "kind string, m int")
    work = lambda how: own.column(F.col("kind"), how, m=F.col("m"), n=F.lit(3), k=F.lit(4), batch=F.lit(1))
    assert [r.x for r in df.select(work("null").alias("x")).collect()] == [48.0, None]
    with pytest.raises(Exception, match="no formula for Other"):
        df.select(work("refuse").alias("x")).collect()
    with pytest.raises(ValueError, match="already"):
        own.register("MatMul")(lambda **_: F.lit(0))


def test_expansion_macro(spark):
    devices = spark.createDataFrame([(1, 0), (2, 4)], "id long, device_index long")
    traces = spark.createDataFrame([(1, 5, "segment_alloc", 10), (2, 6, "segment_free", 20), (2, 7, "alloc", 30), (2, 90, "segment_map", 40)], "device_id long, trace_index long, action string, size long")
    assert macros.install(spark, devices=devices, traces=traces) == ["expansion_timeline"]
    rows = lambda device: sorted(tuple(r) for r in spark.sql(f"SELECT * FROM expansion_timeline({device}, 0, 50)").collect())
    assert rows("NULL") == [(0, 5, "segment_alloc", 10), (4, 6, "segment_free", 20)] and rows(4) == [(4, 6, "segment_free", 20)]


def test_pairs_of_a_hot_item(spark, monkeypatch):
    monkeypatch.setattr(affinity, "TOGETHER", 7)
    rng = random.Random(2)
    rows = [(rng.choice([1, 2]), k, item) for k in range(60) for item in ["hot", *rng.sample("abcdef", 2)]] + [(1, 3, None)]
    got = {tuple(r) for r in affinity.sharing(spark.createDataFrame(rows, "g int, k int, item string"), "k", "item", ["g"]).collect()}
    held = {}
    for g, k, item in rows:
        if item:
            held.setdefault((g, k), set()).add(item)
    assert got == {(g, a, b, len(held[g, a] & held[h, b])) for g, a in held for h, b in held if g == h and a < b and held[g, a] & held[h, b]}


def test_innermost_makes_no_pairs(spark):
    # 20,000 calls run at each of 20,000 moments, in blocks before theirs: 400 million pairs
    n = 20_000
    calls = spark.range(n).select(F.lit(1).alias("lane"), F.col("id").alias("call"), F.col("id").alias("a"), (F.lit(10 * n) - F.col("id") % 7).alias("b"))
    tasks = spark.range(n).select(F.lit(1).alias("lane"), F.col("id").alias("task"), (F.col("id") + n).alias("at"))
    began = time.perf_counter()
    rows = flows.launched_by(tasks, calls, ["lane"], "task", "at", "call", "a", "b").groupBy("call", "depth").count().collect()
    assert [tuple(r) for r in rows] == [(n - 1, n, n)] and time.perf_counter() - began < 40


def test_the_first_kernel_makes_no_pairs(spark):
    # all kernels and marks lie in one block of the width given, and each mark spans all kernels after it
    n = 20_000
    marks = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("record"), F.col("id").alias("start"), F.lit(2 * n).alias("end"))
    work = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("kernel"), F.col("id").alias("at"))
    began = time.perf_counter()
    found = profiler.first_within(marks, work.unionByName(work.withColumn("kernel", F.col("kernel") + n)), ["k"], 10 * n)
    assert found.filter("kernel = record and at = record").count() == n and time.perf_counter() - began < 40


def test_sharing_deals_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(affinity, "ROWS", 100, raising=False)
    rng = random.Random(5)
    rows = {(rng.choice("ab"), rng.randrange(30), rng.choice([1, rng.randrange(200)])) for _ in range(2000)}
    df = spark.createDataFrame([*rows, *list(rows)[:50], (None, 1, 1), ("a", 2, None)], "scope string, k int, item int")
    found = affinity.sharing(df, "k", "item", ["scope"])
    held = {}
    for scope, k, item in rows:
        held.setdefault((scope, item), set()).add(k)
    want = Counter((scope, a, b) for (scope, _), ks in held.items() for a in ks for b in ks if a < b)
    assert {(r.scope, r.k, r.other): r.shared for r in found.collect()} == want
    # a task's rows do not grow with the table
    assert f"hashpartitioning(scope, item, {-(-(len(rows) + 51) // 100)})" in re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString())


def test_ratio_is_that_of_the_standard_library_and_ends_early():
    r = random.Random(7)
    for size in (0, 1, 30, 199, 200, 420):
        for letters in (3, 40):
            for _ in range(12):
                a = "".join(chr(97 + min(int(r.expovariate(0.15)), letters)) for _ in range(size))
                b = "".join(r.choice("abcx") if r.random() < 0.1 else c for c in (a if r.random() < 0.7 else a[::-1])) + r.choice(["", "\U0001f600 end"])
                want = difflib.SequenceMatcher(None, a, b).ratio()
                assert windows._ratio(a, b, 0.0) == windows._ratio(a, b, want) == want
                assert a + b == "" or windows._ratio(a, b, want + 1e-9) is None
                assert windows._alike(windows._masks(a), len(a), b, want)


def test_few_windows_of_much_the_same_characters_are_compared(monkeypatch):
    r = random.Random(5)
    lines = ["".join(r.choice("etaoinshrdlu ") for _ in range(60)) for _ in range(150)]
    content, search = "\n".join(lines), "\n".join(lines[50:53]).replace("e", "w")
    ratios = [difflib.SequenceMatcher(None, search, "\n".join(lines[i : i + 3])).ratio() for i in range(148)]
    best = max(ratios)
    compared, ratio = [], windows._ratio
    monkeypatch.setattr(windows, "_ratio", lambda *x: compared.append(x) or ratio(*x))
    found = windows.place(content, search, 0.6)
    assert found[0] == "fuzzy" and found[3:] == (ratios.index(best) + 1, best) == (51, best)
    assert len(compared) < 8  # the counts of characters alone let dozens through


def _lines(r, n, letters="etaoinshrdlu etaoinshr"):
    """Lines of common letters, some of them with a rare one."""
    return ["".join(r.choice("XQZ7") if r.random() < 0.04 else r.choice(letters) for _ in range(r.randrange(20, 60))) for _ in range(n)]


def test_bounds_are_never_below_the_ratio():
    r = random.Random(11)
    for case in range(60):
        lines, size = _lines(r, r.randrange(9, 30), "ab \n"[: 2 + case % 3] if case % 4 == 0 else "etaoinshrdlu etaoinshr"), 0
        lines = "\n".join(lines).split("\n")
        size = r.randrange(4, len(lines))
        at = r.randrange(len(lines) - size + 1)
        search = "\n".join(lines[at : at + size])
        search = "".join(r.choice("wXe ") if r.random() < (0.01, 0.1, 0.3)[case % 3] else c for c in search if r.random() > 0.01)
        size = search.count("\n") + 1
        if size > len(lines):
            continue
        ratios = [difflib.SequenceMatcher(None, search, "\n".join(lines[i : i + size])).ratio() for i in range(len(lines) - size + 1)]
        for least in (0.0, 0.6):
            bounds = windows._bounds(lines, size, search, least)
            assert all(b >= x for b, x in zip(bounds, ratios, strict=True) if x >= least)
        best = max(ratios)
        found = windows.place("\n".join(lines), search, 0.6)
        if found is None or found[0] == "fuzzy":
            assert (found[3:] if found else None) == ((ratios.index(best) + 1, best) if best >= 0.6 else None)


def test_windows_that_share_too_short_runs_are_left_out(monkeypatch):
    lines = _lines(random.Random(12), 300)
    search = "\n".join(lines[100:200]).translate(str.maketrans("ae", "ea"))
    looked, alike = [], windows._alike
    monkeypatch.setattr(windows, "_alike", lambda *x: looked.append(x) or alike(*x))
    assert windows.place("\n".join(lines), search, 0.85) is None and not looked  # the characters in common let every window through


def test_the_whole_middle_third_is_placed(spark, tmp_path):
    r = random.Random(13)
    docs = [(i, "\n".join(_lines(r, n))) for i, n in enumerate([1, 2, 3, 40, 61, 75, 30, 90, 4])]
    docs += [(9, None), (10, ""), (11, "\n".join(x.replace("a", "i").replace("e", "o") + "a" * (k % 9 == 0) for k, x in enumerate(_lines(r, 60))))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in text_places(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, text in docs if text is not None}
    for i, text in docs[:9]:
        lines = text.split("\n")
        part = "\n".join(lines[len(lines) // 3 : len(lines) // 3 + -(-len(lines) // 3)])
        if i % 3 < 2:
            at = text.find(part)
            assert (got[i].start, got[i].end, got[i].ratio) == (at, at + len(part), 1.0) and got[i].line == text.count("\n", 0, at) + 1
            assert got[i].kind == ("normalised" if i % 3 else "exact")
        else:
            best = _window(text, part.translate(str.maketrans("ae", "ea")), 0.85)
            assert (got[i].line, got[i].ratio) == (best or (None, None))
    assert got[11].kind == "fuzzy" and got[11].line == 21 and docs[11][1][got[11].start : got[11].end].count("\n") == 19
