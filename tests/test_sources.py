import json
import pickle
import random
import sqlite3
import struct

import pytest

from tracegrain.sources import files, snapshot, sqlite, tensors, traces
from tracegrain.streaming import events


def test_statistics(spark, tmp_path):
    path = tmp_path / "op.csv"
    path.write_text("OP Type,Total Time(us)\nA,5\nB,x\n")
    assert sorted(map(tuple, files.statistics(spark, str(path)).collect())) == [("A", 5.0, 1.0), ("B", 0.0, 1.0)]
    path.write_text("nothing\n1\n")
    with pytest.raises(ValueError, match="none of"):
        files.statistics(spark, str(path))


def test_logs(spark, tmp_path):
    (tmp_path / "audit.log").write_text(json.dumps({"a": 1}, indent=2) + "\n" + json.dumps({"b": [1, 2]}, indent=2))
    assert [json.loads(r.value) for r in files.concatenated_json(spark, str(tmp_path / "audit.log")).orderBy("index").collect()] == [{"a": 1}, {"b": [1, 2]}]
    (tmp_path / "x.jsonl").write_text('{"i": 1}\nbad\n{"i": 2}\n')
    assert sorted(r.i for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "i int").collect()) == [1, 2]


def test_dump(spark, tmp_path):
    (tmp_path / "rank3").mkdir()
    data = {"z": {"input_args": [{"Max": "NaN ", "Min": 0}]}, "a": {"input_args": [{"Max": "inf", "Min": 0}]}}
    (tmp_path / "rank3" / "dump.json").write_text(json.dumps({"data": data}))
    from pyspark.sql import functions as F

    rows = files.tensor_dump(spark, str(tmp_path / "rank3" / "dump.json")).withColumn("bad", files.has_nan(F.get_json_object("value", "$.input_args"))).orderBy("exec_order").collect()
    assert [(r["rank"], r.name, r.bad) for r in rows] == [(3, "z", True), (3, "a", False)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, v NUMERIC)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)] + [(None, None, None)])
    df = sqlite.read(spark, path, "t")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double")]
    assert df.count() == 101 and df.agg({"v": "sum"}).first()[0] == sum(i / 2 for i in range(100))
    assert sqlite.tables(path) == ["t"]


def test_snapshot(spark, tmp_path):
    data = {"segments": [{"device": 1, "address": 16, "total_size": 8, "segment_pool_id": (3, 4), "is_expandable": True, "frames": ["f"], "blocks": [{"address": 16, "size": 8, "state": "inactive"}, None]}, "junk"], "device_traces": [[{"action": "alloc", "size": 2}], [{"action": "oom", "device_free": 5}]]}
    (tmp_path / "s.pickle").write_bytes(pickle.dumps(data))
    got = snapshot.read(spark, str(tmp_path / "s.pickle"))
    s = got["segments"].first()
    assert (s.device, s.total_size, s.pool_id, s.is_expandable) == (1, 8, [3, 4], True)
    assert got["blocks"].first().stack is None and got["stacks"].count() == 1
    assert sorted((r.device, r.trace_index, r.action, r.device_free) for r in got["traces"].collect()) == [(0, 0, "alloc", None), (1, 0, "oom", 5)]
    with pytest.raises(pickle.UnpicklingError):
        snapshot.parsed(pickle.dumps(print))


def test_texts(spark, tmp_path):
    (tmp_path / "ps").write_text("PID PPID USER ARGS\n 10 1 me python run.py\n 2 0 root [kthreadd]\n 5 2 root [kworker]\n")
    assert [tuple(r) for r in files.processes(spark, str(tmp_path / "ps")).collect()] == [(10, 1, "me", "python run.py")]
    (tmp_path / "topo").write_text("  n0 n1\nn0 X HCCS\nn1 PCIE X\n")
    assert sorted(map(tuple, files.topology(spark, str(tmp_path / "topo")).collect())) == [("n0", "n1", "HCCS"), ("n1", "n0", "PCIE")]
    df = spark.createDataFrame([("d", "# t\n## A\nbody\n## B\n")], "k string, t string")
    assert [(r.title, r.body) for r in files.sections(df.selectExpr("k", "regexp_replace(t, '^# t\n', '') as t"), "k", "t").collect()] == [("A", "body"), ("B", "")]
    with pytest.raises(ValueError, match="RESULT_TOO_LARGE"):
        files.guarded(spark.range(5), 4)


def test_streams_match_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def drained(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = drained(events.windowed(stream, "1 day"), "w", "complete")
    want = events.windowed(source, "1 day")
    key = lambda df: sorted((r.started, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(want)
    buckets = stream.selectExpr("user_id as key", "cast(unix_micros(ts) as double) / 1e6 as at", "value as cost")
    passed = drained(events.token_bucket(buckets, 0.01, 500.0), "b")
    assert passed.count() == source.count()
    calls = stream.filter("event_type = 'click'").selectExpr("user_id as run_id", "event_id as call_id", "ts as at")
    results = stream.filter("event_type = 'view'").selectExpr("user_id as run_id", "event_id as call_id", "ts as at")
    assert drained(events.paired(calls, results), "p").filter("result_at is not null").count() == 0


def test_trace_events_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    tricky = ['a "quoted" , {\\"ph\\": 1}', "brace } , {", "é 😀", '[{"ph": "X"}]', "back\\\\"]
    rows = []
    for i in range(3000):
        args = {"n": i, "inner": {"ph": "no"}, "list": [{"a": 1}, {"b": rng.choice(tricky)}]} if i % 3 else None
        rows.append({"name": rng.choice(tricky), "ph": rng.choice("Xsf"), "pid": i % 4, "tid": f"t{i % 3}", "ts": i * 1.5, "dur": 2, "id": i // 2, "cat": "async", "args": args, "big": "x" * rng.choice([0, 0, 5000])})
    for j, text in enumerate((json.dumps(rows), json.dumps({"meta": {"k": [1, 2]}, "traceEvents": rows, "end": 1}, indent=1, ensure_ascii=False))):
        path = tmp_path / f"trace{j}.json"
        path.write_text(text, encoding="utf-8")
        for parts in (1, 7, 60):
            found = traces.read(spark, str(path), parts)
            got = sorted((r.ts, r.name, r.ph, r.pid, r.tid, r.dur, r.id, r.args) for r in found.collect())
            assert got == sorted((r["ts"], r["name"], r["ph"], str(r["pid"]), r["tid"], 2.0, str(r["id"]), None if r["args"] is None else json.dumps(r["args"])) for r in rows)
    assert traces.slices(found).count() == sum(r["ph"] == "X" for r in rows)
    starts, ends = traces.flow_ends(found)
    assert starts.count() == sum(r["ph"] == "s" for r in rows) and ends.filter("flow like 'async:%'").count() == sum(r["ph"] == "f" for r in rows)
    (tmp_path / "none.json").write_text("[]")
    assert traces.read(spark, str(tmp_path / "none.json")).count() == 0


def test_tensor_index_opens_only_files_that_can_match(spark, tmp_path):
    def shard(name, tensors):
        head = json.dumps({"__metadata__": {"format": "pt"}} | {n: {"dtype": d, "shape": s, "data_offsets": [0, 0]} for n, d, s in tensors}).encode()
        (tmp_path / name).write_bytes(struct.pack("<Q", len(head)) + head)

    shard("a.safetensors", [("layers.0.weight", "BF16", [4, 8]), ("layers.0.bias", "F32", [8])])
    shard("b.safetensors", [("layers.1.weight", "F8_E4M3", [])])
    where = {"layers.0.weight": "a.safetensors", "layers.0.bias": "a.safetensors", "layers.1.weight": "b.safetensors", "layers.1.lost": "b.safetensors", "head.weight": "missing.safetensors"}
    (tmp_path / tensors.INDEX).write_text(json.dumps({"weight_map": where}))
    got = [tuple(r) for r in tensors.read(spark, str(tmp_path), "layers.*").collect()]
    assert got == [("layers.0.bias", "(8,)", "torch.float32", "a.safetensors"), ("layers.0.weight", "(4, 8)", "torch.bfloat16", "a.safetensors"), ("layers.1.lost", "N/A", "N/A", "b.safetensors"), ("layers.1.weight", "()", "torch.float8_e4m3fn", "b.safetensors")]
    assert [r.tensor_name for r in tensors.read(spark, str(tmp_path), "layers.[0]*", 1).collect()] == ["layers.0.bias"]
    # the missing file is opened only if its tensor may be asked for
    with pytest.raises(Exception, match="missing.safetensors"):
        tensors.read(spark, str(tmp_path)).collect()
