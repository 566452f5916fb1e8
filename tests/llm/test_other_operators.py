"""Preference formatting, nearest neighbours, the pipeline and the entry points."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tracegrain.llm import annperm, preferences


def test_preferences(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "more"), (2, 3, "assistant", "bad"), (3, 0, "user", "x<|im_end|>"), (3, 1, None, None), (None, 0, "user", "q"), (2, 3, "assistant", "bad")]
    got = {r.chosen_id: r for r in preferences.preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r.rejected_id, r.n_common) == (2, 3)
    assert r.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "good<|im_end|>" and r.rejected.endswith("bad<|im_end|>\n")
    assert got[3].rejected is None and "x<| im_end|>" in got[3].prompt and "unknown" in got[3].prompt


def test_preference_pairs_cover_all(spark):
    ids = spark.range(1000).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("first"))
    pairs = preferences.paired(ids).collect()
    assert sorted([p.chosen_id for p in pairs] + [p.rejected_id for p in pairs if p.rejected_id is not None]) == list(range(1000))


def brute(ids, x, queries, k):
    for q in queries:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        yield q, [(int(ids[i]), float(score[i])) for i in order]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[1000:1400] = x[0]  # one vector holds many rows
    ids = np.arange(1500)
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 16), (5004, [float("nan")] * 16), (5005, [1.0]), (5006, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "id long, vector array<float>")
    got: dict = {}
    for r in annperm.search(df, F.col("id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q, want in brute(ids, x.astype(float), range(0, 1500, 20), 10):
        assert len(got[q]) == 10
        if x[q].tolist() == x[0].tolist():
            assert [v for v, _ in got[q]] == [v for v, _ in want]  # ties go to the smaller id
        hit += len({v for v, _ in got[q]} & {v for v, _ in want})
        total += 10
    assert hit / total >= 0.9
    assert annperm.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = annperm.search(df.filter("id in (0, 20, 21)"), F.col("id") % 20 == 0).collect()
    assert len(few) == 4


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "!!! 123", "en", "s", 7), (902, 'note token = "abcdefghijklmnop"', "en", "s", 0), (903, 'note token = "abcdefghijklmnop"', "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {r.doc_id: r for r in docs.collect()}
    assert not {900, 901} & set(left) and len({902, 903} & set(left)) == 1
    kept = left.get(902) or left[903]
    assert "[assign]" in kept.text and kept.n_chars == len(kept.text)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(left)


def test_entry(spark):
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(names)
