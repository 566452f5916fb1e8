"""Ranked search, source mixing and vector codes: SQL on given tables, brute force and odd rows on small ones."""

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm import mixing, pqcodes, queries, tput

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_source_mix", "op13_vector_codes"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in found.fetchall())


def _terms(text):
    return [t for t in "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in text or "").split(" ") if t]


def _ranked(docs, items, k):
    split = [(doc_id, _terms(text)) for doc_id, text in docs]
    number, every = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    counts = [(doc_id, len(t), Counter(t)) for doc_id, t in split]
    df = Counter(term for _, _, c in counts for term in c)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(_terms(text))
    out = []
    for item_id, own in wanted.items():
        scores = []
        for doc_id, n, c in counts:
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * number) // every))) for t in own if t in c)
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item_id, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _search(spark, docs, items, k=3):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, term int, q string")
    items = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, gain int")
    return sorted((tuple(r) for r in tput.ranked(docs, items, k).collect()), key=repr)


def test_ranked_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(40)] + ["Über", "straße"]
    shares = 1 / np.arange(1, len(names) + 1)
    text = lambda n: " ".join(rng.choice(names, n, p=shares / shares.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(150)] + [(i, "w1 w2 w3") for i in range(200, 230)]
    items = [(i, text(rng.integers(1, 12))) for i in range(12)]
    for k in (1, 3, 10):
        assert _search(spark, docs, items, k) == _ranked(docs, items, k)


def test_ranked_search_of_odd_rows(spark):
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (None, "alpha beta"), (4, "gamma " * 50_000), (5, "...")]
    items = [(1, "alpha beta beta"), (None, "gamma"), (2, None), (3, "nothing here"), (1, "gamma")]
    assert _search(spark, docs, items) == _ranked(docs, items, 3)
    assert _search(spark, [], items) == [] and _search(spark, docs, []) == []


def _aimed(sizes, weights=(5, 2, 1)):
    target, full, total = {}, set(), sum(sizes.values())
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        for s in sizes:
            target[s] = 3 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_)
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full.update(over)


DOCS = "doc_id long, text string, source string, size string, s int"


def _mix(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS)
    sized = mixing.sized(docs)
    sources = mixing.targets(sized)
    return sized, sources


def test_mix_of_skewed_sources_and_odd_rows(spark, tmp_path):
    rows = [(i, "w " * (i % 7), "a") for i in range(300)] + [(1000 + i, "x y", "b") for i in range(5)] + [(2000, "z " * 9000, None), (2001, None, None), (None, "q", ""), (None, "q", "")] + [(3000, "same words here", "c")] * 4
    spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.op12_source_mix(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.size) for r in found), key=repr) == sorted(((d, len((t or "").split())) for d, t, _ in rows), key=repr)
    assert found and all(0 <= r.taken <= 3 * r.size for r in found)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    wanted = _aimed(sizes)
    taken, sized = Counter(), {r.source_size: r.target for r in found}
    for r in found:
        taken[r.source_size] += r.taken
    for s, target in wanted.items():
        assert abs(sized[sizes[s]] - target) < 1e-6
        same = [x for x in sizes if sizes[x] == sizes[s]]
        assert abs(taken[sizes[s]] - sum(wanted[x] for x in same)) <= len(same)
    again = mixing.op12_source_mix(spark, str(tmp_path)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mix_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mixing.op12_source_mix(spark, f"{tmp_path}/none").collect() == []
    spark.createDataFrame([(1, " ", "a", "x", 3)], DOCS).write.parquet(f"{tmp_path}/blank/documents.parquet")
    assert [tuple(r) for r in mixing.op12_source_mix(spark, f"{tmp_path}/blank").collect()] == [(1, 0, 0, 0.0, 0)]


def test_slots_follow_the_weights_all_along(spark):
    sized, sources = _mix(spark, [(i, "w " * 500, "abc"[i % 3]) for i in range(600)])
    slots = sorted((r.slot, r.s) for r in mixing.schedule(sources).collect())
    need = Counter(s for _, s in slots)
    seen = Counter()
    for i, (_, s) in enumerate(slots):
        seen[s] += 1
        assert abs(seen[s] - (i + 1) * need[s] / len(slots)) < 6
    pieces = mixing.mixed(mixing.laid(sized, sources), mixing.schedule(sources)).filter("slot is not null")
    assert pieces.filter("to_word < from_word").count() == 0
    # within an epoch no word is taken twice
    twice = pieces.groupBy("epoch", "doc_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"), F.max("size").alias("size")).filter("n > size")
    assert twice.count() == 0


def _brute(points, parts, entries, rounds):
    width = points.shape[1] // parts
    books, codes, error = [], [], np.zeros(len(points), np.int64)
    for p in range(parts):
        x = points[:, p * width : (p + 1) * width]
        book = x[:entries].copy()
        for r in range(rounds + 1):
            d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if r == rounds:
                codes.append(near)
                error += d.min(axis=1)
            else:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = [int(v) // int((near == e).sum()) for v in x[near == e].sum(axis=0)]
        books.append(book)
    return books, np.array(codes).T, error


@pytest.mark.parametrize("spread", [3, 400])
def test_vector_codes_against_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread, (700, 8))  # with a small spread most distances tie
    rows = spark.createDataFrame([(i, [float(v) / 16 for v in p], int(i % 3)) for i, p in enumerate(points.tolist())], "vec_id long, vector array<float>, label int")
    codes, books = pqcodes.compressed(rows, 16, 4, 64, 3)
    want_books, want, error = _brute(points, 4, 64, 3)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    found = {r.vec_id: (r.code, r.error) for r in codes.collect()}
    assert found == {i: ("".join(f"{x:02x}" for x in row), int(error[i])) for i, row in enumerate(want.tolist())}
    back = {r.vec_id: r.vector for r in pqcodes.decoded(codes, books, 16).collect()}
    assert back[5] == [(v + 0.5) / 16 for p in range(4) for v in books[p][want[5, p]]]


def test_tree_finds_the_lowest_index_of_equal_entries():
    rng = np.random.default_rng(3)
    points, asked = rng.integers(0, 3, (300, 3)), rng.integers(-1, 4, (500, 3))
    found, best = pqcodes.Tree(points).nearest(asked)
    d = ((asked[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_vector_codes_of_odd_rows(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("values", T.StringType())])
    good = [1.0, -2.0, 0.5, 3e38]
    rows = [(1, good, 1, "x"), (1, good, 1, "x"), (2, None, 1, "x"), (3, [1.0, None, 2.0, 3.0], 1, "x"), (4, [1.0, float("nan"), 2.0, 3.0], 1, "x"), (5, [1.0, float("inf"), 0.0, 0.0], None, "x"), (None, [0.0] * 4, None, "x"), (6, [], 1, "x"), (7, [1.0, 2.0], 1, "x")]
    codes, books = pqcodes.compressed(spark.createDataFrame(rows, schema))
    found = sorted(((r.vec_id, r.code) for r in codes.collect()), key=repr)
    assert found == [(1, "00000000"), (1, "00000000"), (None, "00000000")] and all(len(b) == 1 for b in books)
    assert pqcodes.compressed(spark.createDataFrame([], schema))[0].collect() == []
