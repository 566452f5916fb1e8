"""Nested escapes, rows that repeat, and clashing names."""

import base64
import hashlib
import time
import zlib
from urllib.parse import quote

import pytest

from tracegrain.llm import decontam, fmdedup, ngramjoin, secrets

TOKEN = "password = abcdefghijklmnop1"


def test_escapes_of_any_depth_are_unwrapped_to_the_end():
    for depth in (1, 3, 7, 8, 9, 20, 300):
        text = TOKEN
        for _ in range(depth):
            text = quote(text, safe="")
        _, spans, layers, _ = secrets.scan(f"é {text} end")
        assert any(kind == 0 and f"é {text} end"[a:b] == text for a, kind, b in spans), depth
        assert layers <= 12
    for sign in ("u005c", "x5c"):
        text = "\\" + sign * 40 + "u0070assword: abcdefghijklmnop"
        assert (0, 0, len(text)) in secrets.scan(text)[1]


def test_deep_escapes_take_linear_time():
    for text in ("%" + "25" * 500_000 + "41", "\\" + "u005c" * 200_000 + "u0041", "%2" * 20_000 + "%35" + "35" * 20_000):
        began = time.time()
        secrets.scan(text + " token=abcdefghijklmnop")
        assert time.time() - began < 6


def test_unwrapped_characters_keep_their_places():
    text = "%" + "25" * 12 + "C3" + "%" + "25" * 12 + "A9 secret: abcdefghijklmnop " + "\\" + "u005c" * 11 + "ud83d" + "\\" + "u005c" * 11 + "ude00"
    layer = secrets._unescaped(secrets.Layer(text))
    assert layer.text == "é secret: abcdefghijklmnop 😀"
    assert layer.source(0, 1) == (0, 54) and layer.source(2, 8) == (55, 61) and layer.source(28, 29)[1] == len(text)


def test_repeated_rows_of_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base)] * 1000 + [(2, base + " more")] * 1000 + [(3, "other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    found = ngramjoin.groups(docs, 3, 90).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1000), (2, 1, 1000), (3, 3, 1)]
    assert time.time() - began < 60


def test_clean_judges_each_row_and_keeps_all_columns(spark):
    item = " ".join(f"benchmark{i} passage{i * 7}" for i in range(20))
    rows = [(1, f"before {item} after", "a"), (1, "a clean text of the same id", "b"), (None, item, "c"), (None, "clean", "d"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(5, item), (6, item[100:] + " and other words at its end")], "item_id long, text string")
    kept = decontam.clean(docs, bench)
    assert kept.columns == ["doc_id", "text", "_row"] and sorted(r._row for r in kept.collect()) == ["b", "d", "e"]
    assert sorted(r._row for r in decontam.clean(docs, bench, block_chars=150).collect()) == ["b", "d", "e"]


def _found(text):
    return secrets.joined(secrets.scan(text)[1])


@pytest.mark.parametrize("before", ["", "i", "id", "idx", "idxy", "prefix", "x" * 7])
def test_base64_right_behind_letters(before):
    token = base64.b64encode(b"the password = abcdefghijkl1234 as given").decode().rstrip("=")
    found = _found(f"A key {before}{token} ends.")
    kind, a, b = found.split(",")[-1].split(":")
    assert kind == "assign" and 6 <= int(a) <= 6 + len(before) and int(b) == 6 + len(before) + len(token)


def test_raw_deflate():
    tool = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = tool.compress(b"some words and secret: zyxwvutsrqponm and more words") + tool.flush()
    token = base64.b64encode(data).decode()
    assert _found(f"see {token} there") == f"assign:4:{4 + len(token)}"


def test_large_raw_deflate():
    tool = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = tool.compress(b"word " * 5_000_000 + b"secret: zyxwvutsrqponm" + b" word" * 1000) + tool.flush()
    token = base64.b64encode(data).decode()
    assert f"assign:0:{len(token)}" in _found(token)


@pytest.mark.parametrize("columns", [16, 20, 24, 32, 38])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_base64_in_short_lines(columns, end):
    token = base64.b64encode(b"in many lines api_key=abcdefghijklmnop and some more to fill them").decode()
    wrapped = end.join(token[i : i + columns] for i in range(0, len(token), columns))
    assert f"assign:7:{7 + len(wrapped)}" in _found(f"before\n{wrapped}\nafter").split(",")


def test_words_on_lines_give_nothing():
    assert _found("internationalisation\n" * 3 + "counterrevolutionaries\nend\n" + "x" * 50 + "\n") == ""


def test_many_short_lines_in_time():
    began = time.time()
    assert _found("\n".join("abcdefghijklmnopqrstuvwx"[: 16 + i % 9] for i in range(40_000))) == ""
    assert _found("Ab3" * 400_000) == ""
    assert time.time() - began < 20


@pytest.mark.parametrize("shard", [1, 30, fmdedup.SHARD])
def test_anchors_of_more_segments_than_a_shard_holds(spark, monkeypatch, shard):
    """One passage between 25 beginnings and 25 ends: its anchors have hundreds of different segments, whose windows meet in part."""
    middle = [f"m{i}" for i in range(14)]
    texts = [" ".join([f"a{i % 25}.{k}" for k in range(12)] + middle + [f"z{i // 25}.{k}" for k in range(12)]) for i in range(625)]
    texts += [texts[7], " ".join(middle * 3), None, ""]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        words = (text or "").split()
        windows = [tuple(words[k : k + 20]) for k in range(len(words) - 19)]
        cut = set()
        for k, w in enumerate(windows):
            cut |= set(range(k, k + 20)) if w in seen else set()
            seen.add(w)
        want[i] = (len(words), len(cut), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in cut).encode()).hexdigest())
    used = []
    plain = fmdedup._earlier_windows
    monkeypatch.setattr(fmdedup, "_earlier_windows", lambda *a: used.append(1) or plain(*a))
    got = fmdedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard=shard)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want
    assert bool(used) == (shard < fmdedup.SHARD)
