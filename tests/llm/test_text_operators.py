"""Operators on texts against brute force, round trips and planted cases."""

import base64
import gzip
import hashlib
import random
import re
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tracegrain.llm import bpe, decontam, fmdedup, langid, ngramjoin, resampling, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts with every edge: null, empty, blank, ties, copies, very long, unusual characters.
EDGES = [None, "", "   \n", "a", "a a", "a b c", "A b C", "'s it's", "x" * 5000, "\x1c\x85 ²½ 中文 😀", "w " * 300, "a b c", None]


def table(spark, texts, **more):
    """doc_id and text, with a null id, a repeated row and clashing column names."""
    rows = [(i, t, "en", "s", 0, 0) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 0, 0), rows[0], rows[3]] if texts else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node int, score int")


def syllables(rng, n):
    return " ".join("".join(rng.choices(("ta", "re", "mo", "lin", "sa", "ku"), k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [syllables(rng, rng.randint(1, 120)) for _ in range(40)]
    near = []
    for t in base[:12]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    joined = [base[i] + " " + base[i + 1] for i in range(0, 10, 2)]
    return EDGES + base + near + joined + base[:5]


def test_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path).ids, special_tokens={})
    docs = table(spark, corpus)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for options in ({}, {"chunk_chars": 60, "overlap": 12}):
        rows = bpe.encode(docs, **options).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = known.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encode(docs.limit(0)).count() == 0


def hidden(text, *ways):
    for way in ways:
        if way == "url":
            text = urllib.parse.quote(text, safe="")
        elif way == "unicode":
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif way == "base64":
            text = base64.b64encode(text.encode()).decode()
        else:
            text = base64.b64encode(gzip.compress(text.encode())).decode()
    return text


@pytest.mark.parametrize("ways", [("url",), ("unicode",), ("base64",), ("gzip",), ("url", "base64"), ("base64", "url"), ("gzip", "base64"), ("unicode", "gzip", "url"), ("base64", "base64", "base64")])
def test_hidden_secrets(ways):
    text = "see " + hidden('token = "abcdefghijklmnop"', *ways) + " end"
    base, spans, layers, unopened = secrets.scan(text)
    inside = [s for s in spans if s not in base and s[1] == 0]
    assert len(inside) == 1 and layers >= len(ways) and not unopened
    start, _, end = inside[0]
    assert 4 <= start < end <= len(text) - 4


def test_base_secrets():
    assert secrets.scan("password: token: abcdefghijklmnop")[0] == []
    assert secrets.scan("xAPI_Key='abcdefghijkl'")[0] == [(1, 0, 22)]
    assert secrets.scan("AKIA" + "A" * 14 + " AKIAAA")[0] == [(0, 1, 18)]
    assert secrets.scan("z" + "0123456789abcdef" * 2)[0] == [(1, 2, 33)]
    assert secrets.scan("%2525252525")[2] < 10  # cycles and fixpoints end


def test_secret_query(spark, corpus):
    docs = table(spark, [*corpus, 'secret="abcdefghijkl"'])
    rows = secrets.found(docs).select("doc_id", "secrets.*").collect()
    assert len(rows) == docs.count() and sum(r.n_assign for r in rows) == 1
    assert secrets.redacted(docs).filter("text = '[assign]\"'").count() == 1
    assert secrets.found(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ways", [("base64",), ("gzip",), ("base64", "url"), ("url", "base64"), ("base64", "base64"), ("base64", "unicode")])
def test_secret_at_two_places(spark, ways):
    token = hidden('token = "abcdefghijklmnop"', *ways)
    text = f"first {token} then {token} end, {token}"
    spans = [s for s in secrets.scan(text)[1] if s[1] == 0]
    assert len(spans) == 3 and all(sum(a <= s[0] and s[2] <= a + len(token) for s in spans) == 1 for a in (6, 12 + len(token), 18 + 2 * len(token)))
    docs = table(spark, [text, "", "", ""])
    assert secrets.found(docs).filter("doc_id = 0").first().secrets.spans.count("assign") == 3
    kept = secrets.redacted(docs).filter("doc_id = 0").first().text
    assert kept.count("[assign]") == 3 and token not in kept


def kinds_in(text, data, **options):
    """Kinds of the spans that are the base64 of data within text."""
    token = base64.b64encode(data).decode()
    return [k for a, k, b in secrets.scan(text.format(token), **options)[1] if text.format(token)[a:b] == token]


SECRET = 'token = "abcdefghijklmnop"'


@pytest.mark.parametrize("data", [b"\xff\x00\x9b " + SECRET.encode(), ("\ufeff" + SECRET).encode(), (SECRET + "\u200b").encode(), ("\x1b[1m" + SECRET).encode(), SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"z" + SECRET.encode("utf-16-le"), gzip.compress(b"a") + gzip.compress(SECRET.encode()), gzip.compress(gzip.compress(SECRET.encode("utf-16")))])
def test_secrets_in_bytes_that_are_not_clean_text(data):
    assert kinds_in("see {} end", data) == [0]
    assert len([s for s in secrets.scan("see " + "".join(f"%{b:02x}" for b in data) + " end")[1] if s[1] == 0]) == 1
    assert len([s for s in secrets.scan("see " + "".join(f"\\x{b:02x}" for b in data) + " end")[1] if s[1] == 0]) == 1


def test_secrets_in_streams_past_the_room():
    rng = random.Random(3)
    filler = syllables(rng, 400_000).encode()  # some MB
    assert len(filler) > 2 << 20
    for at in (0, (1 << 20) - 10, len(filler)):
        assert kinds_in("see {} end", gzip.compress(filler[:at] + b" " + SECRET.encode() + b" " + filler[at:]), expansion=1000) == [0]
    inner = base64.b64encode(b"x" * 100_000 + SECRET.encode())  # a token across the windows' bounds, longer than they share
    assert kinds_in("see {} end", gzip.compress(gzip.compress(filler[:1_000_000] + b" " + inner + b" " + filler)), expansion=1000) == [0]
    assert kinds_in("see {} end", gzip.compress(filler), expansion=1000) == []
    # one large stream does not hide the other escapes of its document
    large, other = ("".join(f"%{b:02x}" for b in x) for x in (gzip.compress(bytes(100_000)), SECRET.encode()))
    assert [(a, k) for a, k, _ in secrets.scan(f"{large} {other}", expansion=1000)[1]] == [(len(large) + 1, 0)]
    # long texts with escapes leave the room to the streams
    text = "plain words " * 1000 + "%41 \\u0041 " + hidden(SECRET, "gzip")
    assert any(k == 0 for _, k, _ in secrets.scan(text, expansion=2000)[1]) and secrets.scan(text, expansion=2000)[3] == 0


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, corpus, n, percent):
    docs = table(spark, corpus)
    sets = [(r.doc_id, shingles(r.text, n)) for r in docs.collect()]
    group = {i: i for i in range(len(sets))}
    find = lambda i: i if group[i] == i else find(group[i])
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = sorted((doc if doc is not None else -1, len(own), least.get(find(i), -1) if own else (doc if doc is not None else -1)) for i, (doc, own) in enumerate(sets))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngramjoin.groups(docs, n, percent).collect())
    assert got == want
    assert ngramjoin.groups(docs.limit(0), n, percent).count() == 0


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 40_000, np.int64).astype(np.uint64) * np.uint64(2))
    for changed in (0, 1, 30, 4000):
        b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, np.int64).astype(np.uint64))))
        words = [np.array([c[i].as_py() for c in ngramjoin._sketches([a, b])], np.int64).view(np.uint64) for i in (0, 1)]
        assert int(np.bitwise_count(words[0] ^ words[1]).sum()) <= len(np.setxor1d(a, b))


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    """Copies with one to nine changed words each and no original, against brute force."""
    rng = random.Random(11)
    words = syllables(rng, 150).split()
    texts = []
    for i in range(150):
        own = list(words)
        for j in rng.sample(range(150), 1 + i % 9):
            own[j] = f"w{rng.randrange(60)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(150))
    for _ in range(150):
        new = [min(group[j] for j in range(150) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(150)]
        if new == group:
            break
        group = new
    assert 1 < len(set(group)) < 150
    got = {r.doc_id: r.component_id for r in ngramjoin.groups(docs, 5, 80).collect()}
    assert got == dict(enumerate(group))


def test_substring_dedup(spark, corpus):
    docs = table(spark, corpus).filter("doc_id is not null").distinct()
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        words = WORD.findall(r.text or "")
        cut = [False] * len(words)
        for i in range(len(words) - 19):
            own = tuple(words[i : i + 20])
            if own in seen:
                cut[i : i + 20] = [True] * 20
            seen.add(own)
        kept = [w for w, c in zip(words, cut, strict=True) if not c]
        want[r.doc_id] = (len(words), sum(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmdedup.deduplicated(docs).collect()} == want
    assert fmdedup.deduplicated(table(spark, corpus)).count() == len(corpus) + 3
    assert fmdedup.deduplicated(docs.limit(0)).count() == 0


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    items = [(i, syllables(rng, 40)) for i in range(4)] + [(9, "short"), (10, None)]
    text = items[0][1]
    edited = text[:50] + "X" + text[51:120] + text[121:]
    planted = ["before " + text + " after", "so " + edited + " on", items[1][1].upper().replace(" ", " - ")]
    docs = table(spark, [*corpus, *planted])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()}
    n = len(corpus)
    assert set(got) == {(n, 0), (n + 1, 0), (n + 2, 1)}
    assert got[n, 0].spans == f"7:{7 + len(text)}" and got[n, 0].edits == 0 and got[n + 1, 0].edits > 0
    assert set(got) == {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, block_chars=300).collect()}
    kept = decontam.clean(docs, bench)
    assert kept.count() == docs.count() - 3 and kept.columns == docs.columns
    assert decontam.matches(docs, bench.limit(0)).count() == decontam.matches(docs.limit(0), bench).count() == 0


def test_excerpts_at_all_offsets(spark):
    rng = random.Random(31)
    item, other = syllables(rng, 80)[:390].strip(), syllables(rng, 30)[:110].strip()
    cuts = [text[at : at + 81] for text in (item, other) for at in range(len(text) - 80)]
    docs = table(spark, [f"some prose before, {cut} and after" for cut in cuts] + ["nothing of the kind"])
    found = decontam.matches(docs, spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")).select("doc_id", "item_id").collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 1 if i < len(item) - 80 else 2) for i in range(len(cuts))}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = langid.profiles(docs.filter(langid.is_training(F.col("doc_id"))))
    held = langid.identified(docs.filter(~langid.is_training(F.col("doc_id"))), known).select("lang", "language.*").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in held)
    odd = langid.identified(table(spark, EDGES), known).select("text", "language.*").collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert langid.profiles(docs.limit(0)) == {}


def test_resampling(spark, corpus):
    docs = table(spark, corpus)
    got = resampling.resampled(docs, spark.createDataFrame([(i,) for i in range(20, 30)], "doc_id long"), share=0.5).collect()
    keys = sorted((r.key for r in got), reverse=True)
    least = keys[-(-len(got) // 2) - 1]
    assert len(got) == docs.count() and all(r.selected == (r.key >= least) for r in got)
    assert resampling.resampled(docs.limit(0), docs.limit(0)).count() == 0


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    model = toxicity.character_model(spark.read.parquet(f"{folder}/documents.parquet"))
    own = toxicity.Restorer(model)
    for written, meant in (("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("s c u m", "scum"), ("m0r0n", "moron")):
        assert own.extra(f"the {written} was") == meant
    assert own.extra("plain words, nothing else!!") == ""
    empty = toxicity.trained(table(spark, []), spark.createDataFrame([], "doc_id long, toxic long"))
    assert {r.score for r in toxicity.scored(table(spark, EDGES).drop("score"), empty).collect()} == {0.0}


@pytest.mark.parametrize(("written", "meant"), [("worthle$$", "worthless"), ("w0rthle55", "worthless"), ("idi07", "idiot"), ("disgu5tin9", "disgusting"), ("i d 1 o t", "idiot"), ("1 d 1 0 t", "idiot"), ("s t u p ! d", "stupid"), ("idiiot", "idiot"), ("stuupid", "stupid")])
def test_noisy_spellings(written, meant):
    words = "the idiot was stupid and worthless a letter of disgusting weather passed all the rest less or more ".split()
    counts = np.ones((28, 28, 28))
    codes = [27 if c == " " else ord(c) - 97 for c in " ".join(["", *words * 50, ""])]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        counts[27 if b == 27 else a, b, c] += 1
    codes = [27, *codes]
    for b, c in zip(codes, codes[1:], strict=False):
        if b == 27:
            counts[27, 27, c] += 1
    own = toxicity.Restorer(np.log(counts / counts.sum(axis=2, keepdims=True)))
    assert own.extra(f"the {written} was, passed!") == meant
    assert own.extra("a letter passed, less 12 345 of all weather!") == ""
