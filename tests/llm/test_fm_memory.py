"""What the steps of op10 hold in a worker, and which anchors leave the shards."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracegrain.llm import fmdedup, textvec

TEXTS = [" ".join(f"w{i % 30}" for i in range(90)), "", None, " ".join(f"w{i % 30}" for i in range(40))]
ALL = bytes([255]) * 64
NONE = np.zeros(0, np.uint64)


def _documents(*names: str) -> pa.RecordBatch:
    numbers = pa.array(range(len(TEXTS)), pa.int64())
    starts = pa.array([[0, 30], [], [], [3]], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict({n: {"text": pa.array(TEXTS, pa.string()), "starts": starts}.get(n, numbers) for n in names})


def _segments(sequences: list[np.ndarray]) -> pa.Table:
    numbers = pa.array(range(len(sequences)), pa.int64())
    words = pa.array([x.tobytes() for x in sequences], pa.binary())
    return pa.table({"seg": numbers, "doc": numbers, "seq": numbers, "at": pa.array([0] * len(sequences), pa.int32()), "anchor": numbers, "words": words})


STEPS = {
    "summaries": lambda: fmdedup._summaries([_documents("doc_id", "doc", "text")]),
    "anchors": lambda: fmdedup._anchors(20, NONE, ALL)([_documents("doc", "text")]),
    "segments": lambda: fmdedup._occurrences(20, NONE, ALL, ALL)([_documents("doc", "text")]),
    "texts": lambda: fmdedup._texts(ALL)([_documents("doc", "text")]),
    "what is left": lambda: fmdedup._removed(20)([_documents("doc", "seq", "text", "starts").take(pa.array([0, 3]))]),
    "search": lambda: [fmdedup._searched(20)(_segments([np.arange(25, dtype=np.uint64)] * 2))],
}


@pytest.mark.parametrize("step", STEPS)
def test_a_worker_gives_back_freed_memory_once_a_step_is_done(step, monkeypatch):
    given = []
    monkeypatch.setattr(textvec, "release", lambda: given.append(1))
    assert len(list(STEPS[step]())) == 1
    assert given == [1]


def test_a_full_shard_is_searched_in_bounded_memory():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    n = fmdedup.SHARD
    sequences = [pool[rng.integers(0, len(pool), 20 + i % 15)] for i in range(n)]
    for i in range(0, n, 100):  # the last 20 words of another segment, behind own ones
        sequences[i + 1] = np.concatenate((sequences[i + 1][:7], sequences[i][-20:], sequences[i + 1][:3]))
    table = _segments(sequences)
    seen, want = set(), {}
    for i, words in enumerate(sequences):
        for k in range(len(words) - 19):
            window = words[k : k + 20].tobytes()
            if window in seen:
                want.setdefault(i, []).append(k)
            seen.add(window)
    del seen
    tracemalloc.start()
    got = fmdedup._searched(20)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(want) == n // 100
    assert {r["seg"]: sorted(r["earlier"]) for r in got.to_pylist()} == want
    assert peak < 80 << 20


def test_an_anchor_of_few_different_segments_stays_in_its_shard(spark, monkeypatch):
    """Lines that recur: each anchor has hundreds of segments, of which a few differ."""
    rng = random.Random(3)
    line = [f"m{i}" for i in range(40)]
    texts = [" ".join((line + [f"s{i}"]) * 120) for i in range(3)] + [" ".join(f"r{rng.randrange(50)}" for _ in range(60)), None]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        words = (text or "").split()
        cut = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            cut |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        want[i] = (len(words), len(cut), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in cut).encode()).hexdigest())
    used = []
    plain = fmdedup._earlier_windows
    monkeypatch.setattr(fmdedup, "_earlier_windows", lambda *a: used.append(1) or plain(*a))
    got = fmdedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard=30)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want
    assert not used
