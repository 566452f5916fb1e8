"""What a worker keeps when a step's task is done, and what is sent to it."""

from __future__ import annotations

import pickle
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracegrain.llm import bpe, decontam, langid, ngramjoin, textvec

TEXTS = ["one two three four five six seven", "", None, "the quick brown fox jumps over the lazy dog " * 9]


def _documents(*names: str) -> pa.RecordBatch:
    columns = {"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "row": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string()), "lang": pa.array(["en"] * len(TEXTS), pa.string())}
    return pa.RecordBatch.from_pydict({n: columns[n] for n in names})


STEPS = {
    "language profiles": lambda: langid._count(3)([_documents("text", "lang")]),
    "language": lambda: langid._predictor({"en": np.arange(400)}, 3, 400)([_documents("text").column(0)]),
    "n-gram counts": lambda: ngramjoin._cells(5)([_documents("text")]),
    "n-gram prefixes": lambda: ngramjoin._prefixes(5, 80, bytes(ngramjoin.CELLS))([_documents("doc_id", "row", "text")]),
    "n-gram sets": lambda: ngramjoin._whole_sets(5)([_documents("text")]),
    "benchmark search": lambda: decontam._search(decontam.probes([(1, TEXTS[3])], 8, 128, 0.1), 8)([_documents("doc_id", "text")]),
    "tokens": lambda: bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["doc_id"], True)([_documents("doc_id", "text")]),
}


@pytest.mark.parametrize("step", STEPS)
def test_a_worker_gives_back_freed_memory_once_its_task_is_done(step, monkeypatch):
    given = []
    monkeypatch.setattr(textvec, "release", lambda: given.append(1), raising=False)
    assert len(list(STEPS[step]())) == 1
    assert given == [1]


def test_release_empties_the_pool_of_freed_arrays():
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        kept = [np.ones(1 << 13) for _ in range(1 << 11)]  # 128 MB in pieces below the size that the system takes back by itself
        wall = [np.ones(1 << 13) for _ in range(2)]
        del kept
        yield wall

    before = held()
    wall = list(textvec.lean(run)([]))
    assert held() - before < 40
    assert len(wall) == 1


def test_a_benchmark_is_sent_without_its_cells():
    groups = decontam.probes([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(20)], 8, 128, 0.1)
    assert all((g.starts >= 0).any() for g in groups)
    sent = pickle.dumps(groups)
    assert len(sent) < 4_000_000  # of which three tables of cells would be 48 MB
    for a, b in zip(groups, pickle.loads(sent), strict=True):
        assert np.array_equal(a.starts, b.starts)
        known = np.arange(len(a.codes))
        assert np.array_equal(decontam._looked_up(b, a.codes, (a.codes >> np.uint64(64 - decontam.CELL_BITS)).astype(np.int32)), known)
