"""The memory of workers: what a chunk of shingles takes at its peak, and what is given back when a task ends."""

import random
import tracemalloc

import pyarrow as pa

from sentryframe.llm import encoding, ngram_join


class Docs:
    """Stands for a DataFrame; gives the function that would run in the tasks."""

    def mapInArrow(self, work, schema):  # noqa: N802
        return work


def test_sketch_holds_a_chunk_few_times(monkeypatch):
    monkeypatch.setattr(ngram_join.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    rng, words = random.Random(3), [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=15_000)) for _ in range(70)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(70), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    work = ngram_join._sketch(Docs(), 5, 8, 0, 64, 1 << 20)
    tracemalloc.start()
    try:
        out = list(work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 1 and sum(len(x) for k, x in zip(out[0]["kind"].to_pylist(), out[0]["data"].to_pylist()) if k) == 4 * 70 * 14_996
    assert peak < 8 * (8 << 20)


def test_tasks_give_memory_back_at_their_end(monkeypatch):
    done = []
    monkeypatch.setattr(encoding, "release", lambda: done.append("released"))
    for work in (ngram_join._sketch(Docs(), 5, 8, 0, 64, 1 << 20), ngram_join._whole_sets(Docs(), 5, 0, 64)):
        done.clear()
        monkeypatch.setattr(ngram_join.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
        assert not list(work(iter([])))
        assert done == ["released", "released"]
