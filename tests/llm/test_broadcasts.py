"""Tables that grow with the corpus are never sent to the driver for a join, however small Spark takes them to be."""

from __future__ import annotations

import random

import numpy as np

from tradebook.llm import golay_dedup, shingle_join


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_golay_keys_meet_by_shuffles(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    fps = spark.createDataFrame([(int(v),) for v in np.array(sorted(set(values)), np.uint64).view(np.int64)], "fp long")
    fps = golay_dedup.stored(fps, "test-fps")  # of a size that Spark knows
    found = golay_dedup.links(fps)
    assert "Broadcast" not in _plan(found) and "SortMergeJoin" in _plan(found)
    every = [r["fp"] for r in fps.collect()]
    close = {(a, b) for a in every for b in every if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert {tuple(r) for r in found.collect()} == close and len(close) >= 35


def test_near_copy_stage_sends_no_shingles(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):
        text = rng.choices(words, k=80)
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(text[:-1] + ["x"])), (3 * k + 2, " ".join(text[:60] + rng.choices(words, k=20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, store = {}, shingle_join.stored

    def spied(df, name):
        plans.setdefault(name, []).append(_plan(df))
        return store(df, name)

    monkeypatch.setattr(shingle_join, "stored", spied)
    kept = [r["doc_id"] for r in shingle_join.one_of_each(docs).select("doc_id").collect()]
    for name in ("shingle-golay", "shingle-met", "shingle-left"):  # Golay keys, and shingles of all documents
        assert plans[name] and not any("Broadcast" in p for p in plans[name])
    assert sorted(kept) == sorted(i for i, _ in rows if i % 3 != 1)
