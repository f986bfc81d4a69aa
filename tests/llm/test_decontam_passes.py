"""A benchmark of several blocks: the passes find the same, and no index outlives its pass."""

from pyspark import Broadcast

from tradebook.llm import qgram_decontam


def test_passes(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False, was=Broadcast.destroy: (gone.append(1), was(self, blocking))[1])
    docs = spark.createDataFrame([(i, f"document {i} " + " ".join(f"word{i}x{k}" for k in range(20))) for i in range(12)], "doc_id long, text string")
    bench = docs.where("doc_id < 6").selectExpr("doc_id AS item_id", "text")
    want = sorted(tuple(r) for r in qgram_decontam.matches(docs, bench).collect())
    assert len(want) == 6 and not gone
    assert sorted(tuple(r) for r in qgram_decontam.matches(docs, bench, block_chars=300).collect()) == want and gone
    gone.clear()
    kept = qgram_decontam.clean(docs, bench, block_chars=300)
    assert gone and kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(6, 12))
