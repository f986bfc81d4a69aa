"""Postings of what queries ask for: the same hits, and little else is made."""

from __future__ import annotations

import random

from tradebook.operators import pieces


def test_only_asked_triples_are_posted(spark):
    rng = random.Random(9)
    texts = ["the quick brown fox", "", None, "ünïcode شركة quick", *("".join(rng.choices("abcdefgh ", k=200)) for _ in range(40))]
    index = spark.createDataFrame(list(enumerate(texts)), "id long, searchable_text string")
    for queries in (["abc", "gh ab", "quick شرك", "ick own"], ["a", "üN x"], ["bc", " "], ["  "]):
        q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        whole = pieces.postings(index, ["id"])
        some = pieces.postings(index, ["id"], asked=pieces.cover(q))
        asked = {(r["width"], r["gram"]) for r in pieces.cover(q).collect()}
        every = {(r["gram"], r["id"]): tuple(r["places"]) for r in whole.collect()}
        got = {(r["gram"], r["id"]): tuple(r["places"]) for r in some.collect()}
        want = {k: v for k, v in every.items() if any((w, k[0] >> (3 - w) * 21) in asked for w in (1, 2, 3))}
        assert want.items() <= got.items() <= every.items() and len(got) <= len(want) + 5
        hits = {tuple(r) for r in pieces.search_pieces(q, some, ["id"]).collect()}
        assert hits == {(n, i) for n, x in enumerate(queries) if x.strip() for i, t in enumerate(texts) if t and all(w in t for w in x.lower().split())}
