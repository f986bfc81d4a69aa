"""Every link that the fingerprints give is compared by its sets, not one partner of each text alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tradebook.llm import golay_dedup, shingle_join
from tradebook.operators.dedupe import components


def _texts():
    """Copies of one text with a word exchanged each, and two pairs of copies whose common line hides their other words."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(700)]
    out = [" ".join(base)]
    for _ in range(25):
        text = list(base)
        for at in rng.sample(range(700), rng.choice([1, 2, 8])):
            text[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    for name in "abcd":
        tail = [f"{name}{k}" for k in range(60)]
        out += ["buy this now and here " * 300 + " ".join(tail + [end]) for end in ("one", "two")]
    return out


def _groups(names, tie):
    top = {f: f for f in names}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in names:
        for b in names:
            if a < b and tie(a, b):
                top[root(b)] = root(a)
    groups = {}
    for f in names:
        groups.setdefault(root(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_all_links_of_the_fingerprints_are_compared(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    rows = shingle_join._narrow(docs, "doc_id", "text")
    every = shingle_join.stored(shingle_join._prefixes(rows, shingle_join._common(rows)), "test-prefixes")
    classes = shingle_join.stored(every.groupBy("fp", "n", "parity").agg(F.min(F.struct("doc_id", "same")).alias("rep")), "test-classes")
    met = shingle_join._met(every, shingle_join._map_of(classes.select("rep.doc_id"), 16))
    found = components(shingle_join._links(shingle_join.stored(met.where("false"), "test-met"), rows, classes)).collect()  # nothing meets by shingles
    got = {}
    for r in found:
        got.setdefault(r["component"], set()).add(r["id"])

    name = lambda s: (shingle_join._name(s) + 2**63) % 2**64 - 2**63  # noqa: E731  as a long
    sets = {name(s): (set(s.tolist()), golay_dedup.fingerprint(t)) for t in _texts() for s in [shingle_join.shingles(t)]}

    def tie(a, b):
        (x, p), (y, q) = sets[a], sets[b]
        return (p ^ q).bit_count() <= 4 and 5 * len(x & y) >= 4 * len(x | y)

    want = _groups(sorted(sets), tie)
    assert {frozenset(g) for g in got.values()} == want
    assert len(want) >= 4 and max(map(len, want)) > 5
