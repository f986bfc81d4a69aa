"""Prefix trie, whitening and language-model scores against brute force, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from tradebook.llm import bloom_lm, prefix_trie, whitening
from tradebook.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, depth int, block long, a string, i long"


def _trie(turns):
    """Nodes by walking every prefix of every rebuilt conversation."""
    convs = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - int(math.fmod(c, 5))
        built = convs.get(family, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, len(built) == d))
    out = []
    for node, who in members.items():
        under = [m for m in members if m[: len(node)] == node]
        kids = [m for m in under if len(m) == len(node) + 1]
        ends = ",".join(map(str, sorted(c for c, here in who if here)))
        out.append(
            (
                min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who), len(kids),
                sum(1 for m in under if any(here for _, here in members[m]) and not any(k[:-1] == m for k in members if k)),
                sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def _of(spark, turns):
    rows = [(*t, 7, 8, "a", 9) for t in turns]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_random_conversations(spark):
    rng = random.Random(5)
    turns = []
    for c in range(-9, 60):
        for t in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 40])):
            turns.append((c, t, rng.choice("ua"), rng.choice(["é", "yes", "no"]) if t % 3 else "same"))
    turns = [t for t in turns if t[0] != 25]  # a family without its first
    rng.shuffle(turns)
    assert _of(spark, turns) == _trie(turns)


def test_trie_of_odd_rows(spark):
    turns = [
        (None, 1, "u", "no conversation"), (1, None, "u", None), (1, 0, None, "x"), (1, 0, None, "x"), (3, 5, "u", ""), (4, 0, "u", "b" * 100_000),
        (6, 0, "a:b", "c"), (11, 0, "a", "b:c"), (2**62, 1, "u", "x"),
    ]
    assert _of(spark, turns) == _trie(turns)
    assert _of(spark, turns[:1]) == [] and _of(spark, []) == []


def test_trie_of_copies_is_one_path(spark):
    turns = [(5 * c, t, "u", f"turn {t}") for c in range(300) for t in range(12)]
    got = _of(spark, turns)
    assert got == _trie(turns) and len(got) == 13 and {r[3] for r in got} == {300}


def _whitened(rows):
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in keep], object)
    fit = np.unique(x.astype(np.int64), axis=0).astype(object)
    n, s = len(fit), fit.sum(axis=0)
    z = n * fit - s
    v = (z.T.dot(z) / n**3).astype(float)
    values, axes = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values)[:16] if values[k] > 1e-11 * np.trace(v)]
    far = (n * x - s).astype(float) / n
    return n, [i for i, _ in keep], [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], far @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


@pytest.mark.parametrize("wide", [1.0, 1e9])
def test_whitening_against_the_whole_matrix(spark, wide):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 20)) * wide + rng.normal(size=(300, 20)) * 0.2 * wide
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400 + i, base[i % 7].tolist()) for i in range(100)]  # copies count once in the fit
    rows += [(900, None), (901, [math.nan] * 20), (902, [None] + [0.0] * 19), (903, [math.inf] * 20), (904, []), (905, [1.0]), (906, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(4)
    n, ids, far, white, explained = _whitened([r for r in rows if r[0] != 905])
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert len(got) == len(ids) * 16 and {r["n"] for r in got} == {n}
    by = sorted(range(len(ids)), key=lambda k: ids[k])
    mine = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    signs = np.sign((mine * white[by]).sum(axis=0))
    assert np.abs(mine * signs - white[by]).max() < 1e-9
    assert [r["deviation"] for r in got[::16]] == [far[k] if far[k] < 2**63 else None for k in by]
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-10) and {r["identity_error"] for r in got} == {0.0}


def test_whitening_without_spread(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(make([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (None, [2.0, 4.0])])).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and sorted(abs(r["whitened"]) for r in line) == pytest.approx([1, 1, 1])
    assert sum(r["vec_id"] is None for r in line) == 2 and {r["explained"] for r in line} == {1.0}


DOCS = "doc_id long, text string, n_tokens int, score string, file int, a array<int>, c string"
TEXTS = [
    (1, "The cat sat on the mat. the CAT sat"), (2, None), (3, ""), (4, " \n\t "), (5, "é日本 \x00 the cat"), (5, "é日本 \x00 the cat"), (None, "the cat"),
    (6, "rare " * 3 + "the"), (9, "the mat " * 30_000), (10, "cat nowhere seen"), (12, "unheard of words"), (13, "the cat sat"), (15, "x"), (17, "cat sat on"),
]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, None, "c") for i, t in rows], DOCS).repartition(3)


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _counts(rows):
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if not _held(i):
            w = (t or "").encode().lower().split() + [b"\n"]
            words.update(w)
            pairs.update(zip([b" ", *w], w))
            words[b" "] += 1
    return words, pairs


def _score(rows, text):
    """Scores as the module's docstring has them, from exact counts put into levels."""
    words, pairs = _counts(rows)
    starts = words.pop(b" ", 0)
    n, v = sum(words.values()), len(words)
    middle = lambda c: 0.0 if c == 0 else max((2.0 ** (c.bit_length() - 1) + 2.0 ** c.bit_length() - 1) / 2, 2.0 ** (c.bit_length() - 1))
    total = base = known = 0
    before = b" "
    toks = (text or "").encode().lower().split() + [b"\n"]
    for w in toks:
        context = middle(words[before] if before != b" " else starts)
        p = (middle(words[w]) + 1) / (n + v + 1)
        both = min(middle(pairs[before, w]), context) if words[w] else 0
        total += math.log10((both + bloom_lm.MU * p) / (context + bloom_lm.MU))
        base += math.log10((words[w] + 1) / (n + v + 1))
        known += words[w] > 0
        before = w
    return len(toks), known, n, base, total


@pytest.mark.parametrize("frequent, part", [(1_000_000, 1 << 27), (2, 1 << 27), (0, 64)])
def test_scores_against_exact_counts(spark, frequent, part):
    docs = _docs(spark, TEXTS)
    model = bloom_lm.learned(docs.where(~bloom_lm.held_out(docs["doc_id"])), bucket_bytes=100_000)
    got = bloom_lm.score(docs, model, frequent_words=frequent, part_bytes=part).collect()
    assert len(got) == len(TEXTS)
    texts = dict(TEXTS)
    close = 0
    for r in got:
        n, known, train, base, total = _score(TEXTS, texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, _held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-12)
        close += r["score"] == pytest.approx(total, rel=1e-9)
    assert close >= len(got) - 2  # a chance hit of the filter may lift a count


def test_several_parts_give_what_one_gives(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = bloom_lm.learned(docs.where(~bloom_lm.held_out(docs["doc_id"])), bucket_bytes=100_000, order=3)
    assert len(list(model.parts(40_000))) > 2
    one, many = (sorted(map(tuple, bloom_lm.score(docs, model, part_bytes=b).select("doc_id", "score").collect())) for b in (1 << 27, 40_000))
    assert one == many


def test_chance_hits_and_levels(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.geometric(0.3, len(h))
    bits = np.frombuffer(bloom_lm._segment([(h, c)], 2.0), np.uint8)
    part = bloom_lm.Part(bits, np.zeros(1, np.int64), np.array([len(bits) // 64]))
    want = bloom_lm.level_of(c, 2.0)
    found = part.levels(h)
    assert (found >= want).all() and (found == want).mean() > 0.97
    strange = part.levels(rng.integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2))
    assert (strange > 0).mean() < 0.03
    assert bloom_lm.level_of(np.array([1, 2, 3, 4, 7, 8, 2**40]), 2.0).tolist() == [1, 2, 2, 3, 3, 4, 41]


def test_no_documents_and_nothing_learned(spark):
    assert bloom_lm.scored(_docs(spark, [])).count() == 0
    held = next(i for i in range(100) if _held(i))
    r = bloom_lm.scored(_docs(spark, [(held, "all is held out")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (5, 0, 0, 0.0, 0.0)


def test_context_helps_held_out_texts(spark):
    got = QUERIES["op13_bloom_lm"](spark, SMALL).where("held_out").selectExpr("sum(score) > sum(base_score)").first()
    assert got[0]
