"""Clever plans against plain ones on small inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradebook.operators import dedupe as dd
from tradebook.operators import evidence as ev
from tradebook.operators import resolve as rs
from tradebook.operators import search as se
from tradebook.operators.keys import numbered

LEGAL = {"inc", "llc", "ltd", "corp", "co", "gmbh", "ag", "limited", "corporation", "company"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _match(a, b):
    lo, hi = sorted((len(a), len(b)))
    if a in b or b in a:
        return lo / hi > 0.7
    return (hi - _distance(a, b)) / hi > 0.85


def _names(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 26))).strip() or "a" for _ in range(n)]
    for w in list(base):
        x = list(w)
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(x) + 1)
            x[k:k + rnd.randint(0, 1)] = rnd.choice(["", "z", "ab"])
        base.append(" ".join("".join(x).split()) or "b")
    return sorted(set(base)) + ["aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaab", "abc", "abcd"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_names_loses_no_pair(spark, seed):
    names = sorted(set(_names(60, seed)))
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if _match(a, b)}
    got = dd.similar_names(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r.a, r.b) for r in got.collect()} == want


@pytest.mark.parametrize("seed,hub", [(1, False), (2, True)])
def test_components_equal_union_find(spark, seed, hub):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    if hub:
        edges += [(500, 500 + i) for i in range(1, 60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in root}
    got = dd.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == want


@pytest.mark.parametrize("parts", ["1", "7"])
def test_numbered_equals_window(spark, parts, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # one group holds half of the rows, one key is null
        df = spark.range(500).select(
            "id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 13).cast("string")).alias("g"),
            (F.col("id") * 37 % 101).alias("o"), (F.col("id") % 5 - 2).alias("v"),
        )
        got = numbered(df, ["o", "id"], ["g"], "rn", {"s": F.col("v")}).select("id", "rn", "s")
        w = Window.partitionBy("g").orderBy("o", "id")
        want = df.select("id", F.row_number().over(w).cast("long"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert rows(got) == rows(want)
        flat = numbered(df, ["o", "id"], (), "rn").select("id", "rn")
        assert rows(flat) == rows(df.select("id", F.row_number().over(Window.orderBy("o", "id")).cast("long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_candidates_equal_all_pairs(spark):
    names = _names(40, 5)
    stored = spark.createDataFrame([(i, n, "", "https://www.x%d.com/" % (i % 9) if i % 3 == 0 else "") for i, n in enumerate(names)],
                                   "id long, name_en string, name_ar string, website_url string")
    got = {tuple(r) for r in rs.candidates(stored, stored).collect()}
    want = set()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i == j:
                continue
            if i % 3 == 0:
                if j % 3 == 0 and i % 9 == j % 9:
                    want.add((i, j))
            elif a.lower() in b.lower():
                want.add((i, j))
    assert got == want


def test_candidates_by_either_name_and_below_a_host(spark):
    stored = spark.createDataFrame(
        [(1, "Gulf Pumps", "مضخات الخليج", ""), (2, "x", "", "http://shop.x.com/a"), (3, "y", "", "http://www.x.com/"), (4, "z", "", "http://xx.com/")],
        "id long, name_en string, name_ar string, website_url string",
    )
    probes = spark.createDataFrame([(11, None, "الخليج", None), (12, "q", "", "http://x.com/")], stored.schema)
    assert {tuple(r) for r in rs.candidates(probes, stored).collect()} == {(11, 1), (12, 2), (12, 3)}


def test_search_many_equals_scan(spark):
    rnd = random.Random(3)
    vocab = ["the"] * 6 + ["pump", "valve", "steel", "gulf", "pipe"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(6))) for i in range(80)]
    queries = [(1, "the pump"), (2, "Steel  gulf pipe"), (3, "the"), (4, "nothing here"), (5, " ")]
    d = spark.createDataFrame(docs, "id long, searchable_text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    want = {(k, i) for k, t in queries for i, s in docs if t.split() and set(t.lower().split()) <= set(s.split())}
    assert {tuple(r) for r in se.search_many(q, d).collect()} == want


def test_contained_passages_equals_scan(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(40)]
    passages = [(j, " ".join(rnd.choice(words) for _ in range(n))) for j, n in enumerate([3, 3, 4, 5, 6, 8, 9])]
    passages += [(99, texts[0][1][1:40]), (100, "alpha"), (101, "pha be"), (102, "ga"), (103, "z"), (104, "mma delta b")]
    p = spark.createDataFrame(passages, "passage_id long, passage string")
    t = spark.createDataFrame(texts, "text_id long, text string")
    want = {(j, i) for j, s in passages for i, x in texts if s in x}
    assert {tuple(r) for r in ev.contained_passages(p, t).collect()} == want


def test_duplicate_pairs_do_not_explode(spark):
    """One domain holds most rows: a star has one pair less than rows."""
    df = spark.range(300).select(
        "id", F.concat(F.lit("Firm "), F.col("id").cast("string")).alias("name_en"), F.lit("https://hot.sa/").alias("website_url"),
        F.lit("").alias("linkedin_url"), F.lit(None).cast("string").alias("city"),
    )
    assert dd.duplicate_pairs(df).count() == 299
