"""Tables kept by buckets and segments, the streamed limit, bulk search for pieces, versions and cursors."""

import random

import pytest
from pyspark.sql import functions as F

from tradebook.operators import metrics as mt
from tradebook.operators import pieces, versions
from tradebook.operators import search as se
from tradebook.operators.keys import perhaps_in
from tradebook.sources.ledger import Ledger
from tradebook.streaming import buckets, limits, segments

def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), keep=3)
    assert ledger.newest() == (-1, {})
    for n in range(5):
        ledger.commit(n, {"n": n})
    assert ledger.newest() == (4, {"n": 4})
    with pytest.raises(RuntimeError):
        ledger.commit(4, {"n": "other"})
    assert ledger.newest()[1] == {"n": 4} and len(ledger._numbers()) == 3


def _page(page_id, items):
    cards = "".join(f'<div class="company-card"><h3>{n}</h3><a href="/c/{k}">More</a></div>' for k, n in items)
    return (page_id, "https://list.example.org/directory", f"<html><body>{cards}</body></html>")


PAGES = [[_page(1, [(k, f"Firm number {k}") for k in range(6)])], [_page(2, [(k, f"Firm number {k}") for k in range(4, 12)])], [_page(3, [(50, "Late firm one"), (51, "Late firm two"), (0, "Firm number 0")])]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_discovery_in_any_order(spark, tmp_path, order):
    folder = str(tmp_path)
    stored = spark.createDataFrame([("100500", "FIRM NUMBER 3", "", "", ""), ("7", "elsewhere", "", "", "")], "id string, name_en string, name_ar string, website_url string, source_url string")
    buckets.load_companies(spark, folder, stored.withColumn("first_seen_at", F.lit("2020-01-01").cast("timestamp")), 16)
    step = buckets.discovery_step(folder, as_of())
    for n in order:
        step(spark.createDataFrame(PAGES[n], "page_id long, url string, html string"), order.index(n))
        assert Ledger(spark, folder).newest()[1]["written"] <= 8  # of 16 buckets: no more than there are records
        step(spark.createDataFrame(PAGES[n], "page_id long, url string, html string"), order.index(n))  # a replay
    got = {r["name_en"].lower(): r for r in buckets.kept_companies(spark, folder).collect()}
    assert len(got) == 15 and set(got) == {f"firm number {k}" for k in range(12)} | {"late firm one", "late firm two", "elsewhere"}
    assert got["firm number 3"]["id"] == "100500" and got["firm number 3"]["first_seen_at"].year == 2020
    ids = [int(r["id"]) for r in got.values()]
    assert len(set(ids)) == 15 and all(100_500 <= i <= 100_513 or i == 7 for i in ids)
    named = buckets.kept_evidence(spark, folder).where("field_name = 'name_en'").groupBy("company_id").count().collect()
    assert sum(r["count"] for r in named) == 17 and {r["company_id"] for r in named} == {str(i) for i in ids if i != 7}


def test_stream_of_calls_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    calls = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 200_000)) for i in range(300)]
    df = spark.createDataFrame(calls, "k string, call_id long, ms long").select("k", "call_id", F.timestamp_millis("ms").alias("ts"))
    named = df.withColumn("k", F.coalesce("k", F.lit("none")))
    want = {r["call_id"]: r["allowed"] for r in mt.limited_calls(named, "k", "ts", "call_id", 10_000, 3).collect()}
    step = limits.limit_step(str(tmp_path), "k", "call_id", "ts", 10_000, 3, 40_000)
    arrival = {c[1]: c[2] + rng.randint(0, 39_000) for c in calls}
    for n in range(3):
        ids = [i for i, at in arrival.items() if min(at // 80_000, 2) == n]
        step(named.where(F.col("call_id").isin(ids)), n)
    step(named, 2)  # a replay
    limits.finish(spark, str(tmp_path), 10_000, 3)
    got = {r["call_id"]: r["allowed"] for r in limits.verdicts(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 300


TEXTS = ["the quick brown fox", "brownish quicksand", "Ünïcode quick", "a", "ab ba", "", "the the the fox", "fox then"]


def test_pieces_against_one_by_one(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    index = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "id long, searchable_text string").withColumn("last_updated", as_of())
    queries = ["quick fox", "ick", "the", "a b", "x", "QUICK", " ", "fox the", "brow uick", "ün", "abca", "ab c bca", "aaa", "b"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {tuple(r) for r in pieces.search_pieces(q, pieces.postings(index, ["id"]), ["id"]).collect()}
    want = {(i, r["id"]) for i, x in enumerate(queries) for r in se.search(index, x, 1000).select("id").collect()}
    assert got == want
    assert pieces.search_pieces(q.limit(0), pieces.postings(index, ["id"]), ["id"]).count() == 0


def _company(i, name, when=0):
    return (str(i), name, None, None, None, None, None, [], [], [], [], when)


COMPANY = "id string, name_en string, name_ar string, business_type string, description_en string, description_ar string, city string, categories array<string>, products array<string>, services array<string>, brands array<string>, v int"


def test_segments_equal_a_rebuild(spark, tmp_path):
    folder, now = str(tmp_path), {}
    rng = random.Random(2)
    q = spark.createDataFrame([(1, "omp"), (2, "new name"), (3, "gone"), (4, "7")], "query_id long, query string")
    for n in range(7):
        rows = {i: f"Company {i} version {n} " + ("new name" if i % 3 == n % 3 else "") for i in rng.sample(range(40), 12)}
        gone = [i for i in rng.sample(range(40), 5) if i not in rows]
        batch = spark.createDataFrame([(*_company(i, t), False) for i, t in rows.items()] + [(*_company(i, "gone"), True) for i in gone], COMPANY + ", gone boolean")
        segments.index_stream(folder, as_of(), F.col("gone"))(batch, n)
        segments.index_stream(folder, as_of(), F.col("gone"))(batch, n)
        now = {i: t for i, t in now.items() if i not in gone} | rows
    rebuilt = se.index_rows(spark.createDataFrame([_company(i, t) for i, t in now.items()], COMPANY), as_of())
    live = segments.live_rows(spark, folder)
    assert sorted(map(tuple, live.select("id", "searchable_text").collect())) == sorted(map(tuple, rebuilt.select("id", "searchable_text").collect()))
    got = {tuple(r) for r in segments.search_segments(spark, folder, q).collect()}
    assert got == {tuple(r) for r in pieces.search_pieces(q, pieces.postings(rebuilt, ["id"]), ["id"]).collect()} and got
    assert len(Ledger(spark, folder).newest()[1]["segments"]) < 7


def test_changed_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, part long, a string, b double")
    old = make([(1, 1, "x", 1.0), (1, 2, None, 2.0), (2, 1, "y", None), (None, 1, "n", 0.0), (3, 1, "z", 1.0), (3, 1, "z", 1.0)])
    new = make([(1, 1, "x", 1.0), (1, 2, "", 2.0), (4, 1, "y", None), (None, 1, "n", 0.5), (3, 1, "z", 1.0)])
    got = sorted(map(str, map(tuple, versions.changed_rows(old, new, ["id", "part"]).collect())))
    assert got == sorted(map(str, [(1, 2, "changed"), (2, 1, "gone"), (4, 1, "added"), (None, 1, "changed")]))


@pytest.mark.parametrize("descending", [False, True])
def test_every_row_once_by_cursor(spark, descending):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.5, 2.5, -1.0]), rng.choice([None, "a", "b"])) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, price double, name string").repartition(3)
    order = [("price", descending), ("name", False), ("id", descending)]
    seen, cursor = [], None
    while True:
        page = versions.page_after(df, order, 10, cursor).collect()
        seen += [r["id"] for r in page]
        cursor = versions.next_cursor(page, order, 10)
        if cursor is None:
            break
    whole = [r["id"] for r in versions.page_after(df, order, 1000).collect()]
    assert seen == whole and sorted(seen) == list(range(53))


def test_bulk_search_moves_only_what_is_asked(spark):
    rows = spark.createDataFrame([(i, w) for i in range(200) for w in "abcdefgh"], "id long, term string")
    asked = spark.createDataFrame([(7, "c"), (9, "h")], rows.schema)
    got = {tuple(r) for r in perhaps_in(rows, asked, ["id", "term"]).collect()}
    assert {(7, "c"), (9, "h")} <= got and len(got) < 10
    assert perhaps_in(rows, asked.limit(0), ["id", "term"]).count() == 0
    index = spark.createDataFrame([(1, "red  iron nail"), (1, "old nut"), (2, "red nut")], "id long, searchable_text string")
    q = spark.createDataFrame([("x", "Red nail"), ("y", "red old"), ("z", "gold nut"), ("e", " ")], "query_id string, query string")
    found = se.search_many(q, index)
    assert "words" not in found._jdf.queryExecution().optimizedPlan().output().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("x", 1), ("y", 1)]  # rows of one id count as one


def test_search_text_is_not_made_for_every_term(spark):
    raw = spark.createDataFrame([(1, "  Café &  Söhne, شركة.٣ a_b "), (2, None)], "id long, name_en string")
    index = se.index_rows(raw, F.lit("2024-01-01").cast("timestamp"))
    assert [r[0] for r in index.orderBy("id").select("searchable_text").collect()] == ["caf s hne شركة ٣ a_b", ""]
    found = se.search(index, "caf hne a_b")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2  # to find rows and to show them, not again for every term
    assert [r.id for r in found.collect()] == [1]


def test_segments_keep_less_than_their_texts_outgrow(spark, tmp_path):
    """What a segment keeps stays near its texts, and it is written without moving postings."""
    words = [f"w{k:04d}" for k in range(3000)]
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(words, k=400))) for k in range(60)]
    index = spark.createDataFrame(rows, "id long, searchable_text string").withColumn("last_updated", F.lit("2024-01-01"))
    folder = f"{tmp_path}/kept"
    segments.add_segment(spark, folder, index)
    posted = sum(f.stat().st_size for f in tmp_path.glob("kept/postings-*/*.parquet"))
    assert 0 < posted < sum(len(t) for _, t in rows)
    q = spark.createDataFrame([(1, "w0001 0002"), (2, "W00"), (3, "w9"), (4, " "), (5, "0 w0003")], "query_id int, query string")
    got = sorted(tuple(r) for r in segments.search_segments(spark, folder, q).collect())
    want = [(n, k) for n, terms in ((1, ["w0001", "0002"]), (2, ["w00"]), (3, ["w9"]), (5, ["0", "w0003"])) for k, t in rows if all(x in t for x in terms)]
    assert got == sorted(want)
