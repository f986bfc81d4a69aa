"""Files read in many pieces give the rows of one piece, and script state as rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators import scripts
from tradebook.sources import large_files as lf
from tradebook.sources import readers as rd

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name_en", T.StringType()), T.StructField("notes", T.StringType())])


@pytest.fixture(params=[64, 1000, None])
def piece(spark, request):
    """Bytes of a piece."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in kept.items():
        spark.conf.set(k, v)


def _notes(rng):
    return "".join(rng.choice(['a', 'é', ' ', '"', ',', '\n', '{', '}', '[', ']', '\\', 'word ']) for _ in range(rng.randint(1, 30))).strip() + "."


def _rows(rng, n):
    return [(k, f"Firm {k}", "x" + _notes(rng)) for k in range(n)]


def test_csv(spark, tmp_path, piece):
    rng = random.Random(3)
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    want = []
    for f, end in enumerate(["\n", "\r\n", "\n"]):
        rows = [(k + 1000 * f, n, t) for k, n, t in _rows(rng, 40)]
        lines = ["id,name_en,notes"] + [f"{k},{n},{quoted(t)}" + (end if k % 10 == 0 else "") for k, n, t in rows]
        (tmp_path / f"{f}.csv").write_text(end.join(lines) + ("" if f == 2 else end), encoding="utf-8", newline="")
        want += rows
    good, bad = lf.read_large_csv(spark, str(tmp_path), SCHEMA)
    plain, _ = rd.read_csv(spark, str(tmp_path), SCHEMA)
    got = sorted(tuple(r) for r in good.collect())
    assert got == sorted(tuple(r) for r in plain.collect()) == sorted(want)
    assert bad.count() == 0
    if piece == 64:
        assert lf.records(spark, str(tmp_path), lf.CSV).rdd.getNumPartitions() > 20


def test_csv_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name_en,notes\n1,one,x\n2,two\n\n3,three,"y\nz"\n', encoding="utf-8")
    good, bad = lf.read_large_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "one", "x"), (3, "three", "y\nz")]
    assert [r[rd.CORRUPT] for r in bad.collect()] == ["2,two"]
    (tmp_path / "a.csv").write_text("", encoding="utf-8")
    assert lf.read_large_csv(spark, str(tmp_path), SCHEMA)[0].count() == 0


@pytest.mark.parametrize("indent", [None, 2])
def test_json(spark, tmp_path, piece, indent):
    rng = random.Random(5)
    schema = T.StructType([*SCHEMA.fields, T.StructField("deep", T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.StringType())]))]))])
    want = []
    for f in range(2):
        rows = [(k + 1000 * f, n, t) for k, n, t in _rows(rng, 25)]
        made = [{"id": k, "name_en": n, "notes": t} | ({"deep": {"a": {"b": t}}} if k % 2 else {}) for k, n, t in rows]
        (tmp_path / f"{f}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=f == 0), encoding="utf-8")
        want += [(k, n, t, t if k % 2 else None) for k, n, t in rows]
    got = lf.read_large_json(spark, str(tmp_path), schema).select("id", "name_en", "notes", "deep.a.b")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_json_odd_files(spark, tmp_path):
    for name, text in (("a", "[]"), ("b", ""), ("c", '[{"id": 1}, {"id": 2'), ("d", '{"id": 3}\n{"id": 4}\n'), ("e", '[{"id": 5, "notes": "\\\\"}]')):
        (tmp_path / name).write_text(text)
    assert sorted(r["id"] for r in lf.read_large_json(spark, str(tmp_path), SCHEMA).collect()) == [1, 2, 3, 4, 5]


def test_assigned_values():
    values = lambda code, name="S": list(scripts.assigned_values(f"<p>S = 1</p><script type=x>{code}</script>", name))
    assert values('window.S = {"a": "}\\"];{"};') == [{"a": '}"];{'}]
    assert values("var S=[1, 2], b = 3") == [[1, 2]] and values("S = {}\nfoo()") == [{}]
    assert values("S = {a: 1}") == values("S == [1]") == values("S = [1][0]") == values("S = [1]\n.map(f)") == values("xS = [1]") == values("o.S = [1]") == []
    assert values("S = [NaN]") == values("S = " + "[" * 100_000) == values('S = {"a": ') == [] and list(scripts.assigned_values(None, "S")) == []
    assert values("S = 1; S = [2]") == [1, [2]]


def test_script_items(spark):
    state = '{"state": {"list-ssr": {"result": {"data": [{"name": " Firm one ", "subdomain": "f1", "n": 5}, 7, {"name": "x"}, {"name": "Firm two", "details": ""}]}}}}'
    rows = [(1, "u1", f"<script>window.__NUXT__={state};</script>"), (2, "u2", "<script>window.__NUXT__=(function(a){return {}}(1))</script>"), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in scripts.script_listing(pages, "https://v/").select("page_id", "ordinal", "name_en", "description_en", "source_url").collect())
    assert got == [(1, 0, "Firm one", None, "https://v/f1"), (1, 3, "Firm two", None, "u1")]
    found = spark.sql("SELECT s.* FROM {p} p, LATERAL script_items(p.html, '__NUXT__', 'state.list-ssr.result.data', 'n, name') s ORDER BY ordinal", p=pages)
    assert found.columns == ["ordinal", "n", "name"] and [tuple(r) for r in found.collect()] == [(0, "5", " Firm one "), (2, None, "x"), (3, None, "Firm two")]
    assert spark.sql("SELECT slugify(' A & B شركة ') AS s, slugify(NULL) AS n").first()[:] == ("a-b-شركة", None)
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT * FROM {p} p, LATERAL script_items(p.html, p.url, 'a', 'b') s", p=pages).collect()
    assert scripts.script_listing(pages.where(F.lit(False)), "x").count() == 0
