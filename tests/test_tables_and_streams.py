"""Reading, writing, versions and streams."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators import resolve
from tradebook.operators import tables as tb
from tradebook.sources import readers as rd
from tradebook.sources import schemas as sc
from tradebook.sources import writers as wr
from tradebook.streaming import limits
from tradebook.streaming import streams as st


def test_csv_rows_and_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name_en,categories,confidence_score\n1,"A, ""q""\nline","[""x"",""y""]",0.5\n\n2,null,"a, b",zz\n3,ok\n', encoding="utf-8")
    schema = T.StructType([sc.COMPANY["id"], sc.COMPANY["name_en"], sc.COMPANY["categories"], sc.COMPANY["confidence_score"]])
    good, bad = rd.read_csv(spark, str(tmp_path), schema)
    got = {r.id: (r.name_en, r.categories, r.confidence_score) for r in good.collect()}
    assert got["1"] == ('A, "q"\nline', ["x", "y"], 0.5) and got["2"] == (None, ["a", "b"], None)
    assert len(bad.collect()) == 1


def test_json_backup(spark, tmp_path):
    (tmp_path / "companies").mkdir()
    (tmp_path / "companies" / "a.json").write_text('[{"id": "1", "name_en": "A", "zzz": 1, "products": ["p"]}, {"id": "2"}]', encoding="utf-8")
    tables = rd.read_backup(spark, str(tmp_path), {"companies": sc.COMPANY})
    assert {r.id: r.products for r in tables["companies"].collect()} == {"1": ["p"], "2": None}


def test_dimensions(spark):
    assert rd.category_table(spark).count() == 7 and rd.city_table(spark).count() == 3 and rd.region_table(spark).count() == 3


def test_conform(spark):
    df = sc.conform(spark.createDataFrame([(1, "x")], "id long, unknown string"), sc.INQUIRY)
    assert df.columns == sc.INQUIRY.fieldNames() and df.first().id == "1"


def test_csv_export_quotes_and_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c', ["x", "y"], "http://www.A.com/?ref=1")], "id string, name_en string, products array<string>, logo_url string")
    wr.write_csv(wr.export_rows(df).coalesce(1), str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert part.read_text(encoding="utf-8") == '\ufeffid,name_en,logo_url,products\n1,"a ""b"", c",https://a.com/,x; y\n'


def test_export_field_list_is_fresh(spark):
    df = spark.createDataFrame([("1", "u")], "id string, source_url string")
    assert wr.export_columns(df, metadata=True) == ["id", "source_url"] and wr.export_columns(df) == ["id"]


def test_locale_order(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "n string")
    assert [r.n.lower() for r in tb.sort_for_export(df, "n").collect()] == ["a", "a", "b", "b"]


def test_sitemap_files(spark, tmp_path):
    df = spark.range(25).select(
        "id", F.lit("s").alias("slug"), F.lit("n").alias("name_en"), F.lit("approved").alias("status"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.lit("2024-01-02").cast("timestamp").alias("created_at"),
    )
    wr.write_sitemap(wr.company_sitemap(df, "https://b.sa", 10), str(tmp_path / "map"))
    parts = sorted(os.listdir(tmp_path / "map"))
    assert [p for p in parts if p.startswith("part=")] == ["part=1", "part=2", "part=3"]
    text = next((tmp_path / "map" / "part=3").glob("*.txt")).read_text()
    assert text.startswith("<?xml") and text.rstrip().endswith("</urlset>") and text.count("<url>") == 5
    assert wr.static_sitemap(spark, "https://b.sa").count() == 8


def test_versions_survive_a_replayed_batch(spark, tmp_path):
    folder = str(tmp_path / "t")
    step = st.keep_versions(folder, lambda b, cur: b if cur is None else tb.upsert(cur, b, ["id"]))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    second = spark.createDataFrame([(2, "c")], "id long, v string")
    for batch_id, df in ((0, first), (1, second), (1, second)):
        step(df, batch_id)
    version, out = wr.latest_version(spark, folder)
    assert version == 1 and {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c")}
    step(first, 0)
    assert wr.latest_version(spark, folder)[0] == 1


def test_a_stored_table_and_a_new_stream_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    schema = "id long, v string"
    wr.write_version(spark.createDataFrame([(9, "old")], schema), folder, 0)
    change = lambda b, cur: b if cur is None else tb.upsert(cur, b, ["id"])
    for n, rows in enumerate(([(1, "a")], [(2, "b")])):
        source = str(tmp_path / f"in{n}")
        spark.createDataFrame(rows, schema).write.parquet(source)
        stream = st.file_stream(spark, source, spark.read.parquet(source).schema)
        st.run_to_end(st.upsert_stream(stream, folder, change), str(tmp_path / f"ck{n}"))
        st.run_to_end(st.upsert_stream(stream, folder, change), str(tmp_path / f"ck{n}"))  # nothing new: no version
    version, out = wr.latest_version(spark, folder)
    assert version == 2 and {tuple(r) for r in out.collect()} == {(9, "old"), (1, "a"), (2, "b")}
    st.keep_versions(folder, change, keep_last=1)(spark.createDataFrame([(3, "c")], schema), 7)
    assert os.listdir(folder) == ["v=3"] and wr.latest_version(spark, folder)[1].count() == 4


def test_unfinished_version_is_ignored(spark, tmp_path):
    folder = str(tmp_path / "t")
    wr.write_version(spark.range(3), folder, 0)
    os.makedirs(f"{folder}/v=1")
    assert wr.latest_version(spark, folder)[0] == 0


def test_streamed_limit(spark, tmp_path):
    rows = [(i, "k", t) for i, t in enumerate([0, 1, 2, 9, 10, 11, 25, 26])]
    calls = spark.createDataFrame(rows, "call_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
    calls.write.parquet(str(tmp_path / "in"))
    stream = st.file_stream(spark, str(tmp_path / "in"), calls.schema)
    step = limits.limit_step(str(tmp_path / "kept"), "k", "call_id", "ts", 10_000, 2, 0)
    st.run_to_end(stream.writeStream.foreachBatch(step), str(tmp_path / "ck"))
    limits.finish(spark, str(tmp_path / "kept"), 10_000, 2)
    got = limits.verdicts(spark, str(tmp_path / "kept")).orderBy("call_id").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True, True]


def test_change_subscription(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    df.write.parquet(folder)
    seen = []
    stream = st.on_change(st.file_stream(spark, folder, df.schema), lambda: spark.read.parquet(folder).where("id > 0"), lambda out: seen.append(out.count()))
    st.run_to_end(stream, str(tmp_path / "ck"))
    spark.createDataFrame([(2, "b")], df.schema).write.mode("append").parquet(folder)
    stream = st.on_change(st.file_stream(spark, folder, df.schema), lambda: spark.read.parquet(folder).where("id > 0"), lambda out: seen.append(out.count()))
    st.run_to_end(stream, str(tmp_path / "ck"))
    assert seen == [1, 2]


@pytest.mark.parametrize("job", ["match", "members"])
def test_join_of_a_hot_key_is_divided(spark, job):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        rows = spark.range(0, 120_000, numPartitions=8).selectExpr(
            "id", "if(id % 3 = 0, 0, id) AS grp", "concat('Firm number ', if(id % 3 = 0, 0, id)) AS name_en", "cast(NULL AS string) AS name_ar",
            "cast(NULL AS string) AS website_url", "cast(NULL AS string) AS source_url", "concat('a', id, '@b.sa') AS email",
            "cast(NULL AS string) AS phone",
        )
        if job == "match":
            out = tb.match_existing(rows, rows.where("id % 2 = 0").withColumn("ordinal", F.col("id")), "ordinal")
            assert out.count() == 80_000  # the hot name, and the even ones of the others
        else:
            out = resolve.verified_members(rows, "grp", "id")
            assert out.count() == 40_000  # only the hot group has several members
        if job == "match":
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        else:
            share = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert share < 20_000  # the hot group lies in several partitions
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path):
    df = spark.range(6).withColumn("v", F.concat(F.lit("v"), F.col("id")))
    df.repartition(3).write.parquet(str(tmp_path / "many" / "t.parquet"))
    df.repartition(2).write.parquet(str(tmp_path / "many" / "u.parquet"))
    df.toPandas().to_parquet(tmp_path / "t.parquet")
    for n, folder in enumerate((tmp_path, tmp_path / "many")):
        stream = st.file_stream(spark, str(folder), df.schema, names="t.parquet")
        st.run_to_end(st.upsert_stream(stream, str(tmp_path / f"kept{n}"), lambda b, cur: b), str(tmp_path / f"ck{n}"))
        assert sorted(tuple(r) for r in wr.latest_version(spark, str(tmp_path / f"kept{n}"))[1].collect()) == [(i, f"v{i}") for i in range(6)]
