"""Folders of a ledger are written with the options that a table asks for."""

from __future__ import annotations

from tradebook.sources.ledger import Ledger


def test_write_takes_options(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, f"text {k % 3}") for k in range(50)], "id long, text string")
    plain, packed = ledger.write(rows, "rows"), ledger.write(rows, "rows", compression="zstd")
    names = [f.name for f in tmp_path.glob("rows-*/*.parquet")]
    assert plain != packed and any(".zstd." in n for n in names) and not all(".zstd." in n for n in names)
    for path in (plain, packed):
        assert sorted(map(tuple, ledger.read([path], rows.schema).collect())) == sorted(map(tuple, rows.collect()))
