"""What the operators of this subpackage share: words, hashes of ids, tables in the shared folder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.session import scratch_folder

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null and empty texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hash_share(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing a classifier: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it again: cuts lineage and gives Spark its true size."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that nothing will read again."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones whenever it runs: those with the smallest hashes of their key.

    A top-k by a hash: every task sends at most ``most`` rows.
    """
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(most)


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates become question marks."""
    return (text or "").encode("utf-8", "replace")


def spans(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive pieces."""
    ends = np.cumsum(lengths)
    return zip((ends - lengths).tolist(), ends.tolist(), strict=True)


def crc(data: bytes, so_far: int = 0) -> int:
    return zlib.crc32(data, so_far) & 0xFFFFFFFF
