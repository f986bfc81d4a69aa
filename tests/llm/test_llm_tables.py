"""Odd tables for every operator and stage: nulls, empty and long texts, ties, repeated rows, no rows, other columns."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tradebook.llm import (
    crf_extract, fm_quality, golay_dedup, line_quality, pattern_grammar, qgram_decontam, source_mix, token_binary, token_counts, tokenise,
    warc_normal,
)
from tradebook.llm.queries import QUERIES, TWINS
from tradebook.llm.text_features import BUCKETS, NAMES

CLASH = "doc_id long, text string, source string, lang string, n_chars long, score double, key long, size long, fp long, _t string, y int, edits string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, 1.0, 5, 7, 9, "z", 1, "e") for i, t, s in rows], CLASH)


LONG = "alpha beta, gamma delta.\n" * 20_000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven.", "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "a"), (5, LONG, "b"),
    (5, LONG, "b"), (None, "no id has this text of a few words at all, you idiot", "c"), (7, "One two three four five six seven eight nine ten eleven.", "a"),
    (8, "é日本 \u0000 <|endoftext|> x", "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


def test_lines(odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in line_quality.clean_lines(odd).collect()}
    assert got[1, 11]["kept"] and not got[2, 0]["kept"] and got[3, 0]["base_failed"]
    long = got[5, 80_000]
    assert long["n_repeat_words"] == 80_000 and long["n_dup_lines"] == 19_999 and long["base_failed"]
    assert line_quality.clean_lines(odd).count() == len(ROWS) and line_quality.clean_lines(none).count() == 0


def test_lines_that_fail(spark):
    rows = [
        (1, "A plain line of text that nobody would mind at all.\nHome | About | News | Contact | Help\nReleased under the MIT License.\nThe last of the lines stays as well.", "a"),
        (2, "\n".join("word### an*** it%%% so&&& " + str(i) for i in range(9)), "a"),
    ]
    a, b = line_quality.clean_lines(_docs(spark, rows)).orderBy("doc_id").collect()
    assert a["kept"] and a["clean_text"].split("\n") == [rows[0][1].split("\n")[0], "The last of the lines stays as well."]
    assert not b["kept"] and not b["base_failed"]


def test_mix(spark, odd, none):
    rows = source_mix.mix(odd).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) < 1 for t, n in per.values())
    assert abs(sum(t for t, _ in per.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(odd.repartition(5)).collect()))
    assert source_mix.mix(none).count() == 0 and source_mix.mixed(none).count() == 0
    assert source_mix.mixed(odd).columns == odd.columns


def test_near_copies(odd, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in golay_dedup.near_groups(odd).collect()}
    assert len({f for _, f in got}) == len({golay_dedup.fingerprint(t) for _, t, _ in ROWS})
    assert {c for (d, _), c in got.items() if d in (2, 3, 4)} == {2} and {c for (d, _), c in got.items() if d in (1, 7)} == {1}
    assert golay_dedup.near_groups(none).count() == 0


def test_a_fingerprint_without_id_still_links(spark):
    """Groups by brute force over all pairs of fingerprints; rows without id tie others."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        text = rng.choices(words, k=60)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(60)] = rng.choice(words)
            rows.append((None if rng.random() < 0.4 else len(rows), " ".join(text), "s"))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in golay_dedup.near_groups(_docs(spark, rows)).collect())
    prints = [golay_dedup.fingerprint(t) for _, t, _ in rows]
    top = list(range(len(rows)))
    for _ in rows:  # the least group number goes round until nothing changes
        new = [min(top[y] for y in range(len(rows)) if bin(prints[x] ^ prints[y]).count("1") <= 4) for x in range(len(rows))]
        if new == top:
            break
        top = new
    least = {}
    for (i, _, _), g in zip(rows, top, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, _, _), p, g in zip(rows, prints, top, strict=True))
    assert any(i is None and p not in {q for (j, _, _), q in zip(rows, prints, strict=True) if j is not None} for (i, _, _), p in zip(rows, prints, strict=True))


def test_mail_edits():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-é \n@b") for _ in range(rng.randint(0, 30)))
        head = text[: text.rfind("\n") + 1] or text
        want = [(m.start(), m.end(), "[mail]") for m in pattern.finditer(head)] + ([(len(head), len(text), "")] if head != text else [])
        assert token_counts.mail_edits(text) == want, text


def test_passages(spark, odd, none):
    bench = spark.createDataFrame([(1, "two three four five six seven!", 0), (2, None, 0), (None, "x" * 50, 0), (3, "ab", 0)], "item_id long, text string, doc_id int")
    got = qgram_decontam.matches(odd, bench)
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()) == [(1, 1, 0), (7, 1, 0)]
    assert qgram_decontam.matches(odd, bench, block_chars=10).count() == 2  # one item to a pass
    clean = qgram_decontam.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) - 2
    assert qgram_decontam.matches(none, bench).count() == qgram_decontam.matches(odd, bench.limit(0)).count() == 0
    assert qgram_decontam.clean(odd, bench.limit(0)).count() == len(ROWS)


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(9)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    for table in (odd, none):
        machine = fm_quality.fitted(table, labels)
        assert fm_quality.score(table, machine).count() == table.count()
        assert fm_quality.accepted(table, machine).columns == odd.columns
        model = pattern_grammar.fitted(table, labels)
        assert pattern_grammar.score(table, model).count() == table.count()
    nothing = fm_quality.fitted(odd, labels.limit(0))
    assert {r["score"] for r in fm_quality.score(odd, nothing).collect()} == {0.5}
    toxic = {r["doc_id"]: r["predicted"] for r in pattern_grammar.score(odd, pattern_grammar.fitted(odd, labels.limit(0))).collect()}
    assert toxic[None] == 1 and toxic[1] == toxic[2] == toxic[3] == 0
    assert {r["held_out"] for r in pattern_grammar.score(odd, model).where("doc_id is null").collect()} == {False}


def test_factorisation_against_pairs():
    import numpy as np

    r = np.random.default_rng(0)
    m = len(NAMES) + BUCKETS
    machine = fm_quality.Machine(0.3, r.normal(size=m), r.normal(size=(m, 3)), np.zeros(m), np.ones(m))
    x = r.normal(size=(2, m))
    for row, got in zip(x, machine.logits(x), strict=True):
        g = (machine.factors @ machine.factors.T) * np.outer(row, row)
        want = 0.3 + row @ machine.linear + np.triu(g, 1).sum()
        assert abs(got - want) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("name,label,least", [("op10_fm_quality", "quality", 0.95), ("op3_pattern_grammar", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    big = SMALL.replace("0.001", "0.1")  # the small tables have some hundred labels, too few for a rate
    got = QUERIES[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    assert got.selectExpr(f"avg(cast(predicted = {label} AS int))").first()[0] >= least


def test_toxic_rates(spark):
    """Accuracy hides a rare label: of the held-out toxic documents nine in ten are found, of the others one in a hundred at most."""
    big = SMALL.replace("0.001", "0.1")
    got = QUERIES["op3_pattern_grammar"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    found, false = got.selectExpr("avg(if(toxic = 1, predicted, null))", "avg(if(toxic = 0, predicted, null))").first()
    assert found >= 0.9 and false <= 0.01


def test_token_files(spark, odd, none, tmp_path):
    import numpy as np

    words = tokenise.words(tokenise.word_bpe_path())
    folder = str(tmp_path / "ids")
    found = token_binary.write(odd, folder, tokenise.word_bpe_path(), 2, file_chars=100_000)
    got = token_binary.read(spark, found, folder).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    start = 0
    assert len(got) == len(rows) and len({r["file"] for r in got}) > 1
    for r, (d, t, _) in zip(got, rows, strict=True):
        ids = words.library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert r["ids_crc32"] == __import__("zlib").crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_binary.round_trip(spark, none).count() == 0


def test_edits(spark, odd, none):
    words = tokenise.words(tokenise.word_bpe_path())
    docs = _docs(spark, [*ROWS, (9, "write to a.b@c.example now\nor jo.81@mail7.example.com x\nlast line", "a")])
    size = lambda t: len(words.encode([t])[0]) // 4
    got = {r["doc_id"]: r for r in token_counts.counted(docs).collect()}
    assert got[9]["tokens_before"] == size("write to a.b@c.example now\nor jo.81@mail7.example.com x\nlast line")
    assert got[9]["tokens_after"] == size("write to [mail] now\nor [mail] x\n")
    assert got[5]["tokens_before"] == size(LONG) and got[5]["n_reencoded"] <= 2 and got[2]["tokens_after"] == 0
    assert token_counts.counted(none).count() == 0
    texts = spark.createDataFrame([(1, "ab cd ef"), (2, None)], "doc_id long, text string")
    state = token_counts.build_state(texts, tokenise.word_bpe_path())
    edits = spark.createDataFrame([(1, 3, 5, "longer words"), (1, 0, 2, None)], "doc_id long, start int, end int, replacement string")
    new = token_counts.apply_edits(token_counts.with_edits(texts, state, edits), tokenise.word_bpe_path()).orderBy("doc_id").collect()
    assert [r["text"] for r in new] == [" longer words ef", ""] and new[0]["tokens_after"] == size(" longer words ef")


def test_archives(spark):
    schema = "page_id long, url string, html string, payload string, refers_to long"
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u", page, "p", 1), (1, "u", page, "p", 1), (2, None, None, "p", 1), (4, "u\r\nv", "", "p", 1), (None, "u", page, "p", 1), (5, "u", "é" * 10, "p", 1), (5, "u", "é" * 10, "p", 1)]
    pages = spark.createDataFrame(rows, schema).repartition(2)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_normal.archive(spark, pages).collect())
    assert got == [("1", 207, "response", None), ("2", 0, "response", None), ("3", 207, "revisit", 1), ("4", 0, "response", None), ("5", 20, "response", None), ("5", 20, "response", None), ("None", 207, "response", None)]
    assert warc_normal.archive(spark, pages.limit(0)).count() == 0


def test_main_text(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<nav><a href=x>menu</a></nav><article><h1>Title</h1><p>A text of some words.</p></article><footer>&copy; site</footer>", 0), (2, None, None, 0), (None, "u", "", 0)],
        "page_id long, url string, html string, text int",
    )
    model = crf_extract.fitted(pages, made=300)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in crf_extract.extract(pages, model).collect()}
    assert got == {1: ("Title\nA text of some words.", 27), 2: ("", 0), None: ("", 0)}
    assert crf_extract.extract(pages.limit(0), model).count() == 0


def test_stages(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns
            docs = docs.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


@pytest.mark.parametrize("name", ["op5_source_mix", "op7_warc_normal", "op9_line_quality"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(TWINS[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
