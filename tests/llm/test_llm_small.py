"""Parts of the operators that need no cluster, against brute force."""

import gzip
import random
import zlib

import numpy as np
import pytest

from tradebook.llm import crf_extract, golay, golay_dedup, id_coder, pattern_grammar, qgram_decontam, text_features, token_counts, tokenise, warc_normal
from tradebook.llm.page_blocks import blocks


# --- token ids -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 300, 8193])
def test_ids_come_back(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), np.zeros(n, int), r.integers(0, 2**32, n, dtype=np.uint64), np.tile(np.arange(37), n // 37 + 1)[:n]):
        made = id_coder.encode(ids.astype("<u4"))
        assert len(made) == -(-n // id_coder.BLOCK)
        assert (id_coder.decode(made) == ids.astype("<u4")).all()


def test_blocks_stand_alone_and_show_damage():
    ids = np.random.default_rng(1).integers(0, 500, 3 * id_coder.BLOCK).astype("<u4")
    made = id_coder.encode(ids)
    assert (id_coder.decode(made[1:2]) == ids[id_coder.BLOCK : 2 * id_coder.BLOCK]).all()
    for at in (30, len(made[0]) - 2):
        broken = bytearray(made[0])
        broken[at] ^= 4
        with pytest.raises((ValueError, zlib.error)):
            id_coder.decode([bytes(broken)])


def test_predictable_ids_are_small():
    ids = np.tile(np.arange(50), 1000).astype("<u4")
    assert 8 * sum(map(len, id_coder.encode(ids))) / len(ids) < 0.5


def test_words_equal_the_library():
    words = tokenise.words(tokenise.word_bpe_path())
    r = random.Random(2)
    pieces = ["Hello", "WORLD", ",", "...", "it's", "é", "É!", "é.", "İ", " ", "\n", " ", "x", "123", "日本", "%%%.", "<|endoftext|>", "<|END", "ﬁ", "ß", "\x85"]
    texts = [None, "", *("".join(r.choices(pieces, k=r.randrange(12))) for _ in range(800))]
    want = [np.array(e.ids, "<u4").tobytes() for e in words.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert words.encode(texts) == want


# --- edits ---------------------------------------------------------------------------------------------


def test_counts_follow_edits():
    words = tokenise.words(tokenise.word_bpe_path())
    count = lambda parts: [len(x) // 4 for x in words.encode(parts)]
    r = random.Random(3)
    for _ in range(600):
        text = "".join(r.choices(["ab", "cde", " ", "\n", "x.", "é", "hello", "  ", "9"], k=r.randrange(60)))
        size = r.choice([1, 3, 8, 20])
        lengths, nodes = token_counts.build(text, count, size)
        places = sorted(r.randrange(len(text) + 1) for _ in range(2 * r.randrange(4)))
        edits = [(a, b, "".join(r.choices(["q", " ", "zz", ""], k=r.randrange(4)))) for a, b in zip(places[::2], places[1::2], strict=True)]
        new, lengths, nodes, _ = token_counts.update(text, lengths, nodes, edits, count, size)
        want = text
        for a, b, x in reversed(edits):
            want = want[:a] + x + want[b:]
        assert new == want and sum(lengths) == len(want)
        assert token_counts.total(nodes) == count([want])[0]
        assert nodes == token_counts.tree(nodes[len(lengths) :])


def test_an_edit_re_encodes_its_leaf_alone():
    seen = []

    def count(parts):
        seen.extend(parts)
        return [len(p.split()) for p in parts]

    text = "word " * 10_000
    lengths, nodes = token_counts.build(text, count)
    seen.clear()
    _, _, nodes, n = token_counts.update(text, lengths, nodes, [(25_000, 25_004, "other")], count)
    assert n == 1 and len(seen) == 1 and token_counts.total(nodes) == 10_000
    with pytest.raises(ValueError):
        token_counts.update(text, lengths, nodes, [(0, 5, ""), (3, 8, "")], count)


# --- fingerprints --------------------------------------------------------------------------------------


def test_golay_tables():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    near = golay.nearest(words)
    every = np.arange(1 << 12) << 11
    code = every ^ golay.syndrome(every)
    assert np.bitwise_count(code[1:]).min() == 7
    assert (np.bitwise_count(words ^ code[near]) <= 3).all()
    around = golay.nearby(words[:300])
    for w, got in zip(words[:300], around, strict=True):
        assert set(got[got >= 0].tolist()) == set(np.flatnonzero(np.bitwise_count(code ^ w) <= 4).tolist())


@pytest.mark.parametrize("bits", range(5))
def test_no_link_is_missed(bits):
    r = np.random.default_rng(bits)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = np.zeros(len(a), np.uint64)
    for i in range(len(a)):
        for b in r.choice(64, bits, replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    filed, looked = golay_dedup.filed_keys(a), golay_dedup.lookup_keys(a ^ flips)
    assert (filed[:, :, None] == looked[:, None, :]).any((1, 2)).all()


def test_fingerprint_by_hand():
    import xxhash

    def plain(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", " \n", "One", "a B c", "É a b\tc d", "x " * 50, "the cat sat on the mat\nthe cat sat on the mat", "a b c"):
        assert golay_dedup.fingerprint(t) == plain(t)


# --- benchmark passages --------------------------------------------------------------------------------


def _edits(item, text):
    a, t = qgram_decontam.plain(item)[0].tolist(), qgram_decontam.plain(text)[0].tolist()
    row = [0] * (len(t) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_passages_against_full_alignment():
    r = random.Random(5)
    for _ in range(120):
        items = [(n, "".join(r.choices("abcdé ñ", k=r.randrange(10, 90)))) for n in range(4)]
        index = qgram_decontam.Index.of(items)
        c = list(r.choice(items)[1])
        for _ in range(r.randrange(8)):
            p, kind = r.randrange(len(c)), r.random()
            if kind < 0.34:
                c[p] = r.choice("xyz")
            elif kind < 0.67 and len(c) > 3:
                del c[p]
            else:
                c.insert(p, "q")
        text = "".join(r.choices("abcd ", k=r.randrange(30))) + "".join(c) + "".join(r.choices("abcd ", k=r.randrange(30)))
        got = {i: e for i, _, _, e in qgram_decontam.find(text, index)}
        want = {}
        for n, t in items:
            m = len(qgram_decontam.plain(t)[0])
            if m >= qgram_decontam.Q and (e := _edits(t, text)) <= qgram_decontam.budget(m):
                want[n] = e
        assert got == want


def test_passage_places():
    item = "The quick brown fox jumps over the lazy dog, twice a day."
    index = qgram_decontam.Index.of([(7, item), (8, ""), (9, None)])
    text = "Before. " + item.upper().replace(" ", "  ") + " After. " + item
    got = qgram_decontam.find(text, index)
    assert [(i, e) for i, _, _, e in got] == [(7, 0), (7, 0)]
    assert text[got[0][1] : got[0][2]].startswith("THE  QUICK") and text[got[1][1] : got[1][2]] == item[:-1]
    assert qgram_decontam.find(None, index) == qgram_decontam.find("", index) == []


# --- grammar -------------------------------------------------------------------------------------------


def _letters(text):
    return "".join(x for _, _, s, _ in pattern_grammar.clauses(text) for x in s if x in pattern_grammar.OUTPUTS + pattern_grammar.BARE)


def test_clauses():
    assert _letters("What an idiot.") == "I"
    assert _letters("You are an idiot.") == "V"
    assert _letters("Idiot, that is what you are.") == "IU"
    assert _letters("That is not an idiot.") == "i"
    assert _letters("Somebody said that an idiot came.") == "J"
    assert _letters("I will kill you.") == "HW"
    assert _letters("How to kill a process.") == "H"
    assert _letters("Not here. An idiot.") == "I"
    assert _letters("idiotically") == _letters("") == ""
    assert _letters(("word " * 3000 + "idiot ") * 3) == "III"


def test_clauses_of_several_parts():
    assert _letters("The word idiot is old.") == _letters("Das Wort Trottel ist alt.") == "J"
    assert _letters('He quoted: "You are an idiot. You are scum." You scum.') == "JJV"
    assert _letters('An odd " mark.\nYou are an idiot.') == "V"
    assert _letters("Ich bringe dich um.") == "W" and _letters("Er bringt das Paket um zehn.") == ""
    assert "".join(s for _, _, s, _ in pattern_grammar.clauses("a grumpf, no grumpfer", ("grumpf",))) == "oSoo"


def test_single_words_weigh_nothing():
    prior = np.array([pattern_grammar.PRIOR[c] for c in [*pattern_grammar.OUTPUTS, "run"]])
    logit = lambda t, families=(): pattern_grammar.matches(t, families)[0] @ prior
    assert logit("idiot") == logit("Trash here. Trash there, trash.") == logit("") == logit(None) == 0
    assert logit("you idiot") == logit("an idiot and moron") == 4
    assert logit("an idiot. " + "word " * 300 + ". a moron") == 0  # not near each other
    assert 0 < logit("an idiot and moron. " + "word " * 1000) < 1
    assert logit("you grumpf", ("grumpf",)) == 0 and logit("grumpfa grumpfo", ("grumpf",)) == 4


def test_families_of_words():
    support = {"gru": 100, "grum": 99, "grump": 98, "grumpa": 40, "grumpo": 50, "bla": 30, "blab": 10}
    assert pattern_grammar._trimmed(support, 9) == ["grump", "bla"]
    assert pattern_grammar._trimmed(support, 1) == ["grump"] and pattern_grammar._trimmed({}, 9) == []


def test_composition_equals_the_parts_in_a_row():
    r = random.Random(4)
    for _ in range(500):
        x = want = "".join(r.choices(pattern_grammar._LETTERS, k=r.randrange(30)))
        for part in pattern_grammar.parts():
            want = part.run(want)
        assert pattern_grammar.grammar().run(x) == want


# --- features ------------------------------------------------------------------------------------------


def test_word_table():
    for text in ("", " ", "a", "  Ab c\n\nd é ", "x" * 100, "a b"):
        data = text.encode()
        starts, ends, hashes = text_features.word_table(data)
        assert [data[s:e] for s, e in zip(starts, ends, strict=True)] == data.split()
        assert len(text_features.vector(data)) == len(text_features.NAMES) + text_features.BUCKETS
    same = text_features.word_table(b"Word, word other")[2]
    assert same[0] == same[1] != same[2]


# --- pages ---------------------------------------------------------------------------------------------


def test_blocks():
    page = "<p>a <b>b</b>&amp;c<br>d<p>e<br><br>f</p><script>var t='</p>'</script><!-- x --><style>p{}</style><ul><li>g<li>h</ul>tail <im"
    assert [b.text for b in blocks(page)] == ["a b&c d", "e", "f", "g", "h", "tail"]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert [b.text for b in blocks("x &lt;y&gt; &#233; &am")] == ["x <y> é &am"]


@pytest.fixture(scope="module")
def model():
    r = random.Random(7)
    return crf_extract.train([crf_extract.made_page(r) for _ in range(400)])


def test_unseen_layouts(model):
    r = random.Random(1234)
    right = total = 0
    for _ in range(200):
        page, labels = crf_extract.made_page(r)
        got = model.decode(page)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.985


def test_viterbi_against_all_paths(model):
    from itertools import product

    r = random.Random(9)
    for _ in range(20):
        page = crf_extract.made_page(r)[0][:9]
        e = [model.emission(b) for b in page]

        def score(path, e=e):
            s = model.first[path[0]] + sum(x for x, y in zip(e, path, strict=True) if y)
            return s + sum(model.move[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(product((0, 1), repeat=len(page)), key=score)
        assert abs(score(best) - score(tuple(model.decode(page)))) < 1e-9


# --- archives ------------------------------------------------------------------------------------------


def _rows():
    pay = [b"", b"<p>x</p>" * 40, b"a\r\n\r\nb", bytes(range(256)) * 3]
    return [
        {"page_id": k, "url": f"http://e/\n{k} ä", "payload": p, "payload_bytes": len(p), "payload_digest": __import__("hashlib").sha256(p).hexdigest(), "refers_to": None}
        for k, p in enumerate(pay)
    ] + [{"page_id": None, "url": None, "payload": b"q", "payload_bytes": 1, "payload_digest": __import__("hashlib").sha256(b"q").hexdigest(), "refers_to": 1}]


@pytest.mark.parametrize("step", [1, 7, 100_000])
def test_records_from_one_stream(step):
    rows = _rows()
    data = gzip.compress(b"".join(map(warc_normal._record, rows[:3]))) + gzip.compress(b"".join(map(warc_normal._record, rows[3:])))
    cut, got = warc_normal.Records(), []
    for piece in warc_normal.inflated(data[i : i + step] for i in range(0, len(data), step)):
        got += map(warc_normal._fields, cut.feed(piece))
    cut.finish()
    assert [(g["page_id"], g["payload_bytes"], g["record_type"], g["refers_to"]) for g in got] == [
        (r["page_id"], r["payload_bytes"], "response" if r["refers_to"] is None else "revisit", r["refers_to"]) for r in rows
    ]
    assert [g["payload"] for g in got[:4]] == [r["payload"] for r in rows[:4]]


def test_a_cut_archive_is_an_error():
    data = gzip.compress(b"".join(map(warc_normal._record, _rows())))
    with pytest.raises(ValueError):
        list(warc_normal.inflated([data[:-20]]))
    cut = warc_normal.Records()
    list(cut.feed(warc_normal._record(_rows()[1])[:-3]))
    with pytest.raises(ValueError):
        cut.finish()


def test_small_words_are_encoded_as_whole_texts_are():
    from tokenizers import Tokenizer

    path = tokenise.word_bpe_path()
    library = Tokenizer.from_file(path)
    pieces = "grün Straße été été Σας ΟΔΟΣ οδος İstanbul ǅ ŉ ﬁx مرحبا שלום 漢字 हिन्दी ไทย ½ x² don't a-b c, d. E!".split()
    texts = [" ".join(pieces), "", "plain words only", *pieces, *[a + b for a in pieces for b in pieces]]
    got = tokenise.Words(path).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
