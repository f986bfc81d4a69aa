"""Pages that leave out tags, elements with words of their own, and long blocks."""

from tradebook.llm import page_blocks


def _texts(html):
    return [b.text for b in page_blocks.blocks(html)]


def test_open_head():
    assert _texts("<html><head><title>t</title><meta charset=x><p>one</p><div>two</div>") == ["one", "two"]
    assert _texts("<head><title>t</title><script>s</script>bare text<p>more") == ["bare text", "more"]
    assert _texts("<head><style>a{}</style><link rel=x><body class=c><p>one") == ["one"]
    assert _texts("<head><title>t</title> \n </head><p>one") == ["one"]


def test_math_and_object():
    got = " ".join(_texts("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><object data=f>words inside</object></article>"))
    assert all(w in got.split() for w in "if x = 2 then words inside".split())


def test_features_of_whole_block():
    text = "12 34 " * 80 + "words " * 800 + "One. Two. Three. End."
    got = page_blocks.text_features(page_blocks.blocks(f"<p>{text}</p>")[0])
    assert "few-letters" not in got and "stops=3" in got
