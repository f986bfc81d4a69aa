"""Every page gives a row of its main text, whatever element holds it."""

import hashlib

from tradebook.plans.page_queries import main_content


def test_pages_without_article(spark, tmp_path):
    pages = [
        (1, "http://a.example/1", "<html><body><nav>menu</nav><main><p>main words here</p></main></body></html>"),
        (2, "http://a.example/2", "<html><body><p>body words here</p></body></html>"),
        (3, "http://a.example/3", "<html><body><article><p>article words here</p></article></body></html>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["root_tag"], r["main_md5"]) for r in main_content(spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {1: ("main", md5("mainwordshere")), 2: ("body", md5("bodywordshere")), 3: ("article", md5("articlewordshere"))}
