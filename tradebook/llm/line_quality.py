"""Line-first cleaning: rules judge single lines, failing lines go, and a document that loses too much goes as a whole.

Everything is a Column expression inside the document's own row: no shuffle,
no Python.  The five-word windows of a text are hashed (xxhash64 chained over
the words) and sorted inside the row only where two of them are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import BLANKS, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
# fixed values: phrases of short lines that belong to a site, not to a text
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|"
    "enable javascript|javascript is (disabled|required)|sign up for|subscribe to (our|the) newsletter|click here to|"
    "share (this|on) |released under the .{1,40}licen[cs]e|licensed under the|copyright (©|\\(c\\)|[0-9]{4})|"
    "lorem ipsum|powered by |skip to (main )?content|log ?in to your account)"
)
CODE_END = "([{}]|\\);)[\\x20\\x09]*$"
BOILERPLATE_WORDS = 30  # longer lines are prose that names such a phrase
WINDOW = 5


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def navigation(line: Column) -> Column:
    """A row of links or cells: three or more separators, one for every six words at least."""
    return (_count(line, SEPARATORS) >= 3) & (_count(line, SEPARATORS) * 6 >= F.size(words_of(line)))


def symbol_noise(line: Column) -> Column:
    """Symbols on every third word or more."""
    return (_count(line, SYMBOLS) >= 3) & (_count(line, SYMBOLS) * 3 >= F.size(words_of(line)))


def shouting(line: Column) -> Column:
    """A double exclamation mark on every third word or more."""
    n = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    return (n >= 3) & (n * 3 >= F.size(words_of(line)))


def boilerplate(line: Column) -> Column:
    """A short line with a phrase of site furniture, or an end of line of a program."""
    return ((F.size(words_of(line)) <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)) | line.rlike(CODE_END)


LINE_RULES = {"navigation": navigation, "symbols": symbol_noise, "shouting": shouting, "boilerplate": boilerplate}


def line_passes(line: Column) -> Column:
    failed = F.lit(False)
    for rule in LINE_RULES.values():
        failed = failed | rule(line)
    return ~failed


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row, though inner lambdas name it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column, hashes: Column) -> Column:
    """Words that stand in a window whose hash occurs twice or more; ``hashes`` has one entry per window."""

    def covered(by_hash: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(by_hash, lambda x, i: same(x, F.get(by_hash, i - 1)) | same(x, F.get(by_hash, i + 1)))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), width)

    def width(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("long")).otherwise(_let(by_hash, covered))


def clean_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeat: int = 20
) -> DataFrame:
    """One row per row of ``docs``: counts, verdicts and the cleaned text.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars,
    clean_text.  ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` % of the words in repeated
    five-word windows.  ``clean_text``: the lines that pass every rule, of equal lines the first.  ``kept``: not
    ``base_failed``, and at most ``max_lost`` of the word characters went with the lines.

    Null and empty texts have no words, so they fail the base rule.  Repeated rows give repeated rows; a null id stays
    null.  Other columns of ``docs`` are not looked at.  The work of a row grows with its own text alone (n log n if
    windows repeat).
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    bare = lambda c: F.length(F.translate(c, BLANKS, ""))
    split = base.withColumns({"_w": words_of(F.col("_t")), "_l": F.split("_t", "\n")})
    w, lines = F.col("_w"), F.col("_l")
    starts = F.when(F.size(w) >= WINDOW, F.slice(w, 1, F.greatest(F.size(w) - WINDOW + 1, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )
    hashed = split.withColumns(
        {
            "_h": F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])),
            "_n": F.size(w).cast("long"),
            "_worded": F.filter(lines, lambda line: F.translate(line, BLANKS, "") != ""),
            "_good": F.array_distinct(F.filter(lines, line_passes)),
        }
    )
    out = hashed.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        bare(F.col("_t")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(w, F.col("_h")).alias("n_repeat_words"),
        F.array_join("_good", "\n").alias("clean_text"),
    ).withColumn("kept_chars", bare(F.col("clean_text")).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    loses = F.col("word_chars") - F.col("kept_chars") > F.lit(max_lost) * F.col("word_chars")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~loses).alias("kept"), "kept_chars", "clean_text",
    )
