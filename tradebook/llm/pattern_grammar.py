"""Weighted finite-state grammar for toxic clauses.

A clause is a string of word classes: insult, word of an insulting family, threat, target, negation, reported speech,
quote mark, parts of a separable threat, other.  Four letter transducers read it one after the other, as one machine
made by composition:

* threat joins a separable verb and its particle at the end of the clause ("bringe ... um"),
* negation turns an insult or threat within its reach into a negated one,
* reported speech turns those after a verb of saying, after "the word" or inside quotes into reported ones; a quote goes
  on over the ends of clauses, up to the end of the line,
* target turns those beside an addressee into aimed ones, on either side.

A document is scored by what these leave: aimed, negated and reported insults and threats by their numbers, and runs of
insults.  A run is an insult that neither is negated nor reported and follows another, different one in the same clause
or within ``RUN_REACH`` characters; runs count for each ``RUN_LENGTH`` characters of text.  So a single insult aimed at
nobody weighs nothing, and neither does one word however often it comes.

Weights are learned from labels, with the values below as their prior.  Also learned are families of insults: beginnings
of words that stand in toxic texts.  They are weaker evidence than a listed insult, so they count in runs alone.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import bounded_sample, held_out, stored
from tradebook.llm.fm_quality import labelled_sample

SAMPLE = 6_000  # labelled rows the weights are learned from, at most
FAMILIES = 200  # beginnings of insults taken from labelled documents, at most
THRESHOLD = 0.3
RUN_REACH = 1_000  # characters
RUN_LENGTH = 500  # characters

# fixed values: words of the grammar in the four languages of the corpus
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid imbecile dumbass trash scum loser losers pathetic worthless disgusting clown "
    "filth vermin scumbag bastard asshole bitch jerk cretin dimwit retard degenerate parasite "
    "dummkopf idiotin trottel abschaum arschloch versager depp schwachkopf dreckskerl missgeburt "
    "imbécile crétin connard connasse abruti salaud ordure minable débile "
    "idiota imbécil estúpido estúpida basura escoria gilipollas pendejo cabrón asqueroso patético"
).split()
THREATS = (
    "kill murder hurt destroy burn beat shoot stab strangle hang slaughter töten umbringen vernichten verprügeln erschießen "
    "tuer frapper brûler détruire égorger matar golpear quemar destruir disparar"
).split()
TARGETS = (
    "you your yours yourself u he him his she her they them their those these people everyone du dich dir dein deine ihr euch sie "
    "tu toi te vous votre vos ils elles eux tú ti usted ustedes vosotros ellos ellas"
).split()
NEGATIONS = "not no never nobody none isn't aren't wasn't don't doesn't won't cannot without nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = (
    "said says say called calls quoted quotes claims claimed wrote writes reported reports according alleged accused sagte sagt schrieb "
    "nannte dit déclare écrit appelé dijo dice llamó escribió"
).split()
ARTICLES = "the a this das ein dieses der le ce un la el esta este".split()
MENTIONS = "word term expression wort begriff ausdruck mot terme palabra término".split()
SEPARABLE = "bringe bringst bringt bringen schlage schlägst schlägt schlagen mache machst macht machen".split()
PARTICLES = "um tot kalt".split()
QUOTES = '"“”„«»'
_END = re.compile(r"[.!?;\n]")
_QUOTE = re.compile(f"[{QUOTES}]")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»]")

# letters: o other, I insult, S word of an insulting family, H threat, P separable verb, E particle at the end, T target,
# N negation, R report, Q quote, A article, M a name for words
# outputs: V aimed insult, U target after an insult, i negated insult, J reported insult, W aimed threat, h negated threat, K reported threat,
# I and S bare insults, H bare threat
OUTPUTS = "VUiJHWhK"
BARE = "IVS"  # what runs are made of
PRIOR = {"V": 4.0, "U": 4.0, "i": 0.3, "J": 0.3, "H": 0.2, "W": 4.0, "h": 0.0, "K": 0.3, "run": 4.0}
PRIOR_BIAS = -4.0


class Transducer:
    """A letter transducer: (state, letter) -> (state, output); letters without an arc pass and lead to state 0's rest arc."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]]):
        self.arcs = arcs

    def run(self, letters: str) -> str:
        state, out, arcs = 0, [], self.arcs
        for x in letters:
            state, y = arcs[state, x]
            out.append(y)
        return "".join(out)


def machine(letters: str, start, step) -> Transducer:
    """The transducer whose states are the values that ``step(state, letter) -> (state, output)`` reaches from ``start``."""
    number, todo, arcs = {start: 0}, deque([start]), {}
    while todo:
        s = todo.popleft()
        for x in letters:
            t, y = step(s, x)
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            arcs[number[s], x] = (number[t], y)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer, letters: str) -> Transducer:
    """Reads with ``a`` and hands its output to ``b``."""

    def step(s, x):
        p, y = a.arcs[s[0], x]
        q, z = b.arcs[s[1], y]
        return (p, q), z

    return machine(letters, (0, 0), step)


NEGATION_REACH, TARGET_REACH, MENTION_REACH = 3, 4, 2
_LETTERS = "oISHPETNRQAM"


def _threat(waiting: bool, x: str):
    if x == "P":
        return True, "o"
    if x == "E":
        return False, "H" if waiting else "o"
    return waiting, x


def _negation(left: int, x: str):
    if x == "N":
        return NEGATION_REACH, "o"
    if left and x in "ISH":
        return left - 1, {"I": "i", "S": "o", "H": "h"}[x]
    return max(left - 1, 0), x


def _reported(state: tuple[bool, bool, bool, int], x: str):
    said, quoted, article, left = state  # a verb of saying or quote mark was read; an article just now; words still mentioned
    if x in "RQAM":
        return (said or x == "R", quoted != (x == "Q"), x == "A", MENTION_REACH if x == "M" and article else left), "o"
    told = (said or quoted or left) and x in "ISH"
    return (said, quoted, False, max(left - 1, 0)), {"I": "J", "S": "o", "H": "K"}[x] if told else x


def _aimed(state: tuple[int, str, int], x: str):
    seen, waiting, left = state  # target seen so lately; insult or threat that waits for a target, and for how long
    near, seen, left = seen > 0, max(seen - 1, 0), max(left - 1, 0)
    if x == "T":
        return (TARGET_REACH, "", 0), {"I": "U", "H": "W", "": "o"}[waiting]
    if x in "IH":
        aimed = {"I": "V", "H": "W"}[x]
        return ((seen, "", 0), aimed) if near else ((0, x, TARGET_REACH), x)
    return (seen, waiting if left else "", left), x


def parts() -> list[Transducer]:
    """The transducers in the order in which they read."""
    return [
        machine(_LETTERS, False, _threat),
        machine("oISHTNRQAM", 0, _negation),
        machine("oISHihTRQAM", (False, False, False, 0), _reported),
        machine("oISHihJKT", (0, "", 0), _aimed),
    ]


@lru_cache(1)
def grammar() -> Transducer:
    whole, *others = parts()
    for t in others:
        whole = compose(whole, t, _LETTERS)
    return whole


# --- one document ----------------------------------------------------------------------------------------


@lru_cache(4)
def _compiled(families: tuple[str, ...]) -> tuple[ahocorasick.Automaton, dict[str, str]]:
    """What to look for, with its length and whether a word may go on after it; and the letters of whole words."""
    letter = {}
    for words, x in ((ARTICLES, "A"), (MENTIONS, "M"), (REPORTS, "R"), (TARGETS, "T"), (NEGATIONS, "N"), (SEPARABLE, "P"), (THREATS, "H"), (INSULTS, "I")):
        letter.update(dict.fromkeys(words, x))
    letter.update(dict.fromkeys(QUOTES, "Q"))
    found = {w: (len(w), False) for w, x in letter.items() if x in "IHP"} | {w: (len(w), True) for w in families}
    finder = ahocorasick.Automaton()
    for w, how in found.items():
        finder.add_word(w, how)
    finder.make_automaton()
    return finder, letter


def clauses(text: str, families: tuple[str, ...] = ()) -> Iterator[tuple[int, int, str, set[str]]]:
    """(start, end, output letters, insults) of the clauses that hold an insult or a threat; the others match nothing.

    ``insults`` are the words that stand for one of ``BARE``.
    """
    finder, letter = _compiled(families)
    low = text.lower()
    done, begin, end, read, quoted = 0, 0, -1, 0, False
    ends: Iterator[re.Match] = _END.finditer(low)
    for last, (size, open_end) in finder.iter(low):
        at = last + 1 - size
        if at < done or (at and low[at - 1].isalnum()) or (not open_end and last + 1 < len(low) and low[last + 1].isalnum()):
            continue
        while end <= last:  # ends of clauses are walked once
            begin, end = end + 1, next((m.start() for m in ends), len(low))
            if begin and low[begin - 1] == "\n":
                quoted, read = False, begin
        line = low.rfind("\n", read, begin)
        if line >= 0:
            quoted, read = False, line + 1
        quoted ^= len(_QUOTE.findall(low, read, begin)) % 2 == 1
        read = begin
        tokens = _TOKEN.findall(low, begin, end)
        letters = [letter.get(w) or ("S" if families and w.startswith(families) else "o") for w in tokens]
        if tokens and tokens[-1] in PARTICLES:
            letters[-1] = "E"
        out = grammar().run("Q" * quoted + "".join(letters))[int(quoted) :]
        yield begin, end, out, {w for w, x in zip(tokens, out, strict=True) if x in BARE}
        done = end


def matches(text: str | None, families: tuple[str, ...] = ()) -> tuple[np.ndarray, int]:
    """``log2(1 + n)`` of how often each output letter occurs and of the runs for each ``RUN_LENGTH`` characters; the number of clauses."""
    text = text or ""
    out, runs, words, before, n = np.zeros(len(OUTPUTS) + 1), 0, set(), None, 0
    for n, (begin, end, letters, insults) in enumerate(clauses(text, families), 1):  # noqa: B007
        out[:-1] += [letters.count(x) for x in OUTPUTS]
        bare = sum(letters.count(x) for x in BARE)
        if bare:
            runs += bare - 1 + (before is not None and begin - before <= RUN_REACH)
            words |= insults
            before = end
    if len(words) > 1:
        out[-1] = runs * RUN_LENGTH / max(len(text), RUN_LENGTH)
    return np.log2(1 + out), n


# --- learning --------------------------------------------------------------------------------------------


def learned_families(sample: DataFrame, least: int = 20, ratio: float = 10.0, most: int = FAMILIES, longest: int = 10) -> list[str]:
    """Beginnings of words not listed, of three letters or more, that stand ``ratio`` times as often in toxic texts as in others.

    A word counts once for each pair of neighbours, so that copies of one text don't make its rare words look like
    insults, and it takes ``least`` of them.  A beginning is as short as the ratio allows, and then as long as nearly all
    of its words go on alike.
    """
    words = F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), " ")
    around = sample.select("y", words.alias("w")).select(
        "y", F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("by"))))
    ).select("y", "col.word", "col.by").where((F.length("word") > 2) & ~F.col("word").isin(INSULTS))
    each = around.groupBy("y", "word", "by").agg(F.lit(1).alias("_")).groupBy("word").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("bad"), F.sum((F.col("y") == 0).cast("long")).alias("good")
    )
    each = stored(each, "toxic-words")
    sizes = each.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    bad, good = max(sizes["bad"] or 0, 1), max(sizes["good"] or 0, 1)
    cut = F.explode(F.transform(F.sequence(F.lit(3), F.least(F.lit(longest), F.length("word"))), lambda n: F.substring("word", F.lit(1), n)))
    counts = each.select(cut.alias("start"), "bad", "good").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.col("bad") / F.lit(float(bad))) / ((F.col("good") + 0.5) / F.lit(float(good)))
    rows = counts.where((F.col("bad") >= least) & (odds >= ratio)).orderBy(F.desc("bad"), "start").limit(most * (longest - 2)).collect()
    return _trimmed({r["start"]: r["bad"] for r in rows}, most)


def _trimmed(support: dict[str, int], most: int, nearly: float = 0.95) -> list[str]:
    """The shortest of the beginnings, each as long as ``nearly`` all of its support goes on alike."""
    out = []
    for w in sorted(support, key=lambda w: (len(w), -support[w], w)):
        if not any(w.startswith(x) for x, _ in out):
            out.append((w, w))
    grown = []
    for w, _ in out:
        now = w
        while (longer := [x for x in support if len(x) == len(now) + 1 and x.startswith(now) and support[x] >= nearly * support[w]]):
            now = max(longer, key=lambda x: (support[x], x))
        grown.append(now)
    return sorted(grown, key=lambda w: (-support[w], w))[:most]


def fit(x: np.ndarray, y: np.ndarray, held: float = 2e-3, rounds: int = 400) -> np.ndarray:
    """Weights of what ``matches`` gives and a bias, by logistic regression drawn to the prior."""
    prior = np.array([PRIOR[c] for c in [*OUTPUTS, "run"]] + [PRIOR_BIAS])
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = prior.copy()
    if not len(y):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + held * (w - prior))
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, **names: str) -> tuple[tuple[str, ...], np.ndarray]:
    """(families, weights) from at most ``most`` labelled rows that aren't held out.

    An id that several documents have may bring more rows than that; twice as many texts at most are kept, by their hash.
    """
    told = labelled_sample(docs, labels, "toxic", most, **names).distinct()
    sample = stored(bounded_sample(told, "text", 2 * most), "toxic-sample")
    families = tuple(learned_families(sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [matches(t, families)[0].tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.mapInArrow(work, "y int, x array<double>").toPandas()  # 2 * most small rows at most
    x = np.array([list(v) for v in rows["x"]]).reshape(-1, len(OUTPUTS) + 1)
    order = np.lexsort((*x.T, rows["y"].to_numpy()))
    return families, fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score(
    docs: DataFrame, model: tuple[tuple[str, ...], np.ndarray], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses), a row per row of ``docs``; ``clauses`` counts those with an insult or a threat.

    Null and empty texts match nothing and have the score of the bias alone.  Repeated rows give equal rows, a null id
    stays null.  Every clause of the whole text is read.
    """
    families, weights = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [matches(t, families) for t in b.column(1).to_pylist()]
            x = np.array([r[0] for r in read]).reshape(-1, len(OUTPUTS) + 1)
            scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            found = [r[1] for r in read]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(found, pa.int64())], ["doc_id", "score", "clauses"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, score double, clauses long").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses"
    )
