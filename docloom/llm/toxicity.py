"""Toxicity with noisy-channel deobfuscation.

Tokens that look disguised (letters mixed with digits or signs, stretched letters, words spelled letter by letter) are turned into a
lattice of what each character may stand for. A Viterbi search under a character trigram model of the whole corpus, with a cost for each
substitution, picks the likeliest plain word. Every token is decoded, of any length, that holds a letter and a digit or sign that may stand for one,
or a doubled letter; it counts as all its readings: restored, as it stands, and with the signs at its ends read as letters. Restored and plain
words are then scored alike. In runs of single letters, digits and signs
(at least two of them and a letter among them, of any length and with separators of any width) a separator may be nothing or a word break: the
character model and how often a word stands in labelled documents decide where words start and end.

Four things are learned, no label of a held-out row among them: the character model, from all texts; words that are common enough in
labelled documents, whatever their labels; weights of words and word stems, from
labelled documents; and boosted trees over what weights say of a document, where each half of the documents is told by the weights
of the other half. All labelled documents outside the held-out fold are learned from, none is left out: texts are counted where they lie, and the
trees are fitted to the numbers of documents in the cells of a fixed grid, so the driver holds counts alone.

Defined results: a null or empty text has no words and gets the score of one; without labels, or with one class only, every score
is 0; several labels of one document count as their largest; of rows that share an id one is learned from, and each is scored; an empty table gives no rows;
other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import durable, one_text, small, spread

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Letters that a sign may stand for, and what a substitution costs (fixed values of the channel).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SUBSTITUTION, COLLAPSE, DELETION = 1.0, 2.0, 12.0
#: What a word costs that is not known, besides its characters.
UNKNOWN = 4.0
ALPHABET = 28  # 0: edge, 1-26: a-z, 27: any other letter
#: Words that a worker remembers before it starts anew.
REMEMBERED = 300_000
STEMS = (4, 5, 6)
MIN_DOCS, MIN_WEIGHT, MAX_WEIGHT = 3, 2.0, 5.0
#: How many standard errors the log odds of a word must be from none; more data never makes a word weightless.
MIN_ERRORS = 2.5
#: A known word is in one of so many documents, or in ``MIN_DOCS`` if those are more: what is rarer says nothing against a misspelling.
RARE = 6_667
#: Bits of a filter of terms: more terms only make it let more through.
FILTER_BITS = 20
#: Where the grid that trees are fitted to is cut, for each value of ``evidence``.
_STRONG = [0.0, *np.arange(MIN_WEIGHT, MAX_WEIGHT, 0.25).tolist()]
GRID = [[0.0, 1, 2, 3, 4, 6, 9, 14, 20, 30, 50, 100], _STRONG, _STRONG, _STRONG, [0.0, 0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.35, 0.5]]
#: The model's bound: so many words and stems, those of the largest weight.
MAX_TERMS = 20_000

#: Letters and digits that stand alone, with separators between them; or one beside a sign that stands alone.
_SIGN = r"[@$!|+(€£¡*#]"
_SPELLED = re.compile(rf"(?<![^\W_])[^\W_](?![^\W_])(?:(?:[\W_]+[^\W_](?![^\W_]))+|(?=\s+{_SIGN}(?!\S))|(?<={_SIGN}\s[^\W_]))")
_LETTER = re.compile(r"[^\W\d_]")
_REPEATED = re.compile(r"([^\W\d_])\1")
_OTHERS = re.compile(r"[\W\d_]+")
_RUNS = re.compile(r"(.)\1+")
_LEET = re.compile(r"[0-9@$!|+(€£¡*#]")
_ENDS = ".,;:?!\"'*#%&<>"
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_CODES = np.zeros(256, np.int32)
_CODES[97:123] = np.arange(1, 27)
_CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27


def char_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the character trigrams of all texts."""
    total = np.zeros(ALPHABET**3, np.int64)
    for t in texts:
        if t:
            c = _CODES[np.frombuffer(f"  {t}  ".encode("utf-8", "surrogatepass"), np.uint8)]
            total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
    return total


def disguised(token: str) -> bool:
    """Whether a token holds a letter and a digit or sign that may stand for one, or a doubled letter."""
    return bool(_LEET.search(token) and _LETTER.search(token) or _REPEATED.search(token))


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class Channel:
    """Restores disguised tokens."""

    def __init__(self, counts: np.ndarray, words: dict[str, int] | None = None):
        total = sum(words.values()) if words else 0
        self.words = {w: -log(n / total) for w, n in (words or {}).items()}
        self.unknown = UNKNOWN if words else 0.0
        self._prefixes: set[str] | None = None
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET) + 0.1
        self.cost = (-np.log(c / c.sum(axis=2, keepdims=True))).tolist()

    def options(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """The lattice: for each run of characters, the strings it may stand for and what that costs."""
        for m in re.finditer(r"(.)\1*", token, re.DOTALL):
            run, c = m.group(0), m.group(1)
            if c.isalpha():
                some = [(c, COLLAPSE if len(run) == 2 else 0.0)]
                if len(run) > 1:
                    some.append((c * 2, 0.0))
            else:
                some = [(x * k, SUBSTITUTION * len(run)) for x in LEET.get(c, "") for k in ({1, min(2, len(run))})]
                some.append(("", DELETION if c in LEET else SUBSTITUTION))
            yield some

    def spelled(self, run: str) -> list[list[tuple[str, float]]]:
        """The lattice of a spelled run. A gap may be nothing or a word break, and a sign there also what it stands for; equal characters with nothing but gaps between them are one stretched character."""
        out: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"([^\W_])(?:[\W_]*\1)*|[\W_]", run):
            c, n = m.group(1), sum(x == m.group(1) for x in m.group(0))
            if c is None:
                c = m.group(0)
                some = [("", 0.0), (" ", 0.0), *[(x, SUBSTITUTION) for x in LEET.get(c, "")]]
                if c not in LEET and out and (" ", 0.0) in out[-1] and len(out[-1]) == 2:
                    continue  # a wide gap is one
            else:
                letters = c if c.isalpha() else LEET.get(c, "")
                own = 0.0 if c.isalpha() else SUBSTITUTION * n
                some = [(x, own + (COLLAPSE if n == 2 else 0.0)) for x in letters]
                if n > 1:
                    some += [(x + gap + x, own) for x in letters for gap in ("", " ")]
                if not c.isalpha():
                    some.append(("", DELETION * n if c in LEET else SUBSTITUTION))
            out.append(some)
        return out

    def restore(self, token: str) -> str:
        """The likeliest plain word for ``token``."""
        return self.decode(list(self.options(token)), breaks=False)

    @property
    def prefixes(self) -> set[str]:
        if self._prefixes is None:
            self._prefixes = {w[:k] for w in self.words for k in range(1, len(w) + 1)}
        return self._prefixes

    def decode(self, lattice: list[list[tuple[str, float]]], breaks: bool = True) -> str:
        """The likeliest path: Viterbi over the last two characters, or the beginning of a known word. A space is a word break; so is the end of a known word, if ``breaks``."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        walks: dict[str, tuple[float, tuple | None]] = {}

        def put(into: dict, key, cost: float, path: tuple | None) -> None:
            if key not in into or cost < into[key][0]:
                into[key] = (cost, path)

        for at, some in enumerate(lattice):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for text, own in some:
                    p, q, total = a, b, cost + own
                    for c in text:
                        k = 0 if c == " " else _code(c)
                        if k or q:
                            total += self.cost[p][q][k] if k else self.cost[p][q][0] + self.unknown
                            p, q = q, k
                    put(after, (p, q), total, (path, text) if text else path)
                if b == 0 and self.words and (breaks or at == 0):
                    put(walks, "", cost, path)
            further: dict[str, tuple[float, tuple | None]] = {}
            for start, (cost, path) in walks.items():
                for text, own in some:
                    head, gap, tail = text.partition(" ")
                    word = start + head
                    total, ended = cost + own, ((path, word), " ")
                    if word in self.words and (gap or breaks or at + 1 == len(lattice)):
                        last = _code(word[-1])
                        if tail:
                            put(further, tail, total + self.words[word], ended)
                        else:
                            put(after, (last, 0), total + self.words[word], ended)
                    if not gap and (word in self.prefixes or not word and not breaks):
                        put(further, word, total, path)
            states, walks = after, further
        path = min(((cost + (self.cost[a][b][0] + self.unknown if b else 0.0), (a, b), path) for (a, b), (cost, path) in states.items()), key=lambda x: x[:2])[2]
        said = []
        while path:
            path, text = path
            said.append(text)
        return "".join(reversed(said)).strip()

    def plain(self, token: str) -> str:
        """What a lower-cased token says first: itself without signs at its ends, or restored if it looks disguised."""
        return self.readings(token)[0]

    def readings(self, token: str) -> list[str]:
        """All that a lower-cased token may say: restored if it looks disguised, as it stands, and restored with the signs at its ends."""
        bare = _EDGES.sub("", token)
        if not disguised(token):
            return [bare]
        inner = token.strip(_ENDS)
        said = [_EDGES.sub("", self.restore(inner)) if _REPEATED.search(inner) or _LEET.search(inner) else bare, bare]
        if inner != token and _LEET.search(token):
            said.append(_EDGES.sub("", self.restore(token)))
        return list(dict.fromkeys(said))

    def tokens(self, text: str) -> list[str]:
        """Lower-cased tokens of a whole text; what is spelled letter by letter adds the words it says."""
        low = text.lower()
        found = low.split()
        for m in _SPELLED.finditer(low):
            run = _with_signs(low, *m.span())
            if _LETTER.search(run):
                found += [w for w in self.decode(self.spelled(run)).split() if len(w) > 1]
        return found


def _with_signs(text: str, start: int, end: int) -> str:
    """The run from ``start`` to ``end`` with the signs before and after it that stand alone."""
    while True:
        at = start
        while at and text[at - 1].isspace():
            at -= 1
        if at == start or not at or text[at - 1] not in LEET or at > 1 and not text[at - 2].isspace():
            break
        start = at - 1
    while True:
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
        if at == end or at == len(text) or text[at] not in LEET or at + 1 < len(text) and not text[at + 1].isspace():
            break
        end = at + 1
    return text[start:end]


class _Plain(dict):
    """Token to its readings, remembered."""

    def __init__(self, channel: Channel):
        super().__init__()
        self.channel = channel

    def __missing__(self, token: str) -> list[str]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = words = self.channel.readings(token)
        return words


class _Weights(dict):
    """Token to the largest weight of its readings and their stems, remembered."""

    def __init__(self, channel: Channel, terms: dict[str, float]):
        super().__init__()
        self.channel, self.terms = channel, terms
        self.stems = {t[:-1] for t in terms if t.endswith("-")}
        self.prefixes = {t[:k] for t in terms for k in range(1, len(t) + 1)}
        self.once = {_RUNS.sub(r"\1", t) for t in terms}
        self.once_stems = {t[:-1] for t in self.once if t.endswith("-")}
        self.lengths = sorted({len(t) for t in self.once_stems})

    def may_weigh(self, token: str) -> bool:
        """Whether any path through the lattice has a weighty word or stem. If none has, the likeliest has none and need not be found."""
        if not _LEET.search(token):  # all that it may stand for is equal with each run of letters as one
            one = _RUNS.sub(r"\1", _OTHERS.sub("", token))
            return one in self.once or any(one[:k] in self.once_stems for k in self.lengths)
        held = {""}
        for some in self.channel.options(token):
            further = set()
            for start in held:
                for text, _ in some:
                    word = start
                    for c in text:
                        word += c
                        if word in self.stems:
                            return True
                    if not word or word in self.prefixes:
                        further.add(word)
            if not further:
                return False
            held = further
        return any(word in self.terms for word in held)

    def said(self, token: str) -> list[str]:
        """Words and stems of the token's readings, of those at least that weigh."""
        if disguised(token):
            inner = token.strip(_ENDS)
            if self.may_weigh(inner) or inner != token and _LEET.search(token) and self.may_weigh(token):
                return [t for word in self.channel.readings(token) for t in terms_of(word)]
        return terms_of(_EDGES.sub("", token))

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        terms = self.said(token)
        self[token] = w = max(map(self.terms.get, terms, [0.0] * len(terms)))
        return w


class _Held(_Weights):
    """Token to those of the terms that its readings and their stems are, remembered."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = tuple(t for t in self.said(token) if t in self.terms)
        return found


def terms_of(word: str) -> list[str]:
    """The word and its stems (marked with a hyphen)."""
    return [word, *[word[:k] + "-" for k in STEMS if len(word) >= k]] if word else [""]


def evidence(tokens: list[str], weights: dict[str, float]) -> tuple[float, ...]:
    """What the weights say of a document: number of weighty words, the three largest weights, their share."""
    w = np.fromiter(map(weights.__getitem__, tokens), float, len(tokens)) if tokens else np.zeros(1)
    hits = w[w > 0]
    top = np.sort(hits)[::-1][:3]
    return (float(len(hits)), *(float(top[i]) if i < len(top) else 0.0 for i in range(3)), len(hits) / max(1, len(tokens)))


MONOTONE = [1, 1, 1, 1, 1]


def char_model(docs: DataFrame, words: dict[str, int] | None = None) -> Channel:
    """The character model of all texts, with known words. Each task sends at most ``ALPHABET``**3 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            total += char_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    total = np.zeros(ALPHABET**3)
    for r in spread(docs.select("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[r["gram"]] = r["n"]
    return Channel(total, words)


def known_words(held: DataFrame) -> dict[str, int]:
    """Plain words of at least ``MIN_DOCS`` documents and of one in ``RARE``, and of how many."""
    least = max(MIN_DOCS, held.count() / RARE)
    words = held.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s.,;:?!\"'()]+"))).alias("word")).filter(F.col("word").rlike(r"^\p{L}+$"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}


def sample(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """The labelled documents outside the held-out fold, or ``rows`` of them drawn by hash: ``doc_id, toxic, half, text``."""
    ours = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    picked = ours.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if rows is not None:
        picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half")
    one = docs.select("doc_id", "text").join(small(picked, picked.count()), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), one_text())
    return one.select("doc_id", "toxic", half, "text")


def term_counts(held: DataFrame, channel: Channel) -> DataFrame:
    """``half, term, bad, good``: toxic and other documents of each half that have a word or stem; a null term counts all documents.

    A term counts in as many toxic documents as it has words before it there, at most: what only copies of one passage share has
    one such word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad, good = _Plain(channel), Counter(), Counter()
        for b in batches:
            for half, toxic, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = [w for t in channel.tokens(text or "") for w in plain[t]]
                terms = {(half, t, None) for w in set(words) for t in terms_of(w)} | {(half, None, None)}
                if toxic > 0:
                    bad.update(terms | {(half, t, crc32(before.encode())) for before, w in set(zip(["", *words], words)) for t in terms_of(w)})
                else:
                    good.update(terms)
        names = list({*bad, *good})
        kinds = (pa.int32(), pa.string(), pa.int64())
        columns = [pa.array([x[i] for x in names], k) for i, k in enumerate(kinds)] + [pa.array([k[x] for x in names], pa.int64()) for k in (bad, good)]
        yield pa.RecordBatch.from_arrays(columns, names=["half", "term", "before", "bad", "good"])

    pairs = spread(held.select("half", "toxic", "text")).mapInArrow(count, "half int, term string, before long, bad long, good long").groupBy("half", "term", "before").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    in_docs = F.coalesce(F.sum(F.when(F.col("before").isNull(), F.col("bad"))), F.lit(0))
    counts = pairs.groupBy("half", "term").agg(in_docs.alias("docs"), F.count("before").alias("places"), F.sum("good").alias("good"))
    return counts.select("half", "term", F.when(F.col("term").isNull(), F.col("docs")).otherwise(F.least("docs", "places")).alias("bad"), "good")


def good_counts(held: DataFrame, terms_in: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """``half, term, good``: documents that have a term; ``terms_in`` makes, once a task, what tells the terms of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell, good = terms_in(), Counter()
        for b in batches:
            for half, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                good.update((half, t) for t in tell(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in good], pa.int32()), pa.array([t for _, t in good], pa.string()), pa.array(list(good.values()), pa.int64())], names=["half", "term", "good"])

    return spread(held.select("half", "text")).mapInArrow(count, "half int, term string, good long").groupBy("half", "term").agg(F.sum("good").alias("good"))


def weighty_counts(held: DataFrame, channel: Channel) -> DataFrame:
    """``term_counts`` of the terms that may weigh, and of all documents, without restoring what cannot change a weight.

    Toxic documents are counted whole. The others are counted as they stand first, and every reading of theirs only for terms that
    would weigh by that count: more of them can only make a term weigh less.
    """
    whole = held.groupBy("half").agg(F.lit(None).cast("string").alias("term"), F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
    bad = durable(term_counts(held.filter("toxic > 0"), channel).filter("term IS NOT NULL").select("half", "term", "bad"), "toxic-bad")
    others, last = held.filter("toxic <= 0"), (1 << FILTER_BITS) - 1
    often = bad.groupBy("term").agg(F.sum("bad").alias("bad")).filter(F.col("bad") >= MIN_DOCS)
    marked = np.zeros(last + 1, bool)
    marked[often.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(last)).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(int)] = True
    bits = np.packbits(marked)

    def plainly():
        seen, on = {}, np.unpackbits(bits)

        def tell(text: str) -> set[str]:
            if len(seen) >= REMEMBERED:
                seen.clear()
            found: set[str] = set()
            for token in set(text.lower().split()):
                if (terms := seen.get(token)) is None:
                    terms = seen[token] = [t for t in terms_of(_EDGES.sub("", token)) if on[crc32(t.encode("utf-8", "replace")) & last]]
                found.update(terms)
            return found

        return tell

    row = lambda counts, name: counts.select("half", "term", *[(F.col(c) if c == name else F.lit(0).cast("long")).alias(c) for c in ("bad", "good")])
    plain = durable(row(bad, "bad").unionByName(row(good_counts(others, plainly), "good")).unionByName(whole), "toxic-plain")
    terms = {t: 1.0 for some in (plain, plain.filter("half <> 0"), plain.filter("half <> 1")) for t in term_weights(some, None, 0.0)}

    def wholly():
        known = _Held(channel, terms)
        return lambda text: {t for token in set(channel.tokens(text)) for t in known[token]}

    named = held.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return row(bad.join(named, "term", "left_semi"), "bad").unionByName(row(good_counts(others, wholly), "good")).unionByName(whole)


def term_weights(counts: DataFrame, most: int | None = MAX_TERMS, errors: float = MIN_ERRORS) -> dict[str, float]:
    """Log odds of words and stems between toxic and other documents, up to ``MAX_WEIGHT``; at most ``most``, all of clear weight."""
    counts = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.filter("term IS NULL").first()
    if not total or not total["bad"] or not total["good"]:
        return {}
    odds = lambda n, of: F.log((F.col(n) + 0.5) / (of + 1.0))
    weight = F.least(odds("bad", total["bad"]) - odds("good", total["good"]), F.lit(MAX_WEIGHT))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    clear = F.col("term").isNotNull() & (F.col("term") != "") & (F.col("bad") >= MIN_DOCS)
    found = counts.filter(clear).select("term", weight.alias("w"), error.alias("error")).filter((F.col("w") >= MIN_WEIGHT) & (F.col("w") >= errors * F.col("error")))
    found = found if most is None else found.orderBy(F.desc("w"), "term").limit(most)
    return {r["term"]: r["w"] for r in found.collect()}


def cells(scored: DataFrame) -> DataFrame:
    """``e0 .. e4, toxic, n``: how many documents of each class lie in each cell of ``GRID``; of those, a bounded number."""
    at = [sum((F.col("evidence")[i] > e).cast("int") for e in edges).alias(f"e{i}") for i, edges in enumerate(GRID)]
    return scored.select(*at, (F.col("toxic") > 0).alias("toxic")).groupBy(*[f"e{i}" for i in range(len(GRID))], "toxic").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> tuple[Channel, dict[str, float], gbt.Forest | None]:
    held = durable(sample(docs, labels, rows), "toxic-learned")
    channel = char_model(docs, known_words(held))
    counts = durable(weighty_counts(held, channel), "toxic-terms")
    seen = []
    for half in (0, 1):
        terms = term_weights(counts.filter(F.col("half") != half))
        seen += cells(with_evidence(spread(held.filter(F.col("half") == half).select("toxic", "text")), channel, terms)).collect()
    told = np.array(sorted(map(tuple, seen)), float).reshape(-1, len(GRID) + 2)
    y, n = told[:, -2], told[:, -1]
    if not 0 < y.sum() < len(y):
        return channel, {}, None
    x = np.stack([np.append(edges, edges[-1] + 1)[told[:, i].astype(int)] for i, edges in enumerate(GRID)], axis=1)
    return channel, term_weights(counts), gbt.fit(x, y, weights=n, edges=GRID, monotone=MONOTONE, trees=40, depth=3, rate=0.3, least=5)


def with_evidence(docs: DataFrame, channel: Channel, terms: dict[str, float], forest: gbt.Forest | None = None) -> DataFrame:
    """``docs`` without text, with ``evidence`` and ``score`` (0 without a forest)."""
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])
    rest = docs.drop("text")
    others = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(channel, terms)
        for b in batches:
            x = np.array([evidence(channel.tokens(t) if t else [], weights) for t in b.column(0).to_pylist()]).reshape(-1, len(MONOTONE))
            score = forest.score(x) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(x), pa.list_(pa.float64())), pa.array(score)], names=[*others, "evidence", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + ["evidence array<double>", "score double"])
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    channel, terms, forest = train(docs, labels, rows)
    scored = with_evidence(spread(docs.select("doc_id", "text")), channel, terms, forest)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
