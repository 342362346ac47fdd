"""Problem 8: score documents for abusive, hateful or sexually explicit passages.

Method: every token of a document has a log-odds score - how much likelier it, and it after its predecessor, is in
abusive passages than elsewhere, with Dirichlet priors. One linear pass finds all maximal scoring segments. A
segment's score is calibrated by extreme value theory: the best segment of harmless text of n tokens follows a Gumbel
law whose location grows with log n; its parameters are fitted to the labelled harmless documents. A document's score
is -log10 of the probability that harmless text of its length holds a segment as good; its passages are all segments
that are significant by themselves.

The log-odds are learned from labels alone: from at most LABELLED labelled documents of at most LABELLED_CHARS characters
together, chosen by hash (a bound on the training sample; every document is scored). Labels are per document, so fitting
alternates: segments found in documents labelled abusive supply the abusive counts, all else the harmless ones; it starts
from the tokens and pairs that such documents hold far oftener than others. Counting is done by the executors; the driver gets counts only.

Disguises are undone before scoring: letters spelled with digits or signs, spaced or dotted letters, drawn-out
letters, look-alike letters, invisible characters, and letters masked by signs (by the one scored word that fits).

Defined results: null, empty and blank texts score 0 and hold no passage; documents without source are reported under
null; contradicting labels count by majority, ties as abusive; repeated labels of one annotator count once. Without labelled
abusive documents nothing is found.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve.llm import unify
from citeresolve.session import materialize

LABELLED, LABELLED_CHARS, ROUNDS, P_VALUE = 6000, 24_000_000, 4, 4e-3
#: In a document labelled abusive a token is likelier abusive by LABEL, and segments of SURE or more, or the best, are counted;
#: a segment of WRONG or more in a document labelled harmless is taken for a wrong label.
LABEL, SURE, WRONG = 0.8, 3.0, 6.0
#: Dirichlet prior: its weight in tokens and the share of abusive tokens in it (a pair's prior share is its second token's); score of a token
#: never seen in training; what every token costs a segment. Harmless documents from which the Gumbel law is fitted; with fewer it is the standard one.
PRIOR, BASE, UNSEEN, DRIFT, LEAST_HARMLESS = 1.5, 0.15, -1.2, 0.4, 10

_SINGLE, _SEVERAL = unify.forms()
_FORMS = str.maketrans(_SINGLE | _SEVERAL)
_INVISIBLE = re.compile("[\xad​-‏⁠﻿]")
#: Letters spelled one by one: with spaces (looked for in the text), with dots, hyphens or underscores (within a word).
_SPACED = re.compile(r" [^\W_] [^\W_] [^\W_](?: [^\W_])*(?![^\W_])")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[@#*$]+[^\W_]+)*|[.!?;:“”\"—\n]")
_LEET = str.maketrans("013457@$", "oieastas")
_RUNS = re.compile(r"(.)\1+")
_END = "."


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def _reduce(w: str) -> str:
    return _RUNS.sub(r"\1", w)


def word_tokens(raw: str) -> tuple[str, ...]:
    """The tokens of one run of characters without white space."""
    if not raw.isascii():
        raw = _INVISIBLE.sub("", raw.translate(_FORMS))
    if _SPELLED.search(raw):
        raw = _SPELLED.sub(lambda m: m.group().replace(m.group(1), ""), raw)
    out = []
    for t in _TOKEN.findall(fold(raw)):
        if not t[0].isalnum():
            out.append(_END)
        elif t.isdigit():
            out.append("0")
        elif t.isalpha():
            out.append(_reduce(t))
        elif "*" in t or "#" in t or "@" in t or "$" in t:
            out.append("?" + t)  # masked: read in the light of the scored words
        elif sum(c.isdigit() for c in t) <= (0.8 if len(t) > 4 else 0.6) * len(t) and len(t) > 3:
            out.append(_reduce(t.translate(_LEET)))
        else:
            out.append("0")
    return tuple(out)


class _Memo(dict):
    def __missing__(self, raw: str) -> tuple[str, ...]:
        got = word_tokens(raw)
        if len(raw) <= 40:
            if len(self) > 400_000:
                self.clear()
            self[raw] = got
        return got


_MEMO = _Memo()


def tokens(text: str) -> list[str]:
    """The tokens of a text; "." ends a clause."""
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: " " + m.group().replace(" ", ""), text)
    return list(chain.from_iterable(map(_MEMO.__getitem__, text.replace("\n", " \n ").split(" "))))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        cur = (i, i + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = (found[j][0], cur[1], found[j][2], cur[3])
            del found[j:]
    return [(hi - lo, a, b) for a, b, lo, hi in found]


class Scorer:
    """Token log-odds and the Gumbel law of harmless text."""

    def __init__(self):
        self.one: dict[str, float] = {}
        self.two: dict[tuple[str, str], float] = {}
        self.masked: dict[str, str | None] = {}
        self.mu, self.beta = 0.0, 1.0
        self.prepared()

    def prepared(self) -> None:
        self.hot_one = {t for t, s in self.one.items() if s > 0}
        self.hot_two = {t for t, s in self.two.items() if s > 0}
        self.by_size: dict[tuple[str, int], list[str]] = defaultdict(list)
        for t in self.hot_one:
            if t.isalpha():
                self.by_size[t[0], len(t)].append(t)
        self.masked.clear()

    def unmask(self, t: str) -> str:
        """The scored word a masked token (with its "?") stands for; as spelled if none fits."""
        got = self.masked.get(t)
        if got is None:
            w = t[1:]
            plain = _reduce(w.translate(_LEET)) if "*" not in w and "#" not in w else None
            if plain in self.one:
                got = plain
            else:
                p = re.compile("".join("[a-z]{1,%d}" % max(1, len(m)) if m[0] in "@#*$" else re.escape(m) for m in re.findall(r"[@#*$]+|[^@#*$]", _reduce_letters(w))))
                fits = [x for n in range(2, len(w) + 1) for x in self.by_size.get((w[0], n), ()) if p.fullmatch(x)]
                got = max(fits, key=lambda x: (self.one[x], x)) if fits else plain or w
            if len(self.masked) > 100_000:
                self.masked.clear()
            self.masked[t] = got
        return got

    def read(self, toks: list[str]) -> list[str]:
        return [self.unmask(t) if t[0] == "?" else t for t in toks] if "?" in " ".join(toks) else toks

    def found(self, toks: list[str], bonus: float = 0.0) -> list[tuple[float, int, int]]:
        """The segments; none where no token or pair has a positive score."""
        if not bonus and self.hot_one.isdisjoint(toks) and self.hot_two.isdisjoint(zip(toks, toks[1:])):
            return []
        return segments([x + bonus for x in self.score(toks)] if bonus else self.score(toks))

    def score(self, toks: list[str]) -> list[float]:
        one, two, out, last = self.one, self.two, [], _END
        for t in toks:
            s = two.get((last, t))
            if s is None:
                s = one.get(t, UNSEEN)
            out.append(s if t != _END else -0.8)
            last = t
        return out

    def best(self, text: str | None) -> tuple[int, list[tuple[float, int, int]], list[str]]:
        """Number of tokens, segments and tokens of a text. Text without any token of positive score has no segment."""
        if not text or not text.strip():
            return 0, [], []
        toks = self.read(tokens(text))
        return len(toks), self.found(toks), toks

    def log_p(self, score: float, n: int) -> float:
        """log10 of the probability that harmless text of n tokens has a segment of `score` or more."""
        z = (score - self.mu) / self.beta - math.log(max(n, 1))
        e = math.exp(-z) if z > -50 else math.inf
        p = -math.expm1(-e) if e < 1 else 1 - math.exp(-e)
        return math.log10(p) if p > 1e-300 else -300.0

    @staticmethod
    def _odds(hit: dict, pool: dict, back: dict | None = None) -> dict:
        """Log-odds that a token is in an abusive passage, with a Dirichlet prior."""
        out = {}
        for k in pool.keys() | hit.keys():
            h = hit.get(k, 0.0)
            rest = max(0.0, pool.get(k, 0) - h)
            prior = BASE if back is None else 1 / (1 + math.exp(-back.get(k[1], UNSEEN) - DRIFT))
            if back is not None and h + rest < 2:
                continue
            v = math.log((h + PRIOR * prior) / (rest + PRIOR * (1 - prior))) - DRIFT
            out[k] = max(-4.0, min(4.0, v))
        return out

    def calibrate(self, best: list[tuple[float, int]]) -> None:
        """Gumbel law (method of moments, upper outliers - wrong labels - aside) of the (best score, tokens) of harmless documents, less log n."""
        keep = sorted(best)[: max(1, int(len(best) * 0.93))]
        if len(keep) < LEAST_HARMLESS:
            self.mu, self.beta = 0.0, 1.0
            return
        m = sum(s for s, _ in keep) / len(keep)
        sd = math.sqrt(sum((s - m) ** 2 for s, _ in keep) / len(keep))
        self.beta = max(0.6, sd * math.sqrt(6) / math.pi)
        n = sum(math.log(max(1, k)) for _, k in keep) / len(keep)
        self.mu = m - 0.5772 * self.beta - self.beta * n


def _reduce_letters(w: str) -> str:
    return re.sub(r"([^@#*$])\1+", r"\1", w)


def labelled(documents: DataFrame, labels: DataFrame, most: int = LABELLED, chars: int = LABELLED_CHARS) -> DataFrame:
    """(toks, bad) of at most `most` labelled documents of at most `chars` characters together, the first by hash."""
    v = labels.where("doc_id IS NOT NULL AND categoria IS NOT NULL").groupBy("doc_id", "anotador").agg(F.max_by("categoria", "rotulado_em").alias("c"))
    v = v.groupBy("doc_id").agg((F.avg((F.col("c") != "nenhum").cast("double")) >= 0.5).alias("bad"))
    texts = documents.where("trim(text) <> ''").select("doc_id", "text")
    first = texts.select("doc_id", F.length("text").alias("n")).join(v, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(most)
    w = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` rows
    chosen = first.withColumn("sum", F.sum("n").over(w)).where(F.col("sum") <= chars).groupBy("doc_id").agg(F.max("bad").alias("bad"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"toks": [tokens(t) for t in p["text"]], "bad": p["bad"]})

    n = documents.sparkSession.sparkContext.defaultParallelism
    got = texts.join(F.broadcast(chosen), "doc_id").repartition(n, "doc_id")
    return materialize(got.select("text", "bad").mapInPandas(run, "toks array<string>, bad boolean"), "p8-labelled")


def counted(docs: DataFrame, of, columns: str) -> DataFrame:
    """Sums of what of(tokens, bad) gives for each document, ((a, b), *numbers), by (a, b); b is null for single tokens."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for p in it:
            for toks, bad in zip(p["toks"], p["bad"]):
                for key, *numbers in of(list(toks), bad):
                    old = total.get(key)
                    total[key] = numbers if old is None else [x + y for x, y in zip(old, numbers)]
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["a", "b", *names])

    return docs.mapInPandas(run, f"a string, b string, {columns}").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])


def keys(toks: list[str], before: str = _END, pairs_from: int = 0) -> Iterator[tuple[str, str | None]]:
    """The tokens, and the pairs of neighbours."""
    yield from ((t, None) for t in toks)
    yield from zip([before, *toks[:-1]] if pairs_from == 0 else toks, toks[pairs_from:])


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Scorer:
    """The scorer learned from labelled documents (toks, bad)."""
    spark = docs.sparkSession
    if docs.where("bad").isEmpty():
        return Scorer()
    n_bad, n_good = (docs.where(F.col("bad") == b).count() or 1 for b in (True, False))
    occur = counted(docs, lambda t, bad: ((k, n, n_k if bad else 0, 0 if bad else n_k) for k, n in Counter(keys(t, pairs_from=1)).items() for n_k in (1,)), "n double, bad double, good double")
    occur = materialize(occur, "p8-counts")
    expected = F.col("good") / n_good * n_bad
    start = {(r["a"], r["b"]): r["hit"] for r in occur.where((F.col("bad") >= 2) & (F.col("bad") > 3 * expected + 1)).select("a", "b", (F.col("bad") - expected).alias("hit")).collect()}
    pool = {(r["a"], r["b"]): r["n"] for r in occur.where("b IS NULL OR n >= 2").select("a", "b", "n").collect()}
    scorer = Scorer()
    hits, wrong = start, {}
    for r in range(rounds):
        if r:
            m = spark.sparkContext.broadcast(scorer)

            def segmented(toks: list[str], bad: bool):
                s = m.value
                t = s.read(toks)
                found = s.found(t, LABEL if bad else 0.0)
                top = max((x[0] for x in found), default=0.0)
                for x, i, j in found:
                    if x >= (min(top, SURE) if bad else WRONG):
                        for k in keys(t[i:j], t[i - 1] if i else _END):
                            yield (k, 1.0, 0.0) if bad else (k, 0.0, 1.0)

            rows = counted(docs, segmented, "hit double, wrong double").collect()
            hits, wrong = ({(x["a"], x["b"]): x[c] for x in rows if x[c]} for c in ("hit", "wrong"))
        left = {k: n - wrong.get(k, 0.0) for k, n in pool.items()}
        split = lambda d, two: {k if two else k[0]: n for k, n in d.items() if (k[1] is not None) == two}
        scorer = Scorer()
        scorer.one = Scorer._odds(split(hits, False), split(left, False))
        scorer.two = Scorer._odds(split(hits, True), split(left, True), scorer.one)
        scorer.prepared()
    m = spark.sparkContext.broadcast(scorer)

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame([(max((s for s, _, _ in m.value.found(m.value.read(list(t)))), default=0.0), len(t)) for t in p["toks"]], columns=["s", "n"])

    scorer.calibrate([tuple(r) for r in docs.where("NOT bad").mapInPandas(best, "s double, n long").collect()])
    return scorer


def score_documents(documents: DataFrame, labels: DataFrame, extra: list[str] | None = None, p_value: float = P_VALUE, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, *extra, score, passages, worst): calibrated score, significant passages and the worst passage's tokens."""
    spark = documents.sparkSession
    s = spark.sparkContext.broadcast(scorer or fit(labelled(documents, labels)))
    least = math.log10(p_value)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = s.value
        for p in it:
            rows = []
            for t in p["text"]:
                n, segs, toks = m.best(t)
                logs = [(m.log_p(x, n), a, b) for x, a, b in segs]
                hits = [x for x in logs if x[0] <= least]
                top = min(logs, default=None)
                rows.append((round(-top[0], 4) + 0.0 if top else 0.0, len(hits), " ".join(toks[top[1] : top[2]]) if hits else None))
            yield p.drop(columns="text").assign(score=[r[0] for r in rows], passages=[r[1] for r in rows], worst=[r[2] for r in rows])

    src = documents.select("doc_id", *(extra or []), "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInPandas(run, f"{fields}, score double, passages int, worst string")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    flagged = (F.col("passages") > 0).cast("long")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(flagged).alias("flagged"), F.avg(flagged).alias("rate"), F.avg("score").alias("mean_score"))
