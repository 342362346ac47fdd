"""Problem 3: find text decoded with the wrong character encoding and restore it.

Method: a hidden Markov model with one clean state and one state per encoding pair (really encoded as, read as; also
read wrongly twice, wrongly and then lower-cased, and with what couldn't be read replaced) labels the characters.
A state's emission is the joint probability of a character above U+007F and its neighbours. The clean state's is
counted over every row of plausible characters; each pair's follows from it by encoding and decoding the counted
characters, so nothing has to be labelled. ASCII characters look alike in all states, so the Viterbi pass runs over
the other characters only, which is exact: between them a path changes state at most once at best.

Each labelled span gets its state's inverse transform. Replaced characters are restored from the vocabulary of the
clean rows: the most frequent word that has letters above U+007F in just those places.

A row whose characters cannot together gain what entering a state costs is clean without a Viterbi pass (an upper
bound, so no other labelling could win).

Defined results: null stays null and is no case; empty texts are no case; ties go to the clean state; rows delivered
repeatedly count once; a case whose text can't be restored stays a case and keeps its characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeresolve.session import materialize

#: Costs of entering and leaving a garbled state (log probabilities); weight of what was not counted.
ENTER, LEAVE, SMOOTH = math.log(1e-4), math.log(0.02), 2.0
#: In the clean state any character, however rare, may be correct: its least share, and the share of a neighbourhood not
#: counted. A garbled state holds only what its encodings make, and hardly in a neighbourhood the language doesn't have.
RARE, NEW_CLEAN, NEW_GARBLED = 1e-3, 0.02, 5e-4
#: Letters and signs a text of this language may hold (fixed values); only rows of these count for the clean state.
LETTERS = "àáâãçéêíóôõúüñÀÁÂÃÇÉÊÍÓÔÕÚÜÑ"
SIGNS = "ºª§°²³¼½“”‘’—–…®™€"
#: Pairs of neighbouring letters that the language has.
NEIGHBOURS = re.compile(rf"[çÇ][ãáéêíóôõúÃÁÉÊÍÓÔÕÚ]|[“‘][{LETTERS}]|[{LETTERS}][”’]|[”’—–…®™]{{2}}|[º°ª][”’]")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
RUN = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
LOST = "�"


def _decode(data: bytes, enc: str) -> str | None:
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            if enc != "cp1252":
                return None
            out.append(chr(b))  # undefined there: read as Latin-1
    return "".join(out)


def _read_as(c: str, real: str, read: str) -> str | None:
    try:
        return _decode(c.encode(real), read)
    except UnicodeEncodeError:
        return None


#: name -> how one character of the original looks.
PAIRS = {
    "utf-8>cp1252": lambda c: _read_as(c, "utf-8", "cp1252"),
    "utf-8>latin-1": lambda c: _read_as(c, "utf-8", "latin-1"),
    "utf-8>cp850": lambda c: _read_as(c, "utf-8", "cp850"),
    "utf-8>cp437": lambda c: _read_as(c, "utf-8", "cp437"),
    "utf-8>mac-roman": lambda c: _read_as(c, "utf-8", "mac_roman"),
    "cp1252>cp850": lambda c: _read_as(c, "cp1252", "cp850"),
    "cp1252>cp437": lambda c: _read_as(c, "cp1252", "cp437"),
    "cp1252>mac-roman": lambda c: _read_as(c, "cp1252", "mac_roman"),
    "cp850>cp1252": lambda c: _read_as(c, "cp850", "cp1252"),
    "cp437>cp1252": lambda c: _read_as(c, "cp437", "cp1252"),
    "mac-roman>cp1252": lambda c: _read_as(c, "mac_roman", "cp1252"),
}


def _twice(c: str, read: str = "cp1252") -> str | None:
    once = _read_as(c, "utf-8", read)
    return None if once is None else "".join(_read_as(x, "utf-8", read) or x if ord(x) > 127 else x for x in once)


PAIRS["utf-8>cp1252 twice"] = _twice
PAIRS["utf-8>latin-1 twice"] = lambda c: _twice(c, "latin-1")
PAIRS["utf-8>cp1252 lower"] = lambda c: (s := _read_as(c, "utf-8", "cp1252")) and s.lower()
PAIRS["utf-8>latin-1 lower"] = lambda c: (s := _read_as(c, "utf-8", "latin-1")) and s.lower()
STATES = ["clean", *PAIRS, "replaced"]
#: Characters whose garbled forms are known, beside Latin letters: general punctuation, euro, trade mark and the like.
REPERTOIRE = [chr(i) for i in (*range(0xA0, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x2040), 0x20AC, 0x2122, 0x2212)]


def near(c: str) -> str:
    """A neighbour as the model sees it."""
    if c > "\x7f":
        return c
    if c.isalpha():
        return c.lower()
    return "0" if c.isdigit() else " " if c.isspace() else "."


#: Characters a reader doesn't see: in clean text the letters around them are neighbours.
UNSEEN = "\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def triples(t: str) -> Iterator[tuple[str, str, str]]:
    """Each character above U+007F with its neighbours."""
    n = len(t)
    for m in NON_ASCII.finditer(t):
        i = m.start()
        yield near(t[i - 1]) if i else " ", t[i], near(t[i + 1]) if i + 1 < n else " "


def seen_triples(t: str) -> Iterator[tuple[str, ...]]:
    """As triples(), followed by the neighbours a reader sees where those differ."""
    n = len(t)
    for (l_, c, r), m in zip(triples(t), NON_ASCII.finditer(t)):
        if l_ in UNSEEN or r in UNSEEN:
            i = j = m.start()
            while i > 0 and t[i - 1] in UNSEEN:
                i -= 1
            while j + 1 < n and t[j + 1] in UNSEEN:
                j += 1
            yield l_, c, r, near(t[i - 1]) if i else " ", near(t[j + 1]) if j + 1 < n else " "
        else:
            yield l_, c, r


_ALPHABET = re.compile(rf"[\x00-\x7f{LETTERS}{SIGNS}]*")


def plausible(t: str) -> bool:
    """Whether all characters, and all neighbours above U+007F, are the language's: only such rows are counted."""
    if _ALPHABET.fullmatch(t) is None:
        return False
    return all(len(r) == 1 or all(NEIGHBOURS.fullmatch(r[i : i + 2]) for i in range(len(r) - 1)) for r in RUN.findall(t))


def profile(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Counts over all plausible rows: (a, b, c, n) of characters with their neighbours and (word, n) of words with letters above U+007F.

    The first is bounded by the alphabet; the second grows with the vocabulary and stays a table.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, words = Counter(), Counter()

        def counted() -> pd.DataFrame:
            rows = [("c", *k, n) for k, n in chars.items()] + [("w", k, None, None, n) for k, n in words.items()]
            return pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n"])

        for p in it:
            for t in p.iloc[:, 0]:
                if t and plausible(t):
                    chars.update(triples(t))
                    words.update(x for x in WORD.findall(t) if not x.isascii())
            if len(words) > 500_000:
                yield counted()
                chars.clear(), words.clear()
        yield counted()

    got = df.select(text_col).mapInPandas(run, "kind string, a string, b string, c string, n long")
    got = materialize(got.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")), "p3-profile")
    return got.where("kind = 'c'").select("a", "b", "c", "n"), got.where("kind = 'w'").select(F.col("a").alias("word"), "n")


class _Gains(dict):
    """word (between two spaces) -> what its characters can gain in garbled states: it depends on the word alone."""

    def __init__(self, of: "Model"):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> float:
        g = 0.0 if word.isascii() else sum(self.of.emission(k)[1] for k in seen_triples(f" {word} "))
        if len(word) <= 40:
            if len(self) > 300_000:
                self.clear()
            self[word] = g
        return g

    def __reduce__(self):
        return (_Gains, (self.of,))


class Model:
    """Emissions, Viterbi labels and inverse transforms."""

    def __init__(self, clean: list[tuple[str, str, str, int]]):
        counts = {s: Counter() for s in STATES}
        base = Counter({(a, b, c): n for a, b, c, n in clean})
        for x in LETTERS + SIGNS:  # unseen letters and signs are as good as seen once
            base["a", x, "a"] += 0.5
        counts["clean"] = base
        self.back: dict[str, dict[str, str]] = {}
        for s, f in PAIRS.items():
            look = {c: f(c) for c in {k[1] for k in base} | {k[0] for k in base if k[0] > "\x7f"} | {k[2] for k in base if k[2] > "\x7f"}}
            for (a, b, c), n in base.items():
                g = look.get(b)
                if not g:
                    continue
                l_ = near((look.get(a) or a)[-1]) if a > "\x7f" else a
                r = near((look.get(c) or c)[0]) if c > "\x7f" else c
                for i, x in enumerate(g):
                    if x > "\x7f":
                        counts[s][near(g[i - 1]) if i else l_, x, near(g[i + 1]) if i + 1 < len(g) else r] += n
            inverse: dict[str, str] = {}
            for c in REPERTOIRE:
                g = f(c)
                if g and g != c and (g not in inverse or (c in LETTERS + SIGNS and inverse[g] not in LETTERS + SIGNS)):
                    inverse[g] = c
            if s.startswith("utf-8>"):
                inverse |= {g.replace("\xa0", " "): c for g, c in inverse.items() if "\xa0" in g}
            self.back[s] = inverse
        self.counts, self.uni, self.total = counts, {}, {}
        for s in STATES:
            u = Counter()
            for (_, b, _), n in counts[s].items():
                u[b] += n
            self.uni[s], self.total[s] = u, sum(u.values()) or 1
        self.find = {s: re.compile("|".join(map(re.escape, sorted(m, key=len, reverse=True)))) for s, m in self.back.items()}
        #: Forms of several characters: they are no text of their own anywhere in a row that has the state.
        self.wide = {s: re.compile("|".join(map(re.escape, sorted((g for g in m if len(g) > 1 and " " not in g), key=len, reverse=True)))) for s, m in self.back.items() if s.startswith("utf-8>")}
        self.memo: dict[tuple[str, ...], tuple[list[float], float]] = {}
        self.gains = _Gains(self)
        behind = Counter()
        for (a, b, c), n in base.items():
            if a == "0" and not c.isalpha():
                behind[b] += n
        #: What stands behind a number most often: an ordinal sign.
        self.behind_number = max(behind, key=lambda c: (behind[c], c), default=LOST)

    def emission(self, k: tuple[str, ...]) -> tuple[list[float], float]:
        """Log probability in each state, and what the best garbled state gains over the clean one (0 at least)."""
        got = self.memo.get(k)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            e = []
            for s in STATES[:-1]:
                n, u = self.total[s], self.uni[s].get(k[1], 0) / self.total[s]
                if s != "clean":
                    e.append(math.log((self.counts[s].get(k[:3], 0) + SMOOTH * (NEW_GARBLED * u + 1e-12)) / (n + SMOOTH)))
                elif k[1] in UNSEEN:
                    e.append(math.log(RARE))
                elif k[1] == "\xa0":  # a space like any other
                    e.append(math.log(RARE * 10))
                else:
                    e.append(math.log((self.counts[s].get((k[3], k[1], k[4]) if len(k) > 3 else k, 0) + SMOOTH * NEW_CLEAN * max(u, RARE)) / (n + SMOOTH)))
            e.append(0.0 if k[1] == LOST else -60.0)
            if k[1] == LOST:
                e[0] = -60.0
            got = self.memo[k] = (e, max(0.0, max(e[1:]) - e[0]))
        return got

    def labels(self, t: str) -> list[tuple[int, int]]:
        """(position, state) of every character above U+007F, by Viterbi; [] when all are clean."""
        if sum(map(self.gains.__getitem__, t.split(" "))) <= -ENTER:
            return []
        ks = [(m.start(), k) for m, k in zip(NON_ASCII.finditer(t), seen_triples(t))]
        es = [self.emission(k) for _, k in ks]
        size = len(STATES)
        score = [0.0 if s == 0 else ENTER for s in range(size)]
        back = []
        first = True
        for e, _ in es:
            if not first:
                best = max(range(1, size), key=score.__getitem__)
                into_clean, from_clean = score[best] + LEAVE, score[0] + ENTER
                new, come = [], []
                for s in range(size):
                    stay = score[s]
                    if s == 0:
                        v, o = (stay, 0) if stay >= into_clean else (into_clean, best)
                    else:
                        v, o = (stay, s) if stay >= from_clean else (from_clean, 0)
                        if best != s and score[best] + LEAVE + ENTER > v:
                            v, o = score[best] + LEAVE + ENTER, best
                    new.append(v)
                    come.append(o)
                score = new
                back.append(come)
            first = False
            score = [v + x for v, x in zip(score, e)]
        s = max(range(size), key=lambda i: (score[i], -i))
        path = [s]
        for come in reversed(back):
            s = come[s]
            path.append(s)
        path.reverse()
        return [(p, s) for (p, _), s in zip(ks, path)] if any(path) else []

    def joined(self, t: str, labels: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """A rare character between two spans of one state belongs to them: the state's rare forms were not counted."""
        out, last = list(labels), -1
        for i, (p, s) in enumerate(labels):
            if s:
                if last >= 0 and labels[last][1] == s and all(t[q] not in LETTERS for q, _ in labels[last + 1 : i]):
                    for j in range(last + 1, i):
                        out[j] = (labels[j][0], s)
                last = i
        return out

    def restore(self, t: str) -> tuple[str, list[str]]:
        """The restored text and the states found in it; replaced characters are left to fill().

        Inverse transforms can uncover another layer, so it goes on until none is found, or a text comes again.
        """
        found: list[str] = []
        seen: set[str] = set()
        while t not in seen:
            seen.add(t)
            labels = self.joined(t, self.labels(t))
            if not labels:
                break
            out, at, i, changed = [], 0, 0, False
            while i < len(labels):
                s = labels[i][1]
                j = i
                while j + 1 < len(labels) and labels[j + 1][1] == s:
                    j += 1
                if s:
                    name = STATES[s]
                    found.append(name)
                    lo, hi = labels[i][0], labels[j][0] + 1
                    if name == "replaced":
                        span = t[lo:hi]
                        if t[lo - 1 : lo].isdigit() and not t[hi : hi + 1].isalpha() and set(span) == {LOST} and len(span) < 3:
                            span = self.behind_number
                    else:
                        if hi < len(t) and t[hi] == " ":
                            hi += 1
                        span = self.find[name].sub(lambda m: self.back[name][m.group()], t[lo:hi])
                        if t[hi - 1 : hi] == " " and not span.endswith(" ") and t[lo:hi].strip() == span:
                            span += " "
                    changed |= span != t[lo:hi]
                    out += [t[at:lo], span]
                    at = hi
                i = j + 1
            out.append(t[at:])
            t = "".join(out)
            if not changed:
                break
            for name in {STATES[s] for _, s in labels if STATES[s] in self.wide}:
                t = self.wide[name].sub(lambda m: self.back[name][m.group()], t)
        return t, list(dict.fromkeys(found))


LOST_WORD = re.compile(rf"[\w{LOST}-]*{LOST}[\w{LOST}-]*")


def readings(w: str) -> Iterator[tuple[str, Callable[[str], str]]]:
    """The forms under which a word with replaced characters may be known, with what makes the known word stand in its place."""
    yield w, str
    yield w.lower(), str.upper if w.isupper() else str.capitalize if w[:1].isupper() else str
    yield w.capitalize(), str


def filled(t: str, known: dict[str, str]) -> str:
    """The text with its replaced characters restored by the known words: whole words, else the parts between hyphens."""

    def one(w: str) -> str | None:
        return next((f(known[k]) for k, f in readings(w) if k in known), None)

    def word(m: re.Match) -> str:
        return one(m.group()) or "".join(one(x) or x for x in re.split("(-)", m.group()))

    return LOST_WORD.sub(word, t) if known else t


def fill(restored: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """The rows with replaced characters restored from the vocabulary (word, n): the most frequent word that has letters above U+007F in just those places.

    Only the forms that occur are looked up, by a join; rows without a replaced character pass as they are.
    """
    kind = restored.schema[id_col].dataType.simpleString()

    def forms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            got = [(i, k) for i, t in zip(p[id_col], p[text_col]) for k in {k for w in LOST_WORD.findall(t) for x in (w, *w.split("-")) if LOST in x for k, _ in readings(x)}]
            yield pd.DataFrame(got, columns=[id_col, "key"])

    def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            p[text_col] = [filled(t, {x["key"]: x["word"] for x in k}) if k is not None else t for t, k in zip(p[text_col], p["known"])]
            yield p.drop(columns="known")

    has = F.coalesce(F.contains(F.col(text_col), F.lit(LOST)), F.lit(False))
    some = restored.where(has)
    need = some.select(id_col, text_col).mapInPandas(forms, f"{id_col} {kind}, key string").distinct()
    ways = [F.regexp_replace("word", r"[^\x00-\x7f]", x) for x in (LOST, LOST * 2)]
    known = words.select("word", "n", F.explode(F.array(*ways)).alias("key")).join(need.select("key").distinct(), "key", "left_semi")
    known = known.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    of = need.join(known, "key").groupBy(id_col).agg(F.collect_list(F.struct("key", "word")).alias("known"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in restored.schema)
    return restored.where(~has).unionByName(some.join(of, id_col, "left").mapInPandas(apply, fields))


def model(df: DataFrame, text_col: str) -> tuple[Model, DataFrame]:
    """The model of all rows of `df`, whose tables are bounded by the alphabet, and the words (word, n) that restore replaced characters."""
    chars, words = profile(df, text_col)
    return Model([tuple(r) for r in chars.collect()]), words


def labelled(df: DataFrame, id_col: str, text_col: str, of: Model) -> DataFrame:
    """(id, restored, states): every text with its garbled spans restored, replaced characters aside; `states` is empty for a clean text. Map-only."""
    m = df.sparkSession.sparkContext.broadcast(of)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            got = [m.value.restore(t) if t else (t, []) for t in p[text_col]]
            yield pd.DataFrame({id_col: p[id_col], "restored": [g[0] for g in got], "states": [g[1] for g in got]})

    src = df.select(id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, f"{id_col} {kind}, restored string, states array<string>")


def repair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, states) of every text, its replaced characters restored from the vocabulary."""
    m, words = model(df, text_col)
    return fill(materialize(labelled(df, id_col, text_col, m), "p3-labelled"), id_col, "restored", words)


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id) of the texts with a garbled span."""
    m, _ = model(df, text_col)
    return labelled(df, id_col, text_col, m).where("size(states) > 0").select(id_col)
