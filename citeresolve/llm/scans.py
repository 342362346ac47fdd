"""Problem 2: repair text read from scanned pages into continuous paragraphs.

Method: a vocabulary is counted over all rows. For a word outside it, and for a word that a far more frequent one could
be misread as, a Levenshtein automaton of the word - any edit of a character, and the cheaper ones readers of page images make,
letter groups like rn/m included - is intersected with a trie of the vocabulary, which retrieves every
candidate within the budget. Candidates are ranked by misreading cost and frequency and accepted in context: one of
the two neighbours must be known beside the candidate. Where the usual confusions give nothing for a word of no
vocabulary, one edit of any kind (a character lost, one too many, another one) is allowed besides them, and both neighbours must
be known beside the candidate. In rows with other traces a short word is also corrected if it is unknown beside both of its neighbours and a
look-alike is known beside both. Then page furniture is removed, words cut at line ends are put
together and the lines are reflowed.

Page furniture: a line that is a page number, or a short one (5 to 90 characters) that begins like lines that stand beside page
numbers all over the corpus (running headers). Words cut at a line end: the joined form is a word and the form with a hyphen isn't.

Only rows with such a trace are rewritten; line breaks between whole words are no trace.

Nothing that grows with the corpus is held by one machine. Words, word pairs and line beginnings are counted into tables.
The trie is cut into shards by the words' first letters, of at most SHARD words; the automaton of a word is first run over the
trie of those beginnings, which tells the shards it can end in, and then in each of them. Each text's words are joined to what is known
of them, and then to the word pairs that its candidates need; only the TOP_WORDS most frequent words, which need no
correction, are held by every worker, so that few words have to be looked up.

The statistics hold every word that occurs twice, every word pair that occurs three times and every line beginning that
occurs four times. The occurrence in question is no evidence for a word, so its own count is that of its other occurrences; one
occurrence counts as none. Every distinct word is looked up whatever its length, and every vocabulary word can be a candidate.

Defined results: null stays null and has no trace; empty and blank texts have none; ties between candidates go to the
more frequent, then the smaller word; rows delivered repeatedly count once, in the statistics too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import ChainMap, Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeresolve.llm import mojibake, unify
from citeresolve.llm.rows import once, pieces
from citeresolve.session import materialize

#: Occurrences from which a word is of the vocabulary and a pair is known.
KNOWN = 3
#: A line beginning is a running header's if it stands beside page numbers in at least this share of its occurrences, as a lower bound of two standard errors.
HEAD_SHARE = 0.4
#: A word this many times as frequent is what a rarer look-alike was meant to be, where the context agrees.
RATIO = 20
#: Misreadings of page images (fixed values): what was printed -> what is read, with its cost.
CONFUSED = {
    0.5: "a:o o:a e:c c:e t:f f:t n:u u:n l:i i:l l:1 i:1 o:0 s:5 g:9 b:8 z:2 g:q q:g ç:q í:i í:l ã:à á:a é:e é:6 ê:e ó:o v:y y:v h:b b:h 0:o 1:l 1:i 5:s 8:b 6:b 9:g 2:z d:a à:ã â:á á:à ú:u õ:ò i:f í:f l:t t:l g:y i:í l:í í:1 ó:0 ô:0 õ:0",
    0.6: "m:rn n:ri d:cl u:ii h:li w:vv rn:m ri:n cl:d m:ni m:iri n:il ê:è",
}
EDIT = 1.0
#: Most frequent trusted words, and running headers, that every worker holds; any other word or header is looked up by a join.
TOP_WORDS, TOP_HEADS = 200_000, 50_000
#: Words in a shard of the vocabulary trie, and words looked up in it by one task.
SHARD, LOOKUPS = 50_000, 2_000
HYPHENS = "-‐¬\xad"
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
CUT = re.compile(rf"([^\W_]+)([{HYPHENS}])[ \t]*((?:\r?\n|\f)[\s\f]*)([^\W_]+)")
LINE = re.compile(r"\r?\n|\f")
D = r"[0-9OoIlSB]{1,4}"
PAGE = re.compile(rf"^(?:[-–—\[(]\s*)?(?:(?:p|p[aá]g|p[aá]gina|fl|fls|folha)\s?\.?\s*)?(?=\S*[0-9])?{D}(?:\s*(?:/|de)\s*{D})?(?:\s*[-–—\])])?$", re.I)
PAGE_END = re.compile(rf"\s{{2,}}(?:[-–—\[(]\s*)?(?:(?:p|p[aá]g|p[aá]gina|fl|fls|folha)\s?\.?\s*)?{D}(?:\s*(?:/|de)\s*{D})?(?:\s*[-–—\])])?$", re.I)
ROMAN = re.compile(r"(?=[ivxlc]{2,7}$)(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
ITEM = re.compile(r"^\s*(?:\d{1,2}[.)]|[a-z]\)|[-•*–—])\s")
NUMBER = re.compile(r"(?<![^\W_])(?=[\dOolISB.,/-]*\d[\dOolISB.,/-]*\d)(?=[\dOolISB.,/-]*[OolISB])[\dOolISB](?:[\dOolISB]|[.,/-](?=[\dOolISB]))+(?![^\W_])")
AS_DIGITS = str.maketrans("OolISB", "001158")

_SINGLE, _SEVERAL = unify.forms()
_FORMS = str.maketrans(_SINGLE | _SEVERAL)
_INVISIBLE = re.compile("[͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\xad]")


_STABLE = re.compile("[\x01-\x7f\xa1-\xac\xae-\xb4\xb6-\xff\u2013\u2014\u2018\u2019\u201c\u201d\u20ac]*")
_CUT_END = re.compile(rf"[{HYPHENS}][ \t]*[\r\n\f]")


def plain(t: str) -> str:
    """The common form of a text (problem 1); a soft hyphen at a line end shows as a hyphen there."""
    if t.isascii() or _STABLE.fullmatch(t):
        return t
    t = re.sub(r"\xad(?=[ \t]*[\r\n\f])", "-", t)
    return unicodedata.normalize("NFC", _INVISIBLE.sub("", t).translate(_FORMS))


@lru_cache(100_000)
def fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))


def is_page(line: str) -> bool:
    s = line.strip()
    if ROMAN.fullmatch(s):
        return True
    return len(s) <= 24 and any(c.isdigit() for c in s) and PAGE.match(s) is not None


def head(line: str) -> str | None:
    """The first three words of a short line, numbers aside: what running headers are known by."""
    s = line.strip()
    if not 5 <= len(s) <= 90:
        return None
    w = [fold(m.group()) for m in islice(WORD.finditer(s), 6) if m.group().isalpha()][:3]
    return " ".join(w) if len(w) >= 2 else None


class Counts:
    """Statistics of rows."""

    def __init__(self):
        self.words, self.pairs, self.heads, self.at_page, self.n = Counter(), Counter(), Counter(), Counter(), 0

    def add(self, t: str) -> None:
        low = (CUT.sub(lambda m: " ", t) if _CUT_END.search(t) else t).lower()
        w = WORD.findall(low)
        self.n += len(w)
        self.words.update(w)
        if "-" in low:
            self.words.update(c for x in low.split() if "-" in x for c in COMPOUND.findall(x))
        self.pairs.update(zip(w, w[1:]))
        lines = LINE.split(t)
        if len(lines) > 1:
            page = [is_page(x) for x in lines]
            for i, x in enumerate(lines):
                h = head(x)
                if h and x.lstrip()[0].isupper():
                    self.heads[h] += 1
                    if (i and page[i - 1]) or (i + 1 < len(lines) and page[i + 1]) or PAGE_END.search(x.rstrip()):
                        self.at_page[h] += 1

    def rows(self) -> Iterator[tuple]:
        # numbers of more than four digits are no vocabulary
        for k, n in self.words.items():
            if len(k) < 5 or not k.isdigit():
                yield ("w", k, None, n, 0)
        for (a, b), n in self.pairs.items():
            if (len(a) < 5 or not a.isdigit()) and (len(b) < 5 or not b.isdigit()):
                yield ("p", a, b, n, 0)
        for h, n in self.heads.items():
            yield ("h", h, None, n, self.at_page[h])


def statistics(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n, at_page) counted over all rows (id, t); counted per partition first, so little is shuffled."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, columns = Counts(), ["kind", "a", "b", "n", "at_page"]
        for p in it:
            for t in p["t"]:
                if t:
                    c.add(t)
                if len(c.pairs) > 500_000:
                    yield from pieces(c.rows(), columns)
                    c = Counts()
        yield from pieces(c.rows(), columns)

    s = texts.select("t").mapInPandas(run, "kind string, a string, b string, n long, at_page long")
    s = s.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("at_page").alias("at_page"))
    n, p = F.col("n"), F.col("at_page") / F.col("n")
    header = (n >= 4) & ((p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n) >= HEAD_SHARE)
    return s.where(F.when(F.col("kind") == "w", F.col("n") >= 2).when(F.col("kind") == "p", F.col("n") >= KNOWN).otherwise(header))


class Trie:
    """Words as nested dicts; the key "" holds the word that ends there."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w


def _confusions() -> dict[str, list[tuple[str, str, float]]]:
    """First printed character -> (rest of the printed group, what is read, cost)."""
    out: dict[str, list[tuple[str, str, float]]] = {}
    for cost, pairs in CONFUSED.items():
        for p in pairs.split():
            a, b = p.split(":")
            out.setdefault(a[0], []).append((a[1:], b, cost))
    return out


CONFUSIONS = _confusions()


def advance(states: dict, waits: tuple, x: str, word: str, edits: int, budget: float) -> tuple[dict, tuple]:
    """The automaton of `word` after reading the character `x` of a vocabulary word.

    A state is (position in word, edits left) -> cost; waits are printed groups still to be completed: (rest, position, edits left, cost).
    """
    n = len(word)
    new: dict[tuple[int, int], float] = {}
    later = []

    def put(k, v):
        if v <= budget and v < new.get(k, 9.0):
            new[k] = v

    for (p, e), v in states.items():
        if p < n and word[p] == x:
            put((p + 1, e), v)
        for rest, read, cost in CONFUSIONS.get(x, ()):
            if v + cost <= budget and word.startswith(read, p):
                if rest:
                    later.append((rest, p + len(read), e, v + cost))
                else:
                    put((p + len(read), e), v + cost)
        if e:
            if p < n:
                put((p + 1, e - 1), v + EDIT)
            put((p, e - 1), v + EDIT)
    for rest, p, e, v in waits:
        if rest[0] == x:
            if len(rest) > 1:
                later.append((rest[1:], p, e, v))
            else:
                put((p, e), v)
    for _ in range(edits):  # a character too many was read
        for (p, e), v in list(new.items()):
            if e and p < n:
                put((p + 1, e - 1), v + EDIT)
    return new, tuple(later)


def intersect(root: dict, word: str, edits: int) -> Iterator[tuple[str, dict]]:
    """(entry, states) of every entry of a trie that the automaton of `word` is still alive at."""
    n = len(word)
    budget = min(3.0, max(0.6, 0.34 * n))
    first = {(k, edits - k): k * EDIT for k in range(min(edits, n) + 1) if k * EDIT <= budget}
    stack = [(root, first, ())]
    while stack:
        node, states, waits = stack.pop()
        if "" in node:
            yield node[""], states
        for x, child in node.items():
            if x:
                new, later = advance(states, waits, x, word, edits, budget)
                if new or later:
                    stack.append((child, new, later))


def accepting(root: dict, word: str, edits: int) -> Iterator[tuple[str, list[float | None]]]:
    """Every other word of the trie that the automaton accepts within its budget, with its least cost by the edits used besides the confusions."""
    n = len(word)
    for w, states in intersect(root, word, edits):
        if w != word:
            cost: list[float | None] = [None] * (edits + 1)
            for (p, e), v in states.items():
                used = edits - e
                if p == n and (cost[used] is None or v < cost[used]):
                    cost[used] = v
            if any(c is not None for c in cost):
                yield w, cost


def accepted(root: dict, word: str, edits: int) -> dict[str, list[float | None]]:
    """The words that accepting() gives, each with its costs."""
    return dict(accepting(root, word, edits))


class _Fine(dict):
    """word (lower case) -> whether it needs no correction."""

    def __init__(self, of: "Reader"):
        super().__init__()
        self.of = of

    def __missing__(self, k: str) -> bool:
        self[k] = got = simple(k) or self.of.trusted(k)
        return got


def simple(k: str) -> bool:
    """Numbers and single letters are no words to correct."""
    return k.isdigit() or len(k) == 1 and k.isalpha()


class Short:
    """The trusted words of up to three letters, and which of them each may be misread for: as many as the alphabet allows."""

    def __init__(self, words: Iterable[str]):
        self.trie = Trie(w for w in words if len(w) <= 3 and w.isalpha())
        self.memo: dict[str, list[str]] = {}

    def options(self, word: str) -> list[str]:
        if len(word) > 3 or not word.isalpha():
            return []
        got = self.memo.get(word)
        if got is None:
            got = self.memo[word] = [w for _, w in sorted((c[0], w) for w, c in accepted(self.trie.root, word, 0).items())]
        return got


class Reader:
    """Corrections, traces and repair of a text by what is known of its words.

    `count`: words with their counts; `sure`: whether a word is trusted, where it is known; `options`: word -> [(word, cost by the edits used)];
    `pairs`: counts of word pairs; `heads`: beginnings of running headers. With a `trie`, what is not given is found in it.
    """

    def __init__(self, count: dict[str, int], pairs: dict[tuple[str, str], int], heads: set[str], sure: dict[str, bool] | None = None, options: dict[str, dict] | None = None, trie: Trie | None = None, short: Short | None = None):
        self.short = short or Short(())
        self.count, self.pairs, self.heads, self.trie = count, pairs, heads, trie
        self.sure, self.options = sure or {}, options or {}
        self.fine = _Fine(self)

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> "Reader":
        """All of a small corpus in memory, from rows of statistics()."""
        rows = list(rows)
        count = {a: n for k, a, _, n, _ in rows if k == "w"}
        trie = Trie(w for w, n in count.items() if n >= KNOWN and "-" not in w)
        out = cls(count, {(a, b): n for k, a, b, n, _ in rows if k == "p"}, {a for k, a, _, _, _ in rows if k == "h"}, trie=trie)
        out.short = Short(w for w in count if len(w) <= 3 and out.trusted(w))
        return out

    def candidates(self, word: str, edits: int = 0) -> list[tuple[float, str]]:
        """(cost, word) of every word of the vocabulary the automaton of `word` accepts within its budget, best first.

        `edits`: how many edits besides the confusions - a character lost, one too many, one for another - it allows.
        """
        got = self.options.get(word)
        if got is None:
            if self.trie is None:
                return []
            got = self.options[word] = accepted(self.trie.root, word, 1)
        out = [(min(c for c in costs[: edits + 1] if c is not None), w) for w, costs in got.items() if any(c is not None for c in costs[: edits + 1])]
        return sorted(out, key=lambda x: (x[0], -self.count[x[1]], x[1]))

    def trusted(self, word: str) -> bool:
        """Whether `word` is of the vocabulary and no far more frequent word may have been misread as it."""
        got = self.sure.get(word)
        if got is None:
            n = self.count.get(word, 0)
            got = self.sure[word] = n >= KNOWN and (word.isdigit() or not any(self.count[v] >= RATIO * n for _, v in self.candidates(word)))
        return got

    def correction(self, word: str, before: str, after: str) -> str | None:
        """What `word` (lower case) was printed as, if it is a misreading."""
        own = max(0, self.count.get(word, 0) - 1)
        score, best = None, None
        for cost, w in self.candidates(word):
            n = self.count[w]
            if n < RATIO * own or not self.trusted(w):  # a frequent misreading is no correction
                continue
            near = self.pairs.get((before, w), 0) + self.pairs.get((w, after), 0)
            if not near and not (cost <= 1.3 and n >= max(RATIO, 300 * own) and len(word) >= 5) and not (cost <= 0.6 and n >= RATIO and not self.trusted(before) and not self.trusted(after)):
                continue
            s = (-cost * 6 + (2.0 if near else 0.0) + 0.25 * min(8, near.bit_length()) + 0.1 * n.bit_length(), w)
            if score is None or s > score:
                score, best = s, w
        return best or self.edited(word, before, after, own)

    def edited(self, word: str, before: str, after: str, own: int) -> str | None:
        """The same by candidates with other edits than the confusions, for a word of no vocabulary: known beside both of its neighbours.

        The first and the last word of a text have one neighbour only and may be cut, so they aren't corrected so.
        """
        if own + 1 >= KNOWN:
            return None
        best = None
        for cost, w in self.candidates(word, 1):
            n = self.count[w]
            if n < RATIO * max(1, own) or not self.trusted(w):
                continue
            l, r = self.pairs.get((before, w), 0), self.pairs.get((w, after), 0)
            if l and r:
                s = (-cost * 6 + 0.25 * min(8, (l + r).bit_length()) + 0.1 * n.bit_length(), w)
                best = s if best is None or s > best else best
        return best and best[1]

    def evidence(self, t: str) -> set[tuple[str, str]]:
        """The word pairs whose counts decide the corrections of a text."""
        words = WORD.findall(self.joined(self.body(t)).lower())
        out: set[tuple[str, str]] = set()
        before = {""}
        for i, k in enumerate(words):
            now = {k}
            for w in self.short.options(k):
                after = words[i + 1] if i + 1 < len(words) else ""
                out |= {(b, x) for b in before for x in (k, w)} | {(x, after) for x in (k, w)}
                now.add(w)
            if not self.fine[k]:
                after = words[i + 1] if i + 1 < len(words) else ""
                for _, w in self.candidates(k, 1):
                    out |= {(b, w) for b in before} | {(w, after)}
                    now.add(w)
            before = now
        return out

    def cut(self, left: str, right: str, sign: str) -> str | None:
        """Of a word over a line end: the joined word, "-" for a compound with its own hyphen, None if it is neither."""
        a, b = left.lower(), right.lower()
        joined, compound = self.count.get(a + b, 0), self.count.get(f"{a}-{b}", 0)
        if joined > compound:
            return left + right
        if compound:
            return "-"
        if sign in "¬\xad":
            return left + right
        if a.isdigit() or b.isdigit():
            return None
        if (a not in self.count or b not in self.count) and (self.candidates(a + b) or a not in self.count and b not in self.count):
            return left + right
        return "-" if a in self.count and b in self.count else left + right

    def furniture(self, line: str) -> bool:
        if is_page(line):
            return True
        return head(line) in self.heads

    def body(self, t: str) -> str:
        """The text without page furniture."""
        lines = LINE.split(t)
        body = [x for x in lines if not self.furniture(x)]
        return t if len(body) == len(lines) else "\n".join(body)

    def traces(self, t: str) -> list[str]:
        """The kinds of traces in a text of the common form."""
        out = []
        body = self.body(t)
        if body is not t:
            out.append("furniture")
            t = body
        if _CUT_END.search(t) and any(self.cut(m[1], m[4], m[2]) not in (None, "-") for m in CUT.finditer(t)):
            out.append("cut")
        if self.fixed(self.joined(t))[1]:
            out.append("misread")
        return out

    def joined(self, t: str) -> str:
        def one(m: re.Match) -> str:
            c = self.cut(m[1], m[4], m[2])
            return m[0] if c is None else f"{m[1]}-{m[4]}" if c == "-" else c

        return CUT.sub(one, CUT.sub(one, t)) if _CUT_END.search(t) else t

    def fixed(self, t: str) -> tuple[str, int]:
        """Misread words and numbers corrected, and how many there were."""
        if all(map(self.fine.__getitem__, set(WORD.findall(t.lower())))):
            return t, 0
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
        low = [w.lower() for _, _, w in words]
        out, at, n = [], 0, 0
        for i, (s, e, w) in enumerate(words):
            k = low[i]
            if self.fine[k]:
                continue
            if any(c.isdigit() for c in k) and any(c in "olisb" for c in k) and NUMBER.fullmatch(w) and sum(c.isdigit() for c in k) >= 2 and k not in self.count:
                c = w.translate(AS_DIGITS)
            else:
                c = self.correction(k, low[i - 1] if i else "", low[i + 1] if i + 1 < len(low) else "")
                if c is None:
                    continue
                low[i] = c
                c = c.upper() if w.isupper() and len(w) > 1 else c.capitalize() if w[0].isupper() else c
            out += [t[at:s], c]
            at = e
            n += 1
        out.append(t[at:])
        return "".join(out), n

    def repair(self, t: str) -> tuple[str, list[str]]:
        """The text as continuous paragraphs and the traces found; a text without a trace stays as it is."""
        kinds = self.traces(t)
        if not kinds:
            return t, kinds
        lines = LINE.split(t)
        kept: list[str] = []
        for x in lines:
            if self.furniture(x):
                while kept and kept[-1] == "" and len(kept) > 1 and kept[-2] == "":
                    kept.pop()
                continue
            kept.append(x.rstrip())
        t = self.joined("\n".join(kept))
        widths = sorted(len(x) for x in t.split("\n") if x.strip())
        wide = widths[int(len(widths) * 0.9)] if widths else 0
        out: list[str] = []
        for x in t.split("\n"):
            s = x.strip()
            if not s:
                out.append("")
            elif len(out) > 1 and not out[-1] and s[0].islower() and out[-2] and out[-2][-1] not in ".!?:;" and not out[-2].isupper() and not ITEM.match(s):
                del out[-1]  # a page break within a sentence
                out[-1] += " " + s
            elif out and out[-1] and not ITEM.match(s) and not out[-1].endswith(":") and not (out[-1].isupper() and not s.isupper()) and (len(out[-1].rsplit("\n", 1)[-1]) > 0.5 * wide or s[0].islower() or not out[-1].endswith((".", "!", "?"))):
                out[-1] += " " + s
            else:
                out.append(s)
        t = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")
        return self.in_context(self.fixed(t)[0]), kinds

    def in_context(self, t: str) -> str:
        """Short words misread as other words corrected: unknown beside both of their neighbours, where the look-alike is known beside both."""
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
        low = [w.lower() for _, _, w in words]
        out, at = [], 0
        for i in range(1, len(words) - 1):
            s, e, w = words[i]
            b, k, a = low[i - 1 : i + 2]
            options = self.short.options(k)
            if options and (b, k) not in self.pairs and (k, a) not in self.pairs:
                c = next((x for x in options if (b, x) in self.pairs and (x, a) in self.pairs), None)
                if c is not None:
                    low[i] = c
                    out += [t[at:s], c.upper() if w.isupper() and len(w) > 1 else c.capitalize() if w[0].isupper() else c]
                    at = e
        return "".join(out) + t[at:]


_BREAK = re.compile(rf"([^\W_]+)[{HYPHENS}][ \t]*(?:\r?\n|\f)[\s\f]*(?=([^\W_]+))")


def cut_words(t: str) -> set[str]:
    """The words that decide about the words cut at line ends: the parts, joined and with a hyphen, of up to four in a row (what two passes of joining can make)."""
    if not _CUT_END.search(t):
        return set()
    chains: list[list[str]] = []
    at = -1
    for m in _BREAK.finditer(t.lower()):
        if m.start() == at:
            chains[-1].append(m[2])
        else:
            chains.append([m[1], m[2]])
        at = m.end()
    out: set[str] = set()
    for c in chains:
        runs = [(i, j) for i in range(len(c)) for j in range(i + 1, min(i + 4, len(c)) + 1)]
        out |= {"".join(c[i:j]) for i, j in runs}
        out |= {f"{''.join(c[i:k])}-{''.join(c[k:j])}" for i, j in runs for k in range(i + 1, j)}
    return out


def shards(words: DataFrame) -> list[str]:
    """Beginnings that part the words (word) into shards of at most SHARD: three letters, and longer ones where more words have them."""
    out: list[str] = []
    n, rest = 3, words.select("word")
    while True:
        c = rest.groupBy(F.substring("word", 1, n).alias("p")).agg(F.count("*").alias("n"), F.max(F.length("word")).alias("longest"))
        got = c.collect()  # as many as beginnings of n letters, each of which, above three letters, has more than SHARD words
        big = [r["p"] for r in got if r["n"] > SHARD and r["longest"] > n]
        out += [r["p"] for r in got if not (r["n"] > SHARD and r["longest"] > n)]
        if not big:
            return out
        rest = rest.where(F.substring("word", 1, n).isin(big))
        n += 1


def answers(rows: Iterable[tuple], search: Callable[[dict, dict[str, int], str, int], Iterator[tuple]]) -> Iterator[tuple]:
    """What `search` gives for the queries among rows (shard, asked, word, n) that come by shard and salt, the vocabulary before the queries: one trie at a time."""
    at, count, root = None, {}, None
    for shard, asked, w, n in rows:
        if shard != at:
            at, count, root = shard, {}, None
        if not asked:
            if root is None:  # the next salt has the same vocabulary
                count[w] = n
        else:
            if root is None:
                root = Trie(count).root
            yield from search(root, count, w, n)


def searched(queries: DataFrame, words: DataFrame, edits: int, search: Callable[[dict, dict[str, int], str, int], Iterator[tuple]], schema: str) -> tuple[DataFrame, int]:
    """What `search` gives for each query (word, n) in each shard of the vocabulary (word, n) that its automaton can end in, and the number of shards.

    Beginnings are packed into shards. A task reads its vocabulary and queries one after the other and returns its answers in
    pieces, so that neither depends on how many there are.
    """
    spark = queries.sparkSession
    heads = shards(words)
    n_words, n_queries = words.count(), queries.count()
    parts = max(1, -(-2 * n_words // SHARD))
    salts = max(1, -(-n_queries // (LOOKUPS * parts)))
    shard_of = {p: k % parts for k, p in enumerate(sorted(heads))}
    longest = max(map(len, heads), default=0)
    shared = spark.sparkContext.broadcast((shard_of, longest))
    columns = [x.split()[0] for x in schema.split(", ")]

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value[0]
        root = Trie(of).root
        for p in it:
            yield from pieces(((w, n, k) for w, n in zip(p["word"], p["n"]) for k in ({of[h] for h, _ in intersect(root, w, edits)} | ({of[h] for h in waiting(root, w, edits)}) if parts > 1 else {0})), ["word", "n", "shard"])

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, most = shared.value
        for p in it:
            p["shard"] = [next(of[w[:k]] for k in range(1, most + 1) if w[:k] in of) for w in p["word"]]
            yield p

    def look_up(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for p in it for r in zip(p["shard"], p["asked"], p["word"], p["n"]))
        yield from pieces(answers(rows, search), columns)

    salt = F.pmod(F.xxhash64("word"), F.lit(salts))
    q = queries.select("word", "n").mapInPandas(route, "word string, n long, shard int").withColumn("salt", salt)
    v = words.select("word", "n").mapInPandas(place, "word string, n long, shard int").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    width = max(1, min(parts * salts, 4 * spark.sparkContext.defaultParallelism))
    both = v.withColumn("asked", F.lit(False)).unionByName(q.withColumn("asked", F.lit(True)))
    both = both.repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", "asked")
    return both.select("shard", "asked", "word", "n").mapInPandas(look_up, schema), parts


def retrieve(queries: DataFrame, words: DataFrame, edits: int) -> DataFrame:
    """(word, options): of each query (word) the words of the vocabulary (word, n) its automaton accepts, with their costs by the edits used."""

    def search(root: dict, count: dict[str, int], w: str, _: int) -> Iterator[tuple]:
        got = [{"w": x, "n": count[x], "costs": c} for x, c in accepting(root, w, edits)]
        if got:
            yield w, got

    got, parts = searched(queries.select("word", F.lit(0).cast("long").alias("n")), words, edits, search, f"word string, options {OPTIONS}")
    return got if parts == 1 else got.groupBy("word").agg(F.flatten(F.collect_list("options")).alias("options"))


def overshadowed(vocabulary: DataFrame) -> DataFrame:
    """(word): of a vocabulary (word, n) the words that a RATIO times as frequent one may have been misread as. A word can come several times.

    Only whether there is one is asked, so the first is enough: the look-alikes of a frequent word are many.
    """
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    doubtful = vocabulary.where((F.col("n") * RATIO <= most) & ~F.col("word").rlike("^[0-9]+$"))

    def search(root: dict, count: dict[str, int], w: str, n: int) -> Iterator[tuple]:
        if any(count[x] >= RATIO * n for x, _ in accepting(root, w, 0)):
            yield (w,)

    return searched(doubtful, vocabulary.where(F.col("n") >= RATIO * KNOWN), 0, search, "word string")[0]


OPTIONS = "array<struct<w:string,n:long,costs:array<double>>>"


def waiting(root: dict, word: str, edits: int) -> Iterator[str]:
    """Entries of a trie inside a printed group: the automaton lives on only if the group is completed."""
    n = len(word)
    budget = min(3.0, max(0.6, 0.34 * n))
    first = {(k, edits - k): k * EDIT for k in range(min(edits, n) + 1) if k * EDIT <= budget}
    stack = [(root, first, ())]
    while stack:
        node, states, waits = stack.pop()
        if "" in node and waits:
            yield node[""]
        for x, child in node.items():
            if x:
                new, later = advance(states, waits, x, word, edits, budget)
                if new or later:
                    stack.append((child, new, later))


class Lexicon:
    """What is known of the words of a corpus (id, t): tables, and what every worker holds."""

    def __init__(self, texts: DataFrame, top_words: int = TOP_WORDS, top_heads: int = TOP_HEADS):
        s = materialize(statistics(texts), "p2-counts")
        self.words = s.where("kind = 'w'").select(F.col("a").alias("word"), "n")
        self.pairs = s.where("kind = 'p'").select("a", "b", "n")
        self.heads = s.where("kind = 'h'").select(F.col("a").alias("head"))
        vocabulary = self.words.where((F.col("n") >= KNOWN) & ~F.col("word").contains("-"))
        # a word that a RATIO times as frequent one may have been misread as is not trusted
        self.trusted = materialize(vocabulary.join(overshadowed(vocabulary), "word", "left_anti"), "p2-trusted")
        self.top = {r["word"]: r["n"] for r in self.trusted.orderBy(F.desc("n"), "word").limit(top_words).collect()}
        self.short = Short(r["word"] for r in self.trusted.where("length(word) <= 3").select("word").collect())
        few = self.heads.limit(top_heads + 1).collect()
        #: All headers, if they are few; else None: they are joined to each text.
        self.top_heads = {r["head"] for r in few} if len(few) <= top_heads else None

    def with_heads(self, texts: DataFrame) -> DataFrame:
        """(id, t, heads): the texts with their beginnings of lines that are headers; null where every worker knows them all."""
        if self.top_heads is not None:
            return texts.select("id", "t", F.lit(None).cast("array<string>").alias("heads"))
        kind = texts.schema["id"].dataType.simpleString()

        def beginnings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                yield from pieces(((i, h) for i, t in zip(p["id"], p["t"]) if t for h in {head(x) for x in LINE.split(t)} - {None}), ["id", "head"])

        of = texts.select("id", "t").mapInPandas(beginnings, f"id {kind}, head string").join(self.heads, "head").groupBy("id").agg(F.collect_list("head").alias("heads"))
        return texts.join(of, "id", "left").select("id", "t", F.coalesce("heads", F.array().cast("array<string>")).alias("heads"))


def restored(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): each row once, its encoding restored, in the common form."""
    src = once(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id")
    m, words = mojibake.model(src, "t")
    m = src.sparkSession.sparkContext.broadcast(m)
    kind = src.schema["id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            p["t"] = [plain(m.value.restore(t)[0]) if t else t for t in p["t"]]
            yield p

    return mojibake.fill(materialize(src.mapInPandas(run, f"id {kind}, t string"), "p2-restored"), "id", "t", words)


def read(df: DataFrame, id_col: str, text_col: str, with_text: bool = True, top_words: int = TOP_WORDS, top_heads: int = TOP_HEADS) -> DataFrame:
    """(id, traces[, repaired]) of every row with at least one trace, each once."""
    spark = df.sparkSession
    texts = materialize(restored(df, id_col, text_col).where("t <> ''"), "p2-texts")
    lex = Lexicon(texts, top_words, top_heads)
    kind = texts.schema["id"].dataType.simpleString()
    top = spark.sparkContext.broadcast((lex.top, lex.top_heads))
    short = spark.sparkContext.broadcast(lex.short)

    def needed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The words of each text that are not known to need no correction; "" for a text with other traces to look at."""
        words, heads = top.value

        def of(t: str, h: list[str] | None) -> set[str]:
            body = Reader({}, {}, heads if h is None else set(h)).body(t)
            k = {w for w in set(WORD.findall(body.lower())) - words.keys() if not simple(w)}
            cut = cut_words(body)
            if body is not t or cut:
                k.add("")
            return k | cut - words.keys()

        for p in it:
            yield from pieces(((i, w) for i, t, h in zip(p["id"], p["t"], p["heads"]) for w in of(t, h)), ["id", "word"])

    texts = lex.with_heads(texts)
    need = materialize(texts.mapInPandas(needed, f"id {kind}, word string"), "p2-needed")
    asked = need.where("word <> ''").select("word").distinct().join(lex.words, "word", "left").join(lex.trusted.select("word", F.lit(True).alias("sure")), "word", "left")
    asked = materialize(asked.select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sure", F.lit(False)).alias("sure")), "p2-asked")
    options = retrieve(asked.where(~F.col("sure") & ~F.col("word").contains("-")), lex.trusted, 1)
    info = materialize(asked.join(options, "word", "left"), "p2-options")
    of = need.join(info, "word", "left").groupBy("id").agg(F.collect_list(F.when(F.col("word") != "", F.struct("word", "n", "sure", "options"))).alias("info"), F.min(F.coalesce("sure", F.lit(False))).alias("calm"))
    doubtful = materialize(texts.join(of.where("NOT calm").drop("calm"), "id"), "p2-doubtful")

    def reader(info, heads, pairs) -> Reader:
        words, top_heads_ = top.value
        count, sure, options = {}, {}, {}
        for x in info:
            sure[x["word"]] = x["sure"]
            if x["n"]:
                count[x["word"]] = x["n"]
            if x["options"] is not None:
                options[x["word"]] = {o["w"]: [None if c is None or c != c else c for c in o["costs"]] for o in x["options"]}
                for o in x["options"]:
                    count[o["w"]] = o["n"]
                    sure[o["w"]] = True
        return Reader(ChainMap(count, words), pairs, top_heads_ if heads is None else set(heads), ChainMap(sure, _Sure(words)), options, short=short.value)

    def wanted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield from pieces(((i, a, b) for i, t, h, x in zip(p["id"], p["t"], p["heads"], p["info"]) for a, b in reader(x, h, {}).evidence(t)), ["id", "a", "b"])

    pairs = doubtful.mapInPandas(wanted, f"id {kind}, a string, b string").join(lex.pairs, ["a", "b"]).groupBy("id").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))

    def decided(p: pd.DataFrame) -> Iterator[tuple]:
        for i, t, h, x, y in zip(p["id"], p["t"], p["heads"], p["info"], p["pairs"]):
            r = reader(x, h, {(z["a"], z["b"]): z["n"] for z in y} if y is not None else {})
            text, kinds = r.repair(t) if with_text else (None, r.traces(t))
            if kinds:
                yield (i, kinds, text) if with_text else (i, kinds)

    def decide(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield from pieces(decided(p), [id_col, "traces", "repaired"][: 2 + with_text])

    return doubtful.join(pairs, "id", "left").mapInPandas(decide, f"{id_col} {kind}, traces array<string>" + (", repaired string" if with_text else ""))


class _Sure(dict):
    """Whether a word is trusted, of words that every worker holds."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __contains__(self, k) -> bool:
        return k in self.words

    def __missing__(self, k) -> bool:
        if k in self.words:
            return True
        raise KeyError(k)
