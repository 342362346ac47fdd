"""Arrow functions for what columns can't express: similarity by matching blocks, vocabulary repair, number groups,
skeletons with offset maps. Always behind an equi join or over single rows, never over all pairs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher, get_close_matches
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeresolve import dims

_LETTER = {"0": "o", "1": "l", "3": "e", "5": "s"}
_ALIKE = [set("ceo"), set("ilt1"), set("nmru"), set("sg5"), set("bh"), set("ao"), set("vy"), set("fpt")]


def fold(s: str) -> str:
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).split())


def similarity(a: str, b: str) -> float:
    """Share of characters in matching blocks (Ratcliff and Obershelp)."""
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(50_000)
def repair_word(word: str) -> str:
    """A word repaired to the legal vocabulary: with digits read as letters, rn as m, or the closest of three whose first letters look alike."""
    f = fold(word)
    if f in dims.LEGAL_WORDS or len(f) < 4:
        return f
    for g in ("".join(_LETTER.get(c, c) for c in f), f.replace("rn", "m"), "".join(_LETTER.get(c, c) for c in f).replace("rn", "m")):
        if g in dims.LEGAL_WORDS:
            return g
    for near in get_close_matches(f, dims.LEGAL_WORDS, 3, 0.75):
        if near[0] == f[0] or any(near[0] in s and f[0] in s for s in _ALIKE):
            return near
    return f


@lru_cache(50_000)
def expand_word(word: str) -> str:
    """An abbreviation expanded to the first legal word it begins, else the first it is a subsequence of."""
    f = fold(word).rstrip(".")
    if len(f) < 2 or f in ("clt", "cpc", "cpp", "cpm", "cdc") or re.fullmatch("[ivxlc]+", f):
        return f
    for w in dims.LEGAL_WORDS:
        if w.startswith(f):
            return w
    for w in dims.LEGAL_WORDS:
        it = iter(w)
        if w[0] == f[0] and all(c in it for c in f):
            return w
    return f


def canonical_words(text: str) -> str:
    """Words repaired, abbreviations (with their full stop) expanded."""
    out = []
    for w, dot in re.findall(r"([^\W_]+)(\.?)", text):
        out.append(expand_word(w) if dot and len(w) > 1 else repair_word(w))
    return " ".join(out)


_GROUP = re.compile(r"[0-9OoQlIi|SsGgBZz](?:[0-9OoQlIi|SsGgBZz]|[.\-/](?=[0-9OoQlIi|SsGgBZz]))*")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})|\d{1,2}/(?:19|20)\d{2}")
_AS_DIGITS = str.maketrans(dims.OCR_LETTERS, dims.OCR_DIGITS)


def number_groups(text: str) -> list[str]:
    """The whole numbers of a text as digits; letters taken for digits only beside digits; no dates."""
    out = []
    for m in _GROUP.finditer(text):
        s, lo, hi = m.group(), m.start(), m.end()
        n = sum(c.isdigit() for c in s)
        glued = lo > 0 and text[lo - 1].isalpha() or hi < len(text) and text[hi].isalpha()
        if n < 1 or glued and n < 2 or _DATE.fullmatch(s):
            continue
        if sum(c.isalpha() or c == "|" for c in s) > n:
            continue
        d = re.sub(r"\D", "", s.translate(_AS_DIGITS))
        if d:
            out.append(d)
    return out


_TWO = {"rn": "m", "ri": "n"}
_SKELETON = {"o": "0", "q": "6", "g": "6", "9": "6", "l": "1", "i": "1", "|": "1", "j": "1", "s": "5", "b": "8", "z": "2", "e": "c", "u": "n"}


@lru_cache(50_000)
def _low(c: str) -> str:
    return fold(c) if c.strip() else ""


def skeleton(text: str) -> tuple[str, list[int]]:
    """Letters and digits in one form for shapes taken for each other, with the source position of each."""
    out, at, i = [], [], 0
    low = [_low(c) for c in text]
    while i < len(text):
        pair = (low[i] + low[i + 1]) if i + 1 < len(text) else ""
        if pair in _TWO:
            c, step = _TWO[pair], 2
        else:
            c, step = low[i], 1
        for x in c:
            if x.isalnum() or x == "|":
                out.append(_SKELETON.get(x, x))
                at.append(i)
        i += step
    return "".join(out), at


def align(text: str, piece: str) -> tuple[int, int] | None:
    """Where `piece` stands in `text`: by equal skeletons, else the most similar window (0.86 at least) at an anchor of its first or last five shapes."""
    t, at = skeleton(text)
    p, _ = skeleton(piece)
    if not p:
        return None
    k = t.find(p)
    if k >= 0:
        return at[k], at[k + len(p) - 1] + 1
    best = (0.0, -1, -1)
    heads = {m.start() for m in re.finditer(re.escape(p[:5]), t)} | {m.start() + 5 - len(p) for m in re.finditer(re.escape(p[-5:]), t)}
    for s in sorted(heads):
        for n in range(len(p) - 3, len(p) + 4):
            if s >= 0 and n > 0 and s + n <= len(t):
                r = similarity(t[s : s + n], p)
                if r > best[0]:
                    best = (r, s, s + n)
    return (at[best[1]], at[best[2] - 1] + 1) if best[0] >= 0.86 else None


def occurrences(text: str, piece: str) -> list[int]:
    """Every position at which `piece` begins in `text`, overlapping ones included."""
    out, k = [], text.find(piece) if piece else -1
    while k >= 0:
        out.append(k)
        k = text.find(piece, k + 1)
    return out


def places(text: str, pieces: list[str]) -> list[tuple[int, int, int]]:
    """(index of the piece, start, end) of every place of each piece in `text`: all equal stretches and all stretches of an
    equal skeleton that overlap none of them, by start; without any, the most similar window of `align`."""
    t, at = skeleton(text)
    out = []
    for i, piece in enumerate(pieces):
        got = [(k, k + len(piece)) for k in occurrences(text, piece)]
        p, _ = skeleton(piece)
        same = [(at[k], at[k + len(p) - 1] + 1) for k in occurrences(t, p)]
        got += [(s, e) for s, e in same if all(e <= a or b <= s for a, b in got)]
        if not got and (near := align(text, piece)):
            got = [near]
        out += [(i, s, e) for s, e in sorted(got)]
    return out


def fuzzy_in(word: str, text: str, least: float = 0.8) -> bool:
    """Whether some stretch of `text` as long as `word` is at least `least` similar to it."""
    w, t = fold(word), fold(text)
    n = len(w)
    return bool(w) and (w in t or any(similarity(w, t[i : i + n]) >= least for i in range(max(0, len(t) - n) + 1)))


#: Word stems that speak for a class or a statute in a stretch of text.
STEMS = {
    "REsp": ("resp", "recurso esp", "rec. esp"), "AREsp": ("aresp", "agravo em rec"), "RHC": ("rhc", "recurso em habeas", "recurso ordinario em habeas"), "HC": ("hc", "habeas"), "RMS": ("rms", "recurso em mandado"),
    "Rcl": ("rcl", "recl"), "RE": ("re ", "recurso extraord"), "ARE": ("are ", "extraordinario com agravo"), "RR": ("rr", "recurso de revista"), "AIRR": ("airr",), "CPC": ("cpc", "processo civil"), "CPP": ("cpp", "processo penal"),
    "CF": ("cf", "constituicao"), "CLT": ("clt", "leis do trabalho"), "CC": ("cc", "codigo civil"), "CDC": ("cdc", "consumidor"), "CPM": ("cpm", "penal militar"), "CE": ("codigo eleitoral",),
}


def evidence(text: str, code: str) -> int:
    """Length of the longest stem in `text` that speaks for `code`; 0 without any."""
    t = fold(text) + " "
    return max((len(s) for s in STEMS.get(code, (code.lower(),)) if s in t), default=0)


def best_evidence(text: str, codes: list[str]) -> str | None:
    """The code with the longest evidence; None without any and for a tie."""
    e = sorted(((evidence(text, c), c) for c in codes), reverse=True)
    return e[0][1] if e and e[0][0] and (len(e) == 1 or e[1][0] < e[0][0]) else None


#: Words after which a number is no case number, and words that lead to one.
BLOCKERS = frozenset("fls fl folha folhas pagina oab cpf cnpj rg valor protocolo matricula cep telefone item anexo r$".split())
LEADING = frozenset("n no nr numero autos processo recurso agravo embargos habeas corpus reclamacao resp aresp rhc rms hc re are rcl ar rr airr arr ro ai apl rse respe agint agrg edcl edv".split())


def cited_number(before: str, unknown: int = 3) -> bool:
    """Whether the words before a number lead to a citation: backwards, a leading word comes before a blocking one and before more than `unknown` others."""
    n = 0
    for w in reversed(re.findall(r"[a-z$]+", fold(before))):
        if w in BLOCKERS:
            return False
        if w in LEADING and w not in ("n", "no", "nr", "numero"):
            return True
        n += w not in ("n", "no", "nr", "numero", "o", "a", "do", "da", "de", "em")
        if n > unknown:
            return False
    return False


def names_match(cited: list[str] | None, record: list[str] | None) -> bool:
    """Whether every word cited has a word of the record at least 0.75 similar."""
    if not cited or not record:
        return False
    return all(c in record or any(alike(c, r) for r in record) for c in cited)


@lru_cache(500_000)
def alike(a: str, b: str, least: float = 0.75) -> bool:
    """Whether two words are similar enough; words that can't be are told by their lengths and letters."""
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


#: Word pairs of one frame: a matrix of bounds, and the pairs that pass it.
PAIRS = 1_000_000


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in 32 classes as two bit sets with a bit for each of the first four of a class, the number of further letters, and the lengths."""
    bags, over = np.zeros((len(words), 2), np.uint64), np.zeros(len(words), np.int32)
    for i, w in enumerate(words):
        n, bits = [0] * 32, [0, 0]
        for c in w:
            k = ord(c) % 32
            if n[k] < 4:
                bits[n[k] // 2] |= 1 << (k + 32 * (n[k] % 2))
            else:
                over[i] += 1
            n[k] += 1
        bags[i] = bits
    return bags, over, np.array([len(w) for w in words], np.int32)


def _shapes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of up to 64 letters: the positions of each of 32 letter classes as bits, and the classes by position (32 behind the end)."""
    at, codes = np.zeros((len(words), 33), np.uint64), np.full((len(words), 64), 32, np.uint8)
    for i, w in enumerate(words):
        if len(w) <= 64:
            for p, c in enumerate(w):
                codes[i, p] = ord(c) % 32
                at[i, ord(c) % 32] |= np.uint64(1 << p)
    return at, codes


def alike_pairs(a: list[str], b: list[str]) -> Iterator[list[tuple[str, str]]]:
    """Every pair of words of `a` and `b` that `alike` holds for, in lists.

    The characters in matching blocks are a common subsequence. Two bounds of its length, the letters in common and the longest
    common subsequence, are computed for many pairs at once; letters of one class count as one, so no pair is lost.
    """
    (x, x_over, x_len), (y, y_over, y_len) = _bags(a), _bags(b)
    at, codes = _shapes(a)[0], _shapes(b)[1]
    step = max(1, PAIRS // max(1, len(b)))
    m = SequenceMatcher(None)
    for lo in range(0, len(a), step):
        rows = slice(lo, lo + step)
        common = np.bitwise_count(x[rows, :1] & y[:, 0]).astype(np.int32) + np.bitwise_count(x[rows, 1:] & y[:, 1]) + np.minimum(x_over[rows, None], y_over)
        i, j = np.nonzero(8 * common >= 3 * (x_len[rows, None] + y_len))
        i += lo
        left = np.full(len(i), -1, np.int64).view(np.uint64)
        for k in range(min(64, int(y_len[j].max(initial=0)))):
            u = left & at[i, codes[j, k]]
            left = (left + u) | (left - u)
        n = x_len[i]
        low = np.uint64(2**64 - 1) >> np.clip(64 - n, 0, 63).astype(np.uint64)
        longest = n - np.bitwise_count(left & low)
        keep = (8 * longest >= 3 * (n + y_len[j])) | (n == 0) | (n > 64) | (y_len[j] > 64)
        i, j = i[keep], j[keep]
        out = []
        for k in np.argsort(j, kind="stable"):
            p, q = a[i[k]], b[j[k]]
            if m.b is not q:
                m.set_seq2(q)
            m.set_seq1(p)
            if m.ratio() >= 0.75:
                out.append((p, q))
        if out:
            yield out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def name_matches(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names_match(list(x) if x is not None else None, list(y) if y is not None else None) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def canonical(a: pd.Series) -> pd.Series:
    return pd.Series([canonical_words(x) if x is not None else None for x in a])


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbers_in(a: pd.Series) -> pd.Series:
    return pd.Series([number_groups(x) if x is not None else None for x in a])


@F.pandas_udf(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
def aligned(t: pd.Series, p: pd.Series) -> pd.DataFrame:
    got = [align(x, y) if x is not None and y is not None else None for x, y in zip(t, p)]
    return pd.DataFrame({"s": pd.array([g[0] if g else None for g in got], "Int32"), "e": pd.array([g[1] if g else None for g in got], "Int32")})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def all_places(t: pd.Series, pieces: pd.Series) -> pd.Series:
    return pd.Series([[{"piece": p[i], "s": s, "e": e} for i, s, e in places(x, p)] if x is not None else None for x, p in zip(t, map(list, pieces))], dtype=object)


@F.pandas_udf(T.StringType())
def skeleton_of(a: pd.Series) -> pd.Series:
    return pd.Series([skeleton(x)[0] if x is not None else None for x in a])
