"""Problem 4: link the spellings of one person or court organ.

Method: every distinct spelling is read into its parts (titles and remarks off, "Surname, Given" and "Names (Organ)" turned
round, generation suffix apart, accents folded, names run together taken apart). Spellings with equal parts are one node.

Candidates are complete: which parts are alike (edit distance, initials, prefixes, nicknames) is found among the distinct parts, by
deletion neighbourhoods and keys of the other rules. Every part of the shorter of two linked names is like one of the longer, so a name
looks up the names that have parts like its two rarest ones. No part or pair of parts is too frequent to be compared.

A pair is verified by Monge-Elkan similarity: each part of the shorter name is assigned to another part of the longer
one - in any order - and the mean similarity of the parts has to reach LEAST_MEAN. Parts are similar as equals, as initial, abbreviation
or nickname, or within a typing error. Nicknames are those of the table and those the corpus shows: given names that mostly occur
before surnames which another given name has too. Verified links are clustered by star clustering: the fullest names become
centres unless they are linked to a centre already; any other spelling joins the centre most similar to it, and
is a centre of its own if two centres fit it equally well.

Different persons: another generation suffix (Filho, Neto, Júnior), another given name (two that are both in use, or of the
two genders, are no typing error of each other), any part of the shorter name that has no match. Fillers and bare offices are no names.

Defined results: null, blank, filler and bare-office strings have no entity; repeated strings count once; ties go to
the smaller string in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve.llm.rows import pieces
from citeresolve.session import discard, materialize

Q, ROWS, LEAST, RECALL = 3, 3, 0.38, 0.97
#: Names of a key from which their lookup is spread over salts, and how many.
HOT, SALTS = 2000, 16
#: Least mean similarity of the parts; how many times as frequent a given name must be for a look-alike to be its typing error.
LEAST_MEAN, RATIO = 0.8, 20
#: Nicknames of the corpus: how many surnames they share with the name at least, and what share of all of theirs.
NICK_LEAST, NICK_SHARE = 3, 0.3

# Words of Portuguese court registries.
TITLES = set("min ministro ministra des desembargador desembargadora exmo exma sr sra rel relator relatora relª minª desª dr dra juiz juiza conv convocado convocada mm doutor doutora redator redatora designado designada substituto substituta".split())
PARTICLES = set("da de do das dos e em d del di".split())
SUFFIXES = {"junior": "junior", "jr": "junior", "jnr": "junior", "jun": "junior", "filho": "filho", "fo": "filho", "fº": "filho", "neto": "neto", "nto": "neto", "netto": "neto", "sobrinho": "sobrinho", "sobr": "sobrinho", "segundo": "segundo", "ii": "segundo"}
REMARK = re.compile(r"[,;–—-]?\s*\(?\b(?:rel(?:atora?)?\.?\s*(?:p/|para)\s*(?:o\s+)?ac[oó]rd[aã]o|relatora?|convocad[oa]|em substitui[cç][aã]o)\b\)?\.?\s*$", re.I)
LEAD = re.compile(r"^\s*(?:(?:exm[oa]s?|sr[aªº]?|sra|min(?:istr[oa])?|des(?:embargador[a]?)?|rel(?:ator[a]?)?|dr[a]?|ju[ií]z[a]?|conv(?:ocad[oa])?|dout[oa]r[a]?)\.?[ªº]?\s*[:.]?\s+)+", re.I)
#: Words of offices and fillers: a string of nothing else names nobody.
OFFICE = set(
    "presidencia presidente vice vicepresidencia tribunal tribunais plantao judiciario judiciaria unificado corregedoria corregedor geral justica gabinete camara turma secao secretaria nucleo plenario orgao especial "
    "nao informado informada informar consta conste sem relator relatora relatoria definir definido designar designado a ser ignorado ignorada desconhecido desconhecida nd na ni nc n i c d xxx xx x xxxx vago vaga diversos diversas varios outros em branco "
    "distribuir distribuido sorteio pendente sigilo sigiloso vara juizo civel criminal federal regional superior supremo stf stj tst tse stm teste nome null none recursal apoio conciliacao primeira segunda terceira quarta quinta sexta unica".split()
)
TAIL = re.compile(r"^(.*\S)(?:\s*\(([^()]+)\)|\s+[-–—]\s*([^-–—()]+))\s*$")
RUN_TOGETHER = re.compile(r"([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])")
WORD = re.compile(r"[^\W_]+º?\.?")


def fold(s: str) -> str:
    s = s.replace("º", "o").replace("ª", "a")
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


DIGITS = str.maketrans("013458", "oleasb")


class Name(tuple):
    """(suffix, parts): parts in order, the given name or the kind of organ first."""

    __slots__ = ()


def parse(raw: str) -> Name | None:
    """The parts of a spelling; None for fillers and bare offices."""
    s = unicodedata.normalize("NFC", re.sub(r"\s+", " ", raw).strip())
    s = REMARK.sub("", REMARK.sub("", s))
    if m := TAIL.match(s):
        s = f"{m[2] or m[3]} {m[1]}"
    s = LEAD.sub("", re.sub(r"([ªº])(?=\S)", r"\1 ", s))
    head, comma, tail = RUN_TOGETHER.sub(r"\1 \2", s).partition(",")
    suffix, both = "", []
    for side in (head, tail):
        out: list[str] = []
        for w in WORD.findall(re.sub(r"\bF\.?º", "filho", side)):
            f = fold(w.rstrip("."))
            if f.isdigit():
                continue
            f = f.translate(DIGITS)
            initial = len(f) == 1 and (w.endswith(".") or not out and f != "e")
            if f in PARTICLES and not initial or f in TITLES and not (len(out) and f in ("conv",)):
                continue
            if f in SUFFIXES and (out or comma):
                suffix = SUFFIXES[f]
                continue
            out.append(f)
        both.append(out)
    parts = both[1] + both[0] if comma and both[1] else both[0] + both[1]
    if not parts or all(p in OFFICE or p in PARTICLES for p in parts):
        return None
    return Name((suffix, tuple(parts)))


def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transposition of neighbours."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def assignment(value: list[list[float]]) -> list[int]:
    """The column of each row (no more rows than columns), each column once, with the greatest sum: the Hungarian method."""
    n, m = len(value), len(value[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while row_of[j0]:
            used[j0] = True
            i0, delta, j1 = row_of[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -value[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


class Matcher:
    """Monge-Elkan similarity of parsed names."""

    def __init__(self, nicknames: list[tuple[str, str]]):
        self.nick: dict[str, set[tuple[str, ...]]] = {}
        for n, full in nicknames:
            if n and full:
                self.nick.setdefault(fold(n), set()).add(tuple(fold(full).split()))
        self.part = lru_cache(200_000)(self._part)

    def short_for(self, n: str, full: str) -> bool:
        """Whether `n` is a short form of the given name `full`: a known one or, for a form that isn't known, by the usual ways of shortening."""
        if any(x[0] == full or distance(x[0], full, 1) <= 1 and len(full) > 5 for x in self.nick.get(n, ()) if len(x) == 1):
            return True
        if n in self.nick or len(n) < 2:
            return False
        v = lambda s: s.replace("w", "v").replace("y", "i")
        if len(n) == 4 and v(n[:2]) == v(n[2:]):  # a doubled syllable
            return v(n[:2]) in v(full)
        if len(n) <= 4 and len(full) >= len(n) + 3 and v(full).startswith(v(n)):
            return True
        if 3 <= len(n) <= 5 and len(full) >= len(n) + 2 and v(full).endswith(v(n)):
            return True
        if len(n) > 3 and n[-1] in "iy" and v(full).startswith(v(n[:-1])) and len(full) >= len(n) + 2:
            return True
        stem = re.sub("z?inh[ao]$", "", n)
        return stem != n and len(stem) > 2 and stem in full

    def _part(self, a: str, b: str, given: bool) -> float:
        """Similarity of two parts, 0 if they are different names."""
        if a == b:
            return 1.0
        if len(a) == 1 or len(b) == 1:
            return 0.9 if a[0] == b[0] else 0.0
        s, t = sorted((a, b), key=len)
        if given:
            if self.short_for(a, b) or self.short_for(b, a):
                return 0.95
            if s + "a" == t or s[:-1] == t[:-1] and {s[-1], t[-1]} in ({"a", "o"}, {"e", "a"}):
                return 0.0
        if t.startswith(s) and (t[len(s) :] in PARTICLES or len(s) < 5 and len(t) > len(s) + 1):
            return 0.85
        d = distance(a, b, 2)
        if len(s) >= 3 and d == 1 or len(s) >= 7 and d == 2 and not given:
            return 1 - d / len(t) - 0.02
        return 0.0

    def split(self, a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
        """`a` with a part taken apart that is two neighbours of `b` run together, the beginnings of two (an acronym), or the nickname of two."""
        letters = {p[0] for p in b}
        for i, p in enumerate(a):
            if p in b or len(p) < 2 or p[0] not in letters and p not in self.nick:
                continue
            for k, (x, y) in enumerate(zip(b, b[1:])):
                if not i and p in self.nick:
                    if not k and any(len(t) == 2 and self.part(t[0], x, False) and self.part(t[1], y, False) for t in self.nick[p]):
                        return (x, y) + a[1:]
                    continue
                if p[0] != x[0] or min(len(x), len(y)) < 2:
                    continue
                if p == x + y:
                    return a[:i] + (x, y) + a[i + 1 :]
                if 1 < len(p) <= 5 and not self.part(p, x, not i and not k):
                    c = next((c for c in range(1, len(p)) if x.startswith(p[:c]) and y.startswith(p[c:])), 0)
                    if c:
                        return a[:i] + (p[:c], p[c:]) + a[i + 1 :]
        return a

    def similarity(self, x: Name, y: Name, in_use: bool = False) -> float:
        """Monge-Elkan similarity of the shorter name's parts within the longer's; 0 where they name different entities.

        `in_use`: the given names, if they differ, are both in use.
        """
        if x[0] != y[0]:
            return 0.0
        a, b = sorted((x[1], y[1]), key=lambda p: (len(p), p))
        if len(a) < 2 and len(b) > 1:
            return 0.0
        part, rows = self.part, []
        for i, p in enumerate(a):
            row = [part(p, q, not i and not j) for j, q in enumerate(b)]
            if not i and in_use and row[0] < 0.9:
                row[0] = 0.0
            if not any(row):
                return self._taken_apart(x[0], a, b, in_use)
            rows.append(row)
        n, m = len(a), len(b)
        to = assignment(rows)
        each = [r[j] for r, j in zip(rows, to)]
        # every part of the shorter name and both first ones have a match; where these aren't each other's, the names have the same parts in another order
        if min(each) <= 0 or 0 not in to or to[0] and (n < m or min(map(len, a)) < 2 or min(each) < 0.8):
            return self._taken_apart(x[0], a, b, in_use)
        if not any(min(len(p), len(b[j])) > 3 for p, j in zip(a, to)):
            return 0.0
        mean = sum(each) / n
        if mean < LEAST_MEAN:
            return 0.0
        turned = sum(s > t for s, t in zip(to, to[1:]))
        return mean - 0.03 * (m - n) - 0.01 * turned if mean - 0.03 * (m - n) - 0.01 * turned > 0 else 1e-3

    def _taken_apart(self, suffix: str, a: tuple[str, ...], b: tuple[str, ...], in_use: bool) -> float:
        """The similarity of names that differ unless a part of one stands for several of the other."""
        for u, v in ((a, b), (b, a)):
            w = self.split(u, v)
            if w is not u:
                return self.similarity(Name((suffix, w)), Name((suffix, v)), in_use)
        return 0.0


def bands(least: float = LEAST, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands for the wanted recall at similarity `least`: from the collision curve 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


def _pack(n: Name) -> str:
    return "|".join((n[0], " ".join(n[1])))


@lru_cache(200_000)
def _unpack(s: str) -> Name:
    x, p = s.split("|")
    return Name((x, tuple(p.split(" "))))


def nodes(strings: DataFrame, column: str) -> DataFrame:
    """(raw, node) of every distinct spelling that names somebody."""
    src = strings.select(F.col(column).alias("raw")).where("raw IS NOT NULL AND trim(raw) <> ''").distinct()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            got = [(r, n) for r in p["raw"] if (n := parse(r)) is not None]
            yield pd.DataFrame({"raw": [r for r, _ in got], "node": [_pack(n) for _, n in got]})

    return src.mapInPandas(run, "raw string, node string")


def _parts(node: F.Column) -> F.Column:
    return F.split(F.element_at(F.split(node, "\\|"), 2), " ")


def learned(node_table: DataFrame, least: int = NICK_LEAST, share: float = NICK_SHARE) -> DataFrame:
    """(nickname, name): given names that mostly stand before surnames which a more frequent given name, or pair of them, has too.

    Acronyms and abbreviations of organs are found likewise. Only the few given names most of whose surnames another one
    has are compared with the others, so that surnames of many given names are not paired up.
    """
    p = _parts(F.col("node"))
    rest = lambda k: F.concat_ws(" ", F.element_at(F.split("node", "\\|"), 1), F.slice(p, k, F.size(p)))
    d = node_table.select("node").distinct()
    one = d.where(F.size(p) >= 2).select(F.element_at(p, 1).alias("given"), rest(2).alias("rest"), (F.size(p) >= 3).alias("plain"))
    two = d.where(F.size(p) >= 3).select(F.concat_ws(" ", F.element_at(p, 1), F.element_at(p, 2)).alias("given"), rest(3).alias("rest"), F.lit(False).alias("plain"))
    d = materialize(one.unionByName(two).where("length(given) > 1 AND rest LIKE '% %'").groupBy("given", "rest").agg(F.max("plain").alias("plain")), "p4-given")
    shared = d.groupBy("rest").agg((F.count("*") > 1).alias("more"))
    n = d.join(shared, "rest").groupBy("given").agg(F.count("*").alias("n"), F.avg(F.col("more").cast("double")).alias("share"))
    few = n.where((F.col("share") >= share) & (F.col("n") >= least) & ~F.col("given").contains(" ")).select("given", F.col("n").alias("n_short"))
    short = d.where("plain").join(few, "given").select("rest", F.col("given").alias("short"), "n_short")
    both = short.join(d, "rest").where("short <> given AND NOT startswith(given, concat(short, ' '))").groupBy("short", "n_short", "given").agg(F.count("*").alias("k"))
    both = both.join(n.select("given", F.col("n").alias("n_full")), "given").where((F.col("k") >= least) & (F.col("k") >= share * F.col("n_short")) & (F.col("n_short") < F.col("n_full")))
    return both.select(F.col("short").alias("nickname"), F.col("given").alias("name"))


def described(node_table: DataFrame) -> DataFrame:
    """(id, node, uses): every node once, with how many nodes have its first part as theirs."""
    d = materialize(node_table.select("node").distinct().select(F.xxhash64("node").alias("id"), "node"), "p4-ids")
    given = F.element_at(_parts(F.col("node")), 1)
    n = d.groupBy(given.alias("given")).agg(F.count("*").alias("uses"))
    return materialize(d.withColumn("given", given).join(n, "given").select("id", "node", "uses"), "p4-described")


def deletions(p: str, k: int) -> set[str]:
    """The string without up to `k` of its characters: strings within distance `k` of each other, transpositions included, share one."""
    out = last = {p}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def part_keys(p: str, given: bool, m: Matcher) -> tuple[set[str], set[str]]:
    """Keys of a whole part as the shorter and as the longer of two: Matcher.part() is above 0 only for parts that share one."""
    near = {f"d{x}" for x in deletions(p, 2 if len(p) >= 7 else 1)}
    short, full = near | {f"p{p}"}, near | {f"p{p[:k]}" for k in (2, 3, 4) if k < len(p)} | {f"p{p[: -len(x)]}" for x in PARTICLES if p.endswith(x) and len(p) > len(x)}
    if given:
        v = lambda t: t.replace("w", "v").replace("y", "i")
        short |= {f"d{x}" for t in m.nick.get(p, ()) if len(t) == 1 for x in deletions(t[0], 1)} 
        if len(p) <= 4:
            short.add(f"q{v(p)}")
        if 3 <= len(p) <= 5:
            short.add(f"e{v(p)}")
        if len(p) > 3 and p[-1] in "iy":
            short.add(f"q{v(p[:-1])}")
        if len(p) == 4 and v(p[:2]) == v(p[2:]):
            short.add(f"b{v(p[:2])}")
        stem = re.sub("z?inh[ao]$", "", p)
        if stem != p:
            short.add(f"i{stem}")
        w = v(p)
        full |= {f"q{w[:k]}" for k in range(1, len(w) + 1)} | {f"e{w[-k:]}" for k in (3, 4, 5)} | {f"b{w[k : k + 2]}" for k in range(len(w) - 1)} | {f"i{p[k:l]}" for k in range(len(p)) for l in range(k + 3, len(p) + 1)}
    return short, full


def alike(parts: DataFrame, nicknames: list[tuple[str, str]]) -> DataFrame:
    """(part, like): all pairs of whole parts (part, given) that may be one, each part with itself too."""

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(nicknames)
        for p in it:
            yield from pieces(((w, k, side) for w, g in zip(p["part"], p["given"]) for side, ks in enumerate(part_keys(w, g, m)) for k in ks), ["part", "key", "side"])

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(nicknames)
        for p in it:
            yield p[[m._part(a, b, False) > 0 or m._part(a, b, True) > 0 for a, b in zip(p["part"], p["like"])]]

    k = materialize(parts.mapInPandas(keys, "part string, key string, side int"), "p4-part-keys")
    both = k.where("side = 0").select("key", "part").join(k.where("side = 1").select("key", F.col("part").alias("like")), "key").where("part <> like")
    both = both.select(F.least("part", "like").alias("part"), F.greatest("part", "like").alias("like")).distinct().mapInPandas(verify, "part string, like string")
    both = materialize(both, "p4-alike")
    return both.unionByName(both.select(F.col("like").alias("part"), F.col("part").alias("like"))).unionByName(parts.select("part", F.col("part").alias("like")))


def composites(n: tuple[str, ...], m: Matcher) -> Iterator[tuple[int, str]]:
    """(position, part) of the parts that may stand for two neighbours: both run together, their beginnings, or the nickname of two given names."""
    for k, (x, y) in enumerate(zip(n, n[1:])):
        if min(len(x), len(y)) > 1:
            yield from ((k, c) for c in {x + y} | {x[:i] + y[:j] for i in range(1, 5) for j in range(1, 6 - i)})
        if not k:
            yield from ((k, p) for p, ts in m.nick.items() if any(len(t) == 2 and m.part(t[0], x, False) and m.part(t[1], y, False) for t in ts))


def _key(suffix: F.Column, x: F.Column, y: F.Column) -> F.Column:
    return F.xxhash64(suffix, F.least(x, y), F.greatest(x, y))


def candidates(d: DataFrame, nicknames: list[tuple[str, str]], hot: int = HOT) -> DataFrame:
    """(i, j): every pair of ids of nodes (id, node) that Matcher.similarity() can find similar.

    Each part of the shorter name has to be like one of the longer's, so it is enough that a name looks up the two of its parts that
    fewest names have, in all forms that are like them. A part that stands for two neighbours is looked up with each of the other parts.
    """
    split_ = F.split("node", "\\|")
    at = d.select("id", F.element_at(split_, 1).alias("suffix"), F.posexplode(_parts(F.col("node"))).alias("pos", "part"))
    at = materialize(at, "p4-parts")
    parts = materialize(at.where("length(part) > 1").groupBy("part").agg(F.max(F.col("pos") == 0).alias("given")), "p4-vocabulary")
    letter = F.concat(F.substring("part", 1, 1), F.lit("*"))
    has = at.select("id", "suffix", "pos", F.explode(F.array("part", letter)).alias("token"))
    # what a name is found by: its pairs of parts, one of them by its first letter alone or not; each part alone
    x, y = has.select("id", "suffix", F.col("pos").alias("k"), F.col("token").alias("t")), has.select("id", F.col("pos").alias("l"), F.col("token").alias("u"))
    pairs = x.join(y, "id").where("k < l AND NOT (endswith(t, '*') AND endswith(u, '*'))").select("id", _key(F.col("suffix"), F.col("t"), F.col("u")).alias("key"))
    alone = at.select("id", _key(F.col("suffix"), F.col("part"), F.lit("")).alias("key"))
    stored = materialize(pairs.unionByName(alone).distinct(), "p4-stored")
    # the forms of each part
    like = alike(parts, nicknames).unionByName(parts.select("part", F.substring("part", 1, 1).alias("like")))
    like = like.unionByName(at.where("length(part) = 1").select("part", letter.alias("like")).distinct())
    used = has.groupBy(F.col("token").alias("like")).agg(F.count("*").alias("n"))
    forms = materialize(like.distinct().join(used, "like").groupBy("part").agg(F.collect_list("like").alias("forms"), F.sum("n").alias("n")), "p4-forms")
    of = at.join(forms, "part").groupBy("id", "suffix").agg(F.array_sort(F.collect_list(F.struct((F.length("part") == 1).alias("initial"), "n", "pos", "part", "forms"))).alias("p"))
    two = of.select("id", "suffix", F.explode(F.col("p")[0]["forms"]).alias("t"), F.when(F.size("p") > 1, F.col("p")[1]["forms"]).otherwise(F.array(F.lit(""))).alias("us"))
    # two initials would find too many; but then another part, a long one, is whole in both names and is looked up with the first initial
    asked = two.select("id", "suffix", "t", F.explode("us").alias("u")).where("NOT (length(t) = 1 AND (length(u) = 1 OR endswith(u, '*')))")
    long = of.select("id", "suffix", F.col("p")[0]["part"].alias("first"), F.explode(F.slice("p", 2, F.size("p"))).alias("r")).where("length(first) > 1 AND length(r.part) > 3")
    long = long.select("id", "suffix", F.explode("r.forms").alias("t"), F.substring("first", 1, 1).alias("u")).where("length(t) > 1")
    asked = asked.unionByName(long)

    def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(nicknames)
        for p in it:
            yield from pieces(((i, k, c) for i, s in zip(p["id"], p["node"]) for k, c in composites(_unpack(s)[1], m)), ["id", "k", "t"])

    c = d.select("id", "node").mapInPandas(made, "id long, k int, t string").join(parts.select(F.col("part").alias("t")), "t", "left_semi")
    c = materialize(c.distinct(), "p4-composites")
    others = at.join(forms, "part").select("id", "suffix", "pos", F.explode("forms").alias("u"))
    sizes = at.groupBy("id", "suffix").agg(F.count("*").alias("m"))
    asked = asked.unionByName(c.join(others, "id").where("pos <> k AND pos <> k + 1").select("id", "suffix", "t", "u"))
    asked = asked.unionByName(c.join(sizes.where("m = 2"), "id").select("id", "suffix", "t", F.lit("").alias("u")))
    twice = c.join(c.select("id", F.col("k").alias("l"), F.col("t").alias("u")), "id").where("l > k + 1").join(sizes, "id")
    asked = asked.unionByName(twice.select("id", "suffix", "t", "u"))
    asked = materialize(asked.select("id", _key(F.col("suffix"), F.col("t"), F.col("u")).alias("key")).distinct(), "p4-asked")
    # keys that many names have are joined in salted parts
    many = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("many"))
    salted = lambda t, name, salt: t.join(many, "key", "left").select("key", F.col("id").alias(name), salt.alias("_s"))
    l_ = salted(asked, "k", F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    r_ = salted(stored, "l", F.when(F.col("many"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return l_.join(r_, ["key", "_s"]).where("k <> l").select(F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j")).distinct()


def verified(d: DataFrame, ids: DataFrame, nicknames: list[tuple[str, str]]) -> DataFrame:
    """(i, j, a, b, similarity) of the pairs (i, j) of ids that name one entity."""
    left = d.select(F.col("id").alias("i"), F.col("node").alias("u"), F.col("uses").alias("n_u"))
    right = d.select(F.col("id").alias("j"), F.col("node").alias("v"), F.col("uses").alias("n_v"))
    less, more = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    pairs = ids.join(left, "i").join(right, "j").select("i", "j", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), ((less >= 3) & (less * RATIO >= more)).alias("in_use"))

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(nicknames)
        for p in it:
            s = np.array([m.similarity(_unpack(u), _unpack(v), w) for u, v, w in zip(p["a"], p["b"], p["in_use"])], float)
            yield p.drop(columns="in_use").assign(similarity=s)[s > 0]

    return pairs.mapInPandas(verify, "i long, j long, a string, b string, similarity double")


def links(node_table: DataFrame, nicknames: list[tuple[str, str]], hot: int = HOT) -> DataFrame:
    """(a, b, similarity), a < b: verified pairs of nodes."""
    d = described(node_table)
    ids = materialize(candidates(d, nicknames, hot), "p4-candidates")
    return materialize(verified(d, ids, nicknames), "p4-verified").select("a", "b", "similarity")


def fullness(node: F.Column) -> F.Column:
    """Whole parts, then letters: how much of the name a node spells out."""
    return F.size(F.filter(_parts(node), lambda p: F.length(p) > 2)) * 1000 + F.least(F.length(node), F.lit(999))


def stars(node_table: DataFrame, link_table: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, centre): star clustering, the fullest and best linked names first.

    Each round makes every undecided node a centre that outranks all its undecided neighbours, and its neighbours
    satellites: the same centres as one greedy pass in rank order. Work per round is a join of the links. A node that two
    centres fit equally well joins neither and is a centre of its own without satellites.
    """
    both = link_table.select(F.col("a").alias("u"), F.col("b").alias("v"), "similarity").unionByName(link_table.select(F.col("b").alias("u"), F.col("a").alias("v"), "similarity"))
    rows = node_table.groupBy("node").agg(F.count("*").alias("spellings"))
    degree = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    rank = rows.join(degree, "node", "left").select(
        "node", F.struct(F.size(_parts(F.col("node"))).alias("n"), F.col("spellings").alias("s"), F.coalesce("degree", F.lit(0)).alias("d"), fullness(F.col("node")).alias("f"), F.col("node").alias("id")).alias("rank")
    )
    rank = materialize(rank, "p4-rank")
    edges = both.join(rank.select(F.col("node").alias("v"), F.col("rank").alias("rv")), "v")
    edges = materialize(edges.select("u", "v", "rv", "similarity"), "p4-edges")
    undecided, centres = rank, None
    for _ in range(rounds):
        open_ = edges.join(undecided.select(F.col("node").alias("v")), "v", "left_semi")
        best = open_.groupBy(F.col("u").alias("node")).agg(F.max("rv").alias("m"))
        new = materialize(undecided.join(best, "node", "left").where("m IS NULL OR rank > m").select("node"), "p4-centres")
        centres = new if centres is None else centres.unionByName(new)
        hit = new.unionByName(edges.join(new.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))).distinct()
        before, undecided = undecided, materialize(undecided.join(hit, "node", "left_anti"), "p4-undecided")
        if before is not rank:
            discard(before)
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError("star clustering did not end; raise `rounds`")
    w = Window.partitionBy("u").orderBy(F.desc("similarity"), F.desc("rv"))
    to = edges.join(centres.select(F.col("node").alias("v")), "v", "left_semi").join(centres.select(F.col("node").alias("u")), "u", "left_anti")
    best = to.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("similarity").over(w)).where("k = 1")
    joined = best.select(F.col("u").alias("node"), F.when(F.expr("next IS NULL OR similarity > next + 1e-9"), F.col("v")).otherwise(F.col("u")).alias("centre"))
    return centres.select("node", F.col("node").alias("centre")).unionByName(joined)


def entities(records: DataFrame, nicknames: DataFrame, column: str = "relator") -> DataFrame:
    """(raw, centre): every spelling with the entity it was linked to."""
    n = materialize(nodes(records, column), "p4-nodes")
    # the given table, and the nicknames of the corpus: their number is that of given names in use, not of rows
    nick = [(r[0], r[1]) for r in nicknames.select("apelido", "nome").distinct().unionAll(learned(n)).collect()]
    l_ = materialize(links(n, nick), "p4-links")
    return n.join(stars(n, l_), "node").select("raw", "centre")


def entity_pairs(found: DataFrame, a: str, b: str, salts: int = 8) -> DataFrame:
    """Pairs a < b of the spellings of each entity. One side is salted, so that the spellings of a hot entity aren't one task's."""
    x = found.select("centre", F.col("raw").alias(a), F.pmod(F.xxhash64("raw"), F.lit(salts)).alias("_s"))
    y = found.select("centre", F.col("raw").alias(b), F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])).alias("_s"))
    return x.join(y, ["centre", "_s"]).where(F.col(a) < F.col(b)).select(a, b)
