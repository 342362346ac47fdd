"""Widening of spans by what belongs to the citation on both sides.

A numbered case takes in the words of class and appeals before it, its state and court and the appeals listed behind it; a
statement its item and court; an article the year of its statute and the enumeration behind it. The words around a span are
read one by one, each by its kind, so that a word that is no part of a citation ends the walk.
"""

from __future__ import annotations

import re
from functools import lru_cache

from citeresolve import dims
from citeresolve.functions import fuzzy

#: How far a phrase may reach to the left, and an item of a list to the right.
REACH, ITEM = 160, 80
GLUE = frozenset("de da do das dos no na nos nas em ao aos a o e".split())
#: Words that make a phrase one of a case; the other words of class and appeal names only complete it.
BEARING = frozenset("recurso agravo embargos habeas reclamacao apelacao acao mandado suspensao".split())
OWN = frozenset("presente este neste deste nesse desse".split())
SHORT = {fuzzy.skeleton(c)[0] for c, _, _ in dims.CLASSES} | {fuzzy.skeleton(x)[0] for x in "agint agrg agr edcl edv ed eds pext ag rec".split()}
WORDS = re.compile(r"[^\s,;:()]+")
STATE = "(?:" + "|".join(u.replace("S", "[S5]").replace("O", "[O0]") for u in dims.UFS) + ")"
COURTS = "(?:[S5]TJ|[S5]TF|T[S5]T|T[S5]E|[S5]TM|Superior Tribunal de Justi[çc]a|Supremo Tribunal Federal|Tribunal Superior do Trabalho|Tribunal Superior Eleitoral|Superior Tribunal Militar)"
AFTER = re.compile(rf"\s*[/–—-]\s*{STATE}(?![A-Za-z])|\s*\(\s*(?:{STATE}|{COURTS})\s*\)|,\s*{STATE}(?![A-Za-z])(?!\s*[a-zà-ÿ])|\s*[,–—-]?\s*d[oa]\s+{COURTS}(?![A-Za-z])|\s*[,–—-]\s*{COURTS}(?![A-Za-z])")
BEFORE = re.compile(rf"{COURTS}\s*[,:–—-]\s*$")
STATEMENT_TAIL = re.compile(rf"(?:\s*,\s*(?:item\s+|inciso\s+)?[IVXL]+(?![A-Za-z]))?(?:\s*,)?(?:\s*(?:d[oa]\s+|/|[–—-]\s*|\(\s*)?{COURTS}(?![A-Za-z])\)?)?(?:\s*,\s*(?:item\s+)?[IVXL]+(?![A-Za-z]))?")
STATUTE_YEAR = re.compile(r"(?:/\s*[0-9]{2,4}|\s+de\s+[0-9]{4})(?![0-9])")
ENUMERATED = re.compile(r",?\s+(?:e\s+|a\s+)?(?:§\s*[0-9]+[º°]?|incisos?\s+[IVXL]+(?:\s+(?:a|e)\s+[IVXL]+)?|[IVXL]+(?![A-Za-z])|al[íi]neas?\s+\S+|caput|par[áa]grafo\s+[úu]nico)")
RAPPORTEUR = re.compile(r"[^.;\n]{0,40}?(?<![A-Za-z])(?:[Rr]el(?:\.|ator)|relatoria)")


@lru_cache(50_000)
def kind(word: str) -> str | None:
    """What a word is in the phrase before a number: class, legal (completes a class), court, glue; None for any other."""
    bare = word.strip(".,;:")
    f = fuzzy.fold(bare)
    if not f or f in GLUE or re.fullmatch(r"n[.º°o]*|n[rº]+\.?|num", f):
        return "glue"
    if re.fullmatch(COURTS, bare):
        return "court"
    plain = bare.replace(".", "")
    if any(c.isupper() for c in plain) and fuzzy.skeleton(plain)[0] in SHORT:
        return "class"
    w = fuzzy.expand_word(word) if word.endswith(".") and len(plain) > 1 else fuzzy.repair_word(bare)
    if w in BEARING:
        return "class"
    return "legal" if w in dims.LEGAL_WORDS else None


def phrase_start(text: str, start: int, floor: int) -> int:
    """Where the words of class and appeals begin that lead to a number at `start`; `start` itself if they name no class."""
    best, edge, bearing = start, start, False
    for m in reversed(list(WORDS.finditer(text, max(floor, start - REACH), start))):
        gap = text[m.end() : edge]
        k = kind(m.group())
        if gap.strip() or gap.count("\n") > 1 or k in (None, "court"):
            break
        edge = m.start()
        if k != "glue":
            best, bearing = edge, bearing or k == "class"
    own = {fuzzy.fold(w) for w in re.findall(r"\w+", text[max(0, best - 20) : best])[-2:]}
    return best if bearing and not own & OWN else start


def court_before(text: str, start: int, floor: int) -> int:
    lo = max(floor, start - ITEM)
    m = BEFORE.search(text[lo:start])
    return lo + m.start() if m else start


def listed(text: str, end: int) -> int:
    """The end of the appeals, courts and states listed after commas; an item with a number is another citation."""
    while m := re.compile(r"[ \t]*,[ \t]*").match(text, end):
        at, stop, bearing = m.end(), None, False
        for w in WORDS.finditer(text, at, min(len(text), at + ITEM)):
            if text[at : w.start()].strip(" \t"):
                break
            if any(c.isdigit() for c in w.group()):
                stop = None
                break
            bare = w.group().strip(".")
            k = "state" if re.fullmatch(STATE, bare) else kind(w.group())
            if k is None or k == "legal" and not bearing:
                break
            if k != "glue":
                bearing = True
                full_stop = w.group().endswith(".") and (bare.isupper() or len(bare) > 5)
                stop = w.end() - full_stop
                if full_stop:
                    break
            at = w.end()
        if stop is None:
            return end
        end = stop
    return end


def widened(text: str, start: int, end: int, family: str, floor: int = 0) -> tuple[int, int] | None:
    """The span of a citation with what belongs to it; None for a case whose number is a year before a rapporteur (a descriptive mention)."""
    if family.startswith("processos") and "descritivos" not in family:
        last = re.search(r"\S+$", text[start:end])
        if last and re.fullmatch("(?:19|20)[0-9]{2}", last.group()) and RAPPORTEUR.match(text[end : end + 80]):
            return None
        start = phrase_start(text, start, floor)
        for _ in range(3):
            m = AFTER.match(text, end)
            if not m:
                break
            end = m.end()
        return court_before(text, start, floor), listed(text, end)
    if family == "artigos":
        if m := STATUTE_YEAR.match(text, end):
            end = m.end()
        if not text[start:end].lower().startswith("art"):
            first = end
            while (m := ENUMERATED.match(text, end)) and m.end() - first < ITEM:
                end = m.end()
    if family == "sumulas":
        m = STATEMENT_TAIL.match(text, end)
        end = m.end() if m and text[end : m.end()].strip(" ,") else end
        start = court_before(text, start, floor)
    return start, end
