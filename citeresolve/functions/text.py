"""Column functions over text: cleaning, folding and comparable keys. All run inside the JVM.

Every function gives null for null. Digits parsed from text go through try_cast, so that no text fails a query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeresolve import dims

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CNJ = r"([0-9OolIS]{1,7})\s*-\s*([0-9OolIS]{2})\.([0-9OolIS]{4})\.([0-9OolIS])\.([0-9OolIS]{2})\.([0-9OolIS]{4})"
SHORT = r"([0-9OolIS]{1,3}(?:\.[0-9OolIS]{3})+|[0-9]{2,8})"
LONG_NAMES = {
    "superior  tribunal  de  justica": "STJ", "supremo  tribunal  federal": "STF", "tribunal  superior  do  trabalho": "TST",
    "tribunal  superior  eleitoral": "TSE", "superior  tribunal  militar": "STM",
}
COURT_NAMES = " (stj|stf|tst|tse|stm|" + "|".join(LONG_NAMES) + ") "
ARTICLE = r"(?i:art(?:igo|s|\.)?)\.?\s*([0-9OolIS]{1,3}(?:\.[0-9OolIS]{3})|[0-9OolIS]{1,5}?)(?:[ºo°](?:[^A-Za-z0-9]|$)|[^A-Za-z0-9]|$)"
LAW = r"(?:lei(?: complementar)?|decreto-lei|lc) (?:no?\.? )?([0-9.]+)(?:/|,? de (?:.* de )?)([0-9]{4}|[0-9]{2})"
#: The last two capitals of a citation, set off by a stroke, dash or bracket: perhaps its state.
UF_END = r"(?:/|-|–|\() ?([A-Z][A-Z])(?: ?\))? *$"


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once: the plan holds a variable where f uses it, not copies of c."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_accents(c: Column) -> Column:
    """Plain letters for accented ones; combining marks and ordinal signs included."""
    return F.regexp_replace(F.translate(c, dims.ACCENTED, dims.PLAIN), r"[̀-ͯ]", "")


def fold(c: Column) -> Column:
    """Lower case without accents, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[\s ]+", " "))


def drop_invisible(c: Column) -> Column:
    return F.translate(c, dims.INVISIBLE, "")


def plain_spaces(c: Column) -> Column:
    return F.translate(c, dims.ODD_SPACES, " " * len(dims.ODD_SPACES))


def dehyphenate(c: Column) -> Column:
    """Words cut by a hyphen at one or two line ends put together."""
    return F.regexp_replace(c, rf"([{LETTER}])-(?:\r?\n){{1,2}}([{LETTER}])", "$1$2")


def collapse_marks(c: Column) -> Column:
    """One full stop or comma for several."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "."), ",{2,}", ",")


#: UTF-8 read as Windows-1252, for the letters and signs of the language.
MOJIBAKE = {
    c.encode("utf-8").decode("latin-1"): c for c in "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÇºª§°ñ"
} | {c.encode("utf-8").decode("cp1252"): c for c in "áâãéêíóôõúüçÂÃÉÊÓÔÕÚÇºª§°ñ—–“"}


def repair_mojibake(c: Column) -> Column:
    """Text-only repair of UTF-8 read as Windows-1252 or Latin-1; ambiguous forms stay. Texts without a lead character of such a form pass as they are."""
    out = c
    for bad in sorted(MOJIBAKE, key=lambda k: (-len(k), k)):
        out = F.replace(out, F.lit(bad), F.lit(MOJIBAKE[bad]))
    return F.when(c.rlike("[" + "".join(sorted({k[0] for k in MOJIBAKE})) + "]"), out).otherwise(c)


def clean(c: Column) -> Column:
    """Mojibake, invisible characters, hyphenation, odd spaces and repeated marks repaired, in this order."""
    return collapse_marks(plain_spaces(dehyphenate(drop_invisible(repair_mojibake(c)))))


def unglue(c: Column) -> Column:
    """A space between a lower and an upper case letter run together in a header (first 1,500 characters)."""
    head = F.regexp_replace(F.substring(c, 1, 1500), r"([a-zà-ÿ])([A-ZÀ-Ö]{2})", "$1 $2")
    return F.concat(head, F.substring(c, 1501, 2147483647))


def ocr_digits(c: Column) -> Column:
    """The digits of a number text, letters taken for digits included."""
    return F.regexp_replace(F.translate(c, dims.OCR_LETTERS, dims.OCR_DIGITS), r"[^0-9]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def is_numeric_token(c: Column) -> Column:
    """Digits and letters taken for digits, at most half of them letters."""
    letters = F.length(F.regexp_replace(c, r"[0-9]", ""))
    return c.rlike(r"^[0-9OoQDlIi|SsLgqGbBZz]+$") & c.rlike("[0-9]") & (letters * 2 <= F.length(c))


def is_number_marker(c: Column) -> Column:
    return F.lower(c).rlike(r"^(?:n[º°]|n\.?[º°]?|no|nr\.?|nro\.?|n[uú]m\.?|ri[º°]|u[º°]|u\.)$")


def is_date(c: Column) -> Column:
    return c.rlike(r"^[0-9OoGlI]{1,2}\s*[./-]\s*[0-9OoGlI]{1,2}\s*[./-]\s*(?:19|20)?[0-9OoGlI]{2}$") | c.rlike(r"^[0-9OoGlI]{1,2}/(?:19|20)[0-9OoGlI]{2}$")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether `long` begins with the first letter of `short` and has the others in this order."""
    return F.rlike(long, F.concat(F.lit("^"), F.regexp_replace(short, r"([a-z0-9])", "$1.*")))


def locate_number(c: Column) -> Column:
    """(raw, digits, fixes) of the first case number of a citation: the long form, else the short one."""
    raw = F.coalesce(F.nullif(F.regexp_extract(c, CNJ, 0), F.lit("")), F.nullif(F.regexp_extract(c, SHORT, 0), F.lit("")))
    return let(raw, lambda r: F.struct(r.alias("raw"), ocr_digits(r).alias("digits"), F.length(F.regexp_replace(r, r"[^A-Za-z|]", "")).alias("fixes")))


def cnj_seq(d: Column) -> Column:
    """Sequence number of a case number of 14 to 20 digits."""
    n = F.length(d)
    return F.when(n.between(14, 20), F.substring(d, F.lit(1), n - 13).try_cast("bigint"))


def cnj_tail(d: Column) -> Column:
    return F.when(F.length(d).between(14, 20), F.right(d, F.lit(13)))


def short_key(d: Column) -> Column:
    """The number of a short case number (at most 8 digits)."""
    return F.when(F.length(d).between(1, 8), d.try_cast("bigint"))


def cnj_justice(tail: Column) -> Column:
    """Court of the justice digit: 5 labour, 6 electoral, 7 military; null for others."""
    j = F.substring(tail, 7, 1)
    return F.when(j == "5", "TST").when(j == "6", "TSE").when(j == "7", "STM")


def format_cnj(seq: Column, tail: Column) -> Column:
    s = lambda a, n: F.substring(tail, a, n)
    return F.concat(F.lpad(seq.cast("string"), 7, "0"), F.lit("-"), s(1, 2), F.lit("."), s(3, 4), F.lit("."), s(7, 1), F.lit("."), s(8, 2), F.lit("."), s(10, 4))


def format_short(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def trailing_uf(c: Column) -> Column:
    """The state at the end of a citation, if it is one."""
    return let(F.regexp_extract(c, UF_END, 1), lambda uf: F.when(uf.isin(dims.UFS), uf))


def year4(y: Column) -> Column:
    """Four digits of a year of two (below 30: this century) or four; null for anything else."""
    return F.when(y.between(0, 29), y + 2000).when(y.between(30, 99), y + 1900).when(y.between(1000, 9999), y)


def is_year(c: Column) -> Column:
    return c.rlike(r"^(19|20)[0-9]{2}$")


def article_number(c: Column) -> Column:
    """Number of an article: 373, 1º, l5O -> 150."""
    n = F.regexp_extract(c, ARTICLE, 1)
    return F.nullif(F.regexp_replace(F.translate(n, "OolIS", "00115"), r"\.", ""), F.lit("")).try_cast("int")


ALIASES = {a: (k, y) for k, (y, names) in dims.DIPLOMAS.items() for a in names}
STATUTE = "(?:^|[^a-z])(" + "|".join(sorted(ALIASES, key=lambda a: (-len(a), a))) + ")(?:[^a-z]|$)"
CITED_YEAR = r"(?:/ ?|,? de )([0-9]{4}|[0-9]{2})$"


def lookup(table: dict, c: Column) -> Column:
    """Value of a small literal table; null for other keys."""
    return F.try_element_at(F.expr(f"map({', '.join(literal(x) for kv in table.items() for x in kv)})"), c)


def literal(x: str | float | tuple) -> str:
    """A value as SQL text: a table of values is one expression then, not one call each."""
    if isinstance(x, tuple):
        return f"array({', '.join(map(literal, x))})"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x}D"


def year_text(c: Column) -> Column:
    """Four digits, as text, of a year text of two or four digits."""
    return F.when(F.length(c) == 4, c).when(c.between("00", "29"), F.concat(F.lit("20"), c)).when(F.length(c) == 2, F.concat(F.lit("19"), c))


def diploma_key(folded: Column) -> Column:
    """Key of the statute named in a folded text: by law number, else by its name; another year than that in force gives KEY/YEAR, an unknown law LEI:number/year."""
    number = F.concat(F.nullif(F.replace(F.regexp_extract(folded, LAW, 1), F.lit("."), F.lit("")), F.lit("")), F.lit("/"), let(F.regexp_extract(folded, LAW, 2), year_text))
    cited = let(F.regexp_extract(folded, CITED_YEAR, 1), year_text)

    def named(name: Column) -> Column:
        key = lookup({a: k for a, (k, _) in ALIASES.items()}, name)
        force = lookup({a: str(y) for a, (_, y) in ALIASES.items()}, name)
        return let(cited, lambda c: F.when(c.isNull() | (c == force), key).otherwise(F.concat(key, F.lit("/"), c)))

    by_number = let(number, lambda n: F.coalesce(lookup(dims.LAW_NUMBERS, n), F.concat(F.lit("LEI:"), n)))
    return F.coalesce(by_number, let(F.regexp_extract(folded, STATUTE, 1), named))


def expanded(folded: Column) -> Column:
    """A folded text with the abbreviations of class and appeal names written out."""
    words = F.split(F.regexp_replace(folded, "[.]([a-z])", ". $1"), " ")
    return F.when(folded.rlike(r"[a-z]\."), F.array_join(F.transform(words, lambda w: F.coalesce(lookup(dims.ABBREVIATIONS, w), w)), " ")).otherwise(folded)


def spread_words(folded: Column) -> Column:
    """The words of a folded text, two spaces apart."""
    return F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), "[^a-z0-9]+", "  ")


def appeal_chain(folded: Column) -> Column:
    """Sorted bag of the appeal markers of a folded text."""
    def of(f: Column) -> Column:
        def counts(g: Column) -> Column:
            bags = []
            for k, words, whole in dims.MARKERS:
                n = F.regexp_count(g, F.lit(words))
                bags.append(F.array_repeat(F.lit(k), n + F.regexp_count(f, F.lit(whole)) if whole else n))
            return F.concat(*bags)

        return let(spread_words(expanded(f)), counts)

    return let(folded, of)


def before_number(c: Column) -> Column:
    """What stands before the first digit of a citation: its class and appeals."""
    return F.regexp_extract(c, "^[^0-9]*", 0)


def chain_distance(a: Column, b: Column) -> Column:
    """10 for each marker only one chain has, 1 for each difference in count."""
    def of(x: Column, y: Column) -> Column:
        out = 10 * (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))
        for k, *_ in dims.MARKERS:
            out = out + F.abs(F.size(F.filter(x, lambda z: z == k)) - F.size(F.filter(y, lambda z: z == k)))
        return out

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def class_code(text: Column) -> Column:
    """Class of a citation, from what stands before its number (a state follows it): the last abbreviation of a class, else the first name of one by preference."""
    codes = "|".join(c for c, _, _ in sorted(dims.CLASSES, key=lambda c: -len(c[0])))

    def of(left: Column) -> Column:
        short = F.regexp_extract_all(F.regexp_replace(F.concat(F.lit(" "), left, F.lit(" ")), r"[^A-Za-z]+", "  "), F.lit(rf" ({codes}) "), F.lit(1))
        named = let(expanded(fold(left)), lambda f: F.coalesce(*[F.when(f.contains(name), F.lit(code)) for code, name, _ in dims.CLASSES]))
        return F.coalesce(F.try_element_at(short, F.lit(-1)), named)

    return let(before_number(text), of)


def class_courts(code: Column) -> Column:
    """Courts that have a class; null for an unknown class."""
    return lookup({c: courts for c, _, courts in dims.CLASSES}, code)


def name_tokens(c: Column) -> Column:
    """Sorted distinct words of a name: titles, particles and words of up to two letters left out."""
    f = F.translate(fold(c), "01345", "oleas")
    words = F.split(F.regexp_replace(f, r"[^a-z]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(dims.NAME_STOP))))


def content_terms(c: Column) -> Column:
    """Distinct words of at least four letters, stop words left out."""
    words = F.regexp_extract_all(fold(c), F.lit(r"[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(dims.STOPWORDS)))


def courts_in(c: Column) -> Column:
    """Courts named in a text, in order, with repeats."""
    spread = F.regexp_replace(F.concat(F.lit(" "), fold(c), F.lit(" ")), "[^a-z]+", "  ")
    found = F.regexp_extract_all(spread, F.lit(COURT_NAMES), F.lit(1))
    def code(x: Column) -> Column:
        out = F.upper(x)
        for n, k in LONG_NAMES.items():
            out = F.when(x == n, F.lit(k)).otherwise(out)
        return out

    return F.transform(found, code)


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,x>>: start, end (code points, end exclusive) and text of every match, without a UDF.

    The matches and the texts between them alternate, so running lengths give the offsets.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("n"), h.alias("x")))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int,x:string>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = (acc["p"] + z["g"]).cast("int")
        e = (acc["p"] + z["g"] + z["n"]).cast("int")
        return F.struct(e.alias("p"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), z["x"].alias("x")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda z: z["x"].isNotNull()), start, step, lambda acc: acc["out"])


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over their union."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return inter / ((a1 - a0) + (b1 - b0) - inter)


def cover(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the smaller one."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.least(a1 - a0, b1 - b0)


def context(text: Column, start: Column, end: Column, before: int = 400, after: int = 160) -> Column:
    """The text around a span: `before` code points before it, the span, `after` behind."""
    lo = F.greatest(F.lit(0), start - before)
    return F.substring(text, lo + 1, end + after - lo)
