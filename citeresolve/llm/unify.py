"""Problem 1: bring text that looks the same into one form, and find rows that differ only in their characters.

Method: DuckDB runs inside the Arrow partitions. One embedded SQL expression maps, in this order: line ends to \\n,
invisible characters to nothing, compatibility forms that expand to several characters (ligatures, roman numeral
characters, the ellipsis) by replacement, every one-to-one form (full and half width, styled letters, special
spaces, hyphens, look-alike letters of other scripts) by one translate, and the rest by nfc_normalize.

A form is mapped only where a reader sees no other sign: superscripts, fractions, ordinal signs, dashes, quotation
marks, letter case, accents, line breaks and runs of spaces stay as they are.

Two forms are made of a text. Its key, by which texts are compared, has every look-alike letter mapped. Its stored form keeps
words of another script: a word with a letter that no Latin one looks like, and a word of look-alikes alone beside such a
word ("Россия и СССР"). Any other look-alike is mapped there too.

Defined results: null stays null; an empty text stays empty; texts that are blank in the common form pair with none;
a row delivered repeatedly counts once; ids of null take no part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeresolve.session import materialize

#: Tasks over which the rows of one text are spread.
SALTS = 8
#: Letters of other scripts that cannot be told from a Latin letter (fixed values, Unicode's confusables data).
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXQWaesijopcyxhdqwl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"
OTHER, OTHER_AS = "ɡ‐‑µ", "g--μ"
#: Invisible characters (fixed values): zero width, joiners, direction marks, soft hyphen, variation selectors, fillers.
INVISIBLE = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}]"


#: A text of these characters alone is its own common form: no form maps them and none combines with another.
STABLE = r"[\x{01}-\x{0c}\x{0e}-\x{7f}\x{a1}-\x{ac}\x{ae}-\x{b4}\x{b6}-\x{ff}\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}\x{20ac}]*"


def look_alikes() -> dict[str, str]:
    """Letters of other scripts that look like a Latin letter, with their accented forms."""
    out = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))
    for c in map(chr, range(0x370, 0x530)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in out and len(to := unicodedata.normalize("NFC", out[d[0]] + d[1:])) == 1:
            out[c] = to
    return out


def forms() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms by rule from the Unicode database, with the look-alikes: (one character for one, several for one)."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for c in map(chr, range(0xA0, 0x1FBFA)):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind not in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"):
            continue
        to = unicodedata.normalize("NFKC", c)
        if kind == "<compat>":
            letters = to.isascii() and to.isalpha()
            if not (to == " " or 0xFB00 <= ord(c) <= 0xFB17 or letters and not 0x249C <= ord(c) <= 0x24B5 or set(to) == {"."}) or 0x2100 <= ord(c) <= 0x214F or 0x3200 <= ord(c) <= 0x33FF:
                continue
        (single if len(to) == 1 else several)[c] = to
    single |= dict(zip(OTHER, OTHER_AS)) | look_alikes()
    return single, several


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _translate(e: str, table: dict[str, str]) -> str:
    return f"translate({e}, {sql_text(''.join(table))}, {sql_text(''.join(table.values()))})"


def _prepared(column: str, several: dict[str, str]) -> str:
    e = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    e = f"regexp_replace({e}, {sql_text(INVISIBLE)}, '', 'g')"
    for c, to in sorted(several.items()):
        e = f"replace({e}, {sql_text(c)}, {sql_text(to)})"
    return e


def canonical_sql(column: str = "t") -> str:
    """The DuckDB expression of the key of `column`."""
    single, several = forms()
    return f"nfc_normalize({_translate(_prepared(column, several), single)})"


FOREIGN = r"[\p{Cyrillic}\p{Greek}]"


def stored_sql(column: str = "t") -> str:
    """The DuckDB expression of the stored form of `column`: as the key, but words of another script stay."""
    single, several = forms()
    alike = look_alikes()
    plain = {c: to for c, to in single.items() if c not in alike}
    foreign = lambda w: f"coalesce(regexp_matches(translate({w}, {sql_text(''.join(alike))}, ''), {sql_text(FOREIGN)}), FALSE)"
    kept = f"{foreign('w')} OR NOT regexp_matches(w, '\\p{{Latin}}') AND ({foreign('l[i - 2]')} OR {foreign('l[i + 2]')})"
    each = f"list_transform(l, lambda w, i: CASE WHEN {kept} THEN w ELSE {_translate('w', alike)} END)"
    words = "regexp_extract_all(c, '[\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]+')"
    return f"(SELECT nfc_normalize(CASE WHEN regexp_matches(c, {sql_text(FOREIGN)}) THEN array_to_string({each}, '') ELSE c END) FROM (SELECT c, {words} AS l FROM (SELECT {_translate(_prepared(column, several), plain)} AS c)))"


def in_duckdb(select: str, schema: T.StructType):
    """A mapInArrow function that runs `select` over the batches (view `b`) of a partition in one DuckDB connection.

    Rows whose characters are all without another form (STABLE) are in the common form already; the SQL decides that
    per row by one pass of an automaton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": "500MB"}) as con:
            for b in batches:
                con.register("b", pa.Table.from_batches([b]))
                yield from con.sql(select).to_arrow_table().cast(arrow).to_batches()
                con.unregister("b")

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return run


def _form(column: str, sql: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, {sql_text(STABLE)}) THEN {column} ELSE {sql} END"


def unify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonico) with every text in its stored form. Map-only."""
    src = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = T.StructType([src.schema["i"], T.StructField("canonico", T.StringType())])
    return src.mapInArrow(in_duckdb(f"SELECT i, {_form('t', stored_sql('t'))} AS canonico FROM b", schema), schema).withColumnRenamed("i", id_col)


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canon, raw): 128-bit digests of the common form and of the stored text, for texts that aren't blank."""
    src = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    schema = T.StructType([src.schema["i"], T.StructField("canon", T.StringType()), T.StructField("raw", T.StringType())])
    q = f"SELECT i, md5(c) AS canon, md5(t) AS raw FROM (SELECT i, t, {_form('t', canonical_sql('t'))} AS c FROM b) WHERE trim(c, chr(32) || chr(9) || chr(10) || chr(12)) <> ''"
    return src.mapInArrow(in_duckdb(q, schema), schema)


def salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def to_all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, classe, forma, representante, formas, linhas) of every row whose text has a class of at least two stored forms.

    `classe` and `forma` are digests of the key and of the stored text; `representante` is the smallest id of the form,
    `formas` and `linhas` count the forms and rows of the class. Copies of one stored text never meet each other, and a
    text that a large share of the rows has is spread over SALTS tasks.
    """
    f = materialize(fingerprints(df, id_col, text_col).distinct(), "p1-fingerprints")
    forms_ = f.groupBy("canon", "raw").agg(F.count("*").alias("n"), F.min("i").alias("representante"))
    several = forms_.groupBy("canon").agg(F.count("*").alias("formas"), F.sum("n").alias("linhas")).where("formas > 1")
    chosen = forms_.join(several, "canon").select("canon", "raw", "representante", "formas", "linhas")
    out = salted(f, "i").join(to_all_salts(chosen), ["canon", "raw", "_s"])
    return out.select(F.col("i").alias(id_col), F.col("canon").alias("classe"), F.col("raw").alias("forma"), "representante", "formas", "linhas")


def same_looking_pairs(df: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """Pairs (a < b) of ids whose texts have one key but different stored characters.

    The pairs are made between the distinct stored forms of a class and only then expanded to the ids that have them.
    """
    members = materialize(classes(df, id_col, text_col).select(F.col(id_col).alias("i"), "classe", "forma"), "p1-members")
    forms_ = members.select("classe", "forma").distinct()
    pairs = forms_.withColumnRenamed("forma", "x").join(forms_.withColumnRenamed("forma", "y"), "classe").where("x < y").select("x", "y")
    left, right = (members.select(F.col("forma").alias(f), F.col("i").alias(i)) for f, i in (("x", "p"), ("y", "q")))
    out = salted(left, "p").join(to_all_salts(pairs), ["x", "_s"]).drop("_s")
    out = to_all_salts(out).join(salted(right, "q"), ["y", "_s"])
    return out.where("p <> q").select(F.least("p", "q").alias(a), F.greatest("p", "q").alias(b)).distinct()
