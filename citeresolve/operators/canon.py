"""Key tables from the headers of the canonical records.

Identifiers are not stored in columns: they are parsed from each record's text. A record that yields no key is
reported by `unindexed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeresolve import dims
from citeresolve.functions import text as X

#: A long number: 14 to 20 digits with full stops, hyphens and spaces between them. A short one: groups of three digits, or two to eight digits.
LONG = "[0-9][0-9. -]{13,29}[0-9]"
FIRST = "(?:^|[^0-9./-])([0-9]{1,3}(?:[.][0-9]{3})+|[0-9]{2,8})(?:[^0-9.]|$)"
#: Over folded first lines.
STATEMENT = "^ ?sumula (vinculante )?(?:n[.o]* )?([0-9]+) (?:do|da) ([a-z]+)"
STATEMENT_NUMBER = "sumula ([0-9]+)"
STATUTE_ARTICLE = "^ ?artigo ([0-9][0-9.]*)[^ ]* (?:do|da) (.+)$"


def first_line() -> Column:
    return X.fold(F.regexp_extract("texto", r"^\s*[^\n]*", 0))


def text_number(c: Column) -> Column:
    return F.nullif(F.replace(c, F.lit("."), F.lit("")), F.lit("")).try_cast("int")


def statements(docs: DataFrame) -> DataFrame:
    """(id, tribunal, numero, vinculante) of each binding statement, from its first line; else a number anywhere and the court's column."""
    s = docs.where("natureza = 'sumula'").select("id", "tribunal", first_line().alias("f"), X.fold(F.col("texto")).alias("all"))
    n, other = F.regexp_extract("f", STATEMENT, 2), F.regexp_extract("all", STATEMENT_NUMBER, 1)
    return s.select(
        "id",
        F.when(n != "", F.upper(F.regexp_extract("f", STATEMENT, 3))).when(other != "", F.col("tribunal")).alias("tribunal"),
        text_number(F.when(n != "", n).otherwise(other)).alias("numero"),
        (F.regexp_extract("f", STATEMENT, 1) != "").alias("vinculante"),
    )


def sumulas(docs: DataFrame) -> DataFrame:
    """(tribunal, numero, vinculante, doc_id): binding statements; of records with one key the last (greatest id) wins."""
    k = statements(docs).where("tribunal IS NOT NULL AND numero IS NOT NULL")
    return k.groupBy("tribunal", "numero", "vinculante").agg(F.max("id").cast("string").alias("doc_id"))


def statute_articles(docs: DataFrame) -> DataFrame:
    """(id, diploma, artigo) of each statute article, from its first line; thousands may be set off by a full stop."""
    d = docs.where("natureza = 'dispositivo'").select("id", first_line().alias("f"))
    name = F.regexp_extract("f", STATUTE_ARTICLE, 2)
    return d.select("id", X.diploma_key(name).alias("diploma"), text_number(F.regexp_extract("f", STATUTE_ARTICLE, 1)).alias("artigo"))


def dispositivos(docs: DataFrame) -> DataFrame:
    """(diploma, artigo, doc_id): statute articles; the last record of a key wins."""
    k = statute_articles(docs).where("diploma IS NOT NULL AND artigo IS NOT NULL")
    return k.groupBy("diploma", "artigo").agg(F.max("id").cast("string").alias("doc_id"))


def rulings(docs: DataFrame) -> DataFrame:
    """One row a ruling: own number (long form: seq, tail; short form: numero), state, appeal chain, class, year of four digits.

    The own number is the first long one of the header - of what follows TST there, for that court - else the first short one of the
    first line. Class and appeals are read from the line before it (for the labour court from the abbreviations before it), the state
    from right behind it.
    """
    r = docs.where("natureza NOT IN ('sumula', 'dispositivo') OR natureza IS NULL")
    r = r.withColumn("head", F.substring(X.unglue(F.col("texto")), 1, 1500)).withColumn("line", F.regexp_extract("head", r"^[^\n]*", 0))
    at = F.when(F.col("tribunal").eqNullSafe("TST") & F.col("head").contains("TST"), F.expr("substring(head, locate('TST', head))")).otherwise(F.col("head"))
    runs = F.regexp_extract_all(at, F.lit(LONG), F.lit(0))
    r = r.withColumn("own", F.try_element_at(F.filter(runs, lambda x: F.length(X.digits(x)).between(14, 20)), F.lit(1)))
    r = r.withColumn("short", F.when(F.col("own").isNull(), F.nullif(F.regexp_extract("line", FIRST, 1), F.lit(""))))
    r = r.withColumn("num", F.coalesce("own", "short"))
    r = r.withColumn("da", F.when(F.col("line").contains("TST-"), F.expr("substring(line, locate('TST-', line) + 3)")).otherwise(F.col("line")))
    r = r.withColumn("antes", F.expr("CASE WHEN num IS NULL OR locate(num, da) = 0 THEN da ELSE substring(da, 1, locate(num, da) - 1) END"))
    r = r.withColumn("uf", F.regexp_extract(F.expr("CASE WHEN locate(num, line) > 0 THEN substring(line, locate(num, line) + length(num)) END"), "^ ?[-–/]? ?([A-Z][A-Z])(?:[^A-Za-z]|$)", 1))
    d = X.digits(F.col("own"))
    return r.select(
        F.col("id").cast("string").alias("doc_id"),
        "tribunal",
        X.year4(F.col("ano")).alias("ano"),
        F.nullif(F.trim("relator"), F.lit("")).alias("relator"),
        X.cnj_seq(d).alias("seq"),
        X.cnj_tail(d).alias("tail"),
        X.short_key(X.digits(F.col("short"))).alias("numero"),
        F.when(F.col("uf").isin(dims.UFS), F.col("uf")).alias("uf"),
        X.appeal_chain(X.fold(F.col("antes"))).alias("chain"),
        F.coalesce(X.class_code(F.col("antes")), X.class_code(F.col("line"))).alias("classe"),
        F.substring("texto", 1, 4000).alias("inicio"),
    )


def cnj_keys(r: DataFrame) -> DataFrame:
    return r.where("seq IS NOT NULL").select("seq", "tail", "doc_id")


def short_keys(r: DataFrame) -> DataFrame:
    return r.where("numero IS NOT NULL").select("numero", "doc_id")


def relators(r: DataFrame) -> DataFrame:
    """Distinct sets of at least two name words."""
    return r.select(X.name_tokens(F.col("relator")).alias("tokens")).where("size(tokens) >= 2").distinct()


def terms(r: DataFrame) -> DataFrame:
    """(doc_id, termos): content words of each ruling's first 4,000 characters."""
    return r.select("doc_id", X.content_terms(F.col("inicio")).alias("termos"))


def unindexed(docs: DataFrame) -> DataFrame:
    """(id, natureza) of records without a key."""
    r = rulings(docs).where("seq IS NULL AND numero IS NULL").select(F.col("doc_id").cast("bigint").alias("id"))
    s = statements(docs).where("tribunal IS NULL OR numero IS NULL").select("id")
    d = statute_articles(docs).where("diploma IS NULL OR artigo IS NULL").select("id")
    return docs.select("id", "natureza").join(r.unionByName(s).unionByName(d), "id")
