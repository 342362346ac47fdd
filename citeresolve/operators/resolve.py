"""Resolution of mentions against the key tables, one disjoint branch per family.

A mention is a row (cit, trecho, tipo, contexto): `cit` identifies it, `contexto` is the text around it. Digits are
never approximated; letters read for digits are counted as fixes. The key tables are joined by equality; a side is
broadcast only by the optimizer's own size limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve import dims
from citeresolve.functions import fuzzy
from citeresolve.functions import text as X
from citeresolve.session import materialize

OUT = ["cit", "classificacao", "id_canonico", "confianca", "regra"]
RELATOR_AFTER = r"^[^.;]{0,40}?Rel(?:ator[a]?)?\.?\s*(?:Min(?:istr[oa])?\.?)?\s*([A-ZÀ-Ö][^,;.()]{3,80})"


def family(m: DataFrame) -> DataFrame:
    """Mentions with their family - temas, sumulas, artigos, descritivos or processos - and the key of their text and what counts behind it."""
    f = X.fold(F.col("trecho"))
    descr = f.rlike("relatoria|rel\\. ?min|relator") & ~F.col("trecho").rlike(X.CNJ) & ~F.col("trecho").rlike(r"[0-9]{1,3}(?:\.[0-9OolIS]{3})+")
    fam = (
        F.when(f.rlike("^tema "), "temas").when(f.rlike("sumula|^sum\\."), "sumulas").when(F.col("tipo") == "lei", "artigos").when(descr, "descritivos").otherwise("processos")
    )
    # of the text behind a mention only this counts: a rapporteur, and a state that the mention lacks
    after = F.coalesce("depois", F.lit("")) if "depois" in m.columns else F.lit("")
    tail = F.concat(F.regexp_extract("trecho", r"[0-9](?:[^0-9]*)$", 0), after)
    m = m.withColumn("folded", f).withColumn("familia", fam).withColumn("relator_depois", F.regexp_extract(tail, RELATOR_AFTER, 1)).withColumn("cut", after.rlike("^/[A-Z]"))
    return m.withColumn("key", F.xxhash64("trecho", "relator_depois", "cut"))


def labelled(df: DataFrame, rule: Column, doc_id: Column) -> DataFrame:
    """The rule as classification, record and confidence."""
    conf = X.lookup(dims.CONFIDENCE, F.col("regra"))
    df = df.withColumn("regra", rule)
    cls = F.when(F.col("regra").startswith("real"), "real").when(F.col("regra").startswith("inventada"), "inventada").otherwise("incompleta")
    return df.select("cit", cls.alias("classificacao"), F.when(F.col("regra").startswith("real"), doc_id).alias("id_canonico"), conf.alias("confianca"), "regra")


#: A number broken off at the end of a citation: a last group of one or two digits, or the last part of a long number incomplete.
BROKEN = r"[0-9]\.[0-9]{1,2}/?$|-[0-9]{2}\.[0-9]{4}\.[0-9](?:\.[0-9]{0,2}(?:\.[0-9]{0,3})?)?$"
#: A citation broken off at its state.
BROKEN_STATE = "/[A-Za-z]?$"


#: A citation of a binding statement broken off at its court.
BROKEN_COURT = " d[oa] ?[A-Z]{0,2}$"
#: Digits and letters read for digits, with gaps.
RUN = r"[0-9OolISBGgqZ|](?:[ .\-/]?[0-9OolISBGgqZ|])*"


def other_number(trecho: Column) -> Column:
    """The digits of the only number of a mention when it is read again, letters for digits and gaps included: one long number, else one short one (3 to 8 digits) that is no year; null if there are several."""
    runs = F.transform(F.regexp_extract_all(trecho, F.lit(RUN), F.lit(0)), lambda x: F.struct(X.ocr_digits(x).alias("d"), F.regexp_count(x, F.lit("[0-9]")).alias("n")))
    read = F.transform(F.filter(runs, lambda x: x["n"] * 2 >= F.length(x["d"])), lambda x: x["d"])
    long, short = F.filter(read, lambda d: F.length(d).between(14, 20)), F.filter(read, lambda d: F.length(d).between(3, 8) & ~X.is_year(d))
    return F.when(F.size(long) == 1, F.element_at(long, 1)).when((F.size(long) == 0) & (F.size(short) == 1), F.try_element_at(short, F.lit(1)))


def features(m: DataFrame) -> DataFrame:
    """What a numbered case says of itself: (key, digits, fixes, again, broken, no_state, uf, chain, courts, named, rel), once for each text."""
    p = m.where("familia = 'processos'").select("key", "trecho", "folded", "relator_depois", "cut").dropDuplicates(["key"])
    p = p.select("*", X.locate_number(F.col("trecho")).alias("n"), other_number(F.col("trecho")).alias("other"))
    return p.select(
        "key",
        F.col("n.digits").alias("digits"),
        F.coalesce("n.fixes", F.lit(0)).alias("fixes"),
        F.when(F.col("other") != F.coalesce("n.digits", F.lit("")), F.col("other")).alias("again"),
        F.col("trecho").rlike(BROKEN).alias("broken"),
        (F.col("trecho").rlike(BROKEN_STATE) | F.col("cut")).alias("no_state"),
        X.trailing_uf(F.col("trecho")).alias("uf"),
        X.appeal_chain(F.col("folded")).alias("chain"),
        X.class_courts(X.class_code(F.col("trecho"))).alias("courts"),
        X.courts_in(F.col("trecho")).alias("named"),
        X.name_tokens(F.nullif(F.col("relator_depois"), F.lit(""))).alias("rel"),
    )


def candidates(p: DataFrame, rulings: DataFrame) -> DataFrame:
    """(key, again, doc_id, dist, other_rel) of the records with a mention's number - read anew (again) where the first reading has none -
    that nothing it says rules out."""
    ways = p.select("*", F.explode(F.array(F.struct(F.lit(0).alias("again_"), F.col("digits").alias("d")), F.struct(F.lit(1).alias("again_"), F.col("again").alias("d")))).alias("way"))
    d = F.col("way.d")
    ways = ways.select("key", "uf", "chain", "courts", "named", "rel", F.col("way.again_").alias("again"), X.cnj_seq(d).alias("seq"), X.cnj_tail(d).alias("tail"), F.when(X.cnj_seq(d).isNull(), X.short_key(d)).alias("numero"))
    r = rulings.select("doc_id", "seq", "tail", "numero", F.col("tribunal").alias("r_court"), F.col("uf").alias("r_uf"), F.col("chain").alias("r_chain"), F.col("relator").alias("r_rel"))
    long = ways.where("seq IS NOT NULL").drop("numero").join(r.where("seq IS NOT NULL").drop("numero"), ["seq", "tail"])
    long = long.where(F.col("r_court").isNull() | F.col("r_court").eqNullSafe(X.cnj_justice(F.col("tail")))).drop("seq", "tail")
    short = ways.where("numero IS NOT NULL").drop("seq", "tail").join(r.where("numero IS NOT NULL").drop("seq", "tail"), "numero").drop("numero")
    ok = (
        (F.col("courts").isNull() | F.col("r_court").isNull() | F.array_contains("courts", F.col("r_court")))
        & (F.col("uf").isNull() | F.col("r_uf").isNull() | (F.col("uf") == F.col("r_uf")))
        & ((F.size("named") == 0) | F.array_contains("named", F.col("r_court")))
    )
    c = long.unionByName(short).where(ok)
    c = c.select("key", "again", "doc_id", X.chain_distance(F.col("chain"), F.col("r_chain")).alias("dist"), "rel", "r_rel")
    # few mentions name a rapporteur: only their names are compared
    named = c.where("coalesce(size(rel), 0) > 0").withColumn("other_rel", ~F.coalesce(fuzzy.name_matches("rel", X.name_tokens(F.col("r_rel"))), F.lit(False)))
    return c.where("coalesce(size(rel), 0) <= 0").withColumn("other_rel", F.lit(False)).unionByName(named).drop("rel", "r_rel")


def processes(m: DataFrame, rulings: DataFrame, around: DataFrame | Callable[[DataFrame], DataFrame] | None = None, beginnings: DataFrame | None = None, salts: int = 8) -> DataFrame:
    """Numbered cases: candidates by key, filters that let unknown values pass, best candidate by rank.

    Mentions with one text are looked up once, so that a record cited over and over is joined once a text; the texts around the
    mention (`around`: cit, contexto, or what gives them for the mentions of a table) and of the record (`beginnings`: doc_id, inicio) are fetched only where several records are equally near.
    """
    around, beginnings = m if around is None else around, rulings if beginnings is None else beginnings
    p = materialize(features(m), "resolve-features")
    w = Window.partitionBy("key").orderBy("again", "dist", "other_rel")
    top = candidates(p, rulings).withColumn("k", F.rank().over(w)).where("k = 1").drop("k")
    top = top.groupBy("key", "again", "dist", "other_rel").agg(F.collect_list("doc_id").alias("docs"))
    mine = m.where("familia = 'processos'").select("cit", "key", F.pmod(F.xxhash64("cit"), F.lit(salts)).cast("int").alias("_s"))
    known = p.drop("again").join(top, "key", "left").select("key", "digits", "fixes", "broken", "no_state", "again", "dist", "other_rel", "docs").withColumn("_s", F.explode(F.array(*map(F.lit, range(salts)))))
    j = materialize(mine.join(known, ["key", "_s"]).drop("_s", "key"), "resolve-known")
    tied = j.where("size(docs) > 1").select("cit", F.explode("docs").alias("doc_id"))
    few = tied.select("cit").distinct()
    here = (around(few) if callable(around) else around.join(few, "cit", "left_semi")).select("cit", X.content_terms(F.col("contexto")).alias("here"))
    there = beginnings.join(tied.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", X.content_terms(F.col("inicio")).alias("there"))
    common = tied.join(here, "cit").join(there, "doc_id").select("cit", "doc_id", F.coalesce(F.size(F.array_intersect("here", "there")), F.lit(0)).alias("common"))
    best = common.groupBy("cit").agg(F.min_by("doc_id", F.struct(-F.col("common"), F.col("doc_id").cast("bigint"))).alias("best"))
    j = j.join(best, "cit", "left").withColumn("doc_id", F.coalesce("best", F.element_at("docs", 1)))
    fixes = F.greatest("fixes", F.coalesce("again", F.lit(0)))
    rule = (
        F.when((F.coalesce(F.length("digits"), F.lit(0)) == 0) & F.col("doc_id").isNull() | F.col("broken"), "incompleta_sem_numero")
        .when(F.col("no_state"), "incompleta_sem_numero")
        .when(F.col("doc_id").isNull(), F.when(fixes > 0, "inventada_ocr").otherwise("inventada"))
        .when(F.col("other_rel"), "real_atributo_divergente")
        .when(fixes > 0, "real_ocr")
        .when(F.size("docs") > 1, "real_duplicata")
        .when(F.col("dist") > 0, "real_cadeia_divergente")
        .otherwise("real_exato")
    )
    return labelled(j, rule, F.col("doc_id"))


def sumula_mentions(m: DataFrame, table: DataFrame) -> DataFrame:
    """Binding statements: on court, number and kind; without a court the Supreme Court if binding, else the number if it is unique."""
    s = m.where("familia = 'sumulas'")
    raw = F.regexp_extract("folded", r"(?:sumula|sum\.|enunciado)[^0-9]{0,30}?([0-9oli]{1,3}(?:\.[0-9oli]{3})+|[0-9oli]*[0-9][0-9oli]*)", 1)
    clean = F.regexp_replace(F.translate(raw, "oli", "011"), r"\.", "")
    vinc = F.col("folded").contains("vinculante")
    court = F.when(F.size(X.courts_in(F.col("trecho"))) > 0, F.element_at(X.courts_in(F.col("trecho")), -1)).when(vinc, "STF")
    cut = F.col("trecho").rlike(BROKEN_COURT)
    s = s.select("cit", F.when(~cut & F.length(clean).between(1, 4), clean.try_cast("int")).alias("numero"), F.length(F.regexp_replace(raw, "[0-9.]", "")).alias("fixes"), vinc.alias("vinculante"), court.alias("tribunal"))
    with_court = s.join(table, ["tribunal", "numero", "vinculante"], "left").where("tribunal IS NOT NULL")
    alone = table.where("NOT vinculante").groupBy("numero").agg(F.count("*").alias("n"), F.min("doc_id").alias("one"))
    without = s.where("tribunal IS NULL").join(alone, "numero", "left").withColumn("doc_id", F.when(F.col("n") == 1, F.col("one")))
    cols = ["cit", "numero", "fixes", "doc_id", "tribunal", F.lit(0).alias("n")]
    u = with_court.select(*cols).unionByName(without.select("cit", "numero", "fixes", "doc_id", "tribunal", F.coalesce("n", F.lit(0)).cast("int").alias("n")))
    rule = (
        F.when(F.col("numero").isNull() | (F.col("tribunal").isNull() & (F.col("n") != 1)), "incompleta_sem_numero")
        .when(F.col("doc_id").isNull(), F.when(F.col("fixes") > 0, "inventada_ocr").otherwise("inventada"))
        .when(F.col("fixes") > 0, "real_ocr")
        .otherwise("real_exato")
    )
    return labelled(u, rule, F.col("doc_id"))


def article_mentions(m: DataFrame, table: DataFrame) -> DataFrame:
    """Statute articles on (statute, article)."""
    a = m.where("familia = 'artigos'").select("cit", X.diploma_key(F.col("folded")).alias("diploma"), X.article_number(F.col("trecho")).alias("artigo"))
    j = a.join(table, ["diploma", "artigo"], "left")
    rule = F.when(F.col("diploma").isNull() | F.col("artigo").isNull(), "incompleta_sem_numero").when(F.col("doc_id").isNull(), "inventada").otherwise("real_exato")
    return labelled(j, rule, F.col("doc_id"))


#: Parts into which words are dealt; each part of one side meets each of the other in one task.
PARTS = 16


def alike_words(cited: DataFrame, known: DataFrame) -> DataFrame:
    """(c, r): every pair of distinct words of the columns c and r that resemble each other."""
    part = lambda df, c: df.select(c).distinct().groupBy(F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("_" + c)).agg(F.collect_list(c).alias(c))
    met = part(cited, "c").withColumn("_r", F.explode(F.array(*map(F.lit, range(PARTS))))).join(part(known, "r"), "_r").select("c", "r")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for x, y in zip(p["c"], p["r"]):
                for pairs in fuzzy.alike_pairs(list(x), list(y)):
                    yield pd.DataFrame(pairs, columns=["c", "r"])

    n = cited.sparkSession.sparkContext.defaultParallelism
    return met.repartition(4 * n).mapInPandas(run, "c string, r string")


def alike_names(asked: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(*by, nome, r_nome): every name asked for and every known one of the same `by` of which each word asked for resembles one of the known name.

    Distinct words are compared, once. A name is looked up by that of its words which the fewest known names have or resemble; its other words
    are checked by the words that resemble them.
    """
    a, k = asked.where("size(nome) > 0").select(*by, "nome").distinct(), known.select(*by, "r_nome").distinct()
    names = a.select("nome").distinct()
    words = names.select("nome", F.explode("nome").alias("c"))
    used = k.select("r_nome").distinct().select(F.explode("r_nome").alias("r")).groupBy("r").agg(F.count("*").alias("f"))
    pairs = materialize(alike_words(words, used), "resolve-words")
    like = pairs.join(used, "r").groupBy("c").agg(F.collect_list("r").alias("rs"), F.sum("f").alias("f"))
    of = words.join(like, "c").groupBy("nome").agg(F.collect_list("rs").alias("all"), F.min_by("rs", F.struct("f", "c")).alias("rarest"))
    of = materialize(of.where("size(all) = size(nome)"), "resolve-names")
    asked_by = a.join(of.select("nome", F.explode("rarest").alias("r")), "nome")
    met = asked_by.join(k.withColumn("r", F.explode("r_nome")), [*by, "r"]).drop("r")
    met = met.join(of.where("size(all) > 1").select("nome", "all"), "nome", "left")
    return met.where(F.col("all").isNull() | F.forall("all", lambda rs: F.arrays_overlap(rs, F.col("r_nome")))).select(*by, "nome", "r_nome").distinct()


def described(m: DataFrame) -> DataFrame:
    """(cit, tribunal, ano, classe, nome) of descriptive mentions, letters for digits in the year and capitals included."""
    t = F.col("trecho")
    courts = X.courts_in(t)
    year = F.regexp_extract("trecho", r"(?:^|[^0-9A-Za-z])((?:19|[2Z][0O])[0-9OolISB]{2})(?:[^0-9A-Za-z]|$)", 1)
    head = F.regexp_extract("trecho", r"(?i)^(.*?)(?:\b(?:stf|stj|tst|tse|stm)\b|19[0-9]{2}|20[0-9]{2}|relat|rel\.)", 1)
    name = F.regexp_extract("trecho", r"(?i)(?:relatoria d[aeo]s?|rel\.|relatora?:?)\s+(.+)$", 1)
    d = m.where("familia = 'descritivos'").select(
        "cit", F.try_element_at(courts, F.lit(1)).alias("named"), F.nullif(X.ocr_digits(F.nullif(year, F.lit(""))), F.lit("")).try_cast("int").alias("ano"), X.class_code(head).alias("classe"), X.name_tokens(name).alias("nome")
    )
    # a class that the court named doesn't have filters nothing
    possible = F.col("named").isNull() | F.coalesce(F.array_contains(X.class_courts(F.col("classe")), F.col("named")), F.lit(False))
    by_class = F.when(F.col("classe") == "Rcl", F.array(F.lit("STF"), F.lit("STJ"))).otherwise(F.array(X.lookup(dims.CLASS_COURT, F.col("classe"))))
    courts_ = F.array_compact(F.when(F.col("named").isNotNull(), F.array("named")).otherwise(by_class))
    return d.select("cit", courts_.alias("tribunais"), "ano", F.when(possible, F.col("classe")).alias("classe"), "nome")


def descriptive_mentions(m: DataFrame, rulings: DataFrame) -> DataFrame:
    """Court, year, rapporteur and class, if one is named: every word of the name cited must resemble one of the record's; one record is real, none or several are incomplete.

    Records are counted by name and class before names meet, so that no list of a name's records is made.
    """
    d = materialize(described(m), "resolve-described")
    by = ["tribunal", "ano"]
    r = rulings.where("relator IS NOT NULL AND ano IS NOT NULL").select(*by, "doc_id", "classe", X.name_tokens(F.col("relator")).alias("r_nome"))
    known = materialize(r.groupBy(*by, "r_nome", "classe").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")), "resolve-known")
    asked = d.select(F.explode("tribunais").alias("tribunal"), "ano", "nome")
    records = alike_names(asked, known, by).join(known, [*by, "r_nome"]).groupBy(*by, "nome", "classe").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    records = records.groupBy(*by, "nome").agg(F.collect_list(F.struct("classe", "n", "doc_id")).alias("found"))
    hit = d.select("cit", F.explode("tribunais").alias("tribunal"), "ano", "nome", F.col("classe").alias("c")).join(records, [*by, "nome"])
    hit = hit.withColumn("found", F.filter("found", lambda x: F.col("c").isNull() | (x["classe"] == F.col("c"))))
    hit = hit.groupBy("cit").agg(F.sum(F.aggregate("found.n", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"), F.min(F.array_min("found.doc_id")).alias("doc_id"))
    j = d.join(hit, "cit", "left")
    rule = (
        F.when((F.size("tribunais") == 0) | F.col("ano").isNull() | (F.size("nome") < 1), "incompleta_sem_numero")
        .when(F.coalesce("n", F.lit(0)) == 0, "incompleta_descritiva_sem_registro")
        .when(F.col("n") == 1, "real_descritiva")
        .otherwise("incompleta_descritiva")
    )
    return labelled(j, rule, F.col("doc_id"))


def topic_mentions(m: DataFrame) -> DataFrame:
    """Topics have no records: always invented."""
    return labelled(m.where("familia = 'temas'"), F.lit("inventada"), F.lit(None).cast("string"))


FAMILIES = ("processos", "sumulas", "artigos", "descritivos", "temas")


def resolve(mentions: DataFrame, rulings: DataFrame, sumulas: DataFrame, dispositivos: DataFrame, around: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(cit, classificacao, id_canonico, confianca, regra) of every mention (cit, trecho, tipo, contexto[, depois]).

    `around` gives (cit, contexto) for the mentions of a table (cit), where the texts aren't to be fetched for all; without it they are the column.

    A mention that can't be read (no text) is incomplete by the rule erro_interno; it takes no other with it.
    """
    m = family(mentions)
    known = F.col("familia").isin(*FAMILIES) & F.col("trecho").isNotNull()
    failed = labelled(m.where(~F.coalesce(known, F.lit(False))), F.lit("erro_interno"), F.lit(None).cast("string"))
    m = materialize(m.where(known).select("cit", "trecho", "tipo", "folded", "familia", "relator_depois", "cut", "key"), "resolve-mentions")
    r = materialize(rulings.drop("inicio"), "resolve-rulings")
    parts = [processes(m, r, around or mentions.select("cit", "contexto"), rulings.select("doc_id", "inicio")), sumula_mentions(m, sumulas), article_mentions(m, dispositivos), descriptive_mentions(m, r), topic_mentions(m), failed]
    out = parts[0].select(*OUT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*OUT))
    return out


def retry(mentions: DataFrame, rulings: DataFrame) -> DataFrame:
    """(cit, doc_id, n): records of the short number that mentions without a record have when they are read again."""
    p = mentions.select("cit", X.short_key(other_number(F.col("trecho"))).alias("numero")).where("numero IS NOT NULL")
    return p.join(rulings.where("numero IS NOT NULL").select("numero", "doc_id"), "numero").groupBy("cit").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def unanimous(df: DataFrame, key: str, value: list[str]) -> DataFrame:
    """Keys whose rows agree on all of `value`, with it."""
    v = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in value])
    return df.groupBy(key).agg(F.count_distinct(v).alias("n"), *[F.min(c).alias(c) for c in value]).where("n = 1").drop("n")
