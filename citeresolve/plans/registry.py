"""Registered queries of the engine's operators over whole tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve import dims
from citeresolve.functions import fuzzy
from citeresolve.functions import text as X
from citeresolve.operators import canon, contract, extract, resolve, review, spans
from citeresolve.plans import sqltext as S
from citeresolve.session import materialize, shared_dir, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def cits(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each span of `citacoes`, with its key."""
    c = contract.rows_latest(table(spark, d, "citacoes"))
    return c.withColumn("cit", F.concat_ws(":", "documento_id", F.col("inicio").cast("string"), F.col("fim").cast("string")))


def latest(spark: SparkSession, d: str) -> DataFrame:
    """What is read of `cits` more than once, written once."""
    return materialize(cits(spark, d).select("cit", "documento_id", "inicio", "fim", "trecho", "tipo"), "cits")


def around(c: DataFrame, docs: DataFrame):
    """What gives the texts around some of the citations `c`: the documents are joined to those alone."""

    def of(few: DataFrame) -> DataFrame:
        return c.join(few, "cit", "left_semi").join(docs, "documento_id", "left").select("cit", X.context(F.col("text"), F.col("inicio"), F.col("fim")).alias("contexto"))

    return of


def mentions(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    docs = table(spark, d, "documents").select("documento_id", "text")
    c = (cits(spark, d) if c is None else c).join(docs, "documento_id", "left")
    after = F.substring(F.col("text"), F.col("fim") + 1, F.lit(160))
    return c.select("cit", "trecho", "tipo", X.context(F.col("text"), F.col("inicio"), F.col("fim")).alias("contexto"), after.alias("depois"))


def keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documentos")
    return canon.rulings(docs), canon.sumulas(docs), canon.dispositivos(docs)


def joined(c) -> F.Column:
    return F.array_join(c, " ")


# ---- scans and cleaning


@query("SELECT source, count(*) AS docs, count(text) AS with_text, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs, max(length(text))::BIGINT AS longest FROM documents GROUP BY source")
def scan_documents_profile(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"), F.max(F.length("text")).cast("bigint").alias("longest")
    )


@query(f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS hash FROM (SELECT doc_id, {S.clean('text')} AS t FROM documents)")
def clean_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("hash"))


@query(f"SELECT DISTINCT trecho_id, md5(t) AS hash FROM (SELECT trecho_id, trecho, {S.mojibake('trecho')} AS t FROM txt) WHERE t <> trecho")
def mojibake_text(spark, d):
    t = table(spark, d, "txt").select("trecho_id", "trecho", X.repair_mojibake(F.col("trecho")).alias("t"))
    return t.where("t <> trecho").select("trecho_id", F.md5("t").alias("hash")).distinct()


@query(r"""
WITH l AS (SELECT trecho_id, unnest(string_split(trecho, chr(10))) AS line, generate_subscripts(string_split(trecho, chr(10)), 1) AS pos FROM (SELECT DISTINCT trecho_id, trecho FROM txt WHERE trecho IS NOT NULL)),
n AS (SELECT trecho_id, pos, try_cast(regexp_extract(line, '^\s*([0-9]{1,3})(?:[^0-9]|$)', 1) AS INT) AS k FROM l WHERE regexp_matches(line, '^\s*[0-9]{1,3}(?:[^0-9]|$)')),
g AS (SELECT trecho_id, k, lag(k) OVER (PARTITION BY trecho_id ORDER BY pos) AS before FROM n),
r AS (SELECT trecho_id, count(*) AS lines, round(coalesce(avg(CASE WHEN before IS NOT NULL THEN CASE WHEN k > before THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS rising FROM g GROUP BY trecho_id)
SELECT *, rising >= 0.8 AS margin FROM r WHERE lines >= 5""")
def margin_number_rows(spark, d):
    return extract.margin_profile(table(spark, d, "txt"), "trecho_id", "trecho")


@query(f"SELECT doc_id, md5({S.fold('text')}) AS hash, len({S.terms('text')})::BIGINT AS terms FROM documents WHERE text IS NOT NULL")
def fold_terms(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.md5(X.fold(F.col("text"))).alias("hash"), F.size(X.content_terms(F.col("text"))).cast("bigint").alias("terms"))


@query(f"""
WITH t AS (SELECT DISTINCT trecho_id, trecho FROM txt WHERE trecho IS NOT NULL), w AS (SELECT unnest(regexp_extract_all(trecho, '[0-9A-Za-z|]+', 0)) AS w FROM t)
SELECT {S.ocr_digits('w')} AS digits, count(*) AS n FROM w WHERE regexp_matches(w, '^[0-9OoQlIi|SsLgqGbBZz]+$') AND regexp_matches(w, '[0-9]') AND length(regexp_replace(w, '[0-9]', '', 'g')) * 2 <= length(w)
  AND length(regexp_replace(w, '[0-9]', '', 'g')) > 0 GROUP BY 1""")
def ocr_digit_repair(spark, d):
    t = table(spark, d, "txt").where("trecho IS NOT NULL").select("trecho_id", "trecho").distinct()
    w = t.select(F.explode(F.regexp_extract_all("trecho", F.lit(r"[0-9A-Za-z|]+"), F.lit(0))).alias("w"))
    w = w.where(X.is_numeric_token(F.col("w")) & F.col("w").rlike("[^0-9]"))
    return w.groupBy(X.ocr_digits(F.col("w")).alias("digits")).agg(F.count("*").alias("n"))


# ---- keys of citations


@query(f"""
WITH {S.CIT}, n AS (SELECT cit, {S.raw_number('trecho')} AS raw, {S.uf('trecho')} AS uf FROM cit), g AS (SELECT *, {S.ocr_digits('raw')} AS dg, length(regexp_replace(raw, '[^A-Za-z|]', '', 'g'))::BIGINT AS fixes FROM n)
SELECT cit, dg AS digits, fixes, {S.seq('dg')} AS seq, {S.tail('dg')} AS tail, CASE substr({S.tail('dg')}, 7, 1) WHEN '5' THEN 'TST' WHEN '6' THEN 'TSE' WHEN '7' THEN 'STM' END AS justice, CASE WHEN {S.seq('dg')} IS NULL THEN {S.short('dg')} END AS numero, uf FROM g""")
def number_keys(spark, d):
    n = cits(spark, d).select("cit", X.locate_number(F.col("trecho")).alias("n"), X.trailing_uf(F.col("trecho")).alias("uf"))
    dg = F.col("n.digits")
    return n.select("cit", dg.alias("digits"), F.col("n.fixes").cast("bigint").alias("fixes"), X.cnj_seq(dg).alias("seq"), X.cnj_tail(dg).alias("tail"), X.cnj_justice(X.cnj_tail(dg)).alias("justice"), F.when(X.cnj_seq(dg).isNull(), X.short_key(dg)).alias("numero"), "uf")


@query(f"SELECT id, ano, {S.year4('ano')} AS ano4 FROM documentos")
def year_pivot(spark, d):
    return table(spark, d, "documentos").select("id", "ano", X.year4(F.col("ano")).alias("ano4"))


@query(f"WITH {S.CIT} SELECT cit, {S.article('trecho')} AS artigo, {S.diploma(S.fold('trecho'))} AS diploma FROM cit WHERE tipo = 'lei'")
def article_keys(spark, d):
    c = cits(spark, d).where("tipo = 'lei'").withColumn("f", X.fold(F.col("trecho")))
    return c.select("cit", X.article_number(F.col("trecho")).alias("artigo"), X.diploma_key(F.col("f")).alias("diploma"))


@query(f"WITH {S.CIT} SELECT cit, {S.class_code('trecho')} AS classe, array_to_string({S.chain(S.fold('trecho'))}, ' ') AS chain, array_to_string({S.courts('trecho')}, ' ') AS courts FROM cit")
def class_chain_court(spark, d):
    t = F.col("trecho")
    return cits(spark, d).select("cit", X.class_code(t).alias("classe"), joined(X.appeal_chain(X.fold(t))).alias("chain"), joined(X.courts_in(t)).alias("courts"))


@query(f"WITH x AS (SELECT doc_id, {S.courts('text')} AS c FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(c) AS court FROM x) SELECT court, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM e GROUP BY court")
def court_mentions(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.courts_in(F.col("text"))).alias("court"))
    return t.groupBy("court").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


PROCESS = r"(?:REsp|AREsp|RHC|RMS|HC|ARE|RE|Rcl|AR) (?:n\.?[º°]? ?)?[0-9OolIS]{1,3}(?:\.[0-9OolIS]{3})+(?:/[A-Z]{2})?"


@query(rf"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, {S.rx(PROCESS)}, 0) AS h, regexp_split_to_array(text, {S.rx(PROCESS)}) AS g FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(h) AS x, unnest(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i-1], lambda y: length(y))), 0))) AS s FROM x WHERE len(h) > 0)
SELECT doc_id, s::INT AS inicio, (s + length(x))::INT AS fim, x AS trecho FROM e""")
def process_spans(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.find_spans(F.col("text"), PROCESS)).alias("m"))
    return t.select("doc_id", F.col("m.s").alias("inicio"), F.col("m.e").alias("fim"), F.col("m.x").alias("trecho"))


# ---- interval operators


@query(f"""
WITH {S.CIT}, k AS (SELECT cit, fim, max(fim) OVER (PARTITION BY documento_id ORDER BY inicio, fim DESC, cit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cit)
SELECT cit FROM k WHERE m IS NULL OR fim > m""")
def span_containment(spark, d):
    return spans.contained_out(cits(spark, d), "documento_id", "inicio", "fim", ["cit"]).select("cit")


@query(f"""
WITH {S.CIT} SELECT a.cit FROM cit a WHERE a.regra IS NULL AND NOT EXISTS (SELECT 1 FROM cit b WHERE b.documento_id = a.documento_id AND b.regra IS NOT NULL AND a.inicio < b.fim AND b.inicio < a.fim)""")
def span_overlap_anti(spark, d):
    c = cits(spark, d)
    a = c.where("regra IS NULL").select("documento_id", F.col("inicio").alias("a_s"), F.col("fim").alias("a_e"), "cit")
    b = c.where("regra IS NOT NULL").select("documento_id", F.col("inicio").alias("b_s"), F.col("fim").alias("b_e"))
    return spans.overlap_anti(a, b, "documento_id").select("cit")


@query(f"""
WITH {S.CIT} SELECT a.cit, max(b.fim) AS floor FROM cit a LEFT JOIN cit b ON b.documento_id = a.documento_id AND b.tipo = 'lei' AND b.fim <= a.inicio WHERE a.tipo <> 'lei' GROUP BY a.cit""")
def asof_floor(spark, d):
    c = cits(spark, d)
    b = c.where("tipo = 'lei'").select("documento_id", F.col("inicio").alias("b_s"), F.col("fim").alias("b_e"))
    return spans.floor_end(c.where("tipo <> 'lei'"), b, "documento_id", "inicio").select("cit", "floor")


@query(f"""
WITH {S.CIT}, a AS (SELECT DISTINCT documento_id, inicio, fim FROM cit WHERE regra LIKE '%descritiva%'), b AS (SELECT documento_id, inicio AS bs, fim AS be FROM cit WHERE tipo = 'lei'),
j AS (SELECT a.documento_id, a.inicio, a.fim, bs, be, greatest(0, bs - a.fim, a.inicio - be) AS gap FROM a JOIN b USING (documento_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY documento_id, inicio, fim ORDER BY gap, bs, be) AS k FROM j WHERE gap <= 500)
SELECT documento_id, inicio, fim, bs, be, gap FROM r WHERE k = 1""")
def nearest_span(spark, d):
    c = cits(spark, d)
    a = c.where("regra LIKE '%descritiva%'").select("documento_id", F.col("inicio").alias("a_s"), F.col("fim").alias("a_e"))
    b = c.where("tipo = 'lei'").select("documento_id", F.col("inicio").alias("b_s"), F.col("fim").alias("b_e"))
    n = spans.nearest(a, b, "documento_id", 500)
    return n.select("documento_id", F.col("a_s").alias("inicio"), F.col("a_e").alias("fim"), F.col("b_s").alias("bs"), F.col("b_e").alias("be"), "gap")


@query(f"""
WITH {S.CIT} SELECT a.cit AS a, b.cit AS b, round({S.iou('a.inicio', 'a.fim', 'b.inicio', 'b.fim')}, 6) AS iou FROM cit a JOIN cit b ON a.documento_id = b.documento_id AND a.cit < b.cit AND a.inicio < b.fim AND b.inicio < a.fim
WHERE {S.iou('a.inicio', 'a.fim', 'b.inicio', 'b.fim')} >= 0.5""")
def iou_pairs(spark, d):
    p = spans.iou_pairs(cits(spark, d), "documento_id", "inicio", "fim", "cit")
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("iou", 6).alias("iou"))


@query(f"""
WITH RECURSIVE {S.CIT}, o AS (SELECT documento_id, cit, inicio, fim, row_number() OVER (PARTITION BY documento_id ORDER BY -coalesce(confianca, 0.0), inicio - fim, inicio, cit) AS k FROM cit),
f AS (SELECT documento_id, k, [{{'i': inicio, 'f': fim, 'c': cit}}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.documento_id, o.k, CASE WHEN len(list_filter(f.kept, lambda y: {S.iou('y.i', 'y.f', 'o.inicio', 'o.fim')} >= 0.5)) > 0 THEN f.kept ELSE list_append(f.kept, {{'i': o.inicio, 'f': o.fim, 'c': o.cit}}) END FROM f JOIN o ON o.documento_id = f.documento_id AND o.k = f.k + 1),
l AS (SELECT documento_id, max(k) AS k FROM f GROUP BY documento_id)
SELECT unnest(kept).c AS cit FROM f JOIN l USING (documento_id, k)""")
def iou_nms(spark, d):
    return spans.suppress(cits(spark, d), "documento_id", "inicio", "fim", "confianca", "cit").select("cit")


@query(f"WITH {S.CIT}, x AS (SELECT a.cit, a.inicio, a.fim FROM cit a) SELECT cit, (fim - inicio)::INT AS n FROM x")
def latest_spans(spark, d):
    return cits(spark, d).select("cit", (F.col("fim") - F.col("inicio")).cast("int").alias("n"))


# ---- key tables


@query(f"WITH {S.RULINGS} SELECT doc_id, tribunal, ano, relator, seq, tail, numero, uf, array_to_string(chain, ' ') AS chain, classe FROM rulings")
def canon_rulings(spark, d):
    r = canon.rulings(table(spark, d, "documentos"))
    return r.select("doc_id", "tribunal", "ano", "relator", "seq", "tail", "numero", "uf", joined("chain").alias("chain"), "classe")


SUM_SQL = f"""s_l AS (SELECT id, tribunal, {S.fold("string_split(ltrim(texto, chr(10) || chr(32)), chr(10))[1]")} AS f, {S.fold("texto")} AS t FROM documentos WHERE natureza = 'sumula'),
sk AS (SELECT id, CASE WHEN f LIKE 'sumula%' AND regexp_matches(f, '[0-9] d[oa] [a-z]') THEN upper(regexp_extract(f, '[0-9] d[oa] ([a-z]+)', 1)) WHEN regexp_matches(t, 'sumula [0-9]') THEN tribunal END AS tribunal,
  try_cast(CASE WHEN f LIKE 'sumula%' AND regexp_matches(f, '[0-9] d[oa] [a-z]') THEN regexp_extract(f, '([0-9]+) d[oa] ', 1) ELSE regexp_extract(t, 'sumula ([0-9]+)', 1) END AS INT) AS numero, f LIKE 'sumula vinculante %' AS vinculante FROM s_l),
sumulas_k AS (SELECT tribunal, numero, vinculante, cast(max(id) AS VARCHAR) AS doc_id FROM sk WHERE tribunal IS NOT NULL AND numero IS NOT NULL GROUP BY 1, 2, 3)"""
ART_SQL = f"""d_l AS (SELECT id, {S.fold("string_split(ltrim(texto, chr(10) || chr(32)), chr(10))[1]")} AS f FROM documentos WHERE natureza = 'dispositivo'),
d_m AS (SELECT id, try_cast(replace(regexp_extract(string_split(f, ' ')[2], '^[0-9][0-9.]*'), '.', '') AS INT) AS artigo, array_to_string(string_split(f, ' ')[4:], ' ') AS nome FROM d_l WHERE f LIKE 'artigo %'),
dk AS (SELECT id, artigo, {S.diploma("nome")} AS diploma FROM d_m),
dispositivos_k AS (SELECT diploma, artigo, cast(max(id) AS VARCHAR) AS doc_id FROM dk WHERE diploma IS NOT NULL AND artigo IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {S.RULINGS} SELECT doc_id, CASE WHEN seq IS NOT NULL THEN printf('%07d-%s.%s.%s.%s.%s', seq, substr(tail, 1, 2), substr(tail, 3, 4), substr(tail, 7, 1), substr(tail, 8, 2), substr(tail, 10, 4))
  ELSE regexp_replace(reverse(regexp_replace(reverse(numero::VARCHAR), '([0-9]{{3}})', '\\1.', 'g')), '^[.]', '') END AS numero FROM rulings""")
def format_numbers(spark, d):
    """Own numbers of rulings as they are written."""
    r = keys(spark, d)[0]
    return r.select("doc_id", F.coalesce(X.format_cnj(F.col("seq"), F.col("tail")), X.format_short(F.col("numero"))).alias("numero"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({S.fold("texto")}, '([a-z]{{2,4}})[.] ', 1)) AS short FROM documentos WHERE natureza = 'acordao' OR natureza IS NULL),
v AS (SELECT DISTINCT unnest(list_filter(string_split({S.fold("string_split(texto, chr(10))[1]")}, ' '), lambda x: regexp_matches(x, '^[a-z]{{5,}}$'))) AS word FROM documentos)
SELECT short, word FROM w JOIN v ON substr(short, 1, 1) = substr(word, 1, 1) AND regexp_matches(word, '^' || regexp_replace(short, '(.)', '\\1.*', 'g'))""")
def abbreviated_words(spark, d):
    """Abbreviations in rulings with the words of headers they may stand for: their letters in order, the first one first."""
    docs = table(spark, d, "documentos")
    w = docs.where("natureza = 'acordao' OR natureza IS NULL").select(F.explode(F.regexp_extract_all(X.fold(F.col("texto")), F.lit("([a-z]{2,4})[.] "), F.lit(1))).alias("short")).distinct()
    v = docs.select(F.explode(F.split(X.fold(F.regexp_extract("texto", r"^[^\n]*", 0)), " ")).alias("word")).where(F.col("word").rlike("^[a-z]{5,}$")).distinct()
    w, v = w.withColumn("k", F.substring("short", 1, 1)), v.withColumn("k", F.substring("word", 1, 1))
    return w.join(v, "k").where(X.is_subsequence(F.col("short"), F.col("word"))).select("short", "word")


@query(f"WITH {SUM_SQL} SELECT * FROM sumulas_k")
def canon_sumulas(spark, d):
    return canon.sumulas(table(spark, d, "documentos"))


@query(f"WITH {ART_SQL} SELECT * FROM dispositivos_k")
def canon_dispositivos(spark, d):
    return canon.dispositivos(table(spark, d, "documentos"))


@query(f"WITH {S.RULINGS} SELECT doc_id::BIGINT AS id, 'ruling' AS kind FROM rulings WHERE seq IS NULL AND numero IS NULL")
def canon_unindexed(spark, d):
    u = canon.unindexed(table(spark, d, "documentos"))
    return u.select("id", F.when(F.col("natureza").isin("sumula", "dispositivo"), F.col("natureza")).otherwise("ruling").alias("kind"))


@query(f"WITH {S.RULINGS} SELECT DISTINCT array_to_string({S.name_tokens('relator')}, ' ') AS tokens FROM rulings WHERE len({S.name_tokens('relator')}) >= 2")
def canon_relators(spark, d):
    return canon.relators(canon.rulings(table(spark, d, "documentos"))).select(joined("tokens").alias("tokens"))


# ---- resolution

_RAWS = "regexp_extract(f, '(?:sumula|sum\\.|enunciado)[^0-9]{0,30}?([0-9oli]{1,3}(?:\\.[0-9oli]{3})+|[0-9oli]*[0-9][0-9oli]*)', 1)"
_CL = f"regexp_replace(translate({_RAWS}, 'oli', '011'), '\\.', '', 'g')"
SUMJ = f"""s0 AS (SELECT cit, CASE WHEN NOT regexp_matches(trecho, ' d[oa] ?[A-Z]{{0,2}}$') AND length({_CL}) BETWEEN 1 AND 4 THEN try_cast({_CL} AS INT) END AS numero, length(regexp_replace({_RAWS}, '[0-9.]', '', 'g')) AS fixes, contains(f, 'vinculante') AS vinculante,
  CASE WHEN len({S.courts('trecho')}) > 0 THEN list_extract({S.courts('trecho')}, -1) WHEN contains(f, 'vinculante') THEN 'STF' END AS tribunal FROM m WHERE familia = 'sumulas'),
alone AS (SELECT numero, count(*) AS n, min(doc_id) AS one FROM sumulas_k WHERE NOT vinculante GROUP BY numero),
sj AS (SELECT s0.cit, s0.numero, fixes, k.doc_id, s0.tribunal, 0 AS n FROM s0 LEFT JOIN sumulas_k k USING (tribunal, numero, vinculante) WHERE s0.tribunal IS NOT NULL
  UNION ALL SELECT s0.cit, s0.numero, fixes, CASE WHEN n = 1 THEN one END, NULL, coalesce(n, 0) FROM s0 LEFT JOIN alone USING (numero) WHERE s0.tribunal IS NULL)"""
RULE_S = "CASE WHEN numero IS NULL OR (tribunal IS NULL AND n <> 1) THEN 'incompleta_sem_numero' WHEN doc_id IS NULL THEN CASE WHEN fixes > 0 THEN 'inventada_ocr' ELSE 'inventada' END WHEN fixes > 0 THEN 'real_ocr' ELSE 'real_exato' END"
SUMQ = S.labelled(RULE_S, "doc_id", "sj")
ARTJ = f"""a0 AS (SELECT cit, {S.diploma('f')} AS diploma, {S.article('trecho')} AS artigo FROM m WHERE familia = 'artigos'), aj AS (SELECT a0.*, k.doc_id FROM a0 LEFT JOIN dispositivos_k k USING (diploma, artigo))"""
RULE_A = "CASE WHEN diploma IS NULL OR artigo IS NULL THEN 'incompleta_sem_numero' WHEN doc_id IS NULL THEN 'inventada' ELSE 'real_exato' END"
ARTQ = S.labelled(RULE_A, "doc_id", "aj")
_NAME = "regexp_extract(trecho, '(?:relatoria d[aeo]s?|Rel\\.|Relatora?:?)\\s+(.+)$', 1)"
TOPQ = S.labelled("'inventada'", "CAST(NULL AS VARCHAR)", "(SELECT cit FROM m WHERE familia = 'temas')")
#: The labels of listed citations, but for those of descriptive mentions: which of these is labelled real does not depend on the records it describes.
GOLD = "g AS (SELECT cit, tipo, trecho, classificacao, id_canonico FROM cit WHERE NOT regexp_matches(trecho, '(?i)relatoria'))"


def undescribed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("trecho").rlike("(?i)relatoria"))


@query(f"WITH {S.CIT}, {GOLD} SELECT cit, classificacao, id_canonico FROM g WHERE tipo = 'jurisprudencia' AND NOT regexp_matches(nfc_normalize(trecho), '(?i)^tema|s[úu]m')")
def resolve_process(spark, d):
    """Numbered cases, against their labels."""
    m = resolve.family(undescribed(mentions(spark, d)))
    return resolve.processes(m, keys(spark, d)[0]).select("cit", "classificacao", "id_canonico")


@query(f"WITH {S.CIT}, {GOLD} SELECT cit, classificacao, id_canonico FROM g")
def resolve_gold(spark, d):
    """Class and record of every listed citation but descriptive ones, against their labels."""
    c = latest(spark, d)
    m = undescribed(mentions(spark, d, c))
    return resolve.resolve(m, *keys(spark, d), around(c, table(spark, d, "documents"))).select("cit", "classificacao", "id_canonico")


@query("""
WITH r AS (SELECT DISTINCT doc_id, classe, array_to_string(list_sort(chain), ' ') AS chain FROM records WHERE natureza = 'acordao' AND classe IS NOT NULL)
SELECT * FROM r""")
def canon_gold(spark, d):
    """Class and appeals read from the headers of rulings, against the records' columns."""
    k = table(spark, d, "records").where("natureza = 'acordao' AND classe IS NOT NULL").select("doc_id").distinct()
    return keys(spark, d)[0].join(k, "doc_id").select("doc_id", "classe", joined("chain").alias("chain"))


@query("SELECT 'sumula' AS kind, tribunal || ' ' || numero || ' ' || vinculante AS key, doc_id FROM sumulas UNION ALL SELECT 'dispositivo', diploma || ' ' || artigo, doc_id FROM dispositivos")
def canon_keys_gold(spark, d):
    """Keys of statements and statute articles read from their headers, against the tables of keys."""
    _, s, a = keys(spark, d)
    one = s.select(F.lit("sumula").alias("kind"), F.concat_ws(" ", "tribunal", F.col("numero").cast("string"), F.col("vinculante").cast("string")).alias("key"), "doc_id")
    return one.unionByName(a.select(F.lit("dispositivo").alias("kind"), F.concat_ws(" ", "diploma", F.col("artigo").cast("string")).alias("key"), "doc_id"))


@query(f"WITH {S.CIT}, {S.MENTIONS}, {SUM_SQL}, {SUMJ} {SUMQ}")
def resolve_sumula(spark, d):
    return resolve.sumula_mentions(resolve.family(mentions(spark, d)), keys(spark, d)[1])


@query(f"WITH {S.CIT}, {S.MENTIONS}, {ART_SQL}, {ARTJ} {ARTQ}")
def resolve_article(spark, d):
    return resolve.article_mentions(resolve.family(mentions(spark, d)), keys(spark, d)[2])


@query()
def resolve_descriptive(spark, d):
    return resolve.descriptive_mentions(resolve.family(mentions(spark, d)), keys(spark, d)[0])


@query(f"WITH {S.CIT}, {S.MENTIONS} {TOPQ}")
def resolve_topic(spark, d):
    return resolve.topic_mentions(resolve.family(mentions(spark, d)))


@query(f"WITH {S.CIT}, {GOLD} SELECT tipo, classificacao, count(*) AS n, count(DISTINCT id_canonico) AS records FROM g GROUP BY ROLLUP (tipo, classificacao)")
def resolve_summary(spark, d):
    """Counts of classes and records of all listed citations but descriptive ones, against their labels."""
    c = latest(spark, d)
    m = undescribed(mentions(spark, d, c))
    r = resolve.resolve(m, *keys(spark, d), around(c, table(spark, d, "documents")))
    j = undescribed(c).select("cit", "tipo").join(r, "cit")
    return j.rollup("tipo", "classificacao").agg(F.count("*").alias("n"), F.count_distinct("id_canonico").alias("records"))


_RUNS = f"list_transform(regexp_extract_all(trecho, {S.q(resolve.RUN)}), lambda x: {{'d': {S.ocr_digits('x')}, 'n': len(regexp_extract_all(x, '[0-9]'))}})"


@query(f"""
WITH {S.CIT}, {S.RULINGS}, n0 AS (SELECT cit, list_transform(list_filter({_RUNS}, lambda y: y.n * 2 >= length(y.d)), lambda y: y.d) AS nums FROM cit WHERE regra IS NULL OR regra LIKE 'inventada%'),
n1 AS (SELECT cit, list_filter(nums, lambda y: length(y) BETWEEN 14 AND 20) AS l, list_filter(nums, lambda y: length(y) BETWEEN 3 AND 8 AND NOT regexp_matches(y, '^(19|20)[0-9]{{2}}$')) AS s FROM n0)
SELECT n1.cit, min(r.doc_id) AS doc_id, count(*) AS n FROM n1 JOIN rulings r ON r.numero = try_cast(s[1] AS BIGINT) WHERE len(l) = 0 AND len(s) = 1 GROUP BY n1.cit""")
def resolve_retry(spark, d):
    return resolve.retry(cits(spark, d).where("regra IS NULL OR regra LIKE 'inventada%'"), keys(spark, d)[0])


@query(f"""
WITH {S.CIT}, {S.RULINGS}, c AS (SELECT cit, id_canonico, {S.chain(S.fold('trecho'))} AS chain FROM cit) SELECT c.cit, {S.chain_distance('c.chain', 'r.chain')}::INT AS dist FROM c JOIN rulings r ON c.id_canonico = r.doc_id""")
def chain_distances(spark, d):
    r = keys(spark, d)[0].select(F.col("doc_id").alias("id_canonico"), F.col("chain").alias("r_chain"))
    return cits(spark, d).join(r, "id_canonico").select("cit", X.chain_distance(X.appeal_chain(X.fold(F.col("trecho"))), F.col("r_chain")).cast("int").alias("dist"))


@query(f"""
WITH {S.CIT}, {S.MENTIONS}, {S.RULINGS} SELECT m.cit, len(list_intersect({S.terms('m.contexto')}, {S.terms('r.inicio_texto')}))::BIGINT AS common FROM m JOIN cit USING (cit) JOIN rulings r ON cit.id_canonico = r.doc_id WHERE m.contexto IS NOT NULL""")
def context_overlap(spark, d):
    c = cits(spark, d).where("id_canonico IS NOT NULL").select("cit", "id_canonico")
    m = mentions(spark, d).where("contexto IS NOT NULL").select("cit", "contexto")
    r = keys(spark, d)[0].select(F.col("doc_id").alias("id_canonico"), "inicio")
    j = m.join(c, "cit").join(r, "id_canonico")
    return j.select("cit", F.size(F.array_intersect(X.content_terms(F.col("contexto")), X.content_terms(F.col("inicio")))).cast("bigint").alias("common"))


@query(f"""
WITH {S.CIT}, {S.RULINGS}, n AS (SELECT DISTINCT {S.name_tokens(_NAME)} AS nome FROM cit WHERE regra LIKE '%descritiva%'), k AS (SELECT DISTINCT {S.name_tokens('relator')} AS tok FROM rulings WHERE len({S.name_tokens('relator')}) >= 2)
SELECT array_to_string(nome, ' ') AS nome, count(*) AS relators FROM n JOIN k ON len(list_filter(nome, lambda x: NOT list_contains(tok, x))) = 0 WHERE len(nome) >= 2 GROUP BY 1""")
def relator_subset(spark, d):
    """Names whose words are all in a known rapporteur's: joined on each name's rarest word, then checked."""
    name = F.regexp_extract("trecho", r"(?:relatoria d[aeo]s?|Rel\.|Relatora?:?)\s+(.+)$", 1)
    n = cits(spark, d).where("regra LIKE '%descritiva%'").select(X.name_tokens(name).alias("nome")).where("size(nome) >= 2").distinct()
    k = canon.relators(keys(spark, d)[0]).select("tokens", F.explode("tokens").alias("w"))
    freq = k.groupBy("w").agg(F.count("*").alias("f"))
    rare = n.select("nome", F.explode("nome").alias("w")).join(freq, "w").groupBy("nome").agg(F.min_by("w", F.struct("f", "w")).alias("w"))
    hit = rare.join(k, "w").where("size(array_except(nome, tokens)) = 0")
    return hit.groupBy(joined("nome").alias("nome")).agg(F.count("*").alias("relators"))


# ---- readings of models


@query("""
WITH i AS (SELECT DISTINCT documento_id, trecho, coalesce(numero, '') AS numero, coalesce(tribunal, '') AS tribunal FROM llm_items)
SELECT documento_id, trecho, min(numero) AS numero FROM i GROUP BY documento_id, trecho HAVING count(DISTINCT numero) = 1""")
def unanimity_vote(spark, d):
    i = table(spark, d, "llm_items").select(F.struct("documento_id", "trecho").alias("k"), F.coalesce("numero", F.lit("")).alias("numero"))
    return resolve.unanimous(i, "k", ["numero"]).select("k.documento_id", "k.trecho", "numero")


@query(f"""
WITH {S.CIT}, {S.RULINGS}, i AS (SELECT DISTINCT documento_id, modelo, trecho, {S.ocr_digits('numero')} AS dg FROM llm_items WHERE tipo = 'processo'),
p AS (SELECT i.documento_id, i.trecho, r.doc_id FROM i JOIN rulings r ON r.numero = CASE WHEN length(dg) <= 8 THEN try_cast(dg AS BIGINT) END)
SELECT documento_id, trecho, count(DISTINCT doc_id) AS n_proposals, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS id_canonico FROM p GROUP BY 1, 2""")
def ensemble_conflict(spark, d):
    dg = X.ocr_digits(F.col("numero"))
    i = table(spark, d, "llm_items").where("tipo = 'processo'").select("documento_id", "trecho", X.short_key(dg).alias("numero"))
    p = i.join(keys(spark, d)[0].where("numero IS NOT NULL").select("numero", F.col("doc_id").alias("id_canonico")), "numero")
    v = review.vote(p.withColumn("cit", F.struct("documento_id", "trecho")), "cit")
    return v.select("cit.documento_id", "cit.trecho", "n_proposals", "id_canonico")


@query("""
WITH r AS (SELECT source, doc_id, n_chars / 80.0 AS spent FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
w AS (SELECT *, count(*) OVER o AS n, coalesce(sum(spent) OVER o, 0.0) AS s, first_value(spent) OVER o AS f FROM r WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN (n > 3 AND (s - f) / (n - 1) > 25.0) OR s > 10800.0 THEN 1 ELSE 0 END AS over FROM w)
SELECT source, doc_id, max(over) OVER (PARTITION BY source ORDER BY doc_id) = 0 AS active FROM k""")
def budget_cutoff(spark, d):
    r = table(spark, d, "documents").where("source IS NOT NULL AND n_chars IS NOT NULL").select("source", "doc_id", (F.col("n_chars") / 80.0).alias("spent"))
    return review.within_budget(r, "doc_id", "spent", mean=25.0, by="source").select("source", "doc_id", "active")


@query("""
WITH i AS (SELECT DISTINCT documento_id, modelo, trecho FROM llm_items WHERE trecho IS NOT NULL AND documento_id IS NOT NULL)
SELECT documento_id, trecho FROM i WHERE modelo = 'leitor-a' EXCEPT SELECT documento_id, trecho FROM i WHERE modelo = 'leitor-b'""")
def cache_misses(spark, d):
    i = review.items(table(spark, d, "llm_items")).withColumn("key", review.cache_key(F.col("documento_id"), F.col("trecho")))
    return review.misses(i.where("modelo = 'leitor-a'"), i.where("modelo = 'leitor-b'")).select("documento_id", "trecho").distinct()


@query("""
WITH i AS (SELECT DISTINCT documento_id, trecho FROM llm_items WHERE trecho IS NOT NULL)
SELECT i.documento_id, i.trecho, (strpos(d.text, i.trecho) - 1)::INT AS inicio, (strpos(d.text, i.trecho) - 1 + length(i.trecho))::INT AS fim FROM i JOIN documents d USING (documento_id) WHERE strpos(d.text, i.trecho) > 0""")
def align_exact(spark, d):
    i = table(spark, d, "llm_items").where("trecho IS NOT NULL").select("documento_id", "trecho").distinct()
    j = i.join(table(spark, d, "documents").select("documento_id", "text"), "documento_id").withColumn("p", F.expr("locate(trecho, text)")).where("p > 0")
    return j.select("documento_id", "trecho", (F.col("p") - 1).cast("int").alias("inicio"), (F.col("p") - 1 + F.length("trecho")).cast("int").alias("fim"))


@query()
def llm_review(spark, d):
    """Readings placed, guarded, matched to citations, resolved anew and settled by the vote."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("documento_id", "text")
    i = review.items(table(spark, d, "llm_items"))
    i = i.where(review.grounded(i)).withColumn("reading", F.concat_ws(":", "documento_id", "modelo", "trecho"))
    at = materialize(review.placed(i, docs), "review-placed")
    c = cits(spark, d)
    hit = review.matched(at, c)
    m = at.dropDuplicates(["reading"]).select(F.col("reading").alias("cit"), "trecho", F.when(F.col("tipo") == "artigo", "lei").otherwise("jurisprudencia").alias("tipo"), F.lit(None).cast("string").alias("contexto"))
    r = resolve.resolve(m, *keys(spark, d)).where("classificacao = 'real'").select(F.col("cit").alias("reading"), "id_canonico")
    return review.settle(c, review.vote(hit.join(r, "reading")))


@query()
def new_citations(spark, d):
    """Places of precise readings that cover no listed citation, resolved as new ones; `cit` names the place."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("documento_id", "text")
    i = review.items(table(spark, d, "llm_items"))
    i = i.where(review.grounded(i)).withColumn("reading", F.concat_ws(":", "documento_id", "modelo", "trecho"))
    own = docs.select("documento_id", F.transform(F.regexp_extract_all(F.substring("text", 1, 1500), F.lit(r"Autos n\S* ([0-9.-]{10,30})"), F.lit(1)), X.digits).alias("numbers"))
    at = review.precise(review.placed(i, docs), review.header_end(docs, "documento_id", "text"), own)
    at = materialize(at, "review-precise")
    fresh = at.join(review.matched(at, cits(spark, d)).select("place").distinct(), "place", "left_anti")
    m = fresh.select(F.col("place").alias("cit"), "trecho", F.when(F.col("tipo") == "artigo", "lei").otherwise("jurisprudencia").alias("tipo"), F.lit(None).cast("string").alias("contexto"))
    return review.added(resolve.resolve(m, *keys(spark, d)))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(substr(text, 1, 1500), chr(10))) AS line, generate_subscripts(string_split(substr(text, 1, 1500), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
SELECT doc_id, coalesce(min(CASE WHEN length(line) >= 70 THEN pos END), 0)::BIGINT AS header_end FROM a GROUP BY doc_id""")
def header_end(spark, d):
    return review.header_end(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query()
def chunk_documents(spark, d):
    return extract.chunks(table(spark, d, "documents"), "doc_id", "text")


# ---- output


@query(f"""
WITH {S.CIT}, g AS (SELECT documento_id, string_agg(inicio || ',' || fim || ',' || classificacao || ',' || coalesce(id_canonico, '-') || ',' || coalesce(printf('%.4f', confianca), '-'), '|' ORDER BY inicio, fim) AS c FROM cit GROUP BY documento_id)
SELECT DISTINCT d.documento_id, coalesce(c, '-') AS citacoes FROM documents d LEFT JOIN g USING (documento_id)""")
def submission_rows(spark, d):
    return contract.packed(cits(spark, d), table(spark, d, "documents"))


@query()
def contract_json(spark, d):
    return contract.nested(cits(spark, d))


@query(f"""
WITH {S.CIT}, j AS (SELECT c.*, d.text AS t, d.documento_id IS NOT NULL AS known FROM cit c LEFT JOIN documents d USING (documento_id)), b AS (SELECT DISTINCT cast(id AS VARCHAR) AS i FROM documentos),
v AS (SELECT d.documento_id, NULL::INT AS inicio, NULL::INT AS fim, 'V1' AS r FROM documents d WHERE text IS NOT NULL AND documento_id NOT IN (SELECT documento_id FROM cit)
UNION ALL SELECT documento_id, inicio, fim, 'V3' FROM cit WHERE inicio IS NULL OR fim IS NULL OR trecho IS NULL OR tipo IS NULL OR classificacao IS NULL OR confianca IS NULL
UNION ALL SELECT documento_id, inicio, fim, 'V4' FROM j WHERE t IS NOT NULL AND (inicio < 0 OR inicio >= fim OR fim > length(t))
UNION ALL SELECT documento_id, inicio, fim, 'V5' FROM j WHERE t IS NOT NULL AND substr(t, inicio + 1, fim - inicio) <> trecho
UNION ALL SELECT documento_id, inicio, fim, 'V6' FROM cit WHERE tipo NOT IN ('lei', 'jurisprudencia')
UNION ALL SELECT documento_id, inicio, fim, 'V7' FROM cit WHERE classificacao NOT IN ('real', 'inventada', 'incompleta')
UNION ALL SELECT documento_id, inicio, fim, 'V8' FROM cit LEFT JOIN b ON b.i = id_canonico WHERE classificacao = 'real' AND (id_canonico IS NULL OR b.i IS NULL)
UNION ALL SELECT documento_id, inicio, fim, 'V9' FROM cit WHERE classificacao <> 'real' AND id_canonico IS NOT NULL
UNION ALL SELECT documento_id, inicio, fim, 'V10' FROM cit WHERE NOT confianca BETWEEN 0.0 AND 1.0
UNION ALL SELECT documento_id, inicio, fim, 'V12' FROM j WHERE t IS NULL
UNION ALL SELECT a.documento_id, b.inicio, b.fim, 'V11' FROM cit a JOIN cit b ON a.documento_id = b.documento_id AND (a.inicio < b.inicio OR (a.inicio = b.inicio AND a.fim < b.fim)) AND a.inicio < b.fim AND b.inicio < a.fim WHERE {S.iou('a.inicio', 'a.fim', 'b.inicio', 'b.fim')} >= 0.5)
SELECT r AS rule, count(*) AS n, count(DISTINCT documento_id) AS docs FROM v GROUP BY r""")
def contract_violations(spark, d):
    v = contract.violations(cits(spark, d), table(spark, d, "documents"), table(spark, d, "documentos"))
    return v.groupBy(F.col("regra_violada").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("documento_id").alias("docs"))


@query(f"WITH {S.CIT} SELECT documento_id, count(*) AS n, count_if(classificacao = 'real') AS n_real, count_if(classificacao = 'inventada') AS n_inventada, count_if(classificacao = 'incompleta') AS n_incompleta FROM cit GROUP BY ROLLUP (documento_id)")
def class_counts(spark, d):
    n = lambda k: F.count_if(F.col("classificacao") == k)
    return cits(spark, d).rollup("documento_id").agg(F.count("*").alias("n"), n("real").alias("n_real"), n("inventada").alias("n_inventada"), n("incompleta").alias("n_incompleta"))


# ---- extraction and fuzzy functions


@query()
def extract_citations(spark, d):
    return extract.extract(table(spark, d, "documents"), "documento_id", "text")


@query()
def extract_and_resolve(spark, d):
    """Every citation found in the documents, resolved."""
    docs = table(spark, d, "documents").select("documento_id", "text")
    s = materialize(extract.extract(docs, "documento_id", "text"), "spans")
    cit = F.concat_ws(":", "documento_id", F.col("inicio").cast("string"), F.col("fim").cast("string"))
    after = F.substring(F.col("text"), F.col("fim") + 1, F.lit(160))
    m = s.join(docs, "documento_id").select(cit.alias("cit"), "trecho", "tipo", X.context(F.col("text"), F.col("inicio"), F.col("fim")).alias("contexto"), after.alias("depois"))
    s = s.withColumn("cit", cit)
    r = resolve.resolve(m, *keys(spark, d), around(s, docs))
    return s.join(r, "cit").drop("cit")


@query()
def extraction_overlap(spark, d):
    """Found citations by family and origin: those that are a listed span, that overlap one, and that overlap none (not every citation is listed)."""
    s = extract.extract(table(spark, d, "documents"), "documento_id", "text").select("documento_id", F.col("inicio").alias("a_s"), F.col("fim").alias("a_e"), "familia", "origem")
    s = materialize(s, "spans")
    b = cits(spark, d).select("documento_id", F.col("inicio").alias("b_s"), F.col("fim").alias("b_e"))
    over = spans.overlap_join(s, b, "documento_id").groupBy("documento_id", "a_s", "a_e").agg(F.max(((F.col("a_s") == F.col("b_s")) & (F.col("a_e") == F.col("b_e"))).cast("int")).alias("same"))
    j = s.join(over, ["documento_id", "a_s", "a_e"], "left")
    return j.groupBy("familia", "origem").agg(F.count("*").alias("found"), F.count_if(F.expr("same = 1")).alias("listed"), F.count_if(F.expr("same = 0")).alias("overlapping"), F.count_if(F.expr("same IS NULL")).alias("unlisted"))


@query()
def extraction_recall(spark, d):
    """Listed citations whose span was found, by kind."""
    s = extract.extract(table(spark, d, "documents"), "documento_id", "text").select("documento_id", "inicio", "fim", F.lit(1).alias("hit"))
    j = cits(spark, d).join(s, ["documento_id", "inicio", "fim"], "left")
    return j.groupBy("tipo").agg(F.count("*").alias("listed"), F.count("hit").alias("found"))


@query()
def fuzzy_name_match(spark, d):
    """Descriptive citations whose rapporteur resembles one of a ruling of that court and year."""
    r = keys(spark, d)[0].where("relator IS NOT NULL").select("tribunal", "ano", "doc_id", X.name_tokens(F.col("relator")).alias("r"))
    m = resolve.family(cits(spark, d)).where("familia = 'descritivos'")
    name = F.regexp_extract("trecho", r"(?:relatoria d[aeo]s?|Rel\.|Relatora?:?)\s+(.+)$", 1)
    year = F.regexp_extract("trecho", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    m = m.select("cit", F.try_element_at(X.courts_in(F.col("trecho")), F.lit(1)).alias("tribunal"), year.alias("ano"), X.name_tokens(name).alias("c"))
    m, by = materialize(m, "fuzzy-described"), ["tribunal", "ano"]
    known = materialize(r.groupBy(*by, F.col("r").alias("r_nome")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "fuzzy-known")
    records = resolve.alike_names(m.withColumnRenamed("c", "nome"), known, by).join(known, [*by, "r_nome"]).groupBy(*by, F.col("nome").alias("c")).agg(F.sum("n").alias("records"), F.min("doc_id").alias("doc_id"))
    return m.join(records, [*by, "c"]).groupBy("cit").agg(F.sum("records").alias("records"), F.min("doc_id").alias("doc_id"))


@query()
def vocab_repair(spark, d):
    """First lines of rulings with words repaired and abbreviations expanded."""
    return table(spark, d, "documentos").select("id", fuzzy.canonical(F.regexp_extract("texto", r"^[^\n]*", 0)).alias("titulo"))


@query()
def number_groups(spark, d):
    return cits(spark, d).select("cit", F.array_join(fuzzy.numbers_in("trecho"), " ").alias("numeros"))


@query()
def skeleton_match(spark, d):
    """Readings and citations of a document that are equal up to shapes taken for each other: an equi join on skeletons."""
    i = table(spark, d, "llm_items").where("trecho IS NOT NULL").select("documento_id", "trecho").distinct().withColumn("sk", fuzzy.skeleton_of("trecho"))
    c = cits(spark, d).select("documento_id", "cit", fuzzy.skeleton_of("trecho").alias("sk"))
    return i.join(c, ["documento_id", "sk"]).select("documento_id", "cit", "trecho")


# ---- stream


@query("""
WITH f AS (SELECT documento_id, text FROM documents WHERE recebido_em IS NOT NULL)
SELECT documento_id, length(text)::BIGINT AS n FROM f""")
def stream_documents(spark, d):
    """The documents read as a stream with repeated deliveries dropped by watermark, written by foreachBatch and read back."""
    import uuid

    from citeresolve.streaming import files

    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    s = files.fresh(files.document_stream(spark, f"{d}/documents.parquet*", schema), ["documento_id"], "recebido_em", "3650 days")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("documento_id", F.length("text").cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("documento_id", "n")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Citations found in the documents and resolved, counted by class and rule."""
    r = extract_and_resolve(spark, d)
    return r.groupBy("tipo", "classificacao", "regra").agg(F.count("*").alias("n"), F.avg("confianca").alias("confianca"))
