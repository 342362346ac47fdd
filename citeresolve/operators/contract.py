"""The output contract: violations as rows, and the packed and nested forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeresolve.operators import spans


def rows_latest(citations: DataFrame) -> DataFrame:
    """One row a span: of rows repeated with a later time the latest."""
    key = ["documento_id", "inicio", "fim"]
    rest = [c for c in citations.columns if c not in key]
    best = citations.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("processado_em", F.coalesce("regra", F.lit("")), F.coalesce("confianca", F.lit(-1.0)))).alias("r"))
    return best.select(*key, "r.*")


def violations(citations: DataFrame, docs: DataFrame, base: DataFrame) -> DataFrame:
    """(documento_id, inicio, fim, regra): one row for each broken rule.

    V1 document without output, V3 missing field, V4 bounds, V5 text, V6 kind, V7 class, V8 real needs a record of the
    base, V9 others have none, V10 confidence, V11 overlap of half or more, V12 output without document.
    """
    c = F.col
    d = docs.select("documento_id", F.col("text").alias("_t"), F.lit(True).alias("_doc"))
    ids = base.select(c("id").cast("string").alias("id_canonico"), F.lit(True).alias("_in")).distinct()
    # the record of a citation is looked up before its text, so that texts are joined once
    j = citations.join(ids, "id_canonico", "left").join(d, "documento_id", "left")
    real, known = c("classificacao") == "real", c("_t").isNotNull()
    broken = {
        "V3": reduce(lambda a, b: a | b, [c(x).isNull() for x in ("inicio", "fim", "trecho", "tipo", "classificacao", "confianca")]),
        "V4": known & ((c("inicio") < 0) | (c("inicio") >= c("fim")) | (c("fim") > F.length("_t"))),
        "V5": known & (F.substring(c("_t"), c("inicio") + 1, c("fim") - c("inicio")) != c("trecho")),
        "V6": ~c("tipo").isin("lei", "jurisprudencia"),
        "V7": ~c("classificacao").isin("real", "inventada", "incompleta"),
        "V8": real & (c("id_canonico").isNull() | c("_in").isNull()),
        "V9": ~real & c("id_canonico").isNotNull(),
        "V10": ~c("confianca").between(0.0, 1.0),
        "V12": ~known,
    }
    rules = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in broken.items()]))
    none = docs.where("text IS NOT NULL").select("documento_id").join(citations.select("documento_id").distinct(), "documento_id", "left_anti")
    out = [
        none.select("documento_id", F.lit(None).cast("int").alias("inicio"), F.lit(None).cast("int").alias("fim"), F.lit("V1").alias("regra_violada")),
        j.select("documento_id", "inicio", "fim", F.explode(rules).alias("regra_violada")),
    ]
    pairs = spans.iou_pairs(citations.withColumn("_id", F.struct("inicio", "fim")), "documento_id", "inicio", "fim", "_id")
    out.append(pairs.select("documento_id", F.col("b_s").alias("inicio"), F.col("b_e").alias("fim"), F.lit("V11").alias("regra_violada")))
    return reduce(DataFrame.unionByName, out)


def nested(citations: DataFrame) -> DataFrame:
    """(documento_id, json): the contract's nested form of each document's citations, by start."""
    c = F.struct("inicio", "fim", "trecho", "tipo", "classificacao", F.when(F.col("id_canonico").isNotNull(), F.struct("id_canonico")).alias("resolucao"), "confianca")
    g = citations.groupBy("documento_id").agg(F.array_sort(F.collect_list(c)).alias("citacoes"))
    return g.select("documento_id", F.to_json(F.struct("documento_id", "citacoes")).alias("json"))


def packed(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """(documento_id, citacoes): `start,end,class,id,confidence` joined by |, `-` for what is absent and for documents without citations."""
    one = F.format_string(
        "%d,%d,%s,%s,%s", "inicio", "fim", "classificacao", F.coalesce("id_canonico", F.lit("-")), F.coalesce(F.format_string("%.4f", "confianca"), F.lit("-"))
    )
    g = citations.select("documento_id", F.struct("inicio", "fim", F.when(F.col("confianca").isNull(), F.regexp_replace(one, ",null$", ",-")).otherwise(one).alias("x")).alias("s"))
    g = g.groupBy("documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "|").alias("citacoes"))
    return docs.select("documento_id").distinct().join(g, "documento_id", "left").select("documento_id", F.coalesce("citacoes", F.lit("-")).alias("citacoes"))
