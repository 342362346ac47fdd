"""The registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeresolve.llm import abuse, bpe, mix, mojibake, names, scans, split, unify
from citeresolve.llm.rows import once
from citeresolve.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.same_looking_pairs(table(spark, d, "txt"), "trecho_id", "trecho", "trecho_a", "trecho_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every passage whose text is stored in several forms, with its class, its form and the form's representative."""
    return unify.classes(table(spark, d, "txt"), "trecho_id", "trecho")


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every passage once, in the common form."""
    return unify.unify(once(table(spark, d, "txt"), "trecho_id"), "trecho_id", "trecho")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.read(table(spark, d, "txt"), "trecho_id", "trecho", with_text=False).select("trecho_id")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with traces of a page once, as continuous paragraphs, with the traces found."""
    return scans.read(table(spark, d, "txt"), "trecho_id", "trecho").withColumn("traces", F.array_join("traces", ", "))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(once(table(spark, d, "txt"), "trecho_id"), "trecho_id", "trecho")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled passage once, restored as far as it can be, with the states found."""
    r = mojibake.repair(once(table(spark, d, "txt"), "trecho_id"), "trecho_id", "trecho").where("size(states) > 0")
    return r.select("trecho_id", "restored", F.array_join("states", ", ").alias("encodings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    e = names.entities(table(spark, d, "records"), table(spark, d, "apelidos"))
    return names.entity_pairs(e, "relator_a", "relator_b")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the entity it is linked to (the parts of its fullest spelling)."""
    return names.entities(table(spark, d, "records"), table(spark, d, "apelidos")).select(F.col("raw").alias("relator"), F.col("centre").alias("entidade"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_items(table(spark, d, "txt"), "trecho_id", "trecho", with_text=False)
    return pieces.where("pieces > 1").select("trecho_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every passage's pieces, each once."""
    return split.split_items(once(table(spark, d, "txt"), "trecho_id"), "trecho_id", "trecho")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def mixture(spark: SparkSession, d: str) -> mix.Mixture:
    return mix.Mixture(table(spark, d, "documents"), table(spark, d, "mistura"), bpe.token_counter(spark))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).ordered()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).report()


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of the mixture has the tokens it was allotted, up to one document, and uses no document too often."""
    m = mixture(spark, d)
    longest = m.sizes.groupBy(F.col("source").alias("fonte")).agg(F.max("n_tokens").alias("longest"))
    r = m.report().join(longest, "fonte", "left")
    return r.select("fonte", (F.abs(F.col("tokens") - F.col("wanted_tokens")) <= F.coalesce("longest", F.lit(0))).alias("as_wanted"), (F.col("most_used") <= F.col("max_repeticoes")).alias("within_repeats"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "rotulos")).where("passages > 0").select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its calibrated score, its significant passages and the worst of them."""
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "rotulos"), ["source"])


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_unified, p2_found, p2_repaired, p3_found, p3_restored, p4_found, p4_entities, p5_found, p5_pieces, p6_ids, p7_mixture, p7_shares, p7_check, p8_found, p8_scores, p8_rates)}
ORACLE = {
    "p5_found": "SELECT DISTINCT trecho_id FROM txt WHERE length(trecho) > 3000",
    "p1_found": f"""
WITH f AS (SELECT DISTINCT trecho_id, {unify.canonical_sql("trecho")} AS c, trecho FROM txt WHERE trecho IS NOT NULL)
SELECT DISTINCT a.trecho_id AS trecho_a, b.trecho_id AS trecho_b FROM f a JOIN f b ON a.c = b.c AND a.trecho_id < b.trecho_id AND a.trecho <> b.trecho
WHERE trim(a.c, chr(32) || chr(9) || chr(10) || chr(12)) <> ''""",
    "p1_unified": f"SELECT DISTINCT trecho_id, {unify.stored_sql('trecho')} AS canonico FROM txt",
    "p7_check": "SELECT DISTINCT fonte, TRUE AS as_wanted, TRUE AS within_repeats FROM mistura WHERE peso > 0 AND max_repeticoes >= 1",
}
