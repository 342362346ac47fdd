"""Model readings as a table: items are aligned to the text, guarded, resolved anew and put to the vote.

Readings can propose a record for a citation the rules left open, or add citations; they never overrule a resolved
one, and readings that disagree change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve import dims
from citeresolve.functions import fuzzy
from citeresolve.functions import text as X
from citeresolve.operators import spans

#: Span beyond which a rule's span three times as long as the model's is cut down.
LONG, TIMES = 150, 3


def items(raw: DataFrame) -> DataFrame:
    """Distinct readings with a position-free key of the document, the model and the piece read."""
    return raw.where("trecho IS NOT NULL AND documento_id IS NOT NULL").dropDuplicates(["documento_id", "modelo", "trecho"])


def grounded(df: DataFrame) -> Column:
    """Guards: the number of a reading must be a whole number of its piece, its year stand in it, topics and statements be called so."""
    f = X.fold(F.col("trecho"))
    number = F.col("numero").isNull() | F.array_contains(fuzzy.numbers_in("trecho"), X.digits(F.col("numero")))
    year = F.col("ano").isNull() | F.col("trecho").contains(F.col("ano").cast("string"))
    topic = (F.col("tipo") != "tema") | f.contains("tema")
    statement = (F.col("tipo") != "sumula") | f.rlike("sumula|sum\\.|enunciado")
    return number & year & topic & statement


def placed(readings: DataFrame, docs: DataFrame, id_col: str = "documento_id", text_col: str = "text") -> DataFrame:
    """Readings with each of their spans in the document and the `place` that names it: every exact place and every one of an
    equal skeleton, else the most similar window. Readings that stand nowhere are dropped.

    The distinct pieces of a document are looked up together, so its skeleton is made once.
    """
    pieces = readings.groupBy("documento_id").agg(F.collect_set("trecho").alias("_p"))
    j = pieces.join(docs.select(F.col(id_col).alias("documento_id"), F.col(text_col).alias("_t")), "documento_id")
    at = j.select("documento_id", F.explode(fuzzy.all_places("_t", "_p")).alias("_s"))
    at = at.select("documento_id", F.col("_s.piece").alias("trecho"), F.col("_s.s").alias("inicio"), F.col("_s.e").alias("fim")).distinct()
    return readings.join(at, ["documento_id", "trecho"]).select(*readings.columns, "inicio", "fim", F.concat_ws(":", "reading", F.col("inicio").cast("string"), F.col("fim").cast("string")).alias("place"))


def matched(readings: DataFrame, citations: DataFrame) -> DataFrame:
    """Places of readings with the citation they cover: at least half of the shorter of the two spans."""
    a = readings.select("documento_id", F.col("inicio").alias("a_s"), F.col("fim").alias("a_e"), "reading", "place")
    b = citations.select("documento_id", F.col("inicio").alias("b_s"), F.col("fim").alias("b_e"), F.col("cit"))
    j = spans.overlap_join(a, b, "documento_id")
    return j.withColumn("cover", X.cover(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))).where("cover >= 0.5")


def precise(placed_: DataFrame, headers: DataFrame, own: DataFrame) -> DataFrame:
    """Places of readings that are no header line and not the document's own case number.

    `headers`: (documento_id, header_end); `own`: (documento_id, numbers), digits the document gives itself.
    """
    j = placed_.join(headers, "documento_id", "left").join(own, "documento_id", "left")
    dg = X.digits(F.coalesce("numero", F.lit("")))
    mine = F.exists(F.coalesce("numbers", F.array().cast("array<string>")), lambda n: (dg != "") & (n.contains(dg) | dg.contains(n)))
    return j.where((F.col("inicio") >= F.coalesce("header_end", F.lit(0))) & ~mine).select(*placed_.columns)


def vote(proposals: DataFrame, key: str = "cit") -> DataFrame:
    """(key, id_canonico, n_proposals): the one record all proposals of a citation agree on; null where they differ."""
    n = proposals.groupBy(key).agg(F.count_distinct("id_canonico").alias("n_proposals"), F.min("id_canonico").alias("one"))
    return n.select(key, F.when(F.col("n_proposals") == 1, F.col("one")).alias("id_canonico"), "n_proposals")


def settle(citations: DataFrame, votes: DataFrame) -> DataFrame:
    """Citations with the vote applied to those the rules left open; conflicts keep the rules' answer."""
    v = votes.select("cit", F.col("id_canonico").alias("voted"))
    j = citations.join(v, "cit", "left")
    take = (F.col("classificacao") != "real") & F.col("voted").isNotNull()
    return j.select(
        "cit",
        F.when(take, "real").otherwise(F.col("classificacao")).alias("classificacao"),
        F.when(take, F.col("voted")).otherwise(F.col("id_canonico")).alias("id_canonico"),
        F.when(take, F.lit(dims.REVIEW_CONFIDENCE["real_nlp"])).otherwise(F.col("confianca")).alias("confianca"),
        F.when(take, "real_nlp").otherwise(F.col("regra")).alias("regra"),
    )


def added(resolved: DataFrame) -> DataFrame:
    """New citations: confidence at most that of new ones, the rule marked."""
    return resolved.withColumn("confianca", F.least("confianca", F.lit(dims.REVIEW_CONFIDENCE["novo"]))).withColumn("regra", F.concat("regra", F.lit("+novo")))


def shrunk(rule_len: Column, model_len: Column) -> Column:
    """Whether a rule's span is to be cut down to the model's."""
    return (rule_len > LONG) & (rule_len > TIMES * model_len)


def within_budget(df: DataFrame, order: str, spent: str, warmup: int = 3, mean: float = 40.0, total: float = 10_800.0, by: str | None = None, block: int = 10_000) -> DataFrame:
    """Rows with `active`: false from the row on whose predecessors' mean cost (the first left out, from the fourth on) or total passes the budget.

    `order` is a whole number. The running sums are two-level - blocks of the order, then rows within a block - so that a
    long run isn't summed in one task.
    """
    run = F.col(by) if by else F.lit(0)
    d = df.withColumn("_r", run).withColumn("_b", F.floor(F.col(order) / block))
    sums = d.groupBy("_r", "_b").agg(F.count("*").alias("c"), F.sum(spent).alias("s"))
    w = Window.partitionBy("_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_r", "_b", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s0"))
    first = d.groupBy("_r").agg(F.min_by(spent, order).alias("f"))
    w = Window.partitionBy("_r", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("n1", F.count("*").over(w)).withColumn("s1", F.coalesce(F.sum(spent).over(w), F.lit(0.0)))
    j = d.join(sums, ["_r", "_b"]).join(first, "_r")
    n, s = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1")
    over = F.when(n > warmup, (s - F.col("f")) / F.greatest(n - 1, F.lit(1)) > mean).otherwise(F.lit(False)) | (s > total)
    end = j.where(over).groupBy("_r").agg(F.min(order).alias("_end"))
    return d.join(end, "_r", "left").withColumn("active", F.col("_end").isNull() | (F.col(order) < F.col("_end"))).select(*df.columns, "active")


def cache_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"))), 256)


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def header_end(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, header_end): offset of the first line of at least 70 characters within the first 1,500; 0 without one."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.substring(text_col, 1, 1500), "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    first = at.groupBy("id").agg(F.min(F.when(F.length("line") >= 70, F.col("at"))).alias("header_end"))
    return first.select(F.col("id").alias(id_col), F.coalesce("header_end", F.lit(0)).cast("bigint").alias("header_end"))
