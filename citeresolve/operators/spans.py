"""Interval operators over span tables keyed by a document column. Spans are [start, end) of code points.

Joins of intervals are equi joins on the document, and where a document's spans may be many also on blocks of
positions, so that no document's spans are all compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve.functions import text as X

BLOCK = 1024


def blocks(start: Column, end: Column, size: int = BLOCK) -> Column:
    """The blocks of positions a span touches."""
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end - 1) / size))


def contained_out(df: DataFrame, doc: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Drop spans that lie inside an earlier span (by start, then the longest, then `order`).

    Containment is transitive, so a running maximum of the ends decides: no comparison of pairs.
    """
    w = Window.partitionBy(doc).orderBy(F.col(start), F.col(end).desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(end).over(w)).where(F.col("_m").isNull() | (F.col(end) > F.col("_m"))).drop("_m")


def overlap_join(a: DataFrame, b: DataFrame, doc: str, how: str = "inner", size: int = BLOCK) -> DataFrame:
    """Pairs of overlapping spans of two tables with the columns (doc, a_s, a_e, ...) and (doc, b_s, b_e, ...).

    Each pair meets in every block both touch and is kept in the first of them, so it comes once.
    """
    x = a.withColumn("_b", F.explode(blocks(F.col("a_s"), F.col("a_e"), size)))
    y = b.withColumn("_b", F.explode(blocks(F.col("b_s"), F.col("b_e"), size)))
    j = x.join(y, [doc, "_b"]).where("a_s < b_e AND b_s < a_e")
    return j.where(F.col("_b") == F.floor(F.greatest("a_s", "b_s") / size)).drop("_b")


def overlap_anti(a: DataFrame, b: DataFrame, doc: str, size: int = BLOCK) -> DataFrame:
    """Spans of `a` that overlap no span of `b`."""
    key = [doc, "a_s", "a_e"]
    hit = overlap_join(a.select(*key).distinct(), b.select(doc, "b_s", "b_e").distinct(), doc, size=size).select(*key).distinct()
    return a.join(hit, key, "left_anti")


def floor_end(points: DataFrame, spans: DataFrame, doc: str, pos: str) -> DataFrame:
    """As-of join: for each point the greatest end of a span that ends at or before it (`floor`, null if none). One sort, no pairs."""
    p = points.select("*", F.col(pos).alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast("int").alias("_e"))
    s = spans.select(doc, F.col("b_e").alias("_p"), F.lit(0).alias("_k"), F.col("b_e").cast("int").alias("_e"))
    w = Window.partitionBy(doc).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = p.unionByName(s, allowMissingColumns=True)
    return u.withColumn("floor", F.max("_e").over(w)).where("_k = 1").drop("_p", "_k", "_e")


def nearest(anchors: DataFrame, others: DataFrame, doc: str, within: int) -> DataFrame:
    """For each anchor (doc, a_s, a_e) the nearest span (doc, b_s, b_e, ...) at most `within` away; ties to the earlier, then the shorter."""
    a = anchors.select(doc, "a_s", "a_e").distinct()
    wide = a.withColumn("lo", F.greatest(F.lit(0), F.col("a_s") - within)).withColumn("hi", F.col("a_e") + within + 1)
    x = wide.withColumn("_b", F.explode(blocks(F.col("lo"), F.col("hi"))))
    y = others.withColumn("_b", F.floor(F.col("b_s") / BLOCK))
    gap = F.greatest(F.lit(0), F.col("b_s") - F.col("a_e"), F.col("a_s") - F.col("b_e"))
    j = x.join(y, [doc, "_b"]).withColumn("gap", gap).where(F.col("gap") <= within)
    cols = [c for c in others.columns if c != doc]
    best = j.groupBy(doc, "a_s", "a_e").agg(F.min_by(F.struct("gap", *cols), F.struct("gap", "b_s", "b_e")).alias("n"))
    return best.select(doc, "a_s", "a_e", "n.*")


def iou_pairs(df: DataFrame, doc: str, start: str, end: str, ident: str, least: float = 0.5) -> DataFrame:
    """Pairs of spans of a document whose overlap is at least `least` of their union, the smaller ident first."""
    base = df.select(doc, F.col(start).alias("a_s"), F.col(end).alias("a_e"), F.col(ident).alias("a_id"))
    other = base.select(doc, F.col("a_s").alias("b_s"), F.col("a_e").alias("b_e"), F.col("a_id").alias("b_id"))
    j = overlap_join(base, other, doc).where("a_id < b_id")
    return j.withColumn("iou", X.iou(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))).where(F.col("iou") >= least)


def islands(df: DataFrame, doc: str, start: str, end: str, name: str = "island") -> DataFrame:
    """The spans with the start of their island: spans of a document that hang together by overlapping. One sort, no pairs."""
    w = Window.partitionBy(doc).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col(start) >= before), F.col(start))
    return df.withColumn("_first", first).withColumn(name, F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def suppress(df: DataFrame, doc: str, start: str, end: str, confidence: str, ident: str, least: float = 0.5) -> DataFrame:
    """Greedy suppression: spans by confidence, length, start and ident; each is kept unless a kept one overlaps it by `least` or more.

    A span suppressed suppresses nothing, so this is a fold over sorted spans rather than a join. Spans of different islands
    don't overlap, so each island is folded by itself, however many spans a document has.
    """
    s = F.struct(
        (-F.coalesce(F.col(confidence), F.lit(0.0))).alias("c"), (F.col(start) - F.col(end)).alias("l"), F.col(start).alias("s"), F.col(ident).alias("id"), F.col(end).alias("e")
    )
    spans = islands(df, doc, start, end, "_island").groupBy(doc, "_island").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    empty = F.filter("spans", lambda x: F.lit(False))
    kept = F.aggregate(
        "spans", empty, lambda k, x: F.when(F.exists(k, lambda y: X.iou(y["s"], y["e"], x["s"], x["e"]) >= least), k).otherwise(F.concat(k, F.array(x)))
    )
    out = spans.select(doc, F.explode(F.when(F.size("spans") == 1, F.col("spans")).otherwise(kept)).alias("k"))
    return out.select(doc, F.col("k.id").alias(ident), F.col("k.s").alias(start), F.col("k.e").alias(end))


def map_back(df: DataFrame, start: str, end: str, offsets: str) -> DataFrame:
    """Spans of a cleaned text as spans of the original, by the map of source offsets."""
    return df.withColumn(start, F.element_at(offsets, F.col(start) + 1)).withColumn(end, F.element_at(offsets, F.col(end)) + 1)
