"""Problem 7: one mixture of several sources whose token shares follow target weights.

Method: a time-varying curriculum. Over training time t in [0, 1] source s has the weight
`q_s (1 + a_s (2t - 1))`, where the caller may say how late each source is to come (`schedule`: -1, all at the start, to 1, all
at the end; by default lighter sources come later), and the weights sum to 1 at every t. Integrated, the
weight is the source's cumulative token demand `D_s(t) = T q_s (t + a_s (t^2 - t))`. A document copy that takes up
the tokens around `c` of its source's supply is wanted at the time t with D_s(t) = c, which is a quadratic in t with
one root in [0, 1]: its training position is `t T`. Documents are range-sorted by position.

Supply: a source's copies are laid out pass after pass (every document once a pass, in another pseudo-random order
each pass), and their running token sums are found in two levels - sums of hash buckets, then within a bucket -
so that no source, however large, is summed in one task.

Targets: the total T is by default the tokens of all documents of the weighted sources. A source can supply at most
its tokens times `max_repeticoes`; what it cannot supply is shared out over the others in proportion to their
weights (so their shares keep the ratio of the weights), until T or every source's supply is reached.

Defined results: null, empty and other token-less texts take no part (the report counts them); documents of a null
source or one without weight take no part; weights of null, zero or less, and repetitions of null or below 1, count
as none; repeated rows of the weight table count once (largest weight, then most repetitions); repeated doc_ids are
one document (the row with the longest text, then the smallest text). An empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeresolve.session import materialize

ROWS_A_BUCKET, SEED, AMPLITUDE = 20_000, 42, 0.5


def allot(supply: dict[str, int], weight: dict[str, float], most: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source: in proportion to the weights, within each source's supply, `total` altogether if it can be had."""
    room = {s: float(supply.get(s, 0)) * most[s] for s in weight}
    got = {s: 0.0 for s in weight}
    free, left = {s for s in weight if room[s] > 0}, float(total)
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / w >= room[s]}
        if not full:
            for s in free:
                got[s] = left * weight[s] / w
            return got
        for s in full:
            got[s] = room[s]
            left -= room[s]
        free -= full
    return got


def lateness(got: dict[str, float], weight: dict[str, float], amplitude: float, schedule: dict[str, float] | None = None) -> dict[str, float]:
    """a_s of each source, from -1 to 1: lighter sources later, or as `schedule` says; weighted by the shares they sum to 0, so that the weights sum to 1 at every time."""
    total = sum(got.values())
    if not total:
        return {s: 0.0 for s in got}
    order = sorted(got, key=lambda s: (-weight[s], s))
    z = {s: amplitude * k / max(1, len(order) - 1) for k, s in enumerate(order)}
    if schedule is not None:
        z = {s: schedule.get(s, 0.0) for s in got}
    mean = sum(got[s] / total * z[s] for s in got)
    a = {s: z[s] - mean for s in got}
    most = max(map(abs, a.values()))
    return {s: v / max(1.0, most) for s, v in a.items()}


def position(c: Column, tokens: Column, a: Column, total: float) -> Column:
    """The inverse of the demand D(t) = tokens (t + a (t^2 - t)) at c, in tokens of the whole mixture."""
    u = F.least(F.lit(1.0), c / tokens)
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * u)
    t = F.when(F.abs(a) < 1e-12, u).otherwise(2 * u / ((1 - a) + root))
    return t * F.lit(float(total))


def weights(mistura: DataFrame, source_col: str = "fonte", weight_col: str = "peso", most_col: str = "max_repeticoes") -> tuple[dict[str, float], dict[str, int]]:
    """The weight table (one row a source: it is read by the driver) without empty rows."""
    best: dict[str, tuple[float, int]] = {}
    for s, w, m in mistura.select(source_col, weight_col, most_col).distinct().collect():
        if s is not None and w is not None and w > 0 and not math.isnan(w) and m is not None and m >= 1:
            best[s] = max(best.get(s, (0.0, 0)), (float(w), int(m)))
    return {s: x[0] for s, x in best.items()}, {s: x[1] for s, x in best.items()}


def sized(documents: DataFrame, n_tokens, sources: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens) of the weighted sources, written once: tokens are counted a single time."""
    d = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"), F.length(text_col).alias("_n"), F.xxhash64(F.col(text_col)).alias("_h"))
    d = d.where(F.col("source").isin(sources) & F.col("doc_id").isNotNull())
    d = d.groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct(F.coalesce("_n", F.lit(-1)), "_h", "source")).alias("x"))
    return materialize(d.select("doc_id", "x.source", "x.n_tokens"), "mix-sizes")


class Mixture:
    """The mixture of `documents` by the table `mistura`."""

    def __init__(self, documents: DataFrame, mistura: DataFrame, n_tokens, total: float | None = None, amplitude: float = AMPLITUDE, seed: int = SEED, schedule: dict[str, float] | None = None):
        self.spark = documents.sparkSession
        self.weight, self.most = weights(mistura)
        self.sizes = sized(documents, n_tokens, sorted(self.weight))
        # one row a source: bounded by the weight table
        seen = {r["source"]: r for r in self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.sum((F.col("n_tokens") > 0).cast("long")).alias("used")).collect()}
        self.supply = {s: int(seen[s]["tokens"] or 0) if s in seen else 0 for s in self.weight}
        self.docs = {s: int(seen[s]["docs"]) if s in seen else 0 for s in self.weight}
        self.blank = {s: int(seen[s]["docs"] - seen[s]["used"]) if s in seen else 0 for s in self.weight}
        self.got = allot(self.supply, self.weight, self.most, total if total is not None else sum(self.supply.values()))
        self.total = sum(self.got.values())
        self.late = lateness(self.got, self.weight, amplitude, schedule)
        self.seed = seed

    def plan(self) -> DataFrame:
        """One row a source: what it may give and what is asked of it."""
        rows = [(s, self.weight[s], self.most[s], self.supply[s], self.docs[s], self.blank[s], self.got[s], self.late[s]) for s in sorted(self.weight)]
        return self.spark.createDataFrame(rows, "source string, peso double, max_repeticoes int, supply long, docs long, blank long, wanted double, late double")

    def placed(self) -> DataFrame:
        """(position, doc_id, source, copy_no, n_tokens) of every copy, unsorted."""
        plan = F.broadcast(self.plan().where("supply > 0").select("source", "supply", "wanted", "late", "max_repeticoes"))
        n = sum(self.docs.values())
        buckets = max(1, -(-n // ROWS_A_BUCKET))
        copies = (
            self.sizes.where("n_tokens > 0")
            .join(plan, "source")
            .withColumn("passes", F.least(F.col("max_repeticoes"), F.ceil(F.col("wanted") / F.col("supply"))).cast("int"))
            .where("passes > 0")
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
            .withColumn("h", F.xxhash64("doc_id", "copy_no", F.lit(self.seed)))
            .withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
        )
        sums = copies.groupBy("source", "copy_no", "bucket").agg(F.sum("n_tokens").alias("s"))
        w = Window.partitionBy("source").orderBy("copy_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("source", "copy_no", "bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"))
        w = Window.partitionBy("source", "copy_no", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        mid = F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens") / 2
        return (
            copies.join(starts, ["source", "copy_no", "bucket"])
            .withColumn("c", mid)
            .where("c <= wanted")
            .select(position(F.col("c"), F.col("wanted"), F.col("late"), self.total).alias("position"), "doc_id", "source", "copy_no", "n_tokens")
        )

    def ordered(self) -> DataFrame:
        """The mixture in training order: range-partitioned and sorted by position."""
        return self.placed().orderBy("position", "doc_id", "copy_no")

    def report(self) -> DataFrame:
        """Target and actual share of every source of the weight table."""
        made = self.placed().groupBy("source").agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy_no").alias("most_used"), F.sum((F.col("copy_no") == 1).cast("long")).alias("documents_used")
        )
        all_w = sum(self.weight.values()) or 1.0
        j = F.broadcast(self.plan()).join(made, "source", "left")
        tokens = F.coalesce("tokens", F.lit(0))
        return j.select(
            F.col("source").alias("fonte"), "peso", (F.col("peso") / all_w).alias("target_share"),
            F.coalesce(F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy())), F.lit(0.0)).alias("actual_share"),
            tokens.alias("tokens"), F.round("wanted").cast("long").alias("wanted_tokens"), F.col("supply").alias("supply_tokens"),
            F.col("docs").alias("documents"), F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeticoes", F.col("blank").alias("documents_without_tokens"),
        )
