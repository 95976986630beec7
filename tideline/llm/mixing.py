"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies r. Documents are ranked within their source; document number i gets as
many copies as there are integers between u + r (i - 1) and u + r i, u being the source's one random offset. Ranking by
size makes the sample stratified, so that a source's tokens, not only its documents, come out close to the target. Ranks come from prefix
sums of counts (by source and size, then by hash range), so that no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.tokens import VOCABULARY, token_counts
from tideline.plans.shared import written

#: Documents of one source and one size are ranked in hash ranges of about so many.
RANGE = 50_000


def tidy_source(c: Column) -> Column:
    """One spelling: trimmed, lower case, runs of blanks, hyphens and underscores as one underscore; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return F.when(s != "", s)


def poured(usable: list[dict], total: float) -> dict[str, float]:
    """Tokens by source for a total: shares by weight; what a source's cap cuts off goes to the others by their weights."""
    cap = {r["source"]: r["max_repeat"] * r["tokens"] for r in usable}
    free, left, amount = {r["source"]: r["weight"] for r in usable}, float(min(total, sum(cap.values()))), {}
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if w * unit >= cap[s]]
        if not full:
            return amount | {s: w * unit for s, w in free.items()}
        for s in full:
            amount[s] = cap[s]
            left = max(0.0, left - cap[s])
            del free[s]
    return amount


def missed(usable: list[dict], amount: dict[str, float]) -> float:
    """The part of the mixture that sources at their cap owe to the others."""
    weights, reached = sum(r["weight"] for r in usable), sum(amount.values())
    return sum(max(0.0, r["weight"] / weights - amount[r["source"]] / reached) for r in usable)


def ratios(rows: list[dict], total: float | None, shortfall: float) -> tuple[float, dict[str, float]]:
    """(total tokens, expected copies of a document by source) from rows of source, weight, max_repeat, tokens.

    ``total`` None: the largest total at which no more than ``shortfall`` of the mixture is missed by sources at their cap; 0 keeps every share exact, at the price of a total that
    the scarcest source dictates. Sources without tokens are left out of the reckoning.
    """
    usable = [r for r in rows if r["weight"] > 0 and r["max_repeat"] > 0 and r["tokens"] > 0]
    if not usable:
        return 0.0, {}
    weights = sum(r["weight"] for r in usable)
    exact = min(r["max_repeat"] * r["tokens"] / r["weight"] for r in usable) * weights
    if total is None:
        low, high = exact, float(sum(r["max_repeat"] * r["tokens"] for r in usable))
        if missed(usable, poured(usable, high)) <= shortfall:
            low = high
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if missed(usable, poured(usable, mid)) <= shortfall else (low, mid)
        total = exact if shortfall <= 0 else low
    amount = poured(usable, total)
    return sum(amount.values()), {r["source"]: min(amount[r["source"]] / r["tokens"], float(r["max_repeat"])) for r in usable}


def wanted(targets: DataFrame) -> DataFrame:
    """source, weight, max_repeat: one row per target source, see Mixture."""
    best = F.max(F.struct(F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeat"), F.lit(0)).cast("long").alias("max_repeat")))
    return targets.select(tidy_source(F.col("source")).alias("source"), "weight", "max_repeat").where("source is not null").groupBy("source").agg(best.alias("b")).select("source", "b.weight", "b.max_repeat")


def available(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source, weight, max_repeat, documents, target_share: what each target could draw on, counted without encoding a text."""
    n = documents.groupBy(tidy_source(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    everything = W.partitionBy(F.lit(1))  # one row per target
    share = F.when(F.sum("weight").over(everything) > 0, F.col("weight") / F.sum("weight").over(everything)).otherwise(0.0)
    return wanted(targets).join(n, "source", "left").select("source", "weight", "max_repeat", F.coalesce("documents", F.lit(0)).alias("documents"), share.alias("target_share"))


class Mixture:
    """``copies``: doc_id, source, n_tokens, copy_no; ``shares``: per target what was wanted and what was reached."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, shortfall: float = 0.1, seed: int = 1, vocabulary: str = VOCABULARY):
        """Sizes are tokens of the public tokenizer in ``vocabulary``. ``total`` and ``shortfall``: see ratios().

        Sources of both tables are brought to one spelling; of several targets for one source the largest weight and with it the largest max_repeat counts. Documents without a source or target are not used, nor are
        those of a weight or max_repeat of null or 0. Null and empty texts have 0 tokens and are drawn as often as others. Repeated rows are
        documents of their own. Sources without any tokens can't be reached: the others share by their weights and the report says so. Empty tables give no copies.
        """
        spark = documents.sparkSession
        source = tidy_source(F.col("source"))
        self.targets = wanted(targets)
        keyed = documents.select(F.struct("doc_id", source.alias("source")).alias("key"), "text").join(self.targets.select(F.col("source").alias("wanted")), F.col("key.source") == F.col("wanted"), "left_semi")
        self.counts = written(token_counts(keyed, vocabulary, "key").select("key.doc_id", "key.source", "n_tokens"), "token-counts")
        sizes = self.counts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
        self.report = self.targets.join(sizes, "source", "left").select("source", "weight", "max_repeat", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        rows = [r.asDict() for r in self.report.collect()]  # one row per target: a hand-written table
        self.total, ratio = ratios(rows, total, shortfall)
        self.plan = spark.createDataFrame([(r["source"], float(ratio.get(r["source"], 0.0)), r["max_repeat"]) for r in rows], "source string, ratio double, cap long")
        self.seed = seed
        self.copies = self._copies()

    def _copies(self) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("alike") / RANGE)))
        alike = self.counts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("alike"))
        before = F.sum("alike").over(W.partitionBy("source").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("alike")
        sized = alike.withColumn("before", before)  # as many rows as there are different sizes
        placed = self.counts.join(sized, ["source", "n_tokens"]).withColumn("part", part)
        parts = placed.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("size"))
        inner = F.sum("size").over(W.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
        ranked = placed.join(parts.withColumn("inner", inner), ["source", "n_tokens", "part"])
        rank = F.col("before") + F.col("inner") + F.row_number().over(W.partitionBy("source", "n_tokens", "part").orderBy("doc_id"))
        u = F.pmod(F.xxhash64("source", F.lit(self.seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        df = ranked.withColumn("rank", rank).join(F.broadcast(self.plan), "source")  # made of the rows collected above
        crossed = F.floor(u + F.col("ratio") * F.col("rank")) - F.floor(u + F.col("ratio") * (F.col("rank") - 1))
        df = df.withColumn("n_copies", F.least(crossed, F.col("cap"))).where("n_copies > 0")
        return df.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy_no"))

    @property
    def kept_rules(self) -> DataFrame:
        """source, by_the_integers, capped: whether a source has as many copies as its expected number says, up to one, and no document more than its cap; one row per target."""
        each = self.copies.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        got = each.groupBy("source").agg(F.sum("c").alias("copies"), F.max("c").alias("most"))
        df = self.plan.join(self.report.select("source", "documents"), "source").join(got, "source", "left").fillna(0, ["copies", "most"])
        return df.select("source", (F.abs(F.col("copies") - F.col("ratio") * F.col("documents")) < 1).alias("by_the_integers"), (F.col("most") <= F.col("cap")).alias("capped"))

    @property
    def shares(self) -> DataFrame:
        """source, weight, max_repeat, documents, tokens, target_share, reached_tokens, reached_share, most_copies: one row per target."""
        got = self.copies.groupBy("source").agg(F.sum("n_tokens").alias("reached_tokens"), F.max("copy_no").alias("most_copies"))
        df = self.report.join(got, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0))).withColumn("most_copies", F.coalesce("most_copies", F.lit(0)))
        everything = W.partitionBy(F.lit(1))  # one row per target
        share = lambda c: F.when(F.sum(c).over(everything) > 0, F.col(c) / F.sum(c).over(everything)).otherwise(0.0)
        return df.select("*", share("weight").alias("target_share"), share("reached_tokens").alias("reached_share"))
