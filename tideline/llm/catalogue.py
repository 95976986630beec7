"""Queries of the text operators over the project's tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.mixing import Mixture, available
from tideline.llm.residue import residue
from tideline.llm.tokens import decoded, encoded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark, d):
    return encoded(table(spark, d, "documents"), offsets=False)


def p6_roundtrip(spark, d):
    """Every text, encoded with offsets and decoded again."""
    return decoded(encoded(table(spark, d, "documents")))


def p7_mix(spark, d):
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_target")).copies


def p7_shares(spark, d):
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_target")).shares


def p7_available(spark, d):
    """What each target could draw on."""
    df = available(table(spark, d, "documents"), table(spark, d, "mix_target"))
    return df.withColumn("target_share", F.round("target_share", 9))


def p7_kept_rules(spark, d):
    """Copies against the sampling rule and the caps, for the usual and the exact mix."""
    made = (("usual", 0.1), ("exact", 0.0))
    each = (Mixture(table(spark, d, "documents"), table(spark, d, "mix_target"), shortfall=s).kept_rules.select(F.lit(name).alias("mix"), "*") for name, s in made)
    return reduce(DataFrame.unionByName, each)


def p7_exact_shares(spark, d):
    """Every source that has documents at its exact share, whatever total that leaves."""
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_target"), shortfall=0).shares


def p7_exact_mix(spark, d):
    """The copies of that mix."""
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_target"), shortfall=0).copies


def p8_found(spark, d):
    return residue(table(spark, d, "documents")).where("placeholder is not null or message is not null").select("doc_id")


def p8_clean(spark, d):
    """The documents that stay, judged row by row."""
    return residue(table(spark, d, "documents"), keep=["source", "text"]).where("placeholder is null and message is null").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_ids, p6_roundtrip, p7_mix, p7_shares, p7_exact_shares, p7_exact_mix, p7_available, p7_kept_rules, p8_found, p8_clean)}


def sql() -> dict[str, str]:
    tidy = "nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g'), '')"
    available = f"""with t as (select {tidy} as source, max(weight) as weight, arg_max(max_repeat, weight)::bigint as max_repeat from mix_target group by 1),
    d as (select {tidy} as source, count(*) as documents from documents group by 1)
    select t.source, t.weight, t.max_repeat, coalesce(d.documents, 0) as documents, round(t.weight / sum(t.weight) over (), 9) as target_share from t left join d using (source)"""
    rules = f"select mix, source, true as by_the_integers, true as capped from (select distinct {tidy} as source from mix_target where {tidy} is not null) t, (values ('usual'), ('exact')) m(mix)"
    return {"p7_kept_rules": rules, "p6_roundtrip": "select doc_id, coalesce(text, '') as text from documents", "p7_available": available}
