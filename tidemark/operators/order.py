"""Orders of events across episodes: leads of series, agreement of episodes, blocks in their declared order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lead_pairs


def peak_leads(panel: DataFrame, series: str, max_lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """(i, j, lead, r) for all ordered pairs of series: the lag of greatest correlation, the least on ties, positive where i comes first."""
    pairs = lead_pairs(panel, series, max_lag, t, v).where("r is not null")
    by = Window.partitionBy("a", "b").orderBy(F.desc("r"), "h")
    best = pairs.withColumn("rank", F.row_number().over(by)).where("rank = 1")
    one = best.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("h").cast("bigint").alias("lead"), "r")
    return one.unionByName(best.select(F.col("b").alias("i"), F.col("a").alias("j"), (-F.col("h")).cast("bigint").alias("lead"), "r"))


def lead_scores(leads: DataFrame) -> DataFrame:
    """(i, score): mean lead of each series over the others."""
    return leads.groupBy("i").agg(F.avg("lead").alias("score"))


def transitivity(leads: DataFrame) -> DataFrame:
    """(triples, violations, rate): of i before j before k how many have i after k; rate is null without triples."""
    first = leads.where("lead > 0").select("i", "j")
    second = leads.where("lead > 0").select(F.col("i").alias("j"), F.col("j").alias("k"))
    third = leads.select("i", F.col("j").alias("k"), "lead")
    rows = first.join(second, "j").join(third, ["i", "k"])
    out = rows.agg(F.count("*").alias("triples"), F.coalesce(F.sum((F.col("lead") < 0).cast("bigint")), F.lit(0)).alias("violations"))
    return out.withColumn("rate", F.col("violations") / F.nullif(F.col("triples"), F.lit(0)))


def _rank(keys: list[str], v: str) -> Column:
    """Average rank from 1."""
    ties = F.count("*").over(Window.partitionBy(*keys, v))
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (ties - 1) / 2


def agreement(turns: DataFrame, episode: str, link: str, t: str, least: int = 4) -> DataFrame:
    """(a, b, n, rho) for episodes a < b with at least so many links in common: rank correlation of their times on these."""
    one = turns.select(F.col(episode).alias("a"), link, F.col(t).alias("ta"))
    two = turns.select(F.col(episode).alias("b"), link, F.col(t).alias("tb"))
    rows = one.join(two, link).where("a < b").withColumns({"ra": _rank(["a", "b"], "ta"), "rb": _rank(["a", "b"], "tb")})
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")).where(F.col("n") >= least)


def median_ranks(turns: DataFrame, episode: str, link: str, t: str, links: int) -> DataFrame:
    """(link, median, episodes, spread) of each link's rank, stretched in every episode to 1 .. links."""
    n = F.count("*").over(Window.partitionBy(episode))
    ranked = turns.withColumns({"_r": _rank([episode], t), "_n": n})
    wide = ranked.withColumn("_w", 1 + (F.col("_r") - 1) * (links - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return wide.groupBy(link).agg(F.percentile("_w", F.lit(0.5)).alias("median"), F.count("*").alias("episodes"), (F.max("_w") - F.min("_w")).alias("spread"))


def block_order(turns: DataFrame, episode: str, block: str, t: str, declared: DataFrame, place: str, least: int = 4) -> DataFrame:
    """(episode, blocks, rho, exact): median times of blocks against their declared places, exact if no block comes before an earlier one; episodes of fewer blocks are left out."""
    mids = turns.groupBy(episode, block).agg(F.percentile(t, F.lit(0.5)).alias("_m")).join(declared.select(block, F.col(place).alias("_p")), block)
    before = F.lag("_m").over(Window.partitionBy(episode).orderBy("_p"))
    rows = mids.withColumns({"_late": F.coalesce(before > F.col("_m"), F.lit(False)), "_rm": _rank([episode], "_m"), "_rp": _rank([episode], "_p")})
    out = rows.groupBy(episode).agg(F.count("*").alias("blocks"), F.corr("_rm", "_rp").alias("rho"), (~F.max("_late")).alias("exact"))
    return out.where(F.col("blocks") >= least)


def precedence(turns: DataFrame, episode: str, link: str, t: str, flow: str, stock: str) -> DataFrame:
    """(episode, flow_t, stock_t, lead, first): whether a flow turns before a stock in each episode that has the stock; null without the flow."""
    at = lambda name: F.max(F.when(F.col(link) == name, F.col(t)))
    out = turns.groupBy(episode).agg(at(flow).alias("flow_t"), at(stock).alias("stock_t")).where("stock_t is not null")
    return out.withColumns({"lead": F.col("stock_t") - F.col("flow_t"), "first": F.col("flow_t") < F.col("stock_t")})
