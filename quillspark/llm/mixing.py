"""Mixing sources to target weights by Pareto order sampling.

Sizes are tokens. Each source gets a goal by water-filling (targets scaled up evenly while no source passes
its cap of ``max_repeat`` whole copies), all its documents get the whole copies that fit into the goal, and
the rest is drawn without replacement and with unequal probabilities: document i of n tokens is included with
p = min(1, c n), where c is such that the expected tokens fill the rest (documents of p = 1 are taken for certain, and
what they leave is spread again over the others). Its Pareto rank is (u / (1 - u)) / (p / (1 - p)) for a random number u,
and documents are taken by ascending rank until the rest is filled.

The tokens are counted once and written to the checkpoint folder; four aggregations over them leave a few numbers per
source, and the mixture itself is a projection of the written counts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.bpe import token_counts
from quillspark.util import cut

#: A source's ranks fall into so many bands; only the band of the cut is sorted.
BANDS = 65_536
#: The table of targets has a row per source; a larger one is refused, as its facts go to every task.
MOST_SOURCES = 10_000


def source_name(column: Column) -> Column:
    """Source names compare after trimming, in lower case and with ``-`` as ``_``."""
    return F.translate(F.lower(F.regexp_replace(column, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), "-", "_")


def allocate(sizes: dict[str, int], targets: Sequence[tuple[str, float, int]]) -> dict[str, float]:
    """Goal in tokens of each source: min(cap, level * share), with the level at which the goals sum to all tokens.

    If the caps are below that sum, every source gets its cap. Sources without documents get 0.
    """
    total = float(sum(sizes.get(s, 0) for s, _, _ in targets))
    caps = {s: float(sizes.get(s, 0) * max(0, repeat)) for s, _, repeat in targets}
    shares = {s: max(0.0, share) for s, share, _ in targets}
    goals = dict.fromkeys(caps, 0.0)
    free, left = {s for s in caps if caps[s] > 0 and shares[s] > 0}, total
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if shares[s] / weight * left >= caps[s]}
        for s in full or free:
            goals[s] = caps[s] if full else shares[s] / weight * left
        if not full:
            break
        left -= sum(caps[s] for s in full)
        free -= full
    return goals


def wanted_sources(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, target share, max_repeat), by name. Rows without a source or share don't count; of repeated names the
    one of least share, then of least repeat, does. A null or negative max_repeat is 0."""
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.greatest(F.coalesce(F.col("max_repeat").cast("int"), F.lit(0)), F.lit(0)).alias("most"))
    first = rows.where("source IS NOT NULL AND share IS NOT NULL").groupBy("source").agg(F.min(F.struct("share", "most")).alias("x")).select("source", "x.*").limit(MOST_SOURCES + 1).collect()
    if len(first) > MOST_SOURCES:
        raise ValueError("the table of targets is too large to send to every task")
    return sorted((r["source"], r["share"], r["most"]) for r in first)


def _name(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def random_number(id_col: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), _name(id_col)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def pareto_rank(u: Column, p: Column) -> Column:
    """odds(u) / odds(p): 0 for what is certain."""
    return F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))


def _per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row per source, at most ``MOST_SOURCES``."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def inclusion_rates(counted: DataFrame, rests: dict[str, float]) -> dict[str, float]:
    """The c of p = min(1, c n) for each source that has a rest to draw.

    Sizes are counted first, so a source is as many rows as it has different sizes; from the largest down, those above a
    size are taken to be certain until c times that size is at most 1.
    """
    if not rests:
        return {}
    sizes = counted.join(_per_source(counted.sparkSession, sorted(rests.items()), "__source string, rest double"), "__source").groupBy("__source", "n_tokens").agg(F.count("*").alias("docs"), F.max("rest").alias("rest"))
    larger = Window.partitionBy("__source").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("__source").orderBy(F.desc("n_tokens")).rowsBetween(0, Window.unboundedFollowing)
    n = F.col("n_tokens").cast("double")
    c = (F.col("rest") - F.coalesce(F.sum(n * F.col("docs")).over(larger), F.lit(0.0))) / F.sum(n * n * F.col("docs")).over(smaller)
    fits = sizes.withColumn("c", c).where(F.col("c") * n <= 1).groupBy("__source").agg(F.max(F.struct("n_tokens", "c")).alias("x"))
    return {r["__source"]: r["c"] for r in fits.select("__source", "x.c").collect()}


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """One row (id_col, source, n_tokens, copies, target_share, goal_share, actual_share) per used document.

    ``copies`` is how often the document is in the mixture, at most the source's max_repeat. ``goal_share`` is
    what the caps leave of the target, ``actual_share`` what the drawn copies come to. Sources are those of
    ``targets`` (see :func:`wanted_sources`); documents of other or null sources, and those without tokens, aren't
    used. Equal rows are drawn alike. The draw depends on ``seed``, ids and sizes alone, so it is the same on every run.
    """
    plan = wanted_sources(targets)
    mine = docs.select(F.col(id_col), source_name(F.col("source").cast("string")).alias("__source"), F.col(text_col)).where(F.col("__source").isin([s for s, _, _ in plan]))
    counted = cut(token_counts(mine, id_col, text_col, ("__source",), vocabulary).where("n_tokens > 0"))
    spark = docs.sparkSession
    sizes = {r["__source"]: r["n"] for r in counted.groupBy("__source").agg(F.sum("n_tokens").alias("n")).collect()}
    goals = allocate(sizes, plan)
    whole = {s: min(most, int(goals[s] // sizes[s])) if sizes.get(s) else 0 for s, _, most in plan}
    rests = {s: rest for s, _, most in plan if sizes.get(s) and whole[s] < most and (rest := goals[s] - whole[s] * sizes[s]) > 0}
    rates = inclusion_rates(counted, rests)
    drawn = [(s, rests[s], rates[s]) for s in sorted(rates)]
    ranked = counted.join(_per_source(spark, drawn, "__source string, rest double, c double"), "__source").withColumn("rank", pareto_rank(random_number(id_col, seed), F.col("c") * F.col("n_tokens")))
    ranked = ranked.withColumn("band", F.floor(F.col("rank") / (1 + F.col("rank")) * BANDS).cast("int"))
    bands = ranked.groupBy("__source", "band").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = bands.withColumn("before", before).where("before < rest").groupBy("__source").agg(F.max(F.struct("band", "before", "rest")).alias("x")).select("__source", "x.*").collect()
    # in the band of the cut a document is taken while taking it brings the sum nearer to the goal
    edge = _per_source(spark, [(r["__source"], r["band"], r["before"]) for r in edges], "__source string, band int, filled bigint")
    last = ranked.join(edge, ["__source", "band"]).groupBy("__source", "rank", _name(id_col).alias("id")).agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("filled").alias("filled"))
    upto = last.withColumn("upto", F.col("filled") + F.sum("n").over(Window.partitionBy("__source").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)))
    ends = upto.where("upto - n / 2 <= rest").groupBy("__source").agg(F.max(F.struct("rank", "id", "upto")).alias("x")).select("__source", "x.*").collect()
    cuts = {r["__source"]: (r["rank"], r["id"], r["upto"]) for r in ends}
    first = {r["__source"]: (r["band"], r["before"]) for r in edges}
    used = {s: whole[s] * sizes.get(s, 0) + (cuts[s][2] if s in cuts else first[s][1] if s in first else 0) for s, _, _ in plan}
    wanted, taken = float(sum(goals.values())) or 1.0, float(sum(used.values())) or 1.0
    facts = [(s, share, goals[s] / wanted, used[s] / taken, whole[s], rates.get(s), first.get(s, (None,))[0], *cuts.get(s, (None, None))[:2]) for s, share, _ in plan]
    schema = "__source string, target_share double, goal_share double, actual_share double, whole int, c double, band int, end_rank double, end_id string"
    rank = pareto_rank(random_number(id_col, seed), F.col("c") * F.col("n_tokens"))
    every = counted.join(_per_source(spark, facts, schema), "__source").withColumn("rank", rank)
    band = F.floor(F.col("rank") / (1 + F.col("rank")) * BANDS).cast("int")
    more = (band < F.col("band")) | (band == F.col("band")) & ((F.col("rank") < F.col("end_rank")) | (F.col("rank") == F.col("end_rank")) & (_name(id_col) <= F.col("end_id")))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    return every.withColumn("copies", copies).where("copies > 0").select(id_col, F.col("__source").alias("source"), "n_tokens", "copies", "target_share", "goal_share", "actual_share")


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: target, goal and actual share, documents, tokens and the most copies used."""
    wanted = mixed.sparkSession.createDataFrame(wanted_sources(targets), "source string, target_share double, max_repeat int")
    used = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.max("goal_share").alias("goal_share"), F.max("actual_share").alias("actual_share"))
    filled = wanted.join(used, "source", "left")
    return filled.select("source", "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("goal_share", "actual_share", "n_docs", "tokens", "most_copies")), "max_repeat")
