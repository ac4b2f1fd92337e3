"""Summaries, rankings and filters over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def year_summary(rows: DataFrame, year: Column, stated: Column, high: Column) -> DataFrame:
    """year, mean stated value (nulls left out, half up), events, high ones."""
    return rows.groupBy(year.cast("long").alias("year")).agg(F.floor(F.avg(stated) + 0.5).cast("long").alias("stated"), F.count("*").alias("events"), F.count_if(high).alias("high"))


def facet_counts(rows: DataFrame, single: dict[str, Column], multiple: dict[str, Column]) -> DataFrame:
    """(facet, value, n) for each facet, one row of `all` counting rows once. Single-valued facets are one grouping-sets
    pass over the rows; multi-valued ones are exploded."""
    wide = rows.select(*(c.alias(k) for k, c in single.items()))
    names = list(single)
    counted = wide.groupingSets([*([wide[k]] for k in names), []], *(wide[k] for k in names)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(names)) - 1
    facet = F.when(F.col("g") == full, "all")
    value = F.when(F.col("g") == full, F.lit("all"))
    for i, k in enumerate(names):
        own = F.col("g") == full - (1 << (len(names) - 1 - i))
        facet, value = facet.when(own, k), value.when(own, F.col(k))
    out = counted.select(facet.alias("facet"), value.alias("value"), "n")
    for k, tags in multiple.items():
        out = out.union(rows.select(F.explode(tags).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(k).alias("facet"), "value", "n"))
    return out


def mix(rows: DataFrame, quality: Column, publisher: Column, day: Column) -> DataFrame:
    """Counts, shares, publishers and newest day of each quality, most frequent first."""
    found = rows.groupBy(quality.alias("quality")).agg(F.count("*").alias("n"), F.count_distinct(publisher).alias("publishers"), F.date_format(F.max(day), "yyyy-MM-dd").alias("newest"))
    whole = Window.partitionBy()  # over a row for each quality
    share = F.floor(F.col("n") * 1000 / F.sum("n").over(whole) + 0.5) / 10
    return found.select("quality", "n", share.alias("share"), "publishers", "newest", F.row_number().over(Window.orderBy(F.desc("n"), "quality")).cast("long").alias("place"))


def margins(rows: DataFrame, used: str, ceiling: str) -> DataFrame:
    """rows with headroom, its fraction of the ceiling, and whether that is over or within 2 percent."""
    fraction = (F.col(ceiling) - F.col(used)) / F.col(ceiling)
    over = F.col(used) > F.col(ceiling)
    return rows.withColumn("headroom", F.col(ceiling) - F.col(used)).withColumn("fraction", F.round(fraction, 4)).withColumn("over", over).withColumn("tight", ~over & (fraction < 0.02))


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with their place within a key; order must end in a unique column."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def candidate_order(direct: Column, authorship: Column, coverage: Column, concepts: Column, score: Column, recency: Column, created: Column, unique: Column) -> list[Column]:
    """The order of a claim's candidates: direct ones first, then by rank of authorship, coverage, points of concepts,
    score, rank of recency and time, each from the largest, what is missing last; then by a unique column."""
    return [*(c.desc_nulls_last() for c in (direct, authorship, coverage, concepts, score, recency, created)), unique.asc()]


#: Kinds of entries about one post, the most telling first.
KINDS = ["post", "repost", "like", "bookmark"]


def one_of_each(entries: DataFrame, by: list[str], kind: Column, post: Column, activity: Column, arrival: Column) -> DataFrame:
    """One entry of each group: a repost that names an activity of its own, which tells more about where it comes from
    than any other; else the most telling kind; of equals the first to arrive (arrival must be unique in a group).

    An aggregate, not a window: summed before the shuffle however many entries a group has."""
    richer = F.coalesce((kind == "repost") & (activity != post), F.lit(False))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0))
    rank = F.when(rank == 0, len(KINDS) + 1).otherwise(rank)
    order = F.struct((~richer).alias("poorer"), rank.alias("rank"), arrival.alias("arrival"))
    others = [c for c in entries.columns if c not in by]
    return entries.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("_row")).select(*by, "_row.*")


def apportion(counts: DataFrame, group: str, item: str, n: str) -> DataFrame:
    """counts with whole percents of their group that sum to 100: floors, then one more for the largest remainders."""
    of = Window.partitionBy(group)
    exact = F.lit(100.0) * F.col(n) / F.sum(n).over(of)
    rows = counts.withColumn("_exact", exact).withColumn("_rest", 100 - F.sum(F.floor("_exact")).over(of))
    place = F.row_number().over(of.orderBy(F.round(F.col("_exact") - F.floor("_exact"), 9).desc(), item))
    return rows.withColumn("share", (F.floor("_exact") + F.when(place <= F.col("_rest"), 1).otherwise(0)).cast("long")).drop("_exact", "_rest")


def run_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, key): keys gained and lost between two runs."""
    gained, lost = after.join(before, key, "left_anti").distinct(), before.join(after, key, "left_anti").distinct()
    return gained.select(F.lit("gained").alias("change"), key).union(lost.select(F.lit("lost").alias("change"), key))


def faceted(rows: DataFrame, facets: dict[str, str], search: str, text: Column) -> DataFrame:
    """Rows that have each facet's value, and every word of the search in text. A value that no row has means all; the
    search is cut at 120 characters."""
    for column, value in facets.items():
        if not rows.where(F.col(column) == value).isEmpty():
            rows = rows.where(F.col(column) == value)
    for word in search[:120].lower().split():
        rows = rows.where(F.contains(text, F.lit(word)))
    return rows
