"""Tables of counts, ranks, sets and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n50(df: DataFrame, keys: list[str], length: str, share: float = 0.5) -> DataFrame:
    """N50 (the length at which the longest reach ``share`` of all) and L50 (how many those are).

    Equal lengths are counted first, so what is sorted is the lengths' histogram.
    """
    histogram = df.where(F.col(length).isNotNull()).groupBy(*keys, length).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(length))
    running = histogram.withColumn("upto", F.sum(F.col("c") * F.col(length)).over(w)).withColumn("rank", F.sum("c").over(w)).withColumn("total", F.sum(F.col("c") * F.col(length)).over(Window.partitionBy(*keys)))
    need = F.col("total") * share
    hit = running.where(F.col("upto") >= need).groupBy(*keys).agg(F.max_by(F.struct(F.col(length).alias("n50"), F.col("upto"), F.col("rank"), F.col("c"), need.alias("need")), length).alias("x"))
    before = F.col("x.upto") - F.col("x.c") * F.col("x.n50")
    extra = F.when(F.col("x.n50") > 0, F.ceil((F.col("x.need") - before) / F.col("x.n50"))).otherwise(0)
    return hit.select(*keys, F.col("x.n50").alias("n50"), (F.col("x.rank") - F.col("x.c") + F.greatest(extra, F.lit(1))).cast("bigint").alias("l50"))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key; ``order`` must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def best(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by``, as an aggregation: partial maxima, no sort of a key's rows."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("__row")).select(*keys, "__row.*")


def average_rank(df: DataFrame, keys: list[str], value: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """Ranks with ties at their mean: from counts of equal values, which are joined back."""
    order = F.desc(value) if descending else F.asc(value)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn(name, F.coalesce(F.sum("__c").over(w), F.lit(0)) + (F.col("__c") + 1) / 2).drop("__c")
    return df.join(ranked, [*keys, value])


def set_regions(df: DataFrame, item: str, label: str, labels: list[str]) -> DataFrame:
    """Venn regions: for each combination of ``labels`` that some item has, a bit mask and the number of items."""
    mask = F.bit_or(F.coalesce(*(F.when(F.col(label) == x, F.lit(1 << k)) for k, x in enumerate(labels)), F.lit(0)))
    return df.where(F.col(label).isin(labels)).groupBy(item).agg(mask.alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def set_sizes(df: DataFrame, item: str, label: str) -> DataFrame:
    """Pairs of labels with the size of their common part and their Jaccard index."""
    pairs = df.select(item, label).where(F.col(item).isNotNull() & F.col(label).isNotNull()).distinct()
    sizes = pairs.groupBy(label).agg(F.count("*").alias("n"))
    a, b = pairs.select(item, F.col(label).alias("a")), pairs.select(item, F.col(label).alias("b"))
    common = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return common.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Matrix of sums with a column for each of the known ``values``, 0 where nothing is."""
    return df.groupBy(*rows).pivot(column, values).agg(F.sum(value)).fillna(0, subset=values)


def merged_counts(tables: list[DataFrame], key: str) -> DataFrame:
    """Count tables joined on their key; a missing count is 0."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out.fillna(0)


def strandness(forward: Column, reverse: Column, tolerance: float = 0.15) -> Column:
    """unstranded, forward or reverse by the share of forward counts; null when it is undecided."""
    share = forward / F.nullif(forward + reverse, F.lit(0))
    return F.when(share < tolerance, "reverse").when(share > 1 - tolerance, "forward").when(share.between(0.5 - tolerance, 0.5 + tolerance), "unstranded")


def significant(log2_fc: Column, padj: Column, alpha: float, least_fc: float) -> Column:
    """Not masked: an adjusted p-value of at most ``alpha`` and a fold change of at least ``least_fc``."""
    return padj.isNotNull() & (padj <= alpha) & (F.abs(log2_fc) >= least_fc)


def direction(log2_fc: Column) -> Column:
    return F.when(log2_fc > 0, "up").otherwise("down")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, name: str = "padj") -> DataFrame:
    """Adjusted p-values: the least p * n / rank from here up, at most 1. Equal p-values are one row of the sorted table.

    ``df`` is read once: a mean of doubles comes out otherwise by its last bits when
    it is computed again, and p-values of two readings don't meet in a join.
    """
    equal = Window.partitionBy(*keys, p)
    counted = df.withColumns({"__c": F.count(p).over(equal), "__i": F.row_number().over(equal.orderBy(p))})
    lead = F.col("__i") == 1
    # the first of each value stands in the sorted table, the others stay apart from it
    rows = counted.withColumn("__apart", F.when(~lead, F.col(p)))
    table = Window.partitionBy(*keys, lead, "__apart")
    up, down = table.orderBy(p), table.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"__r": F.sum("__c").over(up), "__n": F.sum("__c").over(table)})
    adjusted = ranked.withColumn("__a", F.when(lead & F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.try_divide(F.col(p) * F.col("__n"), F.col("__r"))).over(down))))
    return adjusted.withColumn(name, F.max("__a").over(equal)).drop("__c", "__i", "__apart", "__r", "__n", "__a")


def trimmed(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows between two quantiles of their key, both included."""
    bounds = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("__a"), F.percentile(value, F.lit(high)).alias("__b"))
    return df.join(bounds, keys).where(F.col(value).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def lineage(nodes: DataFrame, depth: int, *, node: str = "id", parent: str = "parent") -> DataFrame:
    """id, path (from the root) of each node of a forest at most ``depth`` deep; by pointer doubling, so log2(depth) joins."""
    paths = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), F.array(node).alias("path"))
    steps = 1
    while steps < depth:
        paths = paths.join(paths.select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("path").alias("above")), "up", "left").select("id", F.col("over").alias("up"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path"))
        steps *= 2
    return paths.select("id", "path")


def lowest_common(path: str) -> Column:
    """Aggregate: the last element of the common start of paths, null if there is none. What the least and the greatest path share, all share."""
    low, high = F.min(path), F.max(path)
    same = F.filter(F.zip_with(low, high, lambda a, b: F.when(a == b, a)), lambda x, i: F.slice(low, 1, i + 1) == F.slice(high, 1, i + 1))
    return F.try_element_at(same, F.lit(-1))


def checks(df: DataFrame, rules: dict[str, tuple[str, Column]], example: Column) -> DataFrame:
    """One row a rule: check, status (its level if a row fails, else Success), n_bad and the least example; one pass over ``df``."""
    found = [F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), F.count_if(bad).alias("n_bad"), F.min(F.when(bad, example)).alias("example")) for name, (level, bad) in rules.items()]
    rows = df.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.select("check", F.when(F.col("n_bad") > 0, F.col("level")).otherwise("Success").alias("status"), "n_bad", "example")
