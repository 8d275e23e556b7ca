"""Interval algebra on half-open [start, end) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bin_width: int, *, start: str = "start", end: str = "end", suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs of overlapping intervals of equal keys.

    Both sides are dealt to the bins of ``bin_width`` that they touch and joined
    by key and bin; a pair is made in the bin where the later of the two begins,
    so once. Other columns get the suffix of their side.
    """
    def dealt(df: DataFrame, suffix: str) -> DataFrame:
        rows = df.select(*keys, *(F.col(c).alias(c + suffix) for c in df.columns if c not in keys)).where(F.col(start + suffix) < F.col(end + suffix))
        return rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start + suffix) / bin_width), F.floor((F.col(end + suffix) - 1) / bin_width))))

    a, b = suffixes
    met = dealt(left, a).join(dealt(right, b), [*keys, "__bin"])
    late = F.greatest(start + a, start + b)
    return met.where((F.col(start + a) < F.col(end + b)) & (F.col(start + b) < F.col(end + a)) & (F.floor(late / bin_width) == F.col("__bin"))).drop("__bin")


#: Positions of a bin in which rows of a contig are sorted together; what earlier bins hand on is a row a bin.
BIN = 1 << 20


def _matched(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, null or not."""
    renamed = table.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    return df.join(renamed, same, "left").drop(*(f"__of_{k}" for k in keys))


def running(df: DataFrame, keys: list[str], order: list, columns: dict[str, tuple]) -> DataFrame:
    """``df``, whose __bin rises with ``order``, with running columns: name -> (aggregate, column, own), the aggregate (F.sum or F.max) of all rows before, the own included if ``own``. Null where there is none.

    Rows are sorted within their bin; the totals of earlier bins, a row each, are summed up apart and joined.
    """
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__bin").agg(*(f(c).alias(f"__t_{name}") for name, (f, c, _) in columns.items()))
    totals = totals.select(*keys, "__bin", *(f(f"__t_{name}").over(before).alias(f"__b_{name}") for name, (f, _, _) in columns.items()))
    rows = df.withColumns({f"__w_{name}": f(c).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)) for name, (f, c, own) in columns.items()})
    rows = _matched(rows, totals, [*keys, "__bin"])

    def both(name: str, f):
        a, b = F.col(f"__w_{name}"), F.col(f"__b_{name}")
        return F.greatest(a, b) if f is F.max else F.coalesce(a + b, a, b)

    return rows.withColumns({name: both(name, f) for name, (f, _, _) in columns.items()}).drop(*(f"{p}{name}" for p in ("__w_", "__b_") for name in columns))


def neighbours(df: DataFrame, keys: list[str], order: list, column: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """``df``, whose __bin rises with ``order``, with the value of ``column`` in the row before and after."""
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order)
    place = F.struct(*order)
    ends = df.groupBy(*keys, "__bin").agg(F.min_by(F.struct(column), place).alias("__first"), F.max_by(F.struct(column), place).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__bin")
    ends = ends.select(*keys, "__bin", F.lag("__last").over(over).alias("__before"), F.lead("__first").over(over).alias("__after"))
    rows = df.withColumns({"__p": F.lag(F.struct(column)).over(inside), "__f": F.lead(F.struct(column)).over(inside)})
    rows = _matched(rows, ends, [*keys, "__bin"])
    if before:
        rows = rows.withColumn(before, F.coalesce("__p", "__before")[column])
    if after:
        rows = rows.withColumn(after, F.coalesce("__f", "__after")[column])
    return rows.drop("__p", "__f", "__before", "__after")


def depth(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Steps of constant depth: keys, start, end, depth > 0. Ends are summed before they are sorted, in bins of ``width`` positions."""
    rows = df.where(F.col(start) < F.col(end))
    steps = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).groupBy(*keys, F.col("x.at").alias("start")).agg(F.sum("x.d").alias("d"))
    binned = steps.withColumn("__bin", F.floor(F.col("start") / width))
    found = neighbours(running(binned, keys, ["start"], {"depth": (F.sum, F.col("d"), True)}), keys, ["start"], "start", after="end")
    return found.where("depth > 0").select(*keys, "start", "end", "depth")


def merged(df: DataFrame, keys: list[str], gap: int = 0, *, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Unions of intervals that overlap, touch or lie up to ``gap`` apart: keys, start, end, n."""
    rows = running(df.withColumn("__bin", F.floor(F.col(start) / width)), keys, [start, end], {"__reach": (F.max, F.col(end), False)})
    rows = rows.withColumn("__new", F.coalesce(F.col(start) > F.col("__reach") + gap, F.lit(True)).cast("int"))
    runs = running(rows, keys, [start, end], {"__run": (F.sum, F.col("__new"), True)})
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__run")


def gaps(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Stretches between intervals that none covers."""
    rows = running(df.withColumn("__bin", F.floor(F.col(start) / width)), keys, [start, end], {"__reach": (F.max, F.col(end), False)})
    return rows.where(F.col(start) > F.col("__reach")).select(*keys, F.col("__reach").alias("start"), F.col(start).alias("end"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, bucket: int) -> DataFrame:
    """``left`` with the value of the last ``right`` row of its key at or before it, null if none; of right rows at one time the greatest value counts.

    Both sides are one table, sorted within buckets of ``bucket`` units; what
    earlier buckets hand on is their last right row.
    """
    known = right.where(F.col(right_at).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(right_at).alias("__at"), F.struct(F.col(right_at).alias("at"), F.col(value).alias("v")).alias("__hit"), F.lit(0).alias("__side"))
    asked = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    rows = known.unionByName(asked, allowMissingColumns=True).withColumn("__bin", F.floor(F.col("__at") / bucket))
    found = running(rows, keys, ["__at", "__side"], {"__found": (F.max, F.col("__hit"), True)})
    return found.where("__side = 1").select("__row.*", F.when(F.col("__at").isNotNull(), F.col("__found.v")).alias(value))


def directons(df: DataFrame, keys: list[str], order: list[str], strand: str, *, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Runs of neighbouring features on one strand, by ``order``, which begins with ``start``: keys, strand, run, start, end, n."""
    rows = neighbours(df.withColumn("__bin", F.floor(F.col(start) / width)), keys, order, strand, before="__strand")
    rows = rows.withColumn("__new", F.coalesce(F.col("__strand") != F.col(strand), F.lit(True)).cast("int"))
    runs = running(rows, keys, order, {"run": (F.sum, F.col("__new"), True)})
    return runs.groupBy(*keys, "run", strand).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def strand_switches(runs: DataFrame, keys: list[str], strand: str) -> DataFrame:
    """Regions between neighbouring runs: convergent (+ then -), divergent (- then +) or other. Runs are as few as a contig's directons."""
    w = Window.partitionBy(*keys).orderBy("run")
    kind = F.when((F.col(strand) == "+") & (F.col("__strand") == "-"), "convergent").when((F.col(strand) == "-") & (F.col("__strand") == "+"), "divergent").otherwise("other")
    return runs.withColumns({"__next": F.lead("start").over(w), "__strand": F.lead(strand).over(w)}).where("__next is not null").select(*keys, F.col("end").alias("start"), F.col("__next").alias("end"), kind.alias("kind"))
