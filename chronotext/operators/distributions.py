"""Feature distributions by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronotext.session import materialize

SLOTS = 4_096
OCTAVES = 12


def to_long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value), nulls left out."""
    columns = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    return df.select(*keep, *columns).unpivot(keep, features, "feature", "value").filter(
        "value IS NOT NULL"
    )


def quantiles(long: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, <name>..): exact quantiles with linear interpolation.

    A quantile lies between two places in the order of its group. Each place starts with the range of
    the whole group; a round counts the range's values in equal slots, and the slot that holds the
    place, from its smallest to its largest value, is the next range. A range of one value is the
    answer. The ends of a range have slots of their own, so each round takes values off. A range that is
    still wider than OCTAVES after the first round has its slots on a logarithmic scale, so two rounds
    bring any range down to about an octave, and each one more takes 12 bits off. Nothing is ranked or sorted but the counts of SLOTS slots of a range.
    Infinite values are values like others; NaN is the largest. A null key has no row.
    """
    names = list(shares)
    place = {q: (F.col("_n") - 1) * F.lit(float(shares[q])) for q in names}
    sought = [F.struct(F.lit(q).alias("_q"), F.lit(side).alias("_side"), at(place[q]).alias("_k"))
              for q in names for side, at in (("a", F.floor), ("b", F.ceil))]
    sizes = materialize(long.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("value").alias("_n")))
    ranges = sizes.select(*keys, "_lo", "_hi", F.array(*sought).alias("_at"))
    found, first = None, True
    while True:
        known = ranges.filter(F.col("_lo") == F.col("_hi")).select(*keys, F.col("_lo").alias("_x"), F.inline("_at"))
        found = known if found is None else found.unionByName(known)
        wide = ranges.filter(F.col("_lo") < F.col("_hi"))
        if wide.isEmpty():
            break
        ranges = materialize(_narrowed(long, wide, keys, first))
        first = False
    ends = found.groupBy(*keys, "_q").agg(*[F.max(F.when(F.col("_side") == s, F.col("_x"))).alias(f"_{s}") for s in "ab"])
    part = F.element_at(F.create_map(*[c for q in names for c in (F.lit(q), place[q] - F.floor(place[q]))]), F.col("_q"))
    low, high = F.col("_a"), F.col("_b")
    between = F.when(low == high, low).otherwise(low + (high - low) * part)
    return ends.join(sizes, keys).withColumn("_x", between).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == q, F.col("_x"))).alias(q) for q in names])


def _octaves(value: Column) -> Column:
    """Rising with the value: the logarithm of its size above that of the least double, with its sign."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.log2(F.abs(value)) + 1_100))


def _narrowed(long: DataFrame, ranges: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """For each place sought in a range, the slot that holds it as the next range. Ranges of one group do not
    overlap, so the lower end names a range; places of one slot share it."""
    value, lo, hi = F.col("value"), F.col("_lo"), F.col("_hi")
    even = (value / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves: the width of a range may overflow
    if not first:
        spread = _octaves(hi) - _octaves(lo)
        even = F.when(spread > OCTAVES, (_octaves(value) - _octaves(lo)) / spread).otherwise(even)
    part = F.nanvl(even, F.lit(0.0))
    slot = F.when(value == lo, -1).when(value == hi, SLOTS).otherwise(
        F.least(F.floor(part * SLOTS), F.lit(SLOTS - 1)).cast("int"))
    counted = long.join(ranges.select(*keys, "_lo", "_hi"), keys).filter(value.between(lo, hi)).groupBy(
        *keys, "_lo", slot.alias("_slot")
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    run = Window.partitionBy(*keys, "_lo").orderBy("_slot")
    placed = counted.withColumn("_before", F.sum("_c").over(run) - F.col("_c"))
    own = F.transform(
        F.filter("_at", lambda t: (t["_k"] >= F.col("_before")) & (t["_k"] < F.col("_before") + F.col("_c"))),
        lambda t: F.struct(t["_q"].alias("_q"), t["_side"].alias("_side"), (t["_k"] - F.col("_before")).alias("_k")))
    return placed.join(ranges.drop("_hi"), [*keys, "_lo"]).select(
        *keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), own.alias("_at")).filter(F.size("_at") > 0)


def winsorize_bounds(long: DataFrame, keys: list[str]) -> DataFrame:
    return quantiles(long, keys, {"low": 0.01, "high": 0.99})


def winsorize(long: DataFrame, keys: list[str]) -> DataFrame:
    """Values clipped to the 1 % and 99 % quantiles of their (keys, feature)."""
    at = [*keys, "feature"]
    bounds = winsorize_bounds(long, at)
    return long.join(bounds, at).withColumn(
        "value", F.greatest(F.least("value", "high"), "low")
    ).drop("low", "high")


def mean_by_period(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    return df.groupBy(target).agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features])


def axis_ranges(clipped: DataFrame, dataset: str, target: str) -> DataFrame:
    """(feature, low, high) over all data sets: smallest value and largest period mean,
    each with a 2 % margin of its own set's range."""
    per = (
        clipped.groupBy(dataset, "feature", target)
        .agg(F.min("value").alias("_min"), F.avg("value").alias("_mean"))
        .groupBy(dataset, "feature")
        .agg(F.min("_min").alias("_lo"), F.max("_mean").alias("_hi"))
    )
    margin = (F.col("_hi") - F.col("_lo")) * 0.02
    return per.groupBy("feature").agg(
        F.min(F.col("_lo") - margin).alias("low"), F.max(F.col("_hi") + margin).alias("high")
    )


def box_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q1, median, q3, whisker_low, whisker_high, outliers)."""
    boxes = quantiles(long, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return long.join(boxes, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
    )


def violin_bins(long: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, bin, n, mean): equal-width counts over each feature's own range. `keys`
    ends with the period; the range is shared by the periods of a feature."""
    span = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.floor((F.col("value") - F.col("_lo")) / width)).otherwise(0)
    binned = long.join(F.broadcast(span), "feature").withColumn(
        "bin", F.least(place, F.lit(bins - 1)).cast("int")
    )
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("_s"))
    whole = counts.groupBy(*keys).agg((F.sum("_s") / F.sum("n")).alias("mean"))
    return counts.drop("_s").join(whole, keys)


CELLS = 64


def violin_density(long: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """(keys, cell, value, density): a Gaussian kernel density of each group on `cells` points.

    The width is the deviation times n^(-1/5) (one where there is none). Values are counted in equal cells
    that reach three widths past the group's ends, and the counts are smoothed over the
    cells: a group costs one partial aggregate and cells x cells terms, whatever its size. The
    density times the cell's width sums to one.
    """
    known = long.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.stddev_samp("value").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_sd") > 0, F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).otherwise(1.0)
    known = known.withColumn("_h", width).select(
        *keys, "_h", (F.col("_lo") - 3 * F.col("_h")).alias("_from"), ((F.col("_hi") - F.col("_lo") + 6 * F.col("_h")) / cells).alias("_step"))
    place = F.floor((F.col("value") - F.col("_from")) / F.col("_step") + 1e-9)
    counted = long.join(known, keys).groupBy(*keys, "_h", "_from", "_step", F.least(place, F.lit(cells - 1)).cast("int").alias("_c")).agg(
        F.count(F.lit(1)).alias("_m"))
    one = counted.groupBy(*keys, "_h", "_from", "_step").agg(F.collect_list(F.struct("_c", "_m")).alias("_of"))  # `cells` at most

    def smoothed(i):
        return F.aggregate("_of", F.lit(0.0), lambda s, c: s + c["_m"] * F.exp(-0.5 * F.pow((i - c["_c"]) * F.col("_step") / F.col("_h"), F.lit(2.0))))

    heights = one.withColumn("_y", F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), smoothed))
    heights = heights.withColumn("_all", F.aggregate("_y", F.lit(0.0), lambda s, y: s + y))
    return heights.select(*keys, "_from", "_step", "_all", F.posexplode("_y").alias("cell", "_v")).select(
        *keys, "cell", (F.col("_from") + (F.col("cell") + 0.5) * F.col("_step")).alias("value"),
        (F.col("_v") / (F.col("_all") * F.col("_step"))).alias("density"))


def shared_features(long: DataFrame, dataset: str) -> DataFrame:
    """Features that have values in every data set."""
    seen = long.select(dataset, "feature").distinct()
    total = seen.select(dataset).distinct().agg(F.count(F.lit(1))).scalar()
    return seen.groupBy("feature").agg(F.count(F.lit(1)).alias("datasets")).filter(
        F.col("datasets") == total
    )
