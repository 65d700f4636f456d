"""count, min, max, mean and exact median of a column of doubles, in one lazy plan without a buffer that grows with the data.

Equal values are counted first.  The median's ranks are then narrowed down digit by digit: a double's sign and exponent are its
first digit with ten bits of its fraction, the fraction's other bits follow, in the order of the numbers.  A round counts the
next digit's values within the digits chosen so far, of which there are some millions at most, and its choice, one row for each
of the two middle ranks, is what the next round joins.  All rounds read the same counted values, which are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: By how many bits the fraction is shifted for the first digit, and for each later round also how many bits it tells apart.
FIRST, ROUNDS = 42, ((21, 21), (21, 0))


def digits(x: Column) -> tuple[Column, Column]:
    """Two whole numbers in whose order doubles are, NaN last and both zeros alike: of sign and exponent, and of the fraction."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), guess)
    e = F.when(power > a, guess - 1).when(power * 2 <= a, guess + 1).otherwise(guess)
    fraction = ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    huge, up = a == float("inf"), x > 0
    first = F.when(F.isnan(x), 4000).when(a == 0, 0).when(huge, F.when(up, 3000).otherwise(-3000)).otherwise(F.when(up, e + 1076).otherwise(-1076 - e))
    return first.cast("long"), F.when(F.isnan(x) | huge | (a == 0), 0).otherwise(F.when(up, fraction).otherwise((1 << 52) - 1 - fraction)).cast("long")


def summary(df: DataFrame, number: Column, present: Column) -> DataFrame:
    """One row: count, min, max, mean, median of the numbers that aren't null, and found, whether any row is present.

    Without numbers count is 0 and the others are null; NaN counts as the largest number.
    """
    x = F.col("x")
    rows = df.select(number.cast("double").alias("x"), F.coalesce(present, F.lit(False)).alias("found"))
    counted = rows.groupBy("x", "found").agg(F.count("*").alias("rows"))
    first, fraction = digits(x)
    # What isn't there weighs nothing, but its row goes along, as it may be the only one.
    weight = F.when(x.isNull(), 0).otherwise(F.col("rows")).cast("long").alias("c")
    fraction = F.coalesce(fraction, F.lit(0).cast("long"))
    top = F.coalesce(first, F.lit(-5000)) * (1 << 52 - FIRST) + F.shiftright(fraction, FIRST)
    cut = [F.shiftright(fraction, shift).bitwiseAND(F.lit((1 << bits) - 1)) for bits, shift in ROUNDS]
    values = counted.select("x", "found", weight, *(d.alias(f"d{k}") for k, d in enumerate([top, *cut])))

    def chosen(counts: DataFrame, digit: str) -> DataFrame:
        """counts with only the digit that holds each rank k, and k within it."""
        through = F.col("through")
        summed = counts.withColumn("through", F.sum("c").over(Window.partitionBy("id").orderBy(digit)))
        holds = (through - F.col("c") <= F.col("k")) & (F.col("k") < through)
        return summed.where(holds | (F.col("all.count") == 0)).withColumn("k", F.col("k") - through + F.col("c")).drop("through", "c")

    every = Window.partitionBy(F.lit(0))  # over one row a digit
    per_digit = values.groupBy("d0").agg(F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum(x * F.col("c")).alias("sum"), F.bool_or("found").alias("found"))
    totals = F.struct(F.sum("c").over(every).alias("count"), F.min("low").over(every).alias("min"), F.max("high").over(every).alias("max"), F.sum("sum").over(every).alias("sum"), F.max("found").over(every).alias("found"))
    ranks = F.array(*(F.struct(F.lit(k).alias("id"), F.expr(f"(`all`.count - {1 - k}) div 2").alias("k")) for k in (0, 1)))
    choice = chosen(per_digit.select("d0", "c", totals.alias("all")).select("d0", "c", "all", F.inline(ranks)), "d0")
    keys = ["d0"]
    for k in range(1, len(ROUNDS) + 1):
        near = values.join(F.broadcast(choice), keys)  # at most one row a rank
        keys.append(f"d{k}")
        choice = chosen(near.groupBy("id", *keys).agg(F.sum("c").alias("c"), F.first("k").alias("k"), F.first("all").alias("all"), F.min("x").alias("x")).drop("x" if k < len(ROUNDS) else ""), keys[-1])
    low, high = F.min(F.when(F.col("id") == 0, x)), F.min(F.when(F.col("id") == 1, x))
    last = choice.agg(F.max("all").alias("all"), F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("median"))
    n = F.coalesce("all.count", F.lit(0).cast("long"))
    return last.select(n.alias("count"), "all.min", "all.max", (F.col("all.sum") / F.nullif(n, F.lit(0))).alias("mean"), "median", F.coalesce("all.found", F.lit(False)).alias("found"))
