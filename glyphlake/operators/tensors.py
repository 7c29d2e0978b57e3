"""Image tensors as arrays in columns: tiles, moments, quantisation, labels and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_unit(pixels: Column) -> Column:
    """8-bit pixels as numbers from 0 to 1."""
    return F.transform(pixels, lambda v: v / 255.0)


def tiles(pixels: Column, height: Column, width: Column, most: int | None = None) -> Column:
    """Square tiles of a row-major strip, from the left, as an array of arrays; at most `most`."""
    n = F.floor(width / height).cast("int")
    n = F.least(n, F.lit(most)) if most is not None else n
    one = lambda k: F.flatten(F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.slice(pixels, (y * width + k * height + 1).cast("int"), height)))
    empty = F.array().cast("array<array<double>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(empty)


def tile(pixels: Column, height: Column, width: Column, index: int) -> Column:
    """One square tile of a strip."""
    return F.flatten(F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.slice(pixels, (y * width + index * height + 1).cast("int"), height)))


def flatten_channels(channels: Column) -> Column:
    """Channels one below the other."""
    return F.flatten(channels)


def moments(values: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """(channel, mean, std): mean and population deviation; the same as over means of equally large images."""
    return values.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def normalised(values: DataFrame, m: DataFrame, channel: str = "channel", value: str = "value", max_broadcast_rows: int = 100_000) -> DataFrame:
    """values with `normalised`, (value - mean) / std of its channel; moments are broadcast while they are few."""
    m = m.select(F.col(channel).alias("_c"), "mean", "std")
    m = F.broadcast(m) if m.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows else m
    return values.join(m, F.col(channel) == F.col("_c")).withColumn("normalised", (F.col(value) - F.col("mean")) / F.col("std")).drop("_c", "mean", "std")


def bucket(x: Column, levels: int | Column) -> Column:
    """The level from 0 to levels - 1 that is nearest, halves to even."""
    return F.rint(x * (levels - 1)).cast("int")


def quantised(x: Column, levels: int | Column) -> Column:
    return F.rint(x * (levels - 1)) / (levels - 1)


def one_hot(b: Column, levels: int) -> Column:
    """One array of 0 and 1 with a single 1 at b."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: (i == b).cast("int"))


def from_labels(labels: Column, levels: int) -> Column:
    """The value of the first largest label."""
    return (F.array_position(labels, F.array_max(labels)) - 1) / (levels - 1)


def quantisation_loss(values: DataFrame, value: str = "value", first: int = 2, last: int = 256) -> DataFrame:
    """(levels, mse) of quantising to first..last levels. Equal values are counted first, so few rows are repeated."""
    counted = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    tried = counted.withColumn("levels", F.explode(F.sequence(F.lit(first), F.lit(last))))
    error = F.pow(F.col(value) - quantised(F.col(value), F.col("levels")), 2)
    return tried.groupBy("levels").agg((F.sum(error * F.col("_n")) / F.sum("_n")).alias("mse"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def kl_divergence(mu: Column, log_variance: Column) -> Column:
    """Of a diagonal Gaussian from the standard one, summed over dimensions."""
    return -0.5 * _total(F.zip_with(mu, log_variance, lambda m, v: 1 + v - m * m - F.exp(v)))


def cross_entropy_of_probability(p: Column, target: Column) -> Column:
    """Binary cross entropy with logarithms cut at -100."""
    low = F.lit(-100.0)
    log = lambda x: F.when(x > 0, F.greatest(F.log(x), low)).otherwise(low)
    return -(target * log(p) + (1 - target) * log(1 - p))


def cross_entropy_of_logit(x: Column, target: Column) -> Column:
    """Binary cross entropy of a logit in the form that never overflows."""
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def categorical_cross_entropy(logits: Column, target: Column) -> Column:
    """Log-sum-exp less the logit of the target (from 0)."""
    top = F.array_max(logits)
    return F.log(_total(F.transform(logits, lambda v: F.exp(v - top)))) + top - F.element_at(logits, (target + 1).cast("int"))


def reconstruction(logits: Column, target: Column) -> Column:
    """Binary cross entropy of an array of logits, summed."""
    return _total(F.zip_with(logits, target, cross_entropy_of_logit))


def batch_loss(rows: DataFrame, rebuilt: str = "rebuilt", divergence: str = "kld", channels: int = 1) -> DataFrame:
    """(loss, n): losses of reconstruction and divergences summed over a batch, divided by its size and by the channels."""
    n = F.count(F.lit(1))
    return rows.agg(((F.sum(rebuilt) + F.sum(divergence)) / n / channels).alias("loss"), n.alias("n"))


def save_moments(moments: DataFrame, path: str) -> None:
    """Moments (channel, mean, std) as a table of one file, for other runs to normalise by."""
    moments.select("channel", "mean", "std").coalesce(1).write.mode("overwrite").parquet(path)


def load_moments(spark, path: str) -> DataFrame:
    return spark.read.schema("channel int, mean double, std double").parquet(path)


def weighted_loss(losses: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    return losses.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def reparameterised(mu: Column, log_sigma: Column, noise: Column) -> Column:
    """mu + noise * exp(log_sigma / 2), element by element; noise is a column of standard normal numbers."""
    return F.zip_with(F.zip_with(log_sigma, noise, lambda s, e: e * F.exp(s / 2)), mu, lambda e, m: m + e)


def noise(n: int, key: Column, seed: int = 0) -> Column:
    """n standard normal numbers that depend on key and seed only (Box-Muller on 52 bits of MD5, which any engine has)."""
    text = lambda i, k: F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), key.cast("string"), i.cast("string"))
    unit = lambda i, k: (F.conv(F.substring(F.md5(text(i, k)), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * 3.141592653589793 * unit(i, 1)))


def truncation_losses(vectors: DataFrame, settings: DataFrame, vector: str = "mu") -> DataFrame:
    """settings (hidden) with `loss`: the mean squared length of what a vector loses when only its first `hidden` numbers are kept.

    One pass over the vectors for all settings: squares are summed by place, and each setting takes the places behind it.
    Vectors without numbers lose nothing; settings that repeat all stay.
    """
    parts = vectors.select(F.posexplode_outer(vector).alias("pos", "v"))
    sums = parts.groupBy("pos").agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("s"))  # a row for each place
    places = sums.where("pos IS NOT NULL").agg(F.collect_list(F.struct("pos", "s")).alias("_p")).join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("_n"))))
    d = settings.join(F.broadcast(places))  # one row
    behind = F.filter("_p", lambda p: p["pos"] >= F.col("hidden"))
    loss = F.aggregate(behind, F.lit(0.0), lambda a, p: a + p["s"]) / F.col("_n")
    return d.withColumn("loss", loss).drop("_p", "_n")


def grid_position(i: Column, n: Column) -> Column:
    """Row and column of image i of n in a grid of ceil(sqrt(n)) columns."""
    w = F.ceil(F.sqrt(n)).cast("int")
    return F.struct(F.floor(i / w).cast("int").alias("row"), (i % w).cast("int").alias("col"), w.alias("columns"))


def mosaic_lines(tiles: DataFrame, n: int, fill: float = 0.5) -> DataFrame:
    """(line, pixels) of a picture of n tiles (i, line, pixels) in a grid as grid_position() has it; line counts from its top.

    A tile is its lines, arrays of equal length; i counts from 0. Places without a tile are filled with `fill`. Lines are
    put together one by one from the tiles beside each other, so no task holds the picture, or a whole tile. The last
    places of the grid are the only ones that may lack a tile.
    """
    columns = math.isqrt(n - 1) + 1 if n else 1  # the square root of n, rounded up
    height = F.max(F.col("line") + 1)
    size = tiles.agg(height.alias("_height"), F.max(F.size("pixels")).alias("_width"))  # one row
    t = tiles.join(F.broadcast(size)).withColumn("_g", F.floor(F.col("i") / columns) * F.col("_height") + F.col("line"))
    part = F.struct((F.col("i") % columns).alias("col"), F.col("pixels"))
    lines = t.groupBy("_g").agg(F.array_sort(F.collect_list(part)).alias("_p"), F.first("_width").alias("_width"))
    have = F.flatten(F.transform("_p", lambda p: p["pixels"]))
    missing = F.array_repeat(F.lit(fill).cast(tiles.schema["pixels"].dataType.elementType), columns * F.col("_width") - F.size(have))
    return lines.select(F.col("_g").cast("bigint").alias("line"), F.concat(have, missing).alias("pixels"))
