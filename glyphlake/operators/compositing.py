"""Drawing any number of layers on canvases as relations.

Layers are sparse pixels. Those of one place are sorted by their order and folded one after the other, as mixing with a
truncated result depends on the order; the canvas itself is never held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.geometry import blend

STATE = "struct<value:int,overwrites:bigint>"


def clipped(pixels: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """The pixels that lie on the canvas."""
    return pixels.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))


def composited(pixels: DataFrame, keys: list[str], order: str = "z", how: str = "blend") -> DataFrame:
    """(keys, x, y, value, overwrites) of pixels (keys, order, x, y, value[, opaque]) on an empty canvas.

    Pixels of one place are drawn by `order`, equal ones by value. A value of 0 draws nothing. `blend` mixes with what is
    there by the value as alpha, in single precision, truncated; `replace` puts the value in its place. overwrites counts
    the layers that met a value other than 0. Where `opaque` is true a pixel replaces what is there, and counts no
    overwrite, as outlines do. Pixels of a place are as many as the layers that cross there.
    """
    if how not in ("blend", "replace"):
        raise ValueError(f"unknown way to draw {how}")
    opaque = F.col("opaque") if "opaque" in pixels.columns else F.lit(False)
    drawn = pixels.where("value > 0").select(*keys, "x", "y", F.struct(F.col(order).alias("z"), F.col("value").cast("int").alias("value"), opaque.alias("opaque")).alias("_p"))

    def draw(acc: Column, p: Column) -> Column:
        mixed = blend(p["value"], acc["value"]) if how == "blend" else p["value"]
        over = (~p["opaque"] & (acc["value"] > 0)).cast("bigint")
        return F.struct(F.when(p["opaque"], p["value"]).otherwise(mixed).alias("value"), (acc["overwrites"] + over).alias("overwrites")).cast(STATE)

    empty = F.struct(F.lit(0).alias("value"), F.lit(0).cast("bigint").alias("overwrites")).cast(STATE)
    places = drawn.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return places.select(*keys, "x", "y", F.aggregate("_p", empty, draw).alias("s")).select(*keys, "x", "y", "s.*")


def summary(canvas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overwrites, l, t, r, b) of composited places: the counter and the box of what was drawn."""
    box = [F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b")]
    return canvas.groupBy(*keys).agg(F.sum("overwrites").alias("overwrites"), *box)


def empty_layers(layers: DataFrame, pixels: DataFrame, keys: list[str], order: str = "z") -> DataFrame:
    """The layers (keys, order) that draw nothing; of clipped pixels those wholly off the canvas are among them."""
    return layers.join(pixels.where("value > 0").select(*keys, order).distinct(), [*keys, order], "left_anti").select(*keys, order)


def outline_pixels(boxes: DataFrame, keys: list[str], order: str = "z", value: int = 128) -> DataFrame:
    """The pixels of rectangles (keys, order, l, t, r, b) one pixel wide, corners included, as opaque pixels, each once."""
    c = F.col
    row = lambda y: F.transform(F.sequence(c("l"), c("r")), lambda x: F.struct(x.alias("x"), y.alias("y")))
    column = lambda x: F.transform(F.sequence(c("t"), c("b")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    p = boxes.where("l <= r AND t <= b").withColumn("_p", F.explode(F.array_distinct(F.concat(row(c("t")), row(c("b")), column(c("l")), column(c("r"))))))
    return p.select(*keys, order, "_p.x", "_p.y", F.lit(value).alias("value"), F.lit(True).alias("opaque"))


def cropped(canvas: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """Composited places moved so that their box lies `margin` from each side: (keys, x, y, value, width, height), dark on light.

    Values are inverted; places that are not among them are white. A canvas on which nothing was drawn has no rows.
    """
    box = summary(canvas, keys)
    c = F.col
    return canvas.where("value > 0").join(box.drop("overwrites"), keys).select(
        *keys, (c("x") - c("l") + margin).alias("x"), (c("y") - c("t") + margin).alias("y"), (255 - c("value")).alias("value"),
        (c("r") - c("l") + 1 + 2 * margin).alias("width"), (c("b") - c("t") + 1 + 2 * margin).alias("height"),
    )
