"""Tensor queries: embeddings stand for images and latents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.operators import tensors as t
from glyphlake.plans.registry import query
from glyphlake.session import table

# pixels in [0, 1] with 255 steps, from components of about -0.5 to 0.5
UNIT_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: round_even(least(greatest(x::DOUBLE + 0.5, 0), 1) * 255, 0) / 255.0::DOUBLE) AS u FROM embeddings"


def _unit(spark, sf_dir):
    u = F.transform("embedding", lambda x: F.rint(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255) / 255.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", u.alias("u"))


LONG_SQL = f"SELECT vec_id, unnest(range(0, len(u)))::INT AS channel, unnest(u) AS value FROM ({UNIT_SQL})"


def _long(spark, sf_dir):
    return _unit(spark, sf_dir).select("vec_id", F.posexplode("u").alias("channel", "value"))


@query("quantize", f"SELECT vec_id, channel, round(round_even(value * 3, 0) / 3, 6) AS q FROM ({LONG_SQL})")
def quantize(spark, sf_dir):
    return _long(spark, sf_dir).select("vec_id", "channel", F.round(t.quantised(F.col("value"), 4), 6).alias("q"))


@query("one_hot", f"SELECT vec_id, channel, array_to_string(list_transform(range(0, 4), lambda i: (i = round_even(value * 3, 0)::INT)::INT), '') AS onehot FROM ({LONG_SQL})")
def one_hot(spark, sf_dir):
    l = _long(spark, sf_dir)
    labels = t.one_hot(t.bucket(F.col("value"), 4), 4)
    return l.select("vec_id", "channel", F.array_join(F.transform(labels, lambda x: x.cast("string")), "").alias("onehot"))


@query("flatten_labels", f"SELECT vec_id, channel, round(round_even(value * 3, 0) / 3, 6) AS value FROM ({LONG_SQL})")
def flatten_labels(spark, sf_dir):
    """Labels back to values: equal to the quantised values."""
    l = _long(spark, sf_dir).withColumn("labels", t.one_hot(t.bucket(F.col("value"), 4), 4))
    return l.select("vec_id", "channel", F.round(t.from_labels(F.col("labels"), 4), 6).alias("value"))


@query("quant_loss", f"""
WITH c AS (SELECT value, count(*) AS n FROM ({LONG_SQL}) GROUP BY value)
SELECT levels::INT AS levels, round(sum(n * pow(value - round_even(value * (levels - 1), 0) / (levels - 1), 2)) / sum(n), 9) AS mse FROM c, (SELECT unnest(range(2, 257)) AS levels) GROUP BY levels""")
def quant_loss(spark, sf_dir):
    return t.quantisation_loss(_long(spark, sf_dir)).withColumn("mse", F.round("mse", 9))


@query("moments", f"SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({LONG_SQL}) GROUP BY channel")
def moments(spark, sf_dir):
    return t.moments(_long(spark, sf_dir)).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("normalized", f"""
WITH l AS ({LONG_SQL}), m AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM l GROUP BY channel)
SELECT vec_id, channel, round((value - mean) / std, 5) + 0 AS normalised FROM l JOIN m USING (channel)""")
def normalized(spark, sf_dir):
    l = _long(spark, sf_dir)
    return t.normalised(l, t.moments(l)).select("vec_id", "channel", (F.round("normalised", 5) + 0).alias("normalised"))


@query("kld", """
SELECT vec_id, round(-0.5 * list_sum(list_transform(range(1, 33), lambda i: 1 + embedding[i + 32]::DOUBLE - embedding[i]::DOUBLE * embedding[i]::DOUBLE - exp(embedding[i + 32]::DOUBLE))), 6) AS kld FROM embeddings""")
def kld(spark, sf_dir):
    """The first half of a vector is the mean, the second the logarithm of the variance."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(t.kl_divergence(F.slice("e", 1, 32), F.slice("e", 33, 32)), 6).alias("kld"))


@query("bce", f"""
SELECT vec_id, round(sum(-(z * CASE WHEN v > 0 THEN greatest(ln(CASE WHEN v > 0 THEN v ELSE 1 END), -100) ELSE -100 END
                           + (1 - z) * CASE WHEN v < 1 THEN greatest(ln(CASE WHEN v < 1 THEN 1 - v ELSE 1 END), -100) ELSE -100 END)), 5) AS bce
FROM (SELECT vec_id, CASE WHEN (vec_id + channel) % 50 = 0 THEN 0 WHEN (vec_id + channel) % 50 = 1 THEN 1 ELSE value END AS v, (channel % 2)::DOUBLE AS z FROM ({LONG_SQL})) GROUP BY vec_id""")
def bce(spark, sf_dir):
    l = _long(spark, sf_dir)
    at = (F.col("vec_id") + F.col("channel")) % 50  # some probabilities of 0 and 1, where the logarithm is cut
    p = F.when(at == 0, 0.0).when(at == 1, 1.0).otherwise(F.col("value"))
    loss = t.cross_entropy_of_probability(p, (F.col("channel") % 2).cast("double"))
    return l.groupBy("vec_id").agg(F.round(F.sum(loss), 5).alias("bce"))


@query("bce_logits", """
SELECT vec_id, round(sum(greatest(x, 0) - x * z + ln(1 + exp(-abs(x)))), 5) AS bce
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (unnest(range(0, len(embedding))) % 2)::DOUBLE AS z FROM embeddings) GROUP BY vec_id""")
def bce_logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    loss = t.cross_entropy_of_logit(F.col("x").cast("double"), (F.col("i") % 2).cast("double"))
    return e.groupBy("vec_id").agg(F.round(F.sum(loss), 5).alias("bce"))


@query("cross_entropy", """
SELECT vec_id, round(ln(list_sum(list_transform(embedding[1:10], lambda v: exp(v::DOUBLE)))) - embedding[label + 1]::DOUBLE, 6) AS loss FROM embeddings""")
def cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(t.categorical_cross_entropy(F.col("e"), F.col("label")), 6).alias("loss"))


@query("weighted_loss", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem")
def weighted_loss(spark, sf_dir):
    return t.weighted_loss(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity").select(F.round("loss", 6).alias("loss"))


@query("tiles", f"""
SELECT vec_id, k::INT AS tile, array_to_string(list_transform(range(0, 16), lambda j: round(u[(j // 4) * 16 + k * 4 + j % 4 + 1] * 255)::INT), ',') AS pixels FROM ({UNIT_SQL}), (SELECT unnest(range(0, 3)) AS k)""")
def tiles(spark, sf_dir):
    """A vector as a strip of 16 by 4 pixels: its first three square tiles."""
    u = _unit(spark, sf_dir).select("vec_id", F.posexplode(t.tiles(F.col("u"), F.lit(4), F.lit(16), 3)).alias("tile", "p"))
    return u.select("vec_id", "tile", F.array_join(F.transform("p", lambda v: F.round(v * 255).cast("int").cast("string")), ",").alias("pixels"))


@query("fixed_tile", f"SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda j: round(u[(j // 4) * 16 + 8 + j % 4 + 1] * 255)::INT), ',') AS pixels FROM ({UNIT_SQL})")
def fixed_tile(spark, sf_dir):
    p = t.tile(F.col("u"), F.lit(4), F.lit(16), 2)
    return _unit(spark, sf_dir).select("vec_id", F.array_join(F.transform(p, lambda v: F.round(v * 255).cast("int").cast("string")), ",").alias("pixels"))


@query("flatten_channels", f"""
SELECT vec_id, array_to_string(list_transform(range(0, 32), lambda j: round(u[((j % 16) // 4) * 16 + (j // 16) * 4 + j % 4 + 1] * 255)::INT), ',') AS pixels FROM ({UNIT_SQL})""")
def flatten_channels(spark, sf_dir):
    """The first two tiles, one below the other."""
    p = t.flatten_channels(t.tiles(F.col("u"), F.lit(4), F.lit(16), 2))
    return _unit(spark, sf_dir).select("vec_id", F.array_join(F.transform(p, lambda v: F.round(v * 255).cast("int").cast("string")), ",").alias("pixels"))


@query("to_unit", "SELECT n_chars % 256 AS pixel, round((n_chars % 256) / 255.0::DOUBLE, 6) AS value FROM documents GROUP BY ALL")
def to_unit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("n_chars") % 256).alias("pixel")).distinct()
    return d.select("pixel", F.round(F.element_at(t.to_unit(F.array("pixel")), 1), 6).alias("value"))


@query("grid_layout", """
SELECT vec_id, (vec_id // w)::INT AS row, (vec_id % w)::INT AS col, w::INT AS columns FROM (SELECT vec_id, ceil(sqrt(count(*) OVER ()))::INT AS w FROM embeddings)""")
def grid_layout(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(n)).select("vec_id", t.grid_position(F.col("vec_id"), F.col("n")).alias("g")).select("vec_id", "g.*")


@query("reparameterise", """
SELECT vec_id, i::INT AS i, round(embedding[i]::DOUBLE + sqrt(-2 * ln(u)) * cos(2 * 3.141592653589793::DOUBLE * v) * exp(embedding[i + 32]::DOUBLE / 2), 6) AS z
FROM (SELECT vec_id, embedding, i, (('0x' || substr(md5('0:0:' || vec_id || ':' || i), 1, 13))::BIGINT + 1) / 4503599627370496::DOUBLE AS u,
             (('0x' || substr(md5('0:1:' || vec_id || ':' || i), 1, 13))::BIGINT + 1) / 4503599627370496::DOUBLE AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings))""")
def reparameterise(spark, sf_dir):
    """mu + noise * exp(log sigma / 2); the noise depends on the vector and a seed only."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    z = t.reparameterised(F.slice("e", 1, 32), F.slice("e", 33, 32), t.noise(32, F.col("vec_id")))
    return e.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("z", 6).alias("z"))


@query("vae_loss", """
WITH e AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
b AS (SELECT vec_id, sum(greatest(x, 0) - x * z + ln(1 + exp(-abs(x)))) AS bce FROM (SELECT vec_id, unnest(e) AS x, (unnest(range(0, len(e))) % 2)::DOUBLE AS z FROM e) GROUP BY vec_id),
k AS (SELECT vec_id, -0.5 * list_sum(list_transform(range(1, 33), lambda i: 1 + e[i + 32] - e[i] * e[i] - exp(e[i + 32]))) AS kld FROM e)
SELECT round((avg(bce) + avg(kld)) / 4, 5) AS loss, count(*) AS n FROM b JOIN k USING (vec_id)""")
def vae_loss(spark, sf_dir):
    """Reconstruction from logits and divergence, per sample and channel, as one figure of the whole table as a batch."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    target = F.transform("e", lambda _, i: (i % 2).cast("double"))
    row = e.select(t.reconstruction(F.col("e"), target).alias("rebuilt"), t.kl_divergence(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("kld"))
    return t.batch_loss(row, channels=4).withColumn("loss", F.round("loss", 5))


@query("multi_channel_loss", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT vec_id, sum(ln(list_sum(list_transform(e[16 * ch + 1:16 * ch + 10], lambda v: exp(v)))) - e[16 * ch + 1 + (label + ch) % 10]) AS ce FROM e, (SELECT unnest(range(0, 4)) AS ch) GROUP BY vec_id),
k AS (SELECT vec_id, -0.5 * list_sum(list_transform(range(1, 33), lambda i: 1 + e[i + 32] - e[i] * e[i] - exp(e[i + 32]))) AS kld FROM e)
SELECT round((avg(ce) + avg(kld)) / 4, 5) AS loss, count(*) AS n FROM c JOIN k USING (vec_id)""")
def multi_channel_loss(spark, sf_dir):
    """Cross entropies of four channels with ten classes each, and divergence, per sample and channel."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    losses = [t.categorical_cross_entropy(F.slice("e", 16 * ch + 1, 10), (F.col("label") + ch) % 10) for ch in range(4)]
    row = e.select(sum(losses[1:], losses[0]).alias("rebuilt"), t.kl_divergence(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("kld"))
    return t.batch_loss(row, channels=4).withColumn("loss", F.round("loss", 5))


@query("hidden_sweep", """
WITH v AS (SELECT unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT pos, sum(v * v) AS s FROM v GROUP BY pos),
h AS (SELECT unnest(range(1, 65)) AS hidden)
SELECT hidden, round(coalesce((SELECT sum(s) FROM s WHERE pos >= hidden), 0) / (SELECT count(*) FROM embeddings), 6) AS loss FROM h""")
def hidden_sweep(spark, sf_dir):
    """The loss at each number of hidden values, all of them in one pass."""
    found = t.truncation_losses(table(spark, sf_dir, "embeddings"), spark.range(1, 65).withColumnRenamed("id", "hidden"), "embedding")
    return found.select("hidden", F.round("loss", 6).alias("loss"))
