"""Queries of the media tier, of weight files and of benchmark runs, beside their SQL.

Images are made of the test tables: four by two pixels from the 24 bytes of a digest of an event's id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import media
from .functions import values as V
from .functions.text import ANSWERS
from .operators.stats import QUANTILES
from .plans import report
from .queries import query, r6, table
from .sources import sink, weights
from .storage import Scratch

#: The digest as hexadecimal text, and its bytes by place.
_DIGEST = "substr(md5(event_id::VARCHAR) || md5('more' || event_id), 1, 48)"
_BYTES = f"SELECT user_id, event_id, i, ('0x' || substr({_DIGEST}, i * 2 + 1, 2))::INT AS x FROM events, range(24) r(i)"


def images(spark, sf_dir):
    """video (user), number (its events in order are the frames), height, width, pixels."""
    from pyspark.sql import Window

    i = F.col("event_id").cast("string")
    digest = F.substring(F.concat(F.md5(i), F.md5(F.concat(F.lit("more"), i))), 1, 48)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), number.cast("long").alias("number"), "event_id", F.unhex(digest).alias("pixels"))
    return rows.withColumns({"height": F.lit(2), "width": F.lit(4)})


def _shaped(name: str, expression: str) -> str:
    return f"[[[max({expression}) FILTER (c = 0)]], [[max({expression}) FILTER (c = 1)]], [[max({expression}) FILTER (c = 2)]]] AS {name}"


@query(f"""WITH b AS (SELECT i % 3 AS c, x / 255.0::DOUBLE AS x FROM ({_BYTES})),
s AS (SELECT c, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, {", ".join(f"round(quantile_cont(x, {q}), 6) AS {k}" for k, q in QUANTILES.items())} FROM b GROUP BY c)
SELECT {", ".join(_shaped(k, k) for k in ("min", "max", "mean", "std", *QUANTILES))}, (SELECT count(*) FROM events) AS count FROM s""")
def image_stats(spark, sf_dir):
    out = media.image_stats(images(spark, sf_dir))
    rounded = lambda c: F.transform(c, lambda y: F.transform(y, lambda z: F.transform(z, lambda x: F.round(x, 6))))
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c not in ("min", "max", "count")})


@query("""WITH f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM events)
SELECT video, number FROM f WHERE number % greatest(1, (SELECT count(*) FROM events) // 200) = 0""")
def sampled_frames(spark, sf_dir):
    return media.sampled(images(spark, sf_dir), 200).select("video", "number")


@query(f"""WITH b AS (SELECT event_id, i, x * (0.5 + event_id % 8 / 10.0::DOUBLE) AS y FROM ({_BYTES}))
SELECT event_id, sum(floor(least(255.0, y::FLOAT)))::BIGINT AS total FROM b GROUP BY event_id""")
def brightness_frames(spark, sf_dir):
    """Frames times their level; the sum of the new pixels tells them apart."""
    rows = images(spark, sf_dir).withColumn("level", 0.5 + F.col("event_id") % 8 / 10)
    values = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.conv(F.substring(F.hex("pixels"), i * 2 - 1, 2), 16, 10).cast("long"))
    return media.brightness(rows).select("event_id", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM events),
c AS (SELECT video, max(number) // 2 AS centre, max(number) AS last FROM f GROUP BY video), o AS (SELECT *, unnest([-20, -10, -5, 0, 5, 10, 20]) AS o FROM c)
SELECT video, centre, 2 AS height, (4 * count(*))::INT AS width FROM o WHERE greatest(0, centre + o) <= last GROUP BY ALL""")
def contact_sheets(spark, sf_dir):
    rows = images(spark, sf_dir)
    centres = rows.groupBy("video").agg(F.floor(F.max("number") / 2).alias("centre"))
    return media.sheets(rows, centres).where(F.length("pixels") == F.col("height") * F.col("width") * 3).select("video", "centre", "height", "width")


_LINEAR = "CASE WHEN {0} / 255 > 0.04045 THEN ((({0} / 255 + 0.055) / 1.055) ** 2.4) ELSE {0} / 255 / 12.92 END"
_ROOT = "CASE WHEN {0} > 0.008856 THEN {0} ** (1.0::DOUBLE / 3) ELSE 7.787 * {0} + 16.0::DOUBLE / 116 END"


@query(f"""WITH p AS (SELECT event_id, s, (event_id * (7 + s) % 256)::DOUBLE AS r, (event_id * (13 + s) % 256)::DOUBLE AS g, (event_id * (29 + 2 * s) % 256)::DOUBLE AS b FROM events, (SELECT unnest([0, 1]) AS s)),
l AS (SELECT event_id, s, {_LINEAR.format("r")} AS r, {_LINEAR.format("g")} AS g, {_LINEAR.format("b")} AS b FROM p),
x AS (SELECT event_id, s, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE AS z FROM l),
c AS (SELECT event_id, s, CASE WHEN y > 0.008856 THEN 116 * y ** (1.0::DOUBLE / 3) - 16 ELSE 903.3::DOUBLE * y END AS l, 500 * (({_ROOT.format("x")}) - ({_ROOT.format("y")})) AS a, 200 * (({_ROOT.format("y")}) - ({_ROOT.format("z")})) AS b FROM x),
d AS (SELECT u.event_id, sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2) AS chroma, (u.l * 2.55::DOUBLE + 1) / (v.l * 2.55::DOUBLE + 1) AS ratio FROM c u JOIN c v ON u.event_id = v.event_id AND u.s = 0 AND v.s = 1)
SELECT event_id, round(chroma, 6) AS chroma, chroma > 12 AS covered, round(CASE WHEN chroma > 12 THEN 1.0 ELSE greatest(0.3, least(ratio, 1.2)) END, 6) AS shade FROM d""")
def colour_changes(spark, sf_dir):
    i = F.col("event_id")
    one, other = (V.lab(*[(i * (k + s * m) % 256).cast("double") for k, m in ((7, 1), (13, 1), (29, 2))]) for s in (0, 1))
    rows = table(spark, sf_dir, "events").select("event_id", one.alias("x"), other.alias("y"))
    change = V.colour_change(F.col("x"), F.col("y"))
    return r6(rows.select("event_id", V.chroma_distance(F.col("x"), F.col("y")).alias("chroma"), change["covered"].alias("covered"), change["shade"].alias("shade")), "chroma", "shade")


@query("""WITH p AS (SELECT printf('layers/part-%05d.safetensors', p_partkey // 50) AS file, sum(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_size * (p_partkey % 100 + 1) END)::BIGINT AS n FROM part WHERE p_partkey // 50 % 4 <> 3 GROUP BY 1)
SELECT file, n, CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) WHEN n >= 1000 THEN printf('%.2fK', n / 1e3) ELSE n::VARCHAR END AS text FROM p""")
def weight_parameters(spark, sf_dir):
    """Files of fifty tensors each, one a part, and files of other state between them."""
    root, k = f"{Scratch(spark).at}/weights", F.col("p_partkey")
    shape = F.when(k % 7 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("p_size").cast("long"), k % 100 + 1))
    tensor = F.struct(F.concat(F.lit("t"), k.cast("string")).alias("key"), F.struct(F.lit("F32").alias("dtype"), shape.alias("shape"), F.lit([0, 0]).alias("data_offsets")).alias("value"))
    number = F.floor(k / 50)
    name = F.format_string("layers/%s-%05d.safetensors", F.when(number % 4 == 3, "optimizer").otherwise("part"), number)
    own = table(spark, sf_dir, "part").groupBy(name.alias("_path")).agg(F.to_json(F.map_from_entries(F.collect_list(tensor))).alias("head"))
    size = F.lpad(F.hex(F.octet_length("head")), 16, "0")
    first = F.unhex(F.concat(*[F.substring(size, 15 - 2 * i, 2) for i in range(8)]))
    rows = own.select(F.concat(first, F.encode("head", "UTF-8"), F.unhex(F.lit("00" * 64))).alias("data"), "_path")
    sink.write_files(rows, root, "_path", [], kind="bytes")
    out = weights.parameters(weights.read_weights(spark, root))
    return out.select(F.substring_index("path", "/weights/", -1).alias("file"), "n", "text")


def answers(paths: pd.Series, prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: it answers by the number in the scene's name, in several spellings, or not at all."""
    number = paths.str.extract(r"(\d+)")[0].astype(int).to_numpy()
    said = np.array(["Top Left", "top-right", "It is in the bottom left.", "bottom_right", "no idea"], object)
    return pd.Series(np.where(prompts.str.contains("Where is "), said[number % 5], None))


@query("""WITH p AS (SELECT (['top_left', 'top_right', 'bottom_left', 'bottom_right'])[p_partkey % 4 + 1] AS target, (['top_left', 'top_right', 'bottom_left', 'bottom_right', NULL])[p_partkey % 5 + 1] AS said FROM part),
k AS (SELECT target AS class, count(*) AS total, count(*) FILTER (said = target) AS correct, count(*) FILTER (said IS NULL) AS unparseable FROM p GROUP BY target
      UNION ALL SELECT NULL, count(*), count(*) FILTER (said = target), count(*) FILTER (said IS NULL) FROM p)
SELECT *, round(correct / total, 6) AS accuracy FROM k""")
def benchmark_run(spark, sf_dir):
    k = F.col("p_partkey")
    target = F.get(F.array(*map(F.lit, ANSWERS)), (k % 4).cast("int"))
    samples = table(spark, sf_dir, "part").select(F.concat(F.lit("scene_"), k.cast("string"), F.lit(".jpg")).alias("scene_path"), F.col("p_name").alias("target_celebrity"), target.alias("target_position"))
    return r6(report.accuracy(report.evaluate(samples, "Where is {celebrity}?", answers)), "accuracy")
