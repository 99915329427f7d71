"""Reports on prompts, on evaluation results and on differences between datasets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ANSWERS, near_key, normalise_answer


def prompt_frequency(rows: DataFrame, prompts: str, first: str) -> DataFrame:
    """Prompt, its episodes, their share of all, and its place by frequency, ties by first appearance."""
    spread = rows.select(first, F.explode(prompts).alias("task")) if dict(rows.dtypes)[prompts].startswith("array") else rows.select(first, F.col(prompts).alias("task"))
    counts = spread.groupBy("task").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "first"))
    return counts.select("task", "n", (100.0 * share).alias("percent"), place.alias("place"))


def prompt_lengths(rows: DataFrame, prompt: str) -> DataFrame:
    """Over distinct prompts."""
    own = rows.select(F.length(prompt).alias("l"), prompt).distinct()
    return own.agg(F.count("*").alias("n"), F.avg("l").alias("mean"), F.min("l").alias("low"), F.max("l").alias("high"))


def near_duplicate_groups(rows: DataFrame, prompt: str) -> DataFrame:
    """Groups of prompts that differ in case, white space or final full stops; more than one spelling each."""
    own = rows.select(F.col(prompt).alias("task")).distinct().withColumn("key", near_key(F.col("task")))
    # One spelling is one string of a prompt dictionary; copies are gone before they meet.
    return own.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("task")).alias("spellings")).where("n > 1")


def evaluate(samples: DataFrame, template: str, predict: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """samples with prompt (the template with {celebrity} filled in), prediction and latency_s.

    `predict` takes the scene paths and prompts of an Arrow batch and gives its answers; the model is loaded by it once
    a worker. A batch's time is divided among its rows.
    """
    rows = samples.withColumn("prompt", F.replace(F.lit(template), F.lit("{celebrity}"), F.col("target_celebrity")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            began = time.perf_counter()
            said = predict(frame["scene_path"], frame["prompt"])
            each = round((time.perf_counter() - began) / max(1, len(frame)), 3)
            yield frame.assign(prediction=np.asarray(said, object), latency_s=each)

    schema = T.StructType([*rows.schema.fields, T.StructField("prediction", T.StringType()), T.StructField("latency_s", T.DoubleType())])
    return rows.mapInPandas(run, schema)


def accuracy(results: DataFrame, classes: list[str] = ANSWERS) -> DataFrame:
    """Per class, and for all (class null): total, correct, unparseable, accuracy. Classes without rows stay."""
    rows = results.withColumn("parsed", normalise_answer(F.col("prediction")))
    return outcome_accuracy(rows.withColumn("hit", F.col("parsed").eqNullSafe(F.col("target_position"))).withColumn("lost", F.col("parsed").isNull()), "target_position", classes)


def outcome_accuracy(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    own = rows.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("total"), F.count_if("hit").alias("correct"), F.count_if("lost").alias("unparseable")
    )
    known = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "correct", "unparseable")]
    each = known.join(own, "class", "left").select("class", *sums)
    whole = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "correct", "unparseable")])
    out = each.unionByName(whole.select(F.lit(None).cast("string").alias("class"), "*"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def header_fields(infos: dict[str, dict]) -> list[tuple[str, str, str]]:
    """(dataset, field, value) of headers; whole-number floats are integers, objects are written in key order."""
    import json

    def plain(x):
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items())}
        return [plain(v) for v in x] if isinstance(x, list) else x

    out = []
    for name, info in infos.items():
        for key in ("fps", "robot_type", "codebase_version", "chunks_size"):
            out.append((name, key, json.dumps(plain(info.get(key)))))
        for feature, own in sorted((info.get("features") or {}).items()):
            media = own.get("info") or own.get("video_info") or {}
            for key, value in {"dtype": own.get("dtype"), "shape": own.get("shape"), **{k: media.get(k) for k in ("video.codec", "video.pix_fmt", "video.fps")}}.items():
                out.append((name, f"features.{feature}.{key}", json.dumps(plain(value))))
    return out


#: Fields of a header, and of a feature (a field, and where it lies in the feature).
HEADER = ("fps", "robot_type", "codebase_version", "chunks_size")
FEATURE = {"dtype": ["dtype"], "shape": ["shape"], **{f"video.{k}": [f"info['video.{k}']", f"video_info['video.{k}']"] for k in ("codec", "pix_fmt", "fps")}}


def header_rows(headers: DataFrame) -> DataFrame:
    """(dataset, field, value) of a table of headers (dataset, info: JSON text), a header at a time in its task.

    Values are JSON text, texts among them without quotes; whole-number floats are integers, also in shapes. What isn't
    there is `null`; a header that is null or broken has the four fields of a header, all `null`.
    """
    whole = lambda x: F.when(x.rlike(r"^[\[\]\s\d.,-]*$"), F.regexp_replace(F.regexp_replace(x, r"\.0+(?=[,\]\s]|$)", ""), r"\s", "")).otherwise(x)
    shown = lambda found: F.coalesce(whole(found), F.lit("null"))
    field = lambda name, value: F.struct(name.alias("field"), value.alias("value"))
    own = F.array(*[field(F.lit(k), shown(F.get_json_object("info", f"$.{k}"))) for k in HEADER])

    def of_feature(name, text):
        at = lambda places: F.coalesce(*[F.get_json_object(text, f"$.{p}") for p in places])
        return F.array(*[field(F.concat(F.lit("features."), name, F.lit(f".{k}")), shown(at(places))) for k, places in FEATURE.items()])

    features = F.from_json(F.get_json_object("info", "$.features"), "map<string,string>")
    each = F.flatten(F.transform(F.map_entries(features), lambda e: of_feature(e["key"], e["value"])))
    rows = headers.select("dataset", F.explode(F.concat(own, F.coalesce(each, F.array().cast("array<struct<field:string,value:string>>")))).alias("f"))
    return rows.select("dataset", "f.field", "f.value")


def uniformity(fields: DataFrame, n_datasets: int) -> DataFrame:
    """(dataset, field, value) rows to one row a field: whether all datasets have it with one value."""
    out = fields.groupBy("field").agg(F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("value").alias("n_values"))
    return out.withColumn("uniform", (F.col("n_datasets") == n_datasets) & (F.col("n_values") == 1))
