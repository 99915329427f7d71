"""Composite edits and the media tier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import dataset
from trajspark import media
from trajspark.model import TrajectoryDataset
from trajspark.plans import augment, checks, trials


def test_rotating_prompts_take_turns_by_colour(spark):
    rows = [(i, p) for i, p in enumerate(["the red bowl", "the green bowl", "red", "a colored bowl", "Red", "red", "red"])]
    out = augment.rotating_prompts(spark.createDataFrame(rows, "episode_index long, prompt string")).orderBy("episode_index").collect()
    assert out[3].new_prompt == "a colored bowl"
    assert [out[i].new_prompt for i in (0, 2, 4, 5, 6)] == [augment.TURNS[k % 4].format(color="red") for k in range(5)]


def test_five_prompts_of_every_target(spark):
    own = trials.targets(spark)
    position = F.when(F.col("target") == 1, "middle").otherwise(F.col("target_position"))
    out = own.select("target", augment.five_prompts(position, F.col("target_color"), F.col("left_color"), F.col("right_color"), F.lit(3)).alias("p")).collect()
    assert len(out) == 18 and all(len(r.p) == 5 and all(r.p) and len(set(r.p)) == 5 for r in out)
    assert all(("between" in r.p[3]) == (r.target == 1) for r in out)


def test_expanded_prompts_make_a_valid_dataset(spark):
    ds = dataset(spark, (2, 3))
    episodes = ds.episodes.withColumn("p", F.array(F.lit("x"), F.concat(F.lit("y"), F.col("episode_index").cast("string"))))
    frames, own, tasks = augment.expand_prompts(ds.frames, episodes, "p")
    assert checks.violations(TrajectoryDataset(frames, own, tasks)).collect() == []
    assert frames.count() == 10 and [r.task for r in tasks.orderBy("task_index").collect()] == ["x", "y0", "y1"]


def test_augmented_copies(spark):
    rows = [(0, "Put the cup in the red bowl"), (1, "do something")]
    out = augment.augmented_copies(spark.createDataFrame(rows, "episode_index long, prompt string"), n_text=4, n_visual=2)
    assert out.groupBy("episode_index").count().orderBy("episode_index").collect() == [(0, 9), (1, 9)]
    assert out.where("episode_index = 0 AND copy > 0").select("task").distinct().count() == 4
    assert out.where("copy > 0 AND (brightness < 0.7 OR brightness > 1.3 OR brightness IS NULL)").count() == 0
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, augment.augmented_copies(spark.createDataFrame(rows, "episode_index long, prompt string"), n_text=4, n_visual=2).collect()), key=repr)


def test_levels_of_frames(spark):
    slices = spark.createDataFrame([("f", 0.0, 0.3, 0.5), ("f", 0.3, 0.5, 1.2)], "file string, from_ts double, to_ts double, level double")
    out = {r.frame: r.level for r in augment.level_of_frames(slices, 10.0).collect()}
    assert out == {0: 0.5, 1: 0.5, 2: 0.5, 3: 1.2, 4: 1.2, 5: 1.2}


def test_training_ready(spark):
    ds = dataset(spark)
    whole, info, changed = augment.training_ready(ds.frames, {"total_frames": 12, "total_episodes": 9})
    own = {r.feature: r for r in whole.collect()}
    assert own["action"]["mean"] == [1.5, 1.0] and own["index"]["max"] == [11.0]
    assert info["total_episodes"] == 3 and {c[0] for c in changed} == {"total_episodes", "total_tasks", "splits"}


def test_media(spark):
    red = np.zeros((4, 6, 3), np.uint8)
    red[..., 0] = 200
    frames = spark.createDataFrame([("a", 4, 6, red.tobytes(), 0.5)], "key string, height int, width int, pixels binary, level double")
    out = np.frombuffer(media.brightness(frames).first().pixels, np.uint8).reshape(4, 6, 3)
    assert (out[..., 0] == 100).all()
    got = {r.channel: round(r["mean"], 4) for r in media.channel_stats(frames).collect()}
    assert got == {0: round(200 / 255, 4), 1: 0.0, 2: 0.0}
    assert media.accepted([red], [media.augmented(red, hue_delta=10)]) == []
    assert media.accepted([red], [media.augmented(red, hue_delta=120)]) and media.accepted([red], [])
    assert (media.augmented(red, dx=0.5) == red).all()


def test_noise_and_blur():
    grey = np.full((20, 30, 3), 128, np.uint8)
    noisy = media.augmented(grey, noise_std=10, seed=3)
    assert (noisy == media.augmented(grey, noise_std=10, seed=3)).all() and 7 < noisy.std() < 13
    soft = media.augmented(grey, noise_std=10, blur_radius=2, seed=3)
    assert soft.std() < noisy.std() / 3 and abs(soft.mean() - noisy.mean()) < 1 and soft.shape == grey.shape
    assert (media.blurred(grey, 1.5).round() == grey).all() and (media.blurred(grey, 0) == grey).all()
    edge = np.zeros((9, 9, 3))
    edge[:, 5:] = 100
    out = media.blurred(edge, 1)
    assert (np.diff(out[4, :, 0]) >= -1e-9).all() and np.allclose(out[:, 3], out[0, 3])


def test_image_statistics_of_nothing_and_of_one_colour(spark):
    schema = "key string, height int, width int, pixels binary"
    assert media.image_stats(spark.createDataFrame([], schema)).first()["count"] == 0
    one = media.image_stats(spark.createDataFrame([("a", 1, 2, bytes([255, 0, 51] * 2))] * 3, schema)).first()
    assert one["count"] == 3 and one["mean"] == [[[1.0]], [[0.0]], [[0.2]]] and one["std"] == [[[0.0]]] * 3 and one["q99"] == one["min"]


def test_strips_around_a_frame(spark):
    rows = [("v", i, 2, 3, bytes([i] * 18)) for i in range(8)]
    frames = spark.createDataFrame(rows, "video string, number long, height int, width int, pixels binary")
    centres = spark.createDataFrame([("v", 1)], "video string, centre long")
    out = media.sheets(frames, centres, (-5, 0, 5, 20)).first()
    shown = np.frombuffer(out.pixels, np.uint8).reshape(out.height, out.width, 3)
    assert (out.height, out.width) == (2, 9) and (shown[:, :3] == 0).all() and (shown[:, 6:] == 6).all() and (shown[0, 3:6] == (255, 0, 0)).all()


def test_pickled_weights_are_not_read(spark, tmp_path):
    from trajspark.sources import weights

    (tmp_path / "old.bin").write_bytes(b"x")
    with pytest.raises(ValueError, match="safetensors"):
        weights.read_weights(spark, f"file://{tmp_path}")
