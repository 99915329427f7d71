"""Optional tier: transforms of raw RGB frames (height x width x 3 bytes) in Arrow batches of a few frames each.

Videos are decoded elsewhere; a frame is a row (key, height, width, pixels). Needs numpy only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.stats import QUANTILES


def _pixels(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def mapped(frames: DataFrame, function: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """frames with new pixels of the same size from (pixels, row)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            new = [np.ascontiguousarray(function(_pixels(r["pixels"], r["height"], r["width"]), r), np.uint8).tobytes() for _, r in frame.iterrows()]
            yield frame.assign(pixels=new)

    return frames.mapInPandas(run, frames.schema)


def brightness(frames: DataFrame, level: str = "level") -> DataFrame:
    """Pixels times a row's level, clipped."""
    return mapped(frames, lambda p, r: np.clip(p.astype(np.float32) * r[level], 0, 255))


def hue_shifted(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """A turn of the hue by a rotation of the colour cube about its grey diagonal."""
    if abs(degrees) < 0.5:
        return pixels
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    third, root = (1 - c) / 3, s / np.sqrt(3)
    turn = np.array([[c + third, third - root, third + root], [third + root, c + third, third - root], [third - root, third + root, c + third]])
    return np.clip(pixels @ turn.T, 0, 255)


def augmented(pixels: np.ndarray, brightness: float = 1, contrast: float = 1, saturation: float = 1, hue_delta: float = 0, gamma: float = 1, noise_std: float = 0, blur_radius: float = 0, shadow: float = 0, shadow_x: float = 0.5, dx: float = 0, dy: float = 0, seed: int = 0) -> np.ndarray:
    """Brightness, contrast, saturation, hue, gamma, seeded Gaussian noise, blur, a shadow on the left, and a translation
    that wraps around."""
    x = np.clip(pixels.astype(np.float64) * brightness, 0, 255)
    grey = x @ [0.299, 0.587, 0.114]
    x = np.clip(grey.mean() + contrast * (x - grey.mean()), 0, 255)
    grey = (x @ [0.299, 0.587, 0.114])[..., None]
    x = hue_shifted(np.clip(grey + saturation * (x - grey), 0, 255), hue_delta)
    x = np.clip((x / 255) ** (1 / gamma) * 255, 0, 255)
    if noise_std:
        x = np.clip(x + np.random.default_rng(seed).normal(0, noise_std, x.shape), 0, 255)
    x = blurred(x, blur_radius)
    if shadow:
        x = x.copy()
        x[:, : int(shadow_x * x.shape[1])] *= 1 - shadow
    return np.roll(x, (int(dy * x.shape[0]), int(dx * x.shape[1])), (0, 1)).astype(np.uint8)


def blurred(pixels: np.ndarray, radius: float) -> np.ndarray:
    """A Gaussian blur along both axes; beyond an edge its last pixel goes on."""
    if radius <= 0:
        return pixels
    reach = int(np.ceil(3 * radius))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    weights /= weights.sum()
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = sum(w * np.take(padded, np.arange(k, k + out.shape[axis]), axis) for k, w in enumerate(weights))
    return out


def sampled(frames: DataFrame, target: int, by: str = "video", number: str = "number") -> DataFrame:
    """Frames at equal distances in every video, about `target` of all; the distance is counted first."""
    stride = F.greatest(F.lit(1), F.floor(frames.select(F.count("*")).scalar() / max(1, target)))
    return frames.where(F.col(number) % stride == 0)


def image_stats(frames: DataFrame) -> DataFrame:
    """Statistics of each channel over all pixels, scaled to 0..1 and shaped (3, 1, 1); count is the number of frames.

    A pixel has 256 values, so exact quantiles come from one histogram a channel. Histograms leave the tasks, not
    pixels.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros((3, 256), np.int64), 0
        for frame in batches:
            seen += len(frame)
            for data in frame["pixels"]:
                own = np.frombuffer(data, np.uint8).reshape(-1, 3)
                for c in range(3):
                    counts[c] += np.bincount(own[:, c], minlength=256)
        channel, level = np.nonzero(counts)
        yield pd.DataFrame({"channel": channel, "level": level, "n": counts[channel, level], "frames": 0})
        yield pd.DataFrame({"channel": [-1], "level": [0], "n": [0], "frames": [seen]})

    rows = frames.select("pixels").mapInPandas(run, "channel int, level int, n long, frames long")
    rows = rows.groupBy("channel", "level").agg(F.sum("n").alias("n"), F.sum("frames").alias("frames"))
    x, n, level = F.col("level") / 255, F.col("n"), F.col("level").cast("double")
    levels = F.array(*map(F.lit, QUANTILES.values()))
    # Sums of whole levels are exact; no more than 3 x 256 rows are ever weighed.
    own = rows.where("channel >= 0").groupBy("channel").agg(
        F.min(x).alias("min"), F.max(x).alias("max"), (F.sum(level * n) / F.sum(n) / 255).alias("mean"), (F.sum(level * n) / F.sum(n)).alias("_m"), (F.sum(level * level * n) / F.sum(n)).alias("_q"),
        F.percentile(x, levels, n).alias("_quantiles"),
    )
    own = own.withColumn("std", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))) / 255)
    own = own.withColumns({name: F.col("_quantiles")[i] for i, name in enumerate(QUANTILES)})
    names = ["min", "max", "mean", "std", *QUANTILES]
    every = F.array_sort(F.collect_list(F.struct("channel", *names)))
    shaped = own.agg(every.alias("all")).select(*[F.transform(F.col("all")[c], lambda x: F.array(F.array(x))).alias(c) for c in names])
    return shaped.crossJoin(F.broadcast(rows.where("channel < 0").agg(F.coalesce(F.sum("frames"), F.lit(0)).alias("count"))))  # one row each


#: What is shown of an episode around a frame.
OFFSETS = (-20, -10, -5, 0, 5, 10, 20)


def sheets(frames: DataFrame, centres: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """One strip (video, centre, height, width, pixels) for each (video, centre): the frames at the offsets side by
    side, the centre framed in red. Frames before the first are the first again, those beyond the last are left out.

    frames are (video, number, height, width, pixels); a strip holds as many frames as there are offsets.
    """
    wanted = centres.select("video", "centre", F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    wanted = wanted.withColumn("number", F.greatest(F.lit(0), F.col("centre") + F.col("offset")))
    rows = frames.select("video", "number", "height", "width", "pixels").join(wanted, ["video", "number"])

    def strip(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        canvas = np.full((group["height"].max(), group["width"].sum(), 3), 255, np.uint8)
        x = 0
        for r in group.itertuples():
            own = _pixels(r.pixels, r.height, r.width).copy()
            if r.offset == 0:
                own[[0, -1]] = own[:, [0, -1]] = (255, 0, 0)
            canvas[: r.height, x : x + r.width] = own
            x += r.width
        first = group.iloc[0]
        return pd.DataFrame([(first["video"], first["centre"], *canvas.shape[:2], canvas.tobytes())], columns=["video", "centre", "height", "width", "pixels"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("video", "centre").applyInPandas(strip, f"video {kinds['video']}, centre {kinds['centre']}, height int, width int, pixels binary")


def channel_sums(frames: DataFrame) -> DataFrame:
    """key, channel, n, total, total_sq, low, high of every frame, scaled to 0..1: what dataset statistics add up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for _, r in frame.iterrows():
                x = _pixels(r["pixels"], r["height"], r["width"]).reshape(-1, 3) / 255.0
                rows += [(r["key"], c, len(x), x[:, c].sum(), (x[:, c] ** 2).sum(), x[:, c].min(), x[:, c].max()) for c in range(3)]
            yield pd.DataFrame(rows, columns=["key", "channel", "n", "total", "total_sq", "low", "high"])

    return frames.mapInPandas(run, "key string, channel int, n long, total double, total_sq double, low double, high double")


def channel_stats(frames: DataFrame) -> DataFrame:
    """Mean, population std, min, max of each channel over all frames."""
    out = channel_sums(frames).groupBy("channel").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("total_sq").alias("q"), F.min("low").alias("min"), F.max("high").alias("max"))
    mean = F.col("t") / F.col("n")
    return out.select("channel", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "min", "max")


def mean_hue(pixels: np.ndarray) -> float:
    """The circular mean hue of the saturated pixels in degrees; 0 if there are none."""
    x = pixels.reshape(-1, 3) / 255.0
    high, span = x.max(1), x.max(1) - x.min(1)
    x, high, span = x[span > 0.05], high[span > 0.05], span[span > 0.05]
    if not len(x):
        return 0.0
    r, g, b = x.T
    hue = np.where(high == r, ((g - b) / span) % 6, np.where(high == g, (b - r) / span + 2, (r - g) / span + 4)) * np.pi / 3
    return float(np.degrees(np.arctan2(np.sin(hue).mean(), np.cos(hue).mean())) % 360)


def accepted(original: list[np.ndarray], augmented: list[np.ndarray], limit: float = 25.0) -> list[str]:
    """What speaks against an augmented episode: another number of frames, none, or a hue shift beyond the limit on
    some of at most five frames at equal distances."""
    if not augmented or len(original) != len(augmented):
        return [f"{len(augmented)} frames for {len(original)}"]
    out = []
    for i in np.linspace(0, len(original) - 1, min(5, len(original))).astype(int):
        gap = abs(mean_hue(original[i]) - mean_hue(augmented[i]))
        if min(gap, 360 - gap) > limit:
            out.append(f"frame {i}: hue shift {min(gap, 360 - gap):.1f}")
    return out
