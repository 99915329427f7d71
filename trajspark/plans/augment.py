"""Composite edits: several prompts for an episode, augmented copies, brightness levels, training-ready headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_color, extract_object, variants
from ..operators import sample, stats
from ..operators.keys import first_seen, frame_index, prefixes

#: The wordings that episodes of a colour take in turn.
TURNS = [
    "Put the banana in the {color} colored bowl.",
    "Place the banana in the {color} bowl.",
    "Move the banana to the {color} colored bowl.",
    "Put the banana in the {color} bowl.",
]
#: Of the five prompts of an episode, the first by colour in turn ..
COLOR_TURNS = {
    "red": ["Move the banana to the red colored bowl.", "Put the banana in the red colored bowl.", "Put the banana in the red bowl.", "Place the banana in the red bowl."],
    "green": ["Put the banana in the green bowl.", "Place the banana in the green bowl.", "Move the banana to the green colored bowl.", "Put the banana in the green colored bowl."],
    "blue": ["Put the banana in the blue colored bowl.", "Put the banana in the blue bowl.", "Place the banana in the blue bowl.", "Move the banana to the blue colored bowl."],
}
#: .. the second by position in turn ..
POSITION_TURNS = {
    "left": ["left bowl", "1st bowl from the left", "leftmost bowl"],
    "middle": ["center bowl", "2nd bowl from the left", "middle bowl"],
    "right": ["right bowl", "3rd bowl from the left", "rightmost bowl"],
}
#: .. and the third by the colours that it excludes.
EXCLUDED = {"red": "not green and not blue", "green": "not red and not blue", "blue": "not red and not green"}


def _by(key: Column, table: dict[str, list[str]], turn: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.get(F.array(*map(F.lit, own)), turn % len(own))) for k, own in table.items()])


def rotating_prompts(episodes: DataFrame, key: str = "episode_index", prompt: str = "prompt") -> DataFrame:
    """Episodes with the wording that is next for their colour; prompts without a colour stay.

    Turns count the earlier episodes of a colour by two-level prefix sums, so no window holds a whole colour.
    """
    rows = episodes.withColumn("color", detect_color(F.col(prompt)))
    rows = prefixes(rows, key, {f"_{c}": F.when(F.col("color") == c, 1).otherwise(0).cast("long") for c in ("green", "red", "blue")})
    turn = F.coalesce(*[F.when(F.col("color") == c, F.col(f"_{c}")) for c in ("green", "red", "blue")])
    wording = F.replace(F.get(F.array(*map(F.lit, TURNS)), (turn % 4).cast("int")), F.lit("{color}"), F.col("color"))
    out = rows.withColumn("new_prompt", F.coalesce(wording, F.col(prompt)))
    return out.drop("_green", "_red", "_blue")


def five_prompts(position: Column, color: Column, left: Column, right: Column, number: Column) -> Column:
    """Colour, position, exclusion, and two relations of an episode; `left` and `right` are the neighbours' colours,
    null at the ends. `number` is the episode's number among those of its kind."""
    place = F.concat(F.lit("Put the banana into the "), _by(position, POSITION_TURNS, number), F.lit(" from the robot perspective."))
    excluded = F.coalesce(*[F.when(color == c, F.lit(t)) for c, t in EXCLUDED.items()])
    exclusion = F.concat(F.lit("Put the banana into the bowl that is "), excluded, F.lit("."))
    beside = lambda side, c: F.concat(F.lit(f"Put the banana into the bowl on the {side} of the "), c, F.lit(" bowl from the robot perspective."))
    rank = lambda c: F.when(c == "blue", 0).when(c == "red", 1).otherwise(2)
    first, second = F.when(rank(left) < rank(right), left).otherwise(right), F.when(rank(left) < rank(right), right).otherwise(left)
    between = F.concat(F.lit("Put the banana into the bowl between the "), first, F.lit(" bowl and the "), second, F.lit(" bowl."))
    middle = left.isNotNull() & right.isNotNull()
    fourth = F.when(middle, between).when(left.isNotNull(), beside("right", left)).otherwise(beside("left", right))
    turned = F.when(number % 2 == 0, beside("right", left)).otherwise(beside("left", right))
    fifth = F.when(middle, turned).otherwise(_by(color, COLOR_TURNS, number + 2))
    return F.array(_by(color, COLOR_TURNS, number), place, exclusion, fourth, fifth)


def expand_prompts(frames: DataFrame, episodes: DataFrame, prompts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every episode once for each prompt of an array column: new frames, episodes and dictionary, densely numbered."""
    copies = episodes.select("episode_index", "length", F.posexplode(prompts).alias("copy", "task"))
    sizes = episodes.select("episode_index", "length", F.size(prompts).cast("long").alias("k"))
    sizes = prefixes(sizes, "episode_index", {"e0": F.col("k"), "f0": F.col("k") * F.col("length")})
    placed = copies.join(sizes.select("episode_index", "e0", "f0"), "episode_index")
    start = F.col("f0") + F.col("copy") * F.col("length")
    placed = placed.select("episode_index", "length", "task", (F.col("e0") + F.col("copy")).alias("new_episode"), start.alias("dataset_from_index"))
    tasks = first_seen(placed, "task", ["new_episode"], "task_index")
    placed = placed.join(tasks, "task")
    rows = frames.drop("task_index", "task").withColumn("frame_index", frame_index("index"))
    rows = rows.join(placed.select("episode_index", "new_episode", "dataset_from_index", "task_index"), "episode_index")
    index = F.col("dataset_from_index") + F.col("frame_index")
    rows = rows.withColumns({"index": index, "episode_index": F.col("new_episode")}).drop("new_episode", "dataset_from_index")
    own = placed.select(
        F.col("new_episode").alias("episode_index"), "length", "dataset_from_index",
        (F.col("dataset_from_index") + F.col("length")).alias("dataset_to_index"), F.array("task").alias("tasks"),
    )
    return rows, own, tasks.select("task_index", "task")


#: Ranges of the visual parameters that a copy draws.
RANGES = {"brightness": (0.7, 1.3), "contrast": (0.8, 1.2), "saturation": (0.8, 1.2), "hue_delta": (-10.0, 10.0), "gamma": (0.8, 1.2)}


def augmented_copies(episodes: DataFrame, prompt: str = "prompt", n_text: int = 5, n_visual: int = 3, seed: int = 42, ranges: dict = RANGES) -> DataFrame:
    """Each episode as it is and n_text x n_visual times over: a wording and seeded visual parameters for every copy.

    Wordings come in a seeded order; an instruction without colour or object keeps its own text n_text times.
    """
    text = F.col(prompt)
    color, thing = detect_color(text), extract_object(text)
    known = color.isNotNull() & thing.isNotNull()
    keyed = F.transform(variants(text, color, thing), lambda t: F.struct(sample.seeded_key(F.concat(F.col("episode_index").cast("string"), F.lit(":"), t), seed).alias("k"), t.alias("t")))
    chosen = F.transform(F.slice(F.array_sort(keyed), 1, n_text), lambda s: s["t"])
    wordings = F.when(known, chosen).otherwise(F.array_repeat(text, n_text))
    spread = episodes.withColumn("task", F.explode(wordings)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n_visual))))
    every = episodes.withColumns({"task": text, "copy": F.lit(0)}).unionByName(spread)
    key = F.concat_ws(":", "episode_index", "task", "copy")
    return every.withColumns(
        {
            name: F.when(F.col("copy") > 0, sample.uniform(F.concat(F.lit(name + ":"), key), seed, low, high))
            for name, (low, high) in ranges.items()
        }
    )


#: Brightness levels.
LEVELS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]


def brightness_levels(episodes: DataFrame, seed: int = 42, levels: list[float] = LEVELS) -> DataFrame:
    """Each episode with a seeded level; the number of episodes doesn't change."""
    return episodes.withColumn("level", sample.choice(F.col("episode_index"), seed, levels))


def level_of_frames(slices: DataFrame, fps: float) -> DataFrame:
    """file, frame, level of every video frame that an episode's slice (file, from_ts, to_ts, level) covers; where
    slices touch, the later one counts."""
    ends = F.sequence(F.rint(F.col("from_ts") * fps).cast("long"), F.rint(F.col("to_ts") * fps).cast("long"))
    spread = slices.select("file", "from_ts", "level", F.explode(ends).alias("frame"))
    return spread.groupBy("file", "frame").agg(F.max_by("level", "from_ts").alias("level"))


def training_ready(frames: DataFrame, info: dict) -> tuple[DataFrame, dict, list[tuple[str, str, str]]]:
    """Statistics of every numeric feature, the header with counted totals, and (field, old, new) of what changed."""
    parts = []
    for name, kind in frames.dtypes:
        if kind.startswith("array"):
            own = stats.as_arrays(stats.vector_stats(frames.select(F.col(f"`{name}`").alias("v")), "v", []), [])
            parts.append(own.select(F.lit(name).alias("feature"), *[F.col(c).cast("array<double>").alias(c) for c in own.columns]))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            own = stats.scalar_stats(frames.select(F.col(f"`{name}`").cast("double").alias("v")), "v", [])
            parts.append(own.select(F.lit(name).alias("feature"), *[F.array(F.col(c).cast("double")).alias(c) for c in own.columns]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    n, episodes, tasks = frames.agg(F.count("*"), F.count_distinct("episode_index"), F.count_distinct("task_index")).first()
    new = info | {"total_frames": n, "total_episodes": episodes, "total_tasks": tasks, "splits": {"train": f"0:{episodes}"}}
    changed = [(k, str(info.get(k)), str(v)) for k, v in new.items() if info.get(k) != v]
    return whole, new, changed


def resume(done: DataFrame, plan: DataFrame, key: str = "episode_index") -> DataFrame:
    """What a plan still has to do."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def neighbours_in_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with the value to the left and to the right in a fixed order; null at the ends."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"left": F.lag(value).over(w), "right": F.lead(value).over(w)})
