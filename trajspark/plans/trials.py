"""Evaluation plans: bowl layouts x targets x wordings as cross joins of small literal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sample import seeded_key

#: Bowl colours from left to right, by layout.
CONFIGS = [
    ("config1-green-red-blue", "green", "red", "blue"),
    ("config2-red-green-blue", "red", "green", "blue"),
    ("config3-red-blue-green", "red", "blue", "green"),
    ("config4-blue-red-green", "blue", "red", "green"),
    ("config5-green-blue-red", "green", "blue", "red"),
    ("config6-blue-green-red", "blue", "green", "red"),
]
POSITIONS = ["left", "center", "right"]
#: Wordings.
COLOR_WORDINGS = [
    "Put the banana in the {color} bowl.",
    "Put the banana in the {color} colored bowl.",
    "Place the banana in the {color} bowl.",
    "Move the banana to the {color} colored bowl.",
]
NEGATIONS = {
    "red": "Put the banana into the bowl that is not green and not blue.",
    "green": "Put the banana into the bowl that is not red and not blue.",
    "blue": "Put the banana into the bowl that is not red and not green.",
}
ORDINAL_WORDINGS = [
    ["1st bowl from the left", "left bowl", "leftmost bowl"],
    ["2nd bowl from the left", "center bowl", "middle bowl"],
    ["3rd bowl from the left", "right bowl", "rightmost bowl"],
]
#: Targets (0 left .. 2 right) of the compact plan by layout; slots are canonical, paraphrase,
#: negation, ordinal, relation.
COMPACT_TARGETS = [(0, 1, 2, 2, 1), (0, 1, 0, 1, 2), (2, 0, 0, 1, 2), (0, 0, 2, 1, 2), (1, 1, 0, 2, 2), (2, 1, 0, 1, 0)]
#: Columns that are filled in by hand.
SCORING = [
    "policy_repo_id", "checkpoint", "date", "operator", "grasp_success", "correct_bowl_motion", "release_success",
    "task_success", "actual_bowl_color", "actual_bowl_position", "failure_mode", "notes",
]


def targets(spark: SparkSession, objects: DataFrame | None = None) -> DataFrame:
    """Every target of every layout, with the colours beside it (null at the ends); with `objects`, for each object."""
    names = ("config_name", "left_bowl", "center_bowl", "right_bowl")
    layouts = [F.struct(F.lit(i).alias("config"), *[F.lit(x).alias(n) for n, x in zip(names, own, strict=True)]) for i, own in enumerate(CONFIGS)]
    each = spark.range(1) if objects is None else objects
    configs = each.select(*([] if objects is None else ["object"]), F.inline(F.array(*layouts)))
    order = F.array("left_bowl", "center_bowl", "right_bowl")
    rows = configs.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("target"))
    return rows.withColumns(
        {
            "target_color": F.get(order, F.col("target")),
            "target_position": F.get(F.array(*map(F.lit, POSITIONS)), F.col("target")),
            "left_color": F.when(F.col("target") > 0, F.get(order, F.col("target") - 1)),
            "right_color": F.when(F.col("target") < 2, F.get(order, F.col("target") + 1)),
        }
    )


def _pick(items: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), at)


def _colored(at: Column) -> Column:
    return F.replace(_pick(COLOR_WORDINGS, at), F.lit("{color}"), F.col("target_color"))


def _ordinal(at: Column) -> Column:
    words = F.get(F.array(*[F.array(*map(F.lit, own)) for own in ORDINAL_WORDINGS]), F.col("target"))
    return F.concat(F.lit("Put the banana into the "), F.get(words, at), F.lit(" from the robot perspective."))


def _negation() -> Column:
    return F.coalesce(*[F.when(F.col("target_color") == c, F.lit(text)) for c, text in NEGATIONS.items()])


def _side(side: str) -> tuple[Column, Column]:
    """Variant and prompt of `right of the bowl to the left` or `left of the bowl to the right`."""
    color = F.col("left_color" if side == "right" else "right_color")
    prompt = F.concat(F.lit(f"Put the banana into the bowl on the {side} of the "), color, F.lit(" bowl from the robot perspective."))
    return F.concat(F.lit(f"{side}_of_"), color), prompt


def _between() -> Column:
    """The two edge colours are named in a fixed order: blue first, then red, then green."""
    rank = lambda c: F.when(c == "blue", 0).when(c == "red", 1).otherwise(2)
    a, b = F.col("left_color"), F.col("right_color")
    first, second = F.when(rank(a) < rank(b), a).otherwise(b), F.when(rank(a) < rank(b), b).otherwise(a)
    return F.concat(F.lit("Put the banana into the bowl between the "), first, F.lit(" bowl and the "), second, F.lit(" bowl."))


def _row(family: str, variant, prompt: Column, when: Column | None = None) -> Column:
    own = F.struct(F.lit(family).alias("prompt_family"), (F.lit(variant) if isinstance(variant, str) else variant).alias("prompt_variant"), prompt.alias("prompt"))
    return own if when is None else F.when(when, own)


def _exploded(rows: DataFrame, options: list[Column]) -> DataFrame:
    """A row for each option that applies; `slot` keeps their order."""
    spread = rows.select("*", F.posexplode(F.array(*options)).alias("slot", "o")).where(F.col("o").isNotNull())
    return _about(spread.select("*", "o.*").drop("o"))


def _about(rows: DataFrame) -> DataFrame:
    """Wordings speak of a banana; rows of another object speak of that."""
    return rows.withColumn("prompt", F.replace("prompt", F.lit("banana"), "object")) if "object" in rows.columns else rows


def full(spark: SparkSession, objects: DataFrame | None = None) -> DataFrame:
    """Every wording of every target: 174 rows."""
    middle = F.col("target") == 1
    options = [_row("color", f"color_template_{i + 1}", _colored(F.lit(i))) for i in range(4)]
    options += [_row("negation", "not_other_two_colors", _negation())]
    options += [_row("ordinal", f"ordinal_template_{i + 1}", _ordinal(F.lit(i))) for i in range(3)]
    options += [_row("relative", *_side("right"), F.col("target") > 0), _row("relative", *_side("left"), F.col("target") < 2)]
    options += [_row("between", "between_edge_bowls", _between(), middle)]
    return _exploded(targets(spark, objects), options)


def balanced(spark: SparkSession, objects: DataFrame | None = None) -> DataFrame:
    """Five wordings of every target, chosen by layout and target in turn: 90 rows."""
    turn = (F.col("config") + F.col("target")) % 3
    middle, of = F.col("target") == 1, F.col("config") % 3
    relation = (
        F.when(middle & (of == 0), _row("between", "between_edge_bowls", _between()))
        .when((middle & (of == 1)) | (F.col("target") == 2), _row("relative", *_side("right")))
        .otherwise(_row("relative", *_side("left")))
    )
    options = [
        _row("color", "canonical", _colored(F.lit(0))),
        _row("color", "paraphrase", _colored(1 + turn)),
        _row("negation", "not_other_two_colors", _negation()),
        _row("ordinal", "position_paraphrase", _ordinal(turn)),
        relation,
    ]
    return _exploded(targets(spark, objects), options)


def compact(spark: SparkSession, objects: DataFrame | None = None) -> DataFrame:
    """One target for each of five slots of every layout: 30 rows, ten of each colour."""
    chosen = [(c, t, s) for c, own in enumerate(COMPACT_TARGETS) for s, t in enumerate(own)]
    rows = targets(spark, objects).join(F.broadcast(spark.createDataFrame(chosen, "config int, target int, slot int")), ["config", "target"])
    turn = F.col("config") % 3
    relation = (
        F.when(F.col("target") == 1, _row("between", "between_edge_bowls", _between()))
        .when(F.col("target") == 2, _row("relative", *_side("right")))
        .otherwise(_row("relative", *_side("left")))
    )
    options = F.array(
        _row("color", "canonical", _colored(F.lit(0))),
        _row("color", "paraphrase", _colored(1 + turn)),
        _row("negation", "not_other_two_colors", _negation()),
        _row("ordinal", "position_paraphrase", _ordinal(turn)),
        relation,
    )
    return _about(rows.withColumn("o", F.get(options, F.col("slot"))).select("*", "o.*").drop("o"))


PROFILES = {"full": (full, 3), "balanced": (balanced, 3), "compact30": (compact, 1)}


def plan(spark: SparkSession, profile: str = "balanced", repeats: int | None = None, seed: int | None = 42, policy: str = "", checkpoint: str = "", objects: DataFrame | None = None) -> DataFrame:
    """The trial sheet: rows repeated, numbered in plan order, then in a seeded order unless seed is None. With `objects` (a
    table with a column `object`, each once), a sheet for each of them."""
    rows, usual = PROFILES[profile]
    repeats = usual if repeats is None else repeats
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    of = [] if objects is None else ["object"]
    out = rows(spark, objects).withColumn("repeat_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    place = F.row_number().over(Window.partitionBy(*of).orderBy("config", *(["slot"] if profile == "compact30" else ["target", "slot"]), "repeat_id"))
    out = out.withColumn("trial_id", place)
    if seed is not None:
        out = out.withColumn("trial_id", F.row_number().over(Window.partitionBy(*of).orderBy(seeded_key(F.col("trial_id"), seed), "trial_id")))
    base = [*of, "trial_id", "repeat_id", "config_name", "left_bowl", "center_bowl", "right_bowl", "target_color", "target_position", "prompt_family", "prompt_variant", "prompt"]
    given = {"policy_repo_id": policy, "checkpoint": checkpoint}
    return out.select(*[F.col(c).cast("string").alias(c) for c in base], *[F.lit(given.get(c, "")).alias(c) for c in SCORING])


def summary(rows: DataFrame) -> DataFrame:
    """Counts by layout, by family and by colour, in one pass."""
    sets = ["config_name", "prompt_family", "target_color"]
    grouped = rows.groupingSets([[c] for c in sets], *sets).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") == 3, "config_name").when(F.col("g") == 5, "prompt_family").otherwise("target_color").alias("dimension"), F.coalesce(*sets).alias("value"), "n")
