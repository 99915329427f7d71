"""Prompt functions: Column in, Column out. Patterns use no look-around, so that other engines can run them too."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How ordinals are written, misspellings included, by position from the left.
ORDINALS = {
    0: ["first", "1st", "1nd", "1rd", "1th"],
    1: ["second", "2nd", "2st", "2rd", "2th"],
    2: ["third", "3rd", "3st", "3nd", "3th"],
}
#: Words before a target, and its optional tail.
INTO = r"(?:into|in|to|inside)\s+(?:the\s+)?"
TAIL = r"(?:\s+from\s+(?:the\s+)?left)?(?:\s+from\s+the\s+robot\s+perspective)?"
#: The whole ordinal prompt; groups are object and digit.
FULL_ORDINAL = (
    r"(?i)^\s*put\s+the\s+(.+?)\s+into\s+the\s+([1-3])\s*(?:st|nd|rd|th|[a-z]{2})?\s+"
    r"bowl\s+from\s+the\s+left\s+from\s+the\s+robot\s+perspective\s*\.?\s*$"
)
#: A colour prompt; groups are object and colour.
COLOR_PROMPT = r"(?i)^Put\s+the\s+(.+?)\s+(?:into|in|to|inside)\s+(?:the\s+)?(red|green|blue)(?:\s+colored)?\s+bowl\.?$"
#: Colours in the order in which they are looked for.
COLORS = ["green", "red", "blue"]
#: The two other colours, in the order in which prompts name them.
OTHERS = {"red": ("green", "blue"), "green": ("red", "blue"), "blue": ("red", "green")}
POSITIONS = ["left", "center", "right"]
RIGHT_ORDINALS = ["3rd", "2nd", "1st"]
#: Wordings of one instruction.
TEMPLATES = [
    "place the {obj} into the {color} bowl",
    "put the {obj} in the {color} bowl",
    "move the {obj} to the {color} bowl",
    "drop the {obj} into the {color} bowl",
    "set the {obj} down in the {color} bowl",
    "pick up the {obj} and place it in the {color} bowl",
    "pick up the {obj} and put it in the {color} bowl",
    "grab the {obj} and place it in the {color} bowl",
    "take the {obj} and put it in the {color} bowl",
    "grasp the {obj} and drop it in the {color} bowl",
    "lift the {obj} and place it in the {color} bowl",
    "please place the {obj} into the {color} bowl",
    "please put the {obj} in the {color} bowl",
    "could you place the {obj} in the {color} bowl",
    "go ahead and place the {obj} into the {color} bowl",
    "now place the {obj} in the {color} bowl",
    "carefully place the {obj} into the {color} bowl",
    "place the {obj} in the {color}-colored bowl",
    "transfer the {obj} to the {color} bowl",
    "deposit the {obj} into the {color} bowl",
]
#: Answers in a 2 x 2 grid, in the order in which they are looked for.
ANSWERS = ["top_left", "top_right", "bottom_left", "bottom_right"]


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def near_key(text: Column) -> Column:
    """Texts with equal keys differ in case, white space or final full stops only."""
    return F.regexp_replace(squeeze(F.lower(text)), r"\.+$", "")


def ordinal_pattern(position: int) -> str:
    return rf"(?i)\b{INTO}(?:{'|'.join(ORDINALS[position])})\s+bowl{TAIL}"


def ordinal_to_color(task: Column, colors: list[Column]) -> Column:
    """Every `into the 2nd bowl from the left ..` becomes `in the <colour> colored bowl`; else unchanged."""
    for position, color in enumerate(colors):
        task = F.regexp_replace(task, F.lit(ordinal_pattern(position)), F.concat(F.lit("in the "), color, F.lit(" colored bowl")))
    return task


def _ordinal_part(task: Column, group: int) -> Column:
    return F.regexp_extract(task, FULL_ORDINAL, group)


def _or_raise(task: Column, new: Column, pattern: str, strict: bool) -> Column:
    miss = F.raise_error(F.concat(F.lit("could not parse prompt: "), task)).cast("string") if strict else task
    return F.when(task.rlike(pattern), new).otherwise(miss)


def ordinal_to_position(task: Column, strict: bool = True) -> Column:
    """The full ordinal prompt with left, center or right; another prompt raises, or stays if not strict."""
    digit = F.try_element_at(F.array(*map(F.lit, POSITIONS)), _ordinal_part(task, 2).try_cast("int"))
    new = F.concat(F.lit("Put the "), squeeze(_ordinal_part(task, 1)), F.lit(" into the bowl on the "), digit)
    return _or_raise(task, F.concat(new, F.lit(" from the robot perspective")), FULL_ORDINAL, strict)


def ordinal_from_right(task: Column, strict: bool = True) -> Column:
    """The full ordinal prompt counted from the right."""
    digit = F.try_element_at(F.array(*map(F.lit, RIGHT_ORDINALS)), _ordinal_part(task, 2).try_cast("int"))
    new = F.concat(F.lit("Put the "), squeeze(_ordinal_part(task, 1)), F.lit(" into the "), digit)
    return _or_raise(task, F.concat(new, F.lit(" bowl from the right from the robot perspective")), FULL_ORDINAL, strict)


def negated(task: Column) -> Column:
    """A colour prompt that names the two colours it doesn't mean; another prompt stays."""
    own = F.trim(task)
    color = F.lower(F.regexp_extract(own, COLOR_PROMPT, 2))
    pick = F.coalesce(*[F.when(color == c, F.lit(f"{a} and not {b}")) for c, (a, b) in OTHERS.items()])
    new = F.concat(F.lit("Put the "), F.trim(F.regexp_extract(own, COLOR_PROMPT, 1)), F.lit(" into the bowl that is not "), pick, F.lit("."))
    return F.when(own.rlike(COLOR_PROMPT), new).otherwise(task)


def relative_prompts(obj: Column, position: Column, colors: Column) -> Column:
    """One prompt for an edge position, two for the middle, from the neighbours' colours."""

    def said(side: str, color: Column) -> Column:
        return F.concat(F.lit("Put the "), obj, F.lit(f" into the bowl on the {side} of the "), color, F.lit(" bowl from the robot perspective"))

    return (
        F.when(position == 0, F.array(said("left", colors[1])))
        .when(position == 2, F.array(said("right", colors[1])))
        .otherwise(F.array(said("right", colors[0]), said("left", colors[2])))
    )


def ordinal_position(task: Column) -> Column:
    """0, 1 or 2 of an ordinal prompt, null for another."""
    cases = [F.when(task.rlike(rf"(?i)\b(?:{'|'.join(words)})\s+bowl"), F.lit(p)) for p, words in ORDINALS.items()]
    return F.coalesce(*cases)


def detect_color(text: Column) -> Column:
    """The first of COLORS that stands in a text as a word."""
    return F.coalesce(*[F.when(F.lower(text).rlike(rf"\b{c}\b"), F.lit(c)) for c in COLORS])


def extract_object(text: Column, skip: list[str] | None = None) -> Column:
    """The first word after `the` that is no colour, bowl or it."""
    stop = F.array(*map(F.lit, [*COLORS, "bowl", "it"] if skip is None else skip))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\bthe\s+(\w+)"), F.lit(1))
    return F.get(F.filter(found, lambda w: ~F.array_contains(stop, w)), F.lit(0))


def _with(value: Column, then) -> Column:
    """then(value), with the value worked out once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def variants(text: Column, color: Column, obj: Column, templates: list[str] = TEMPLATES) -> Column:
    """The wordings of an instruction, distinct without regard to case, in the templates' order; the text alone
    if it has no colour or object."""

    def filled(own: Column) -> Column:
        pieces = [re.split(r"(\{obj\}|\{color\})", t) for t in templates]
        part = {"{obj}": own["obj"], "{color}": own["color"]}
        return F.array(*[F.concat(*[part.get(p, F.lit(p)) for p in own_pieces if p]) for own_pieces in pieces])

    def distinct(own: Column) -> Column:
        lowered = own["lowered"]
        first = F.filter(own["filled"], lambda t, i: F.array_position(lowered, F.get(lowered, i)) == i + 1)
        return F.when(F.size(F.array_distinct(lowered)) == len(templates), own["filled"]).otherwise(first)

    def worded(own: Column) -> Column:
        every = _with(filled(own), lambda f: _with(F.struct(f.alias("filled"), F.transform(f, F.lower).alias("lowered")), distinct))
        return F.when(own["color"].isNotNull() & own["obj"].isNotNull(), every).otherwise(F.array(own["text"]))

    return _with(F.struct(text.alias("text"), color.alias("color"), obj.alias("obj")), worded)


def normalise_answer(text: Column) -> Column:
    """One of ANSWERS: the answer itself, an alias with a space or hyphen, or the first that it contains."""
    t = F.trim(F.lower(text))
    exact = [F.when(t.isin(a, a.replace("_", " "), a.replace("_", "-")), F.lit(a)) for a in ANSWERS]
    inside = [
        F.when(t.contains(a) | t.contains(a.replace("_", " ")) | t.contains(a.replace("_", "-")), F.lit(a)) for a in ANSWERS
    ]
    return F.coalesce(*exact, *inside)


def has_ordinal(text: Column) -> Column:
    words = "|".join(w for own in ORDINALS.values() for w in own)
    return text.rlike(rf"(?i)\b(?:{words})\b.*?bowl")


def first_contained(text: Column, names: Column) -> Column:
    """The first of an array of names that a text contains, without regard to case."""
    return F.get(F.filter(names, lambda n: F.contains(F.lower(text), F.lower(n))), F.lit(0))


def parse_config(name: Column) -> Column:
    """The three colours of `configN-a-b-c` (the last part of a path), null for another name."""
    own = F.lower(F.regexp_extract(name, r"([^/]+)/*$", 1))
    return F.when(own.rlike(r"^config\d+-[a-z]+-[a-z]+-[a-z]+$"), F.slice(F.split(own, "-"), 2, 3))


def slug(text: Column) -> Column:
    return F.replace(F.lower(F.translate(text, ".'", "")), F.lit(" "), F.lit("_"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def replaced_longest_first(text: Column, mapping: dict[str, str]) -> Column:
    """Each phrase of a mapping replaced, longer phrases before those that they contain, whole words, any case.

    The phrases are marked by number first, so what a replacement brings in is not replaced again.
    """
    order = sorted(mapping, key=lambda k: (-len(k), k))
    for i, phrase in enumerate(order):
        quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in phrase)
        text = F.regexp_replace(text, rf"(?i)\b{quoted}\b", f"\x00{i}\x01")
    for i, phrase in enumerate(order):
        text = F.replace(text, F.lit(f"\x00{i}\x01"), F.lit(mapping[phrase]))
    return text
