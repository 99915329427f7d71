"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a Boolean column over features of a text. On a sample of rows every rule is timed and its rejections
counted, over the same ready columns that it reads later; rules then run in order of rejections per second, as
branches of one CASE, so a later rule is evaluated only for rows that every earlier one passed. The order changes the
cost and the rule that is named first, never which rows are kept.

A null text is empty: it has no words, so the rule on words rejects it. Very long texts are measured whole, in one
row. Equal texts, and so repeated rows, get equal verdicts; a measure that just meets a limit passes. Rules of equal
worth keep the order in which they are given; of an empty table all do, and no row comes out. Other columns, also
ones named like a feature, pass through untouched.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch

#: Rows of the sample on which rules are timed, about.
SAMPLE_ROWS = 1000

#: How often the sample is gone through in a timed run, and timed runs of a rule.
COPIES, RUNS = 8, 2

#: Symbols that count, and the words of a window that may come again.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

_P = "_q_"


def _own(name: str) -> Column:
    return F.col(_P + name)


def with_words(df: DataFrame) -> DataFrame:
    """Add the arrays that features share; each in a step of its own, so that none is computed twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumn(_P + "text", text).withColumn(
        _P + "words", F.filter(F.split(_own("text"), SPACE_CLASS), lambda w: w != "")
    )


def n_words() -> Column:
    return F.size(_own("words")).cast("long")


def word_chars() -> Column:
    return F.length(F.array_join(_own("words"), "")).cast("long")


def n_symbols() -> Column:
    return (F.length(_own("text")) - F.length(F.regexp_replace(_own("text"), SYMBOLS, ""))).cast("long")


def lines() -> Column:
    """Lines that have a word."""
    return F.filter(F.split(_own("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines() -> Column:
    return F.aggregate(
        F.array(lines()), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))
    ).cast("long")


def n_upper_words() -> Column:
    """Words of two or more characters that lower case changes and upper case doesn't."""
    return F.size(F.filter(_own("words"), lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))


def n_distinct_words() -> Column:
    return F.size(F.array_distinct(_own("words")))


def n_repeat_words() -> Column:
    """Words inside 8-word windows that the text has twice or more, the first time included.

    Windows are told apart by 64-bit hashes of their words' hashes. Texts whose hashes all differ are done; only
    others sort their windows to find the equal ones and add up what these cover.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def covered(marks: Column) -> Column:
        ranked = F.sort_array(F.transform(marks, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(ranked, lambda r: _let(F.sort_array(_twice(r)), _union_length))

    def _twice(ranked: Column) -> Column:
        same = F.filter(
            ranked,
            lambda s, j: (s["x"] == F.get(ranked, j - 1)["x"]) | (s["x"] == F.get(ranked, j + 1)["x"]),
        )
        return F.transform(same, lambda s: s["i"])

    def _union_length(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(marks: Column) -> Column:
        none = F.size(F.array_distinct(marks)) == F.size(marks)
        return F.when(none, F.lit(0).cast("long")).otherwise(covered(marks))

    hashes = F.transform(_own("words"), lambda w: F.xxhash64(w))
    return F.when(F.size(_own("words")) <= WINDOW, F.lit(0).cast("long")).otherwise(
        _let(hashes, lambda h: _let(windows(h), count))
    )


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


#: Rules that reject a text; each is a function so that a rule's column is built where it is used.
BASE_RULES = {
    "few_words": lambda: n_words() < 20,
    "repeated_windows": lambda: 100 * n_repeat_words() > 30 * n_words(),
}
RULES = BASE_RULES | {
    "symbols": lambda: 10 * n_symbols() > 3 * n_words(),
    "duplicate_lines": lambda: 10 * n_dup_lines() > 3 * F.size(lines()),
    "word_length": lambda: (word_chars() < 2 * n_words()) | (word_chars() > 25 * n_words()),
    "upper_case": lambda: 10 * n_upper_words() > 4 * n_words(),
    "few_distinct": lambda: (n_words() >= 50) & (20 * n_distinct_words() < n_words()),
}


def plan(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS, prepare=with_words) -> list[str]:
    """Rule names by rejections per second on a sample of about `sample_rows` rows.

    The sample is written with the columns that `prepare` adds, so a rule's time is what it costs beyond those. Every
    rule runs over COPIES of the sample, so that its work outweighs a job's start, once to warm up and then RUNS times, of which
    the shortest counts. Costs are told apart by factors of two, so that noise doesn't order rules of about equal worth.
    """
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, sample_rows / total)
    scratch = Scratch(docs.sparkSession)
    few = docs.select("text") if share == 1 else docs.select("text").sample(fraction=share, seed=1)
    sample = scratch.table(prepare(few), "quality_sample")
    many = sample.withColumn(_P + "copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    seconds, hits = {}, {}
    for name, rule in ({"": lambda: F.lit(False)} | rules).items():
        counted = many.agg(F.count_if(rule() & (_own("copy") > 0)))
        for run in range(RUNS + 1):
            began = time.perf_counter()
            hits[name] = counted.head()[0] / COPIES
            took = time.perf_counter() - began
            seconds[name] = took if run < 2 else min(seconds[name], took)
    scratch.drop("")
    cost = {name: max(seconds[name] - seconds[""], COPIES * 1e-3) for name in rules}
    return sorted(rules, key=lambda name: -(hits[name] + 0.5) / 2.0 ** round(math.log2(cost[name])))


def cascade(rules: dict, order: list[str]) -> Column:
    """The first rule in order that rejects a row; null if none does."""
    out = None
    for name in order:
        out = F.when(rules[name](), name) if out is None else out.when(rules[name](), name)
    return out if out is not None else F.lit(None).cast("string")


def _ruled(docs: DataFrame, rules: dict, order: list[str]) -> DataFrame:
    """Every row of docs whole, as one struct, so that no name of its columns can clash, and the rule that rejects it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_P + "whole"), F.col("text"))
    return with_words(whole).withColumn(_P + "failed", cascade(rules, order))


def apply_rules(docs: DataFrame, rules: dict = RULES, order: list[str] | None = None) -> DataFrame:
    """docs with `failed_rule` (null: kept) in place of any column of that name."""
    order = plan(docs, rules) if order is None else order
    out = _ruled(docs, rules, order)
    rest = [F.col(_P + "whole")[c].alias(c) for c in docs.columns if c != "failed_rule"]
    return out.select(*rest, _own("failed").alias("failed_rule"))


def keep(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    rows = _ruled(docs, rules, plan(docs, rules)).withColumn(_P + "row", F.monotonically_increasing_id())
    # The row number, which is never negative, keeps the optimiser from moving the filter below the columns it reads:
    # it would then split a text once for each time that a rule mentions its words.
    rows = rows.where(_own("failed").isNull() & (_own("row") >= 0))
    return rows.select(*[F.col(_P + "whole")[c].alias(c) for c in docs.columns])


#: The measures that `report` returns, and the rules as they read them there.
MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
MEASURED_RULES = RULES | {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "duplicate_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.size(lines()),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")),
}


def measured(docs: DataFrame) -> DataFrame:
    return with_words(docs).withColumns({k: f() for k, f in MEASURES.items()})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures of every text, base_failed, and kept by the cascade.

    The measures are asked for of every row, so they are computed once. The rules of the cascade read them; their
    costs are taken with the measures ready, so rules that only compare come before those with work of their own.
    """
    order = plan(docs, MEASURED_RULES, prepare=measured)
    failed = MEASURED_RULES["few_words"]() | MEASURED_RULES["repeated_windows"]()
    rows = measured(docs.select("doc_id", "text")).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & cascade(MEASURED_RULES, order).isNull()
    return rows.withColumn("kept", kept).select("doc_id", *MEASURES, "base_failed", "kept")
