"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Self-joins double the distance to an ancestor each time, so a tree of depth d takes
about log2(d) of them to give every message its depth and branch score, and as many to list the messages of the
chosen branches. Leaves are ranked by score in their tree; each chosen root-to-leaf path is one conversation.

A message without a parent, or whose parent isn't there, is a root. Messages on a circle of parents hang from no
root and are on no path. Null texts, roles and scores are empty, empty and 0. Repeated message ids of one tree are
one message (the smallest by role, text and score counts). Branches of equal score are ranked by their leaf's id. Very
long texts and conversations are formatted whole, in time linear in their length; a path is one row. No messages give
no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the template: a turn is <|role|>, a line feed, its text, </s>, a line feed.
OPEN, SHUT, END = "<|", "|>\n", "</s>\n"

#: Control strings that a text must not show, and how they are written in it. The sign ~ itself is
#: escaped first, so reading back is unambiguous: ~2 and ~1 are undone before ~0.
ESCAPES = [
    ("~", "~0"),
    ("<|", "~1|"),
    ("</s>", "~1/s>"),
    ("<s>", "~1s>"),
    ("<<", "~1~1"),
    ("[INST]", "~2INST]"),
    ("[/INST]", "~2/INST]"),
]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for written, plain in (("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("~3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("|")))


def chains(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it (by turn, role, text)."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def paths(messages: DataFrame, scratch: Scratch, best: int | None = None) -> DataFrame:
    """tree, leaf, rank (from 1), score, above (steps from the leaf up), node: the messages of each chosen path.

    messages: tree, node, parent, role, text, score. best: paths of a tree, all if None.
    """
    nodes = messages.groupBy("tree", "node").agg(
        F.min(F.struct("role", "text", "score", "parent")).alias("own")
    )
    links = nodes.select("tree", "node", F.col("own.parent").alias("parent"), F.coalesce("own.score", F.lit(0.0)).alias("score"))
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    joined = links.alias("a").join(
        known.alias("b"), _same("a", "b") & (F.col("a.parent") == F.col("b.parent")), "left"
    )
    jump = scratch.table(
        joined.select(
            "a.tree",
            "a.node",
            F.when(F.col("there"), F.col("a.parent")).alias("up"),
            F.lit(1).cast("long").alias("steps"),
            F.col("a.score").alias("sum"),
        ),
        "jump0",
    )
    parents = jump
    # After k joins `up` is the ancestor 2^k steps above, null if the root is nearer; sum and steps reach up to it.
    # Messages that have reached their root are done and stay where they are; only the others, and what their trees
    # hold, go on. A circle never ends: as many joins as a path of all messages needs show every one that has a root.
    limit = max(1, jump.count()).bit_length()
    open_, done = jump.where(F.col("up").isNotNull()), jump.where(F.col("up").isNull())
    levels = [open_]
    while len(levels) <= limit and not open_.isEmpty():
        trees = open_.select("tree").distinct()
        above = open_.unionByName(done).alias("b").join(trees.alias("t"), _same("b", "t"), "left_semi")
        on = _same("a", "b") & (F.col("a.up") == F.col("b.node"))
        jump = open_.alias("a").join(above.alias("b"), on).select(
            "a.tree",
            "a.node",
            F.col("b.up").alias("up"),
            (F.col("a.steps") + F.col("b.steps")).alias("steps"),
            (F.col("a.sum") + F.col("b.sum")).alias("sum"),
        )
        jump = scratch.table(jump, f"jump{len(levels)}")
        open_, done = jump.where(F.col("up").isNotNull()), done.unionByName(jump.where(F.col("up").isNull()))
        levels.append(open_)
    inner = parents.where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")).distinct()
    leaves = (
        done.alias("a")
        .join(inner.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("sum").desc(), "node"))
    chosen = leaves.withColumn("rank", rank)
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    spread = scratch.table(
        chosen.select("tree", F.col("node").alias("leaf"), "rank", "sum", F.lit(0).cast("long").alias("above"), "node"),
        "leaves",
    )
    # A row stands for 2^k messages from `node` up; each join halves that until it is one message.
    for k in reversed(range(len(levels) - 1)):
        on = _same("a", "b") & (F.col("a.node") == F.col("b.node"))
        higher = (
            spread.alias("a")
            .join(levels[k].alias("b"), on)
            .select("a.tree", "a.leaf", "a.rank", "a.sum", (F.col("a.above") + (1 << k)).alias("above"), F.col("b.up").alias("node"))
        )
        spread = scratch.table(spread.unionByName(higher), f"spread{k}")
    text = nodes.select("tree", "node", F.coalesce("own.role", F.lit("")).alias("role"), F.coalesce("own.text", F.lit("")).alias("text"))
    on = _same("a", "b") & (F.col("a.node") == F.col("b.node"))
    return spread.alias("a").join(text.alias("b"), on).select(
        "a.tree", "a.leaf", "a.rank", F.col("a.sum").alias("score"), "a.above", "b.role", "b.text"
    )


def conversations(messages: DataFrame, scratch: Scratch, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """tree, leaf, rank, score, formatted, and loss_spans (start and length in code points of what is learned)."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(SHUT))
    rows = paths(messages, scratch, best).withColumns({"head": head, "body": escape(F.col("text"))})
    size = F.length("head").cast("long") + F.length("body") + len(END)
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("above").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    turn = F.struct(
        (-F.col("above")).alias("order"), F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == learn, span).alias("span")
    )
    rows = rows.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text, head (code points before the text), size>>."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), SHUT, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, SHUT) + len(SHUT), F.lit(1 << 30))).alias("text"),
            (F.instr(p, SHUT) + len(SHUT) - 1).alias("head"),
            F.length(p).alias("size"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, leaf, turn (from 0), role, text, learned (whether the text is a span of the loss mask), and for checks
    n_spans and formatted_chars of the conversation.

    A turn's place is a running sum over the turns before it, and it meets the mask's spans there.
    """
    rows = formatted.select(
        "tree",
        "leaf",
        F.size("loss_spans").alias("n_spans"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.posexplode(turns(F.col("formatted"))).alias("turn", "t"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("t.size").cast("long") + len(END)).over(before), F.lit(0)) + F.col("t.head")
    rows = rows.withColumns({"at": start, "chars": (F.col("t.size") - F.col("t.head")).cast("long")})
    spans = formatted.select(F.col("tree").alias("own_tree"), F.col("leaf").alias("own_leaf"), F.explode("loss_spans").alias("s"))
    same = F.col("tree").eqNullSafe(F.col("own_tree")) & F.col("leaf").eqNullSafe(F.col("own_leaf"))
    rows = rows.join(spans, same & (F.col("at") == F.col("s.start")) & (F.col("chars") == F.col("s.length")), "left")
    learned = F.col("s").isNotNull().alias("learned")
    return rows.select("tree", "leaf", "turn", "t.role", "t.text", learned, "n_spans", "formatted_chars")
