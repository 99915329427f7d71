"""Greedy choice of boxes, the largest first, as rounds over all groups at once.

A box meets others on the grid cells that it touches. A round takes the FIRST largest open boxes of every cell as one list. A
box that is in the list of each cell it touches and conflicts with no larger one there has no open larger neighbour, so
it stays, whatever becomes of the others; every open box that conflicts with it goes. The rest is open for the next
round. The result is that of taking boxes one after another, largest first. Lists are cut before they are shuffled, so
a cell that most boxes touch costs what others do, no pairs are listed, and a box meets a bounded list a cell, never
all of its group. The number of rounds is that of the longest chain of boxes that wait for each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

#: Boxes of a cell's list.
FIRST = 16

_BOX = ("x", "y", "w", "h")


def largest_first(
    items: DataFrame, by: str, size: Column, place: tuple[Column, ...], conflict: Callable[[Column, Column], Column], cell: float, scratch: Scratch
) -> DataFrame:
    """The items (by, id, ..; ids are unique in a group) that conflict with no larger one that stays.

    `place` is a box (x, y, width, height), and items that conflict must have boxes that meet; `conflict` says it of two
    structs of all columns. Equal sizes go by id. `cell` should be about the length of a box's side: a box touches (side /
    cell + 1) squared cells. A null group is a group; items with a null or no number in their box stay out.
    """
    known = F.lit(True)
    for c in place:
        known = known & c.isNotNull() & ~F.isnan(c.cast("double"))
    x, y, w, h = place
    ends = F.struct(F.floor(x / cell).alias("x0"), F.floor((x + w) / cell).alias("x1"), F.floor(y / cell).alias("y0"), F.floor((y + h) / cell).alias("y1"))
    item = F.struct(F.struct(F.col(by).alias("of")).alias("g"), F.struct((-size).alias("a"), F.col("id").alias("id")).alias("rank"), ends.alias("at"), F.struct(*items.columns).alias("own"))

    def grid(df: DataFrame) -> DataFrame:
        out = df.withColumn("cx", F.explode(F.sequence("b.at.x0", "b.at.x1")))
        return out.withColumn("cy", F.explode(F.sequence("b.at.y0", "b.at.y1"))).withColumn("g", F.col("b.g"))

    open_, names, turn = scratch.table(items.where(known).select(item.alias("b")), "open_0"), [], 0
    cells = (F.col("b.at.x1") - F.col("b.at.x0") + 1) * (F.col("b.at.y1") - F.col("b.at.y0") + 1)
    while not open_.isEmpty():
        spread = grid(open_)
        lead = F.row_number().over(Window.partitionBy("g", "cx", "cy").orderBy("b.rank"))
        lists = spread.withColumn("_n", lead).where(F.col("_n") <= FIRST).groupBy("g", "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("b.rank", "b"))).alias("list"))
        larger = lambda x: F.exists("list", lambda k: (k["rank"] < x["rank"]) & conflict(k["b"]["own"], x["b"]["own"]))
        free = lists.select(F.explode(F.filter("list", lambda x: ~larger(x))).alias("x")).select("x.b")
        stay = scratch.table(free.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") == cells).select("b"), f"stay_{turn}")
        near = grid(stay).groupBy("g", "cx", "cy").agg(F.collect_list("b.own").alias("kept"))
        hit = F.exists("kept", lambda k: (F.col("b.own.id") == k["id"]) | conflict(k, F.col("b.own")))
        gone = spread.join(near, ["g", "cx", "cy"]).where(hit).select("g", F.col("b.own.id").alias("id")).distinct()
        left = open_.withColumns({"g": F.col("b.g"), "id": F.col("b.own.id")}).join(gone, ["g", "id"], "left_anti").select("b")
        names.append(f"stay_{turn}")
        turn += 1
        open_ = scratch.table(left, f"open_{turn}")
        scratch.drop(f"open_{turn - 1}")
    spark = items.sparkSession
    kept = spark.read.schema(open_.schema).parquet(*[f"{scratch.at}/{n}" for n in names]) if names else open_
    return scratch.finish(kept.select("b.own.*"))


def boxes(rows: DataFrame, by: str, scratch: Scratch, overlap: float = 0.35, cell: float = 50.0) -> DataFrame:
    """Boxes (id, x, y, w, h) of a frame that overlap no larger one that stays: kept largest first, ties by id."""
    from ..functions.values import iou

    own = rows.select(by, "id", *[F.col(c).cast("double").alias(c) for c in _BOX])
    box = lambda b: tuple(b[c] for c in _BOX)
    return largest_first(own, by, F.col("w") * F.col("h"), tuple(map(F.col, _BOX)), lambda k, b: iou(box(k), box(b)) >= overlap, cell, scratch)


def centres(shapes: DataFrame, by: str, distance: float, scratch: Scratch) -> DataFrame:
    """Shapes (id, area, cx, cy) of a frame whose centre is not nearer than `distance` to a larger one that stays.

    A shape stands as a square of that side around its centre: centres that are nearer have squares that meet.
    """
    side = F.lit(float(distance))
    place = (F.col("cx") - side / 2, F.col("cy") - side / 2, side, side)
    near = lambda k, s: F.hypot(k["cx"] - s["cx"], k["cy"] - s["cy"]) < distance
    return largest_first(shapes.select(by, "id", "area", "cx", "cy"), by, F.col("area"), place, near, float(distance), scratch)
