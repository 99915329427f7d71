"""Queries of whole-dataset edits, sources, sinks and small functions over the test tables, beside their SQL.

A dataset is the events again: an episode is a user, its frames the events in order at ten a second.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .model import TrajectoryDataset, features_of, is_text, normalise_videos, video_keys, without_nulls
from .operators import datasets, edit, greedy, joins, keys, sample, stats, trim
from .plans import augment, checks, compare, report, trials
from .queries import LAYOUTS, BOUNDS, DOWN, E, N, SPANS, STATS, frames, numbered, query, r6, table
from .sources import layouts, sink
from .storage import Scratch, write_text

#: Header of the test dataset.
INFO = {
    "codebase_version": "v3.0", "fps": 10, "robot_type": "arm", "chunks_size": 40,
    "features": {"value": {"dtype": "float64", "shape": [1]}, "task": {"dtype": "string"}, "top": {"dtype": "video", "info": {"video.fps": 10}}},
}

#: Prompts of the event types, in the order of the types' names.
COLORED = {"click": "red", "signup": "green", "purchase": "blue", "error": "red", "view": "green"}


def dataset(spark, sf_dir, prompt=None) -> TrajectoryDataset:
    """All events as one dataset with dense ids, a data file for ten episodes, and one camera. Prompts are event types
    or `prompt` of them; an episode's prompt is that of its first frame."""
    rows = frames(spark, sf_dir)
    said = prompt(F.col("task")) if prompt else F.col("task")
    first = rows.groupBy("episode_index").agg(F.min_by("task", "index").alias("task")).select("episode_index", said.alias("task"))
    tasks = keys.first_seen(first, "task", ["episode_index"], "task_index").select("task_index", "task")
    named = first.join(F.broadcast(tasks), "task")  # a dictionary has a row a prompt
    own = keys.reindex(rows.drop("task")).join(named.select("episode_index", "task_index"), "episode_index")
    own = own.select(
        F.col("new_index").alias("index"), F.col("new_episode").alias("episode_index"), F.col("frame_index").cast("long").alias("frame_index"),
        (F.col("frame_index") / 10).cast("float").alias("timestamp"), "task_index", "value", F.col("index").alias("source_index"),
    )
    episodes = keys.episode_spans(rows).join(named, "episode_index")
    file, number = F.floor(F.col("new_episode") / 10), F.col("new_episode")
    before = F.col("dataset_from_index") / 10
    episodes = episodes.select(
        number.alias("episode_index"), "length", "dataset_from_index", "dataset_to_index", F.array("task").alias("tasks"),
        F.lit(0).cast("long").alias("data/chunk_index"), file.alias("data/file_index"),
        F.lit(0).cast("long").alias("meta/episodes/chunk_index"), (number % 2).alias("meta/episodes/file_index"),
        F.lit(0).cast("long").alias("videos/top/chunk_index"), file.alias("videos/top/file_index"),
        before.alias("videos/top/from_timestamp"), (before + (F.col("length") - 1) / 10).alias("videos/top/to_timestamp"),
    )
    return TrajectoryDataset(own, episodes, tasks, dict(INFO))


def stored(spark, ds: TrajectoryDataset) -> TrajectoryDataset:
    """The dataset's tables written and read again, so that edits with several uses of them don't repeat their making."""
    scratch = Scratch(spark)
    tables = [scratch.table(df, name) for df, name in ((ds.frames, "frames"), (ds.episodes, "episodes"), (ds.tasks, "tasks"))]
    return TrajectoryDataset(*tables, ds.info)


#: The same dataset for the other engine: f frames, e episodes.
DS = f"""f AS (SELECT n.*, s.new_episode AS e, s.start + n.rn AS i FROM ({N}) n JOIN ({SPANS}) s USING (ep)),
e AS (SELECT s.new_episode AS e, s.ep, s.length, s.start, t.task FROM ({SPANS}) s JOIN (SELECT ep, arg_min(task, idx) AS task FROM ({E}) GROUP BY ep) t USING (ep))"""
AUTO = """a AS (SELECT *, quantile_cont(value, 0.5) FILTER (rn < greatest(3, least(10, n // 10))) OVER (PARTITION BY e) AS early,
  min(value) OVER (PARTITION BY e) AS low, max(value) OVER (PARTITION BY e) AS high FROM f),
c AS (SELECT *, CASE WHEN high - early >= early - low THEN value >= early + 0.45 * greatest(high - low, 0.000001) ELSE value <= early - 0.45 * greatest(high - low, 0.000001) END AS shut FROM a),
r AS (SELECT e, min(s) AS run FROM (SELECT e, isl, min(rn) AS s, count(*) AS k FROM (SELECT *, sum((NOT shut)::INT) OVER (PARTITION BY e ORDER BY rn) AS isl FROM c) WHERE shut GROUP BY 1, 2) WHERE k >= 5 GROUP BY e),
auto AS (SELECT e.e, e.length AS n, CASE WHEN e.length <= 20 THEN 0 ELSE greatest(0, least(coalesce(r.run + 8, round_even(e.length * 0.35::DOUBLE, 0)::BIGINT), e.length - 20)) END::BIGINT AS auto FROM e LEFT JOIN r USING (e)),
whole AS (SELECT e FROM (SELECT e, row_number() OVER (ORDER BY md5(concat('42:', e)), e) AS k, count(*) OVER () AS n FROM e) WHERE k <= round_even(n * 0.2::DOUBLE, 0)),
plan AS (SELECT auto.e, n, CASE WHEN auto.e % 5 = 0 THEN false WHEN auto.e % 5 = 1 THEN true ELSE whole.e IS NOT NULL END AS keep_full,
  least(n - 1, CASE WHEN auto.e % 5 = 0 THEN auto.e % 13 WHEN auto.e % 5 = 1 THEN 0 WHEN whole.e IS NOT NULL THEN 0 ELSE auto END)::BIGINT AS trim_start, auto.e % 5 = 0 AS validated FROM auto LEFT JOIN whole ON whole.e = auto.e)"""


def cache(ds: TrajectoryDataset) -> DataFrame:
    """Earlier decisions: every fifth episode validated, every other fifth one kept whole."""
    e = F.col("episode_index")
    rows = ds.episodes.where(e % 5 < 2)
    return rows.select(
        "episode_index", (e % 5 == 1).alias("keep_full"), F.when(e % 5 == 0, e % 13).alias("trim_start"), F.lit(0).cast("long").alias("auto_trim_start"), (e % 5 == 0).alias("validated")
    )


# Whole-dataset edits


@query(f"""WITH {DS}, {AUTO}, m AS (SELECT unnest(['all', 'trim_validated', 'only_validated']) AS mode)
SELECT mode, e AS episode_index, CASE mode WHEN 'all' THEN keep_full ELSE NOT validated END AS keep_full,
CASE WHEN mode = 'all' OR validated THEN trim_start ELSE 0 END AS trim_start FROM plan, m WHERE mode <> 'only_validated' OR validated""")
def trim_plan_modes(spark, sf_dir):
    ds = stored(spark, dataset(spark, sf_dir))
    plans = [datasets.trim_plan(ds.frames, "value", 0.2, 42, cache(ds), mode).withColumn("mode", F.lit(mode)) for mode in ("all", "trim_validated", "only_validated")]
    return plans[0].unionByName(plans[1]).unionByName(plans[2]).select("mode", "episode_index", "keep_full", "trim_start")


@query(f"""WITH {DS}, {AUTO}, k AS (SELECT f.e, f.idx, f.rn - p.trim_start AS frame_index FROM f JOIN plan p USING (e) WHERE f.rn >= p.trim_start)
SELECT idx AS source_index, e AS episode_index, frame_index, row_number() OVER (ORDER BY e, frame_index) - 1 AS index, round(frame_index / 10.0::DOUBLE, 3) AS timestamp FROM k""")
def post_grasp_dataset(spark, sf_dir):
    ds = stored(spark, dataset(spark, sf_dir))
    out = datasets.start_at(ds, datasets.trim_plan(ds.frames, "value", 0.2, 42, cache(ds))).frames
    return out.select("source_index", "episode_index", "frame_index", "index", F.round(F.col("timestamp").cast("double"), 3).alias("timestamp"))


@query(f"""WITH {DS}, {AUTO}, k AS (SELECT e, n - trim_start AS length FROM plan)
SELECT e AS episode_index, length, (sum(length) OVER (ORDER BY e) - length)::BIGINT AS dataset_from_index, sum(length) OVER (ORDER BY e)::BIGINT AS dataset_to_index,
e AS data_file, 0.0::DOUBLE AS from_timestamp, round(length / 10.0::DOUBLE, 6) AS to_timestamp FROM k""")
def post_grasp_episodes(spark, sf_dir):
    ds = stored(spark, dataset(spark, sf_dir))
    out = datasets.start_at(ds, datasets.trim_plan(ds.frames, "value", 0.2, 42, cache(ds))).episodes
    times = [F.col(f"`videos/top/{x}_timestamp`").alias(f"{x}_timestamp") for x in ("from", "to")]
    return out.select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.col("data/file_index").alias("data_file"), *times)


def neglected(spark, sf_dir) -> TrajectoryDataset:
    """The dataset with two rows of every third episode, of which the first is out of date, and prompts of frames that
    don't follow their episodes."""
    ds = dataset(spark, sf_dir)
    old = ds.episodes.where("episode_index % 3 = 0").withColumns({"length": F.col("length") + 5, "tasks": F.array(F.lit("out of date")), "row": F.lit(0)})
    stale = F.when(F.col("frame_index") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("task_index"))
    frames_ = ds.frames.withColumn("task_index", stale)
    return stored(spark, TrajectoryDataset(frames_, old.unionByName(ds.episodes.withColumn("row", F.lit(1))), ds.tasks, ds.info))


_CUT = f"""{BOUNDS}, {DS}, k AS (SELECT f.e, f.idx, f.value, f.rn - c.lead AS frame_index FROM f JOIN c ON c.ep = f.ep WHERE f.rn >= c.lead AND f.rn < c.n - c.trail)"""


@query(f"""{_CUT} SELECT idx AS source_index, k.e AS episode_index, frame_index, row_number() OVER (ORDER BY k.e, frame_index) - 1 AS index,
round(frame_index / 10.0::DOUBLE, 3) AS timestamp, task FROM k JOIN e ON e.e = k.e""")
def frozen_dataset(spark, sf_dir):
    ds = datasets.trimmed_frozen(neglected(spark, sf_dir), "value", threshold=50)
    out = ds.frames.join(ds.tasks, "task_index")
    return out.select("source_index", "episode_index", "frame_index", "index", F.round(F.col("timestamp").cast("double"), 3).alias("timestamp"), "task")


@query(f"""{_CUT}, g AS (SELECT e, count(*) AS length, avg(value) AS mean, quantile_cont(value, 0.5) AS q50 FROM k GROUP BY e),
p AS (SELECT *, sum(length) OVER (ORDER BY e) AS upto, sum(length) OVER (PARTITION BY e // 10 ORDER BY e) - length AS before FROM g)
SELECT e AS episode_index, length, (upto - length)::BIGINT AS dataset_from_index, upto::BIGINT AS dataset_to_index, round(before / 10.0::DOUBLE, 6) AS from_timestamp,
round(before / 10.0::DOUBLE + (length - 1) / 10.0::DOUBLE, 6) AS to_timestamp, round(mean, 6) AS mean, round(q50, 6) AS q50, length::DOUBLE AS count FROM p""")
def frozen_dataset_episodes(spark, sf_dir):
    out = datasets.trimmed_frozen(neglected(spark, sf_dir), "value", threshold=50).episodes
    times = [F.round(f"`videos/top/{x}_timestamp`", 6).alias(f"{x}_timestamp") for x in ("from", "to")]
    own = [F.round(F.get(F.col(f"`stats/value/{x}`"), F.lit(0)), 6).alias(x) for x in ("mean", "q50", "count")]
    return out.select("episode_index", "length", "dataset_from_index", "dataset_to_index", *times, *own)


@query(f"""WITH {DS}, k AS (SELECT f.*, e.length - e.e % 7 AS left_ FROM f JOIN e ON e.e = f.e)
SELECT idx AS source_index, e AS episode_index, rn AS frame_index, row_number() OVER (ORDER BY e, rn) - 1 AS index FROM k WHERE rn < left_""")
def clipped_dataset(spark, sf_dir):
    """Slices that end up to six frames before their episodes do."""
    ds = dataset(spark, sf_dir)
    short = F.col("`videos/top/to_timestamp`") - F.col("episode_index") % 7 / 10
    ds = stored(spark, TrajectoryDataset(ds.frames, ds.episodes.withColumn("videos/top/to_timestamp", short), ds.tasks, ds.info))
    return datasets.clipped_to_limits(ds, 0.001).frames.select("source_index", "episode_index", "frame_index", "index")


@query(f"""WITH {DS}, k AS (SELECT e.e, len(d.kept) AS length, e.e // 10 AS file FROM e JOIN ({DOWN}) d USING (ep)),
p AS (SELECT *, sum(length) OVER (ORDER BY e) AS upto, sum(length) OVER (PARTITION BY file ORDER BY e) - length AS before FROM k)
SELECT e AS episode_index, length, (upto - length)::BIGINT AS dataset_from_index, upto::BIGINT AS dataset_to_index, round(before / 3.0::DOUBLE, 6) AS from_timestamp,
round(before / 3.0::DOUBLE + (length - 1) / 3.0::DOUBLE, 6) AS to_timestamp FROM p""")
def downsample_dataset(spark, sf_dir):
    out = datasets.downsampled(stored(spark, dataset(spark, sf_dir)), 3.0).episodes
    times = [F.col(f"`videos/top/{x}_timestamp`").alias(f"{x}_timestamp") for x in ("from", "to")]
    return r6(out.select("episode_index", F.col("length").cast("long").alias("length"), "dataset_from_index", "dataset_to_index", *times), "from_timestamp", "to_timestamp")


def doubtful(spark, sf_dir) -> tuple[TrajectoryDataset, DataFrame]:
    """Two rows for each episode, of which the second is half a second later; videos of one episode each without every
    eleventh time and the last four, and none for every ninth episode."""
    ds = dataset(spark, sf_dir)
    e, zero = F.col("episode_index"), F.lit(0).cast("long")
    row = F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 1)]))
    own = ds.episodes.withColumn("row", row).withColumns({"videos/top/file_index": e, "videos/top/chunk_index": zero})
    late = (F.col("row") + e) % 2 == 1
    own = own.withColumns({"videos/top/from_timestamp": F.when(late, 0.5).otherwise(0.0), "dataset_from_index": F.col("dataset_from_index") + F.when(e % 3 == 0, F.col("row")).otherwise(0)})
    times = ds.frames.where("frame_index % 11 <> 5 AND episode_index % 9 <> 4")
    last = ds.episodes.select("episode_index", "length")
    times = times.join(last, "episode_index").where(F.col("frame_index") < F.col("length") - 4)
    times = times.select(F.lit("top").alias("key"), zero.alias("chunk"), F.col("episode_index").alias("file"), (F.col("frame_index") / 10).alias("t"))
    return stored(spark, TrajectoryDataset(ds.frames, own, ds.tasks, ds.info)), Scratch(spark).table(times, "times")


CANDIDATES = f"""{DS}, v AS (SELECT f.e, f.idx, f.rn, f.n, row, off, f.e % 9 <> 4 AND (rn + off) % 11 <> 5 AND rn + off < n - 4 AS valid,
  CASE WHEN f.e % 3 = 0 THEN row ELSE 0 END = 0 AS fits FROM (SELECT *, CASE WHEN (row + e) % 2 = 1 THEN 5 ELSE 0 END AS off FROM f, (SELECT unnest([0, 1]) AS row)) f),
s AS (SELECT e, row, count(*) AS n, count(*) FILTER (valid) AS valid, bool_and(fits) AS fits FROM v GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY valid DESC, (valid = n) DESC, fits DESC, row) AS k FROM s) WHERE k = 1)"""


@query(f"WITH {CANDIDATES} SELECT e AS episode_index, row, n, valid FROM b")
def repair_choice(spark, sf_dir):
    return datasets.repaired(*doubtful(spark, sf_dir), 0.02)[1].select("episode_index", "row", "n", "valid")


@query(f"""WITH {CANDIDATES}, k AS (SELECT v.*, min(rn) OVER (PARTITION BY e) AS first FROM v JOIN b USING (e, row) WHERE v.valid),
d AS (SELECT e, dense_rank() OVER (ORDER BY e) - 1 AS new FROM (SELECT DISTINCT e FROM k))
SELECT idx AS source_index, new AS episode_index, row_number() OVER (PARTITION BY e ORDER BY rn) - 1 AS frame_index, row_number() OVER (ORDER BY e, rn) - 1 AS index,
round((rn - first) / 10.0::DOUBLE, 3) AS timestamp FROM k JOIN d USING (e)""")
def repair_dataset(spark, sf_dir):
    out = datasets.repaired(*doubtful(spark, sf_dir), 0.02)[0].frames
    return out.select("source_index", "episode_index", "frame_index", "index", F.round(F.col("timestamp").cast("double"), 3).alias("timestamp"))


@query(f"""WITH {CANDIDATES}, k AS (SELECT v.*, off, min(rn) OVER (PARTITION BY e) AS first, max(rn) OVER (PARTITION BY e) AS last FROM v JOIN b USING (e, row) WHERE v.valid)
SELECT row_number() OVER (ORDER BY e) - 1 AS episode_index, count(*) AS length, round(any_value(off + first) / 10.0::DOUBLE, 3) AS from_timestamp, round(any_value(off + last) / 10.0::DOUBLE, 3) AS to_timestamp FROM k GROUP BY e""")
def repair_episodes(spark, sf_dir):
    out = datasets.repaired(*doubtful(spark, sf_dir), 0.02)[0].episodes
    times = [F.round(F.col(f"`videos/top/{x}_timestamp`"), 3).alias(f"{x}_timestamp") for x in ("from", "to")]
    return out.select("episode_index", "length", *times)


@query(f"WITH {CANDIDATES} SELECT 'video_timestamps' AS \"check\", e AS episode_index, 'top: ' || count(*) AS detail FROM v WHERE row = 0 AND NOT valid GROUP BY e")
def video_timestamp_report(spark, sf_dir):
    ds, times = doubtful(spark, sf_dir)
    return checks.video_violations(ds.frames, ds.episodes.where("row = 0"), times, 0.02)


@query(f"""WITH {DS}, x AS (SELECT count(*) AS n FROM e) SELECT 'missing_file' AS "check", e AS episode_index, printf('videos/top/chunk-000/file-%03d.mp4', e // 10) AS detail FROM e WHERE (e // 10) % 4 = 2
UNION ALL SELECT 'total_episodes', NULL, n::VARCHAR FROM x UNION ALL SELECT 'range', e, start::VARCHAR FROM e WHERE e = 3""")
def trimmed_output_report(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    moved = F.col("dataset_from_index") + F.when(F.col("episode_index") == 3, 1).otherwise(0)
    total = ds.frames.count()
    bad = TrajectoryDataset(ds.frames, ds.episodes.withColumn("dataset_from_index", moved), ds.tasks, ds.info | {"total_frames": total, "total_episodes": -1})
    there = checks.named_files(ds.episodes).select("path").distinct().where("NOT (path LIKE 'videos/%' AND cast(substring(path, -7, 3) AS int) % 4 = 2)")
    return checks.trimmed_violations(bad, ["index", "value"], there)


@query(f"""WITH {DS}, h AS (SELECT count(*) // 2 AS half, count(*) AS n FROM e), p AS (SELECT a.e, a.length AS n, b.length AS m, a.e % 7 AS dark FROM e a, h LEFT JOIN e b ON b.e = a.e + h.half WHERE a.e < h.half),
c AS (SELECT 1 AS step, 'header' AS name, 0 AS bad UNION ALL SELECT 2, 'episode_total', 0 UNION ALL SELECT 3, 'frame_total', 1 UNION ALL SELECT 4, 'episode_ids', 0 UNION ALL SELECT 5, 'frame_ids', 0
UNION ALL SELECT 6, 'task_ids', 1 UNION ALL SELECT 7, 'no_ordinals', count(DISTINCT task) FROM e WHERE task = 'view' UNION ALL SELECT 8, 'phrases', 3 - count(DISTINCT CASE task WHEN 'click' THEN 'red' WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'blue' WHEN 'signup' THEN 'green' END) FROM e
UNION ALL SELECT 9, 'ranges', count(*) FROM e WHERE e % 10 = 3 UNION ALL SELECT 10, 'files', (SELECT count(DISTINCT e // 10) FROM e) UNION ALL SELECT 11, 'brightness', count(*) FROM p WHERE dark = 0
UNION ALL SELECT 12, 'copies', count(*) FROM p WHERE n IS DISTINCT FROM m)
SELECT step, name, CASE WHEN bad = 0 THEN 'ok' ELSE 'fail' END AS status, bad::BIGINT AS bad FROM c""")
def final_report(spark, sf_dir):
    """A dataset with faults: a wrong frame total, an unknown prompt, an ordinal one, wrong ranges, no videos listed."""
    color = lambda t: F.coalesce(*[F.when(t == k, F.lit(f"Put it in the {v} colored bowl")) for k, v in COLORED.items() if k != "view"], F.lit("Put it into the 2nd bowl"))
    ds = stored(spark, dataset(spark, sf_dir, color))
    n = ds.episodes.count()
    rows = ds.frames.withColumn("task_index", F.when(F.col("index") == 17, 77).otherwise(F.col("task_index")))
    episodes = ds.episodes.withColumn("dataset_to_index", F.col("dataset_to_index") + F.when(F.col("episode_index") % 10 == 3, 1).otherwise(0))
    bad = TrajectoryDataset(rows, episodes, ds.tasks, ds.info | {"total_episodes": n, "total_frames": 1})
    e = F.col("episode_index")
    same = F.when(e < n // 2, e % 7 == 0).otherwise((e - n // 2) % 7 == 0)
    light = ds.episodes.select("episode_index", F.when(same | (e < n // 2), 100.0).otherwise(60.0).alias("brightness"))
    listed = checks.named_files(ds.episodes).select("path").distinct().where("path LIKE 'data/%'")
    out = checks.final_report(bad, (n, 2), 1, listed, light)
    return out.select(F.col("step"), "name", "status", "bad")


@query(f"""WITH {DS}, t AS (SELECT task, row_number() OVER (ORDER BY min(e)) - 1 AS i FROM e WHERE task IN ('click', 'view') GROUP BY task),
u AS (SELECT task, (SELECT count(*) FROM t) + row_number() OVER (ORDER BY min(e)) - 1 AS i FROM e WHERE task NOT IN ('click', 'view') GROUP BY task)
SELECT e AS episode_index, task, i AS task_index FROM e JOIN (SELECT * FROM t UNION ALL SELECT * FROM u) USING (task)""")
def authoritative_tasks(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    few = keys.first_seen(ds.episodes.select("episode_index", F.col("tasks")[0].alias("task")).where("task IN ('click', 'view')"), "task", ["episode_index"], "task_index")
    tasks, mapping = datasets.authoritative_tasks(ds.episodes, few)
    return mapping.join(tasks, "task_index").select("episode_index", "task", "task_index")


_COLOR = "CASE task WHEN 'click' THEN 'red' WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'blue' ELSE 'green' END"
_OTHERS = "CASE c WHEN 'red' THEN 'green and not blue' WHEN 'green' THEN 'red and not blue' ELSE 'red and not green' END"


def colored(task):
    return F.concat(F.lit("Put the cup in the "), F.coalesce(*[F.when(task == k, F.lit(v)) for k, v in COLORED.items()]), F.lit(" colored bowl"))


@query(f"""WITH {DS}, k AS (SELECT e, {_COLOR} AS c, row_number() OVER (ORDER BY md5(concat('42:', e)), e) AS k, count(*) OVER () AS n FROM e)
SELECT e AS episode_index, CASE WHEN k <= greatest(1, round_even(n * 0.4::DOUBLE, 0)) THEN 'Put the cup into the bowl that is not ' || {_OTHERS} || '.' ELSE 'Put the cup in the ' || c || ' colored bowl' END AS task FROM k""")
def negated_share(spark, sf_dir):
    """Prompts of episodes by their frames, so that frames and episodes must agree."""
    out = datasets.negated_share(stored(spark, dataset(spark, sf_dir, colored)), 0.4, 42)
    by_frames = out.frames.select("episode_index", "task_index").distinct().join(out.tasks, "task_index")
    said = out.episodes.select("episode_index", F.col("tasks")[0].alias("said"))
    agreed = F.when(F.col("task") == F.col("said"), F.col("task")).otherwise("frames and episodes differ")
    return by_frames.join(said, "episode_index").select("episode_index", agreed.alias("task"))


#: Ordinals of the event types and the bowls' colours, left to right, of three sources.
ORDINAL = {"click": "1st", "signup": "2nd", "purchase": "3rd", "error": "1st", "view": "2nd"}
BOWLS = [["green", "red", "blue"], ["blue", "green", "red"], ["red", "blue", "green"]]
_PLACE = "CASE task WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 2 END"
_BOWL = f"([{', '.join(map(str, BOWLS))}])[(ep % 3 + 1)::INT][({_PLACE})::INT]"


def ordinal_sources(spark, sf_dir) -> list[TrajectoryDataset]:
    said = lambda t: F.concat(F.lit("Put the cup into the "), F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in ORDINAL.items()]), F.lit(" bowl from the left from the robot perspective"))
    ds = dataset(spark, sf_dir, said)
    named = frames(spark, sf_dir).select("episode_index").distinct()
    old = keys.prefix(named, "episode_index", F.lit(1).cast("long"), "new").select(F.col("new").alias("episode_index"), (F.col("episode_index") % 3).alias("_part"))
    ds = stored(spark, TrajectoryDataset(ds.frames.join(old, "episode_index"), ds.episodes.join(old, "episode_index"), ds.tasks, ds.info))
    part = lambda df, i: df.where(F.col("_part") == i).drop("_part")
    return [TrajectoryDataset(part(ds.frames, i), part(ds.episodes, i), ds.tasks, dict(ds.info)) for i in range(3)]


_MERGED_ORDER = "row_number() OVER (ORDER BY ep % 3, ep) - 1"


@query(f"WITH {DS} SELECT {_MERGED_ORDER} AS episode_index, 'Put the cup in the ' || {_BOWL} || ' colored bowl' AS task, length FROM e")
def relabel_and_merge(spark, sf_dir):
    rewrite = lambda own: lambda t: X.ordinal_to_color(t, [F.lit(c) for c in own])
    out = datasets.relabelled_and_merged(ordinal_sources(spark, sf_dir), [rewrite(own) for own in BOWLS])
    return prompts_of_frames(out)


def prompts_of_frames(ds: TrajectoryDataset) -> DataFrame:
    """Prompts by frames and dictionary, beside the episodes' lengths."""
    said = ds.frames.groupBy("episode_index", "task_index").agg(F.count("*").alias("n")).join(ds.tasks, "task_index")
    rows = said.join(ds.episodes.select("episode_index", "length"), "episode_index")
    return rows.where("n = length").select("episode_index", "task", "length")


@query(f"WITH {DS} SELECT {_MERGED_ORDER} AS episode_index, 'Put the cup into the bowl on the ' || (['left', 'center', 'right'])[({_PLACE})::INT] || ' from the robot perspective' AS task, length FROM e")
def position_and_merge(spark, sf_dir):
    return prompts_of_frames(datasets.relabelled_and_merged(ordinal_sources(spark, sf_dir), [X.ordinal_to_position] * 3))


_RELATIVE = f"""CASE {_PLACE} WHEN 1 THEN ['left of the ' || b[2]] WHEN 3 THEN ['right of the ' || b[2]] ELSE ['right of the ' || b[1], 'left of the ' || b[3]] END"""


@query(f"""WITH {DS}, x AS (SELECT *, ([{', '.join(map(str, BOWLS))}])[(ep % 3 + 1)::INT] AS b FROM e),
y AS (SELECT ep, length, unnest({_RELATIVE}) AS side, generate_subscripts({_RELATIVE}, 1) AS k FROM x)
SELECT row_number() OVER (ORDER BY ep % 3, ep, k) - 1 AS episode_index, 'Put the cup into the bowl on the ' || side || ' bowl from the robot perspective' AS task, length FROM y""")
def expand_and_merge(spark, sf_dir):
    own = lambda colors: lambda t: X.relative_prompts(F.lit("cup"), X.ordinal_position(t), F.array(*map(F.lit, colors)))
    return prompts_of_frames(datasets.expanded_and_merged(ordinal_sources(spark, sf_dir), [own(colors) for colors in BOWLS]))


@query(f"""WITH {DS}, m AS (SELECT {_MERGED_ORDER} AS episode_index, 'Put the cup in the ' || {_BOWL} || ' colored bowl' AS task FROM e)
SELECT *, ([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2])[concat('0x', substr(md5(concat('42:', episode_index)), 1, 8))::BIGINT % 8 + 1]::DOUBLE AS level FROM m""")
def colour_dataset(spark, sf_dir):
    out = datasets.colour_dataset(ordinal_sources(spark, sf_dir), BOWLS, 42)
    return out.episodes.select("episode_index", F.col("tasks")[0].alias("task"), "level")


@query(f"""WITH {DS}, x AS (SELECT e, e % 3 AS source, e // 10 AS file FROM e), n AS (SELECT source, file, row_number() OVER (ORDER BY source, file) - 1 AS new FROM (SELECT DISTINCT source, file FROM x))
SELECT e AS episode_index, source, new AS data_file FROM x JOIN n USING (source, file)""")
def sequential_files(spark, sf_dir):
    rows = dataset(spark, sf_dir).episodes.withColumn("source", F.col("episode_index") % 3)
    return datasets.sequential_files(rows).select("episode_index", "source", F.col("data/file_index").alias("data_file"))


@query(f"WITH {DS} SELECT e AS episode_index, 1000 + e // 10 AS size FROM e")
def file_dictionary(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    rows = normalise_videos(ds.episodes).select("episode_index", F.explode("videos").alias("v")).select("episode_index", "v.key", "v.chunk", "v.file")
    files = rows.select("key", "chunk", "file").distinct().withColumn("size", 1000 + F.col("file"))
    return joins.by_file(rows, files, "size").select("episode_index", "size")


@query(f"WITH {DS} SELECT e AS episode_index, arg_min(value, idx) AS first_value, arg_max(value, idx) AS last_value, min(idx) AS first_index, max(idx) AS last_index FROM f GROUP BY e")
def first_last_rows(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    out = datasets.first_and_last(ds.frames, ["value", "source_index"])
    return out.select("episode_index", "first_value", "last_value", F.col("first_source_index").alias("first_index"), F.col("last_source_index").alias("last_index"))


@query(f"""WITH {DS}, d AS (SELECT e, rn, abs(lead(value) OVER (PARTITION BY e ORDER BY rn) - value) AS change FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY change, rn) AS k FROM d WHERE rn < 14 AND change IS NOT NULL)
SELECT e AS episode_index, rn AS frame_index, round(change, 6) AS change FROM k WHERE k = 1""")
def steadiest_frame(spark, sf_dir):
    return r6(datasets.steadiest(dataset(spark, sf_dir).frames, "value").select("episode_index", "frame_index", "change"), "change")


@query(f"""WITH {DS}, {AUTO} SELECT e AS episode_index, [min(value)] AS min, [max(value)] AS max, [round(avg(value), 4)] AS mean, [count(value)::DOUBLE] AS count, [round(quantile_cont(value, 0.9), 4)] AS q90,
[(min(rn) + 0.0)::DOUBLE] AS first_frame FROM f GROUP BY e""".replace(f", {AUTO}", ""))
def episode_stats_map(spark, sf_dir):
    ds = datasets.with_episode_stats(stored(spark, dataset(spark, sf_dir)), ["value", "frame_index"])
    out = datasets.nested_stats(ds.episodes).select("episode_index", F.col("stats")["value"].alias("v"), F.col("stats")["frame_index"].alias("f"))
    rounded = lambda name: F.transform(F.col("v")[name], lambda x: V.rounded(x, 4)).alias(name)
    return out.select("episode_index", *[rounded(x) for x in ("min", "max", "mean", "count", "q90")], F.col("f")["min"].alias("first_frame"))


# Sources and sinks


def round_trip(spark, sf_dir, layout, **how) -> TrajectoryDataset:
    root = f"{Scratch(spark).at}/dataset"
    layouts.write(dataset(spark, sf_dir), root, layout, **how)
    return layouts.read(spark, root)


ROUND_TRIP = f"WITH {DS}, t AS (SELECT task, row_number() OVER (ORDER BY min(e)) - 1 AS i FROM e GROUP BY task) SELECT f.idx AS source_index, f.e AS episode_index, f.i AS index, f.rn AS frame_index, t.i AS task_index, t.task, f.value FROM f JOIN e USING (e) JOIN t ON t.task = e.task"


def _frames_of(ds: TrajectoryDataset) -> DataFrame:
    rows = ds.frames.join(ds.tasks, "task_index")
    return rows.select("source_index", "episode_index", "index", "frame_index", "task_index", "task", "value")


@query(ROUND_TRIP)
def round_trip_layout_3(spark, sf_dir):
    return _frames_of(round_trip(spark, sf_dir, "3", rows_per_file=1000, tasks_layout="B"))


@query(ROUND_TRIP)
def round_trip_layout_2(spark, sf_dir):
    return _frames_of(round_trip(spark, sf_dir, "2"))


@query(f"""WITH {DS}, n AS (SELECT count(*) AS n FROM e) SELECT e AS episode_index, printf('data/chunk-%03d/episode_%06d.parquet', e // 40, e) AS path, length AS n_rows, n.n AS total_episodes, (n.n + 39) // 40 AS total_chunks, '0:' || n.n AS train
FROM e, n""")
def episode_files(spark, sf_dir):
    """Every file of layout 2 by its path, which the path rule must give, with the header that was written."""
    root = f"{Scratch(spark).at}/dataset"
    layouts.write(dataset(spark, sf_dir), root, "2")
    info = layouts.read_info(spark, root)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data").select("episode_index", F.col("_metadata.file_path").alias("path"))
    rows = rows.withColumn("path", F.regexp_extract("path", r"(data/chunk-\d+/episode_\d+\.parquet)$", 1))
    rows = rows.groupBy("episode_index", "path").agg(F.count("*").alias("n_rows")).where(F.col("path") == V.chunk_path(F.col("episode_index"), 40))
    return rows.withColumns({"total_episodes": F.lit(info["total_episodes"]).cast("long"), "total_chunks": F.lit(info["total_chunks"]).cast("long"), "train": F.lit(info["splits"]["train"])})


@query(f"WITH {DS} SELECT printf('meta/episodes/chunk-000/file-%03d.parquet', e % 2) AS path, count(*) AS n, sum(length)::BIGINT AS n_frames FROM e GROUP BY 1")
def episode_file_groups(spark, sf_dir):
    root = f"{Scratch(spark).at}/dataset"
    layouts.write(dataset(spark, sf_dir), root, "3")
    rows = layouts.read_episodes(spark, root).withColumn("path", F.regexp_extract("_metadata.file_path", r"(meta/episodes/chunk-\d+/file-\d+\.parquet)$", 1))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("length").alias("n_frames"))


@query(f"WITH {DS} SELECT printf('chunk-%03d/file-%03d.parquet', (i // 1000) // 40, (i // 1000) % 40) AS path, count(*) AS n, min(i) AS low, max(i) AS high FROM f GROUP BY 1")
def exact_file_rows(spark, sf_dir):
    """Files of 1000 frames each, as they are on disk."""
    root = f"{Scratch(spark).at}/dataset"
    layouts.write(dataset(spark, sf_dir), root, "3", rows_per_file=1000)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data").select("index", F.regexp_extract("_metadata.file_path", r"/data/(.+)$", 1).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"))


@query(f"""WITH {DS}, n AS (SELECT count(*) AS n_episodes, sum(length)::BIGINT AS n_frames FROM e)
SELECT printf('chunk-000/file-%03d.parquet', e // 10) AS path, sum(length)::BIGINT AS n, bool_or(e = 4) AS changed, count(*) FILTER (e = 4) AS n_said FROM e GROUP BY 1""")
def changed_files(spark, sf_dir):
    """One episode's prompt changed in a stored dataset: which files were written again, which copied."""
    scratch = Scratch(spark)
    a, b = f"{scratch.at}/a", f"{scratch.at}/b"
    layouts.write(dataset(spark, sf_dir), a, "3")
    done = layouts.rewrite(edit.change_prompt(layouts.read(spark, a), 4, "another prompt"), a, b)
    ds = layouts.read(spark, b)
    rows = ds.frames.select("episode_index", "task_index", F.regexp_extract("_metadata.file_path", r"/data/(.+)$", 1).alias("path")).join(ds.tasks, "task_index")
    said = F.count_distinct(F.when(F.col("task") == "another prompt", F.col("episode_index")))
    there = rows.groupBy("path").agg(F.count("*").alias("n"), said.alias("n_said"))
    return done.join(there, "path").select("path", "n", "changed", "n_said")


@query(f"WITH {DS} SELECT e AS episode_index, CASE WHEN e % 4 = 1 THEN length + 1000 ELSE length END AS length FROM e")
def later_rows_win(spark, sf_dir):
    root = f"{Scratch(spark).at}/dataset"
    ds = dataset(spark, sf_dir)
    layouts.write(ds, root, "3")
    again = ds.episodes.where("episode_index % 4 = 1").withColumn("length", F.col("length") + 1000)
    layouts.write_grouped(again, [], lambda names: f"{root}/meta/episodes/chunk-001/file-000.parquet", ["episode_index"])
    return layouts.read_episodes(spark, root, last_wins=True).select("episode_index", "length")


@query(f"WITH {DS} SELECT layout, f.rn AS frame_index, f.idx AS source_index, e.task, video FROM f JOIN e USING (e), (SELECT unnest(['2', '3']) AS layout, unnest(['videos/chunk-000/top/episode_000007.mp4', 'videos/top/chunk-000/file-000.mp4']) AS video) WHERE e = 7")
def single_episode(spark, sf_dir):
    out = None
    for layout in ("2", "3"):
        root = f"{Scratch(spark).at}/dataset"
        layouts.write(dataset(spark, sf_dir), root, layout)
        rows, tasks, videos = layouts.read_episode(spark, root, 7)
        one = rows.crossJoin(F.broadcast(tasks)).withColumns({"layout": F.lit(layout), "video": F.lit(videos["top"].removeprefix(root + "/"))})  # one prompt
        one = one.select("layout", "frame_index", "source_index", "task", "video")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/far/' ELSE 'BASE/' END || 'scene_' || p_partkey || '.jpg' AS scene_path, [p_name, p_brand, 'a, "b"'] AS names FROM part""")
def csv_samples(spark, sf_dir):
    part, folder = table(spark, sf_dir, "part"), f"{Scratch(spark).at}/samples"
    scene = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/far/").otherwise(""), F.lit("scene_"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    names = F.to_json(F.array("p_name", "p_brand", F.lit('a, "b"')))
    layouts.write_csv(part.select("p_partkey", scene.alias("scene_path"), names.alias("all_celebrities")), f"{folder}/plan.csv")
    rows = layouts.read_samples(spark, f"{folder}/plan.csv")
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.replace("scene_path", F.lit(folder + "/"), F.lit("BASE/")).alias("scene_path"), F.col("all_celebrities").alias("names"))


@query(f"WITH {DS} SELECT e AS episode_index, e % 2 = 0 AS keep_full, e % 5 AS trim_start, e % 3 = 0 AS validated FROM e")
def side_cache(spark, sf_dir):
    """The decisions of a plan through a JSON side file."""
    path, e = f"{Scratch(spark).at}/trim_indices.json", F.col("episode_index")
    rows = dataset(spark, sf_dir).episodes.select("episode_index", (e % 2 == 0).alias("keep_full"), (e % 5).alias("trim_start"), (e % 3 == 0).alias("validated"))
    layouts.write_cache(spark, rows, path)
    return layouts.read_cache(spark, path).select("episode_index", "keep_full", "trim_start", "validated")


@query(f"SELECT 'value' AS feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.99), 6) AS q99, count(*) AS n FROM ({E}) UNION ALL SELECT 'index', round(avg(idx), 6), round(quantile_cont(idx, 0.99), 6), count(*) FROM ({E})")
def stats_file(spark, sf_dir):
    path, rows = f"{Scratch(spark).at}/stats.json", frames(spark, sf_dir)
    parts = [stats.scalar_stats(rows.select(F.col(c).cast("double").alias("v")), "v", []).withColumn("feature", F.lit(c)) for c in ("value", "index")]
    layouts.write_stats(spark, parts[0].unionByName(parts[1]), "feature", path)
    back = spark.createDataFrame([(layouts.read_text(spark, path),)], "t string")
    back = back.select(F.explode(F.from_json("t", "map<string, struct<mean:double, q99:double, count:bigint>>")).alias("feature", "s"))
    return back.select("feature", F.round("s.mean", 6).alias("mean"), F.round("s.q99", 6).alias("q99"), F.col("s.count").alias("n"))


@query("SELECT unnest(['README.md', 'meta/notes.txt', 'videos/top/a.mp4']) AS path, unnest([true, true, true]) AS same")
def copied_siblings(spark, sf_dir):
    scratch = Scratch(spark)
    a, b = f"{scratch.at}/a", f"{scratch.at}/b"
    ds = dataset(spark, sf_dir)
    info = layouts.write(ds, a, "3")
    layouts.write_card(ds, a, "Events", ["one", "two"], info)
    write_text(spark, f"{a}/meta/notes.txt", "kept as it is")
    write_text(spark, f"{a}/videos/top/a.mp4", "frames")
    done = layouts.copy_siblings(spark, a, b)
    return spark.createDataFrame([(p, layouts.read_text(spark, f"{a}/{p}") == layouts.read_text(spark, f"{b}/{p}")) for p in done], "path string, same boolean")


@query("SELECT 'nation-' || s_nationkey AS label, count(*)::INT AS n FROM supplier WHERE s_suppkey % 5 < 3 GROUP BY 1")
def image_folder(spark, sf_dir):
    """A file for each supplier, written by tasks: images in a label's folder and one below it, notes, and images too deep."""
    root, k = f"{Scratch(spark).at}/images", F.col("s_suppkey")
    inner = F.get(F.array(*map(F.lit, ("%s.jpg", "more/%s.PNG", "%s.jpeg", "%s.txt", "too/deep/%s.jpg"))), (k % 5).cast("int"))
    name = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit("/"), F.replace(inner, F.lit("%s"), k.cast("string")))
    rows = table(spark, sf_dir, "supplier").select(F.encode("s_name", "UTF-8").alias("data"), name.alias("_path"))
    sink.write_files(rows, root, "_path", [], kind="bytes")
    return layouts.read_image_folder(spark, root).select("label", F.size("paths").alias("n"))


@query("SELECT * FROM (VALUES ('base.pos', 1.5::DOUBLE), ('gripper.pos', -3.0::DOUBLE)) t(joint, degrees)")
def start_pose(spark, sf_dir):
    path = f"{Scratch(spark).at}/pose.json"
    write_text(spark, path, '{"base": 1.5, "gripper.pos": -3}')
    return spark.createDataFrame(sorted(layouts.read_pose(spark, path).items()), "joint string, degrees double")


# Samples and boxes


@query("""WITH RECURSIVE b AS (SELECT user_id, event_id AS id, (event_id * 37 % 1000)::DOUBLE AS cx, (event_id * 53 % 1000)::DOUBLE AS cy, (event_id % 41)::DOUBLE AS area, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 41 DESC, event_id) AS r FROM events),
g(user_id, r, kept) AS (SELECT user_id, r, [{'id': id, 'cx': cx, 'cy': cy}] FROM b WHERE r = 1 UNION ALL
SELECT b.user_id, b.r, CASE WHEN len(list_filter(g.kept, lambda k: sqrt((k.cx - b.cx) ** 2 + (k.cy - b.cy) ** 2) < 150)) > 0 THEN g.kept ELSE list_append(g.kept, {'id': b.id, 'cx': b.cx, 'cy': b.cy}) END
FROM g JOIN b ON b.user_id = g.user_id AND b.r = g.r + 1), e AS (SELECT user_id, unnest(arg_max(kept, r)) AS k FROM g GROUP BY user_id) SELECT user_id, k.id AS id, k.cx AS cx, k.cy AS cy FROM e""")
def centre_dedup(spark, sf_dir):
    i = F.col("event_id")
    shapes = table(spark, sf_dir, "events").select("user_id", i.alias("id"), *[c.cast("double").alias(n) for n, c in (("area", i % 41), ("cx", i * 37 % 1000), ("cy", i * 53 % 1000))])
    return greedy.centres(shapes, "user_id", 150.0, Scratch(spark)).select("user_id", "id", "cx", "cy")


POOL = ["ada", "ben", "cyd", "dan", "eve", "fay"]


@query(f"""WITH p AS (SELECT p_partkey AS k, ['x', 'y', 'z'] AS names, (['x', 'y', 'z'])[p_partkey % 3 + 1] AS target, ({POOL})[p_partkey % 6 + 1] AS new FROM part),
o AS (SELECT k, n, list(c ORDER BY md5(concat('42:', k, ':', n, ':', c))) AS cs FROM p, (SELECT unnest(['x', 'y', 'z']) AS n), (SELECT unnest({POOL}) AS c) GROUP BY 1, 2),
w AS (SELECT p.*, a.cs AS xs, b.cs AS ys, c.cs AS zs FROM p JOIN o a ON a.k = p.k AND a.n = 'x' JOIN o b ON b.k = p.k AND b.n = 'y' JOIN o c ON c.k = p.k AND c.n = 'z'),
s1 AS (SELECT *, CASE WHEN target = 'x' THEN new ELSE list_filter(xs, lambda c: c <> new)[1] END AS rx FROM w),
s2 AS (SELECT *, CASE WHEN target = 'y' THEN new ELSE list_filter(ys, lambda c: c <> new AND c <> rx)[1] END AS ry FROM s1)
SELECT k AS p_partkey, [rx, ry, CASE WHEN target = 'z' THEN new ELSE list_filter(zs, lambda c: c <> new AND c <> rx AND c <> ry)[1] END] AS replacement FROM s2""")
def replacement_names(spark, sf_dir):
    k = F.col("p_partkey")
    xyz, pool = F.array(*map(F.lit, "xyz")), F.array(*map(F.lit, POOL))
    rows = table(spark, sf_dir, "part").select("p_partkey", xyz.alias("names"), F.get(xyz, (k % 3).cast("int")).alias("target"), F.get(pool, (k % 6).cast("int")).alias("new"))
    return sample.replacements(rows, "names", "target", "new", POOL, 42, "p_partkey").select("p_partkey", "replacement")


@query(f"""WITH o AS (SELECT s, list(c ORDER BY md5(concat('7:', s, ':', c)))[1:4] AS everyone FROM (SELECT p_partkey AS s FROM part), (SELECT unnest({POOL}) AS c) GROUP BY s)
SELECT s AS scene_id, unnest(everyone) AS target, unnest(['top_left', 'top_right', 'bottom_left', 'bottom_right']) AS position, everyone FROM o""")
def scene_draw(spark, sf_dir):
    return sample.scenes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id")), POOL, ["top_left", "top_right", "bottom_left", "bottom_right"], 7)


@query(f"SELECT idx AS index, value FROM ({E}) ORDER BY value DESC, idx LIMIT 20")
def first_examples(spark, sf_dir):
    from .model import first_rows

    return first_rows(frames(spark, sf_dir).select("index", "value"), 20, F.col("value").desc(), "index")


# Text, lists and maps


@query("SELECT p_partkey, replace(replace(replace(p_name, 'red pump', 'A pump'), 'red', 'blue'), 'pump', 'gear') AS short FROM part WHERE NOT contains(p_name, 'red pump') UNION ALL SELECT p_partkey, 'A pump' FROM part WHERE p_name = 'red pump'")
def longest_first(spark, sf_dir):
    mapping = {"red": "blue", "pump": "gear", "red pump": "A pump"}
    return table(spark, sf_dir, "part").select("p_partkey", X.replaced_longest_first(F.col("p_name"), mapping).alias("short"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0")
def null_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("said"))
    return without_nulls(rows, "said").select("conv_id", "turn")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [p_brand] END AS one, CASE WHEN p_partkey % 3 = 1 THEN [] ELSE list_sort([p_name, p_brand]) END AS many FROM part")
def text_lists(spark, sf_dir):
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k != 0, F.col("p_brand")).alias("a"), F.when(k != 1, F.array("p_name", "p_brand")).alias("b"))
    return rows.select("p_partkey", V.text_list(F.col("a"), "string").alias("one"), V.text_list(F.col("b"), "array<string>", True).alias("many"))


@query("SELECT p_partkey, '0:' || p_size AS span, 0 AS low, p_size::BIGINT AS high, p_partkey % 2 = 0 AS parsed FROM part")
def span_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", V.span_text(F.col("p_size")).alias("span"))
    other = V.parse_span(F.when(F.col("p_partkey") % 2 == 0, F.col("span")).otherwise("all of it"))
    own = V.parse_span(F.col("span"))
    return rows.select("p_partkey", "span", own["low"].cast("int").alias("low"), own["high"].alias("high"), other.isNotNull().alias("parsed"))


@query("SELECT p_partkey, list_sort(['b.pos', 'a' || p_size || '.pos']) AS keys, p_size + p_partkey AS total FROM part")
def suffix_keys(spark, sf_dir):
    joint = F.concat(F.lit("a"), F.col("p_size").cast("string"))
    joints = V.zipped(F.array(joint, F.lit("b.pos")), F.array(F.col("p_size").cast("double"), F.col("p_partkey").cast("double")))
    own = table(spark, sf_dir, "part").select("p_partkey", V.suffixed_keys(joints, ".pos").alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).cast("long")
    return own.select("p_partkey", F.array_sort(F.map_keys("m")).alias("keys"), total.alias("total"))


@query("SELECT page_id, length(url)::BIGINT AS n, md5(url) AS same FROM pages")
def data_uris(spark, sf_dir):
    coded = F.base64(F.encode("url", "UTF-8"))
    uri = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), coded)).otherwise(coded)
    back = F.decode(V.data_uri_bytes(uri), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", F.length(back).cast("long").alias("n"), F.md5(back).alias("same"))


@query("SELECT s_suppkey, [s_acctbal, s_suppkey::DOUBLE] AS squeezed, [[1.0, s_acctbal], [2.0, 3.0]]::DOUBLE[][] AS turned FROM supplier")
def array_shapes(spark, sf_dir):
    a, k = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    two = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(a, F.lit(3.0)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.only_row(F.array(F.array(a, k))).alias("squeezed"), V.transposed(two).alias("turned"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'images.front' ELSE 'images.b' || p_size END AS first, 'images.top' AS wanted, 'top' AS videos, true AS textual FROM part")
def camera_choice(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    extra = F.when(F.col("p_partkey") % 2 == 0, F.lit("images.front")).otherwise(F.concat(F.lit("images.b"), F.col("p_size").cast("string")))
    names = F.array(F.lit("state"), F.lit("images.top"), extra)
    own = V.camera_key(names, "images."), V.camera_key(names, "images.", "images.top")
    textual = is_text(part, "p_name") and not is_text(part, "p_size") and features_of(INFO, but=("string",)) == ["value", "top"]
    return part.select("p_partkey", own[0].alias("first"), own[1].alias("wanted"), F.lit(features_of(INFO, "video")[0]).alias("videos"), F.lit(textual).alias("textual"))


@query("SELECT event_id, value < 250 AS fine FROM events")
def finite_values(spark, sf_dir):
    x = F.when(F.col("value") < 250, F.col("value")).when(F.col("value") < 300, F.lit(float("nan"))).when(F.col("value") < 350, F.lit(float("-inf")))
    return table(spark, sf_dir, "events").select("event_id", V.finite(x).alias("fine"))


# Plans


@query(f"WITH {DS} SELECT e AS episode_index, CASE WHEN e % 3 = 0 THEN 'own' ELSE task END AS prompt FROM e")
def prompt_fallback(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    own = ds.episodes.withColumn("tasks", F.when(F.col("episode_index") % 3 == 0, F.array(F.lit("own"), F.lit("other"))))
    return edit.single_prompt(own, ds.frames.select("episode_index", "task_index").distinct(), ds.tasks).select("episode_index", "prompt")


@query(f"WITH {DS} SELECT e AS episode_index, CASE WHEN e = 4 THEN 'another prompt' ELSE task END AS task, length FROM e")
def change_one_prompt(spark, sf_dir):
    return prompts_of_frames(edit.change_prompt(stored(spark, dataset(spark, sf_dir)), 4, "another prompt"))


@query(f"WITH {DS} SELECT e AS episode_index, 'the only prompt' AS task, length FROM e")
def retask_dataset(spark, sf_dir):
    return prompts_of_frames(edit.retask(stored(spark, dataset(spark, sf_dir, lambda t: F.lit("old"))), "the only prompt"))


@query(f"""WITH {DS}, t AS (SELECT e, {_COLOR} AS c FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY e) - 1 AS k FROM t)
SELECT e AS episode_index, replace((['Put the banana in the @ colored bowl.', 'Place the banana in the @ bowl.', 'Move the banana to the @ colored bowl.', 'Put the banana in the @ bowl.'])[(k % 4 + 1)::INT], '@', c) AS prompt FROM n""")
def rotating_wordings(spark, sf_dir):
    own = dataset(spark, sf_dir, colored).episodes.select("episode_index", F.col("tasks")[0].alias("prompt"))
    return augment.rotating_prompts(own).select("episode_index", F.col("new_prompt").alias("prompt"))


@query(f"WITH {DS} SELECT e AS episode_index, 1 + 5 * 3 AS n, 5 AS n_texts, true AS in_range FROM e")
def augmented_plan(spark, sf_dir):
    own = dataset(spark, sf_dir, colored).episodes.select("episode_index", F.col("tasks")[0].alias("prompt"))
    out = augment.augmented_copies(own)
    inside = F.bool_and(F.when(F.col("copy") > 0, F.col("brightness").between(0.7, 1.3) & F.col("hue_delta").between(-10, 10)).otherwise(F.col("brightness").isNull()))
    texts = F.count_distinct(F.when(F.col("copy") > 0, F.col("task"))).cast("int")
    return out.groupBy("episode_index").agg(F.count("*").cast("int").alias("n"), texts.alias("n_texts"), inside.alias("in_range"))


@query(f"""WITH {DS}, s AS (SELECT e // 10 AS file, start / 10.0::DOUBLE AS a, (start + length - 1) / 10.0::DOUBLE AS b, 0.5::DOUBLE + (e % 8) / 10.0::DOUBLE AS level FROM e)
SELECT file, unnest(generate_series(round_even(a * 10, 0)::BIGINT, round_even(b * 10, 0)::BIGINT)) AS frame, round(level, 3) AS level FROM s""")
def frame_levels(spark, sf_dir):
    own = dataset(spark, sf_dir).episodes
    part = lambda x: F.col(f"`videos/top/{x}`")
    slices = own.select(part("file_index").alias("file"), part("from_timestamp").alias("from_ts"), part("to_timestamp").alias("to_ts"), (0.5 + F.col("episode_index") % 8 / 10).alias("level"))
    return augment.level_of_frames(slices, 10.0).withColumn("level", F.round("level", 3))


@query(f"WITH {DS} SELECT e AS episode_index FROM e WHERE e % 3 <> 1")
def resumed_plan(spark, sf_dir):
    own = dataset(spark, sf_dir).episodes.select("episode_index")
    return augment.resume(own.where("episode_index % 3 = 1"), own)


@query(f"""WITH {DS} SELECT 'value' AS feature, {STATS.format(x='value')} FROM f UNION ALL SELECT 'index', {STATS.format(x='i')} FROM f UNION ALL SELECT 'frame_index', {STATS.format(x='rn')} FROM f""")
def training_stats(spark, sf_dir):
    rows = dataset(spark, sf_dir).frames.select("episode_index", "task_index", "value", "index", "frame_index")
    out, info, changed = augment.training_ready(stored(spark, TrajectoryDataset(rows, rows.limit(0), rows.limit(0), {})).frames, {"fps": 10})
    wanted = {"total_frames", "total_episodes", "total_tasks", "splits"}
    if {name for name, _, _ in changed} != wanted or info["splits"]["train"] != f"0:{info['total_episodes']}":
        raise ValueError(f"header: {changed}")
    names = ["min", "max", "mean", "std", "count", *stats.QUANTILES]
    return out.where("feature IN ('value', 'index', 'frame_index')").select("feature", *[F.round(F.col(c)[0], 6).alias(c) for c in names]).withColumn("count", F.col("count").cast("long"))


@query(f"WITH {DS} SELECT count(*) AS total_episodes, sum(length)::BIGINT AS total_frames, count(DISTINCT task) AS total_tasks, count(*) AS total_videos, (count(*) + 39) // 40 AS total_chunks, true AS matches FROM e")
def header_totals(spark, sf_dir):
    ds = stored(spark, dataset(spark, sf_dir))
    totals = ds.totals()
    matches = checks.totals_match(TrajectoryDataset(ds.frames, ds.episodes, ds.tasks, totals))
    names = [f"total_{x}" for x in ("episodes", "frames", "tasks", "videos", "chunks")]
    return spark.createDataFrame([tuple(int(totals[n]) for n in names) + (matches,)], ", ".join(f"{n} long" for n in names) + ", matches boolean")


@query("SELECT * FROM (VALUES ('videos/top', 'top'), ('stats', 'left out'), ('missing', 'raises')) t(name, what)")
def column_choice(spark, sf_dir):
    """Columns found by prefix and suffix, dropped by prefix, and required."""
    from .model import require_columns, without_stats

    own = dataset(spark, sf_dir).episodes.withColumn("stats/value/min", F.lit(0.0))
    left = [c for c in without_stats(own).columns if c.startswith("stats/")]
    try:
        require_columns(own, ["length", "nowhere"])
        raised = "passes"
    except ValueError:
        raised = "raises"
    rows = [("videos/top", video_keys(own.columns)[0]), ("stats", "still there" if left else "left out"), ("missing", raised)]
    return spark.createDataFrame(rows, "name string, what string")


@query("""WITH h AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1),
f AS (SELECT user_id, unnest(['fps', 'robot_type', 'codebase_version', 'chunks_size', 'features.value.dtype', 'features.value.shape', 'features.value.video.codec', 'features.value.video.pix_fmt', 'features.value.video.fps',
    'features.top.dtype', 'features.top.shape', 'features.top.video.codec', 'features.top.video.pix_fmt', 'features.top.video.fps']) AS field,
  unnest(['10', 'arm-' || n % 3, 'null', '1000', 'float32', '[1]', 'null', 'null', 'null', 'video', '[4,2,3]', CASE WHEN top > 300 THEN 'h264' ELSE 'av1' END, 'yuv420p', (n % 2)::VARCHAR]) AS value FROM h)
SELECT field, count(DISTINCT user_id) AS n_datasets, count(DISTINCT value) AS n_values, count(DISTINCT value) = 1 AS uniform FROM f GROUP BY field""")
def header_fields(spark, sf_dir):
    """A header for each user's events, flattened to fields; 10 and 10.0 are the same value."""
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("dataset")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    odd, n = F.col("n") % 2, F.col("n").cast("string")
    media = F.struct(F.when(F.col("top") > 300, "h264").otherwise("av1").alias("video.codec"), F.lit("yuv420p").alias("video.pix_fmt"), odd.alias("video.fps"))
    info = F.to_json(F.struct(F.struct(F.lit("video").alias("dtype"), F.array(*map(F.lit, (4, 2, 3))).alias("shape"), media.alias("info")).alias("top")))
    value = F.when(odd == 0, F.lit('"value":{"dtype":"float32","shape":[1]}')).otherwise(F.lit('"value":{"dtype":"float32","shape":[ 1.0 ]}'))
    fps = F.when(odd == 0, "10").otherwise("10.0")
    text = F.concat(F.lit('{"fps":'), fps, F.lit(',"robot_type":"arm-'), (F.col("n") % 3).cast("string"), F.lit('","chunks_size":1000,"features":{'), value, F.lit(","), F.substring(info, 2, 1 << 30), F.lit("}"))
    rows = report.header_rows(own.select("dataset", text.alias("info")))
    return report.uniformity(rows, own.count())


def _turned(turns: dict, key: str, number: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN ({v})[{number} % {len(v)} + 1]" for k, v in turns.items()) + " END"


_SIDE = "'Put the banana into the bowl on the {} of the ' || {} || ' bowl from the robot perspective.'"
_EXCLUDED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in augment.EXCLUDED.items())


@query(f"""WITH {DS}, t AS (SELECT e.e AS ep, length, start, e.e // 18 AS number, k, b[k] AS color, CASE WHEN k > 1 THEN b[k - 1] END AS l, CASE WHEN k < 3 THEN b[k + 1] END AS r, (['left', 'middle', 'right'])[k] AS pos
  FROM (SELECT *, (e % 3 + 1)::INT AS k FROM e) e JOIN (VALUES {LAYOUTS}) c(config, name, b) ON config = e.e // 3 % 6),
p AS (SELECT ep, length, start, unnest([0, 1, 2, 3, 4]) AS copy, unnest([{_turned(augment.COLOR_TURNS, 'color', 'number')},
  'Put the banana into the ' || {_turned(augment.POSITION_TURNS, 'pos', 'number')} || ' from the robot perspective.',
  'Put the banana into the bowl that is ' || CASE color {_EXCLUDED} END || '.',
  CASE k WHEN 1 THEN {_SIDE.format('left', 'r')} WHEN 3 THEN {_SIDE.format('right', 'l')} ELSE 'Put the banana into the bowl between the ' || CASE WHEN 'blue' IN (l, r) THEN 'blue' ELSE 'red' END || ' bowl and the ' ||
    CASE WHEN 'green' IN (l, r) THEN 'green' ELSE 'red' END || ' bowl.' END,
  CASE WHEN k <> 2 THEN {_turned(augment.COLOR_TURNS, 'color', '(number + 2)')} WHEN number % 2 = 0 THEN {_SIDE.format('right', 'l')} ELSE {_SIDE.format('left', 'r')} END]) AS task FROM t)
SELECT ep * 5 + copy AS episode_index, task, length, (5 * start + copy * length)::BIGINT AS low, (5 * start + (copy + 1) * length - 1)::BIGINT AS high, sums.s AS source
FROM p JOIN (SELECT e AS ep, sum(idx)::BIGINT AS s FROM f GROUP BY 1) sums USING (ep)""")
def five_prompt_dataset(spark, sf_dir):
    """Every episode five times, once for each of its prompts, with all its frames; episodes take layouts and places in turn."""
    ds = stored(spark, dataset(spark, sf_dir))
    e = F.col("episode_index")
    layout = F.get(F.array(*[F.array(*map(F.lit, own[1:])) for own in trials.CONFIGS]), (F.floor(e / 3) % 6).cast("int"))
    k = (e % 3).cast("int")
    place = F.get(F.array(*map(F.lit, augment.POSITION_TURNS)), k)
    beside = F.when(k > 0, F.get(layout, k - 1)), F.when(k < 2, F.get(layout, k + 1))
    own = ds.episodes.withColumn("prompts", augment.five_prompts(place, F.get(layout, k), *beside, F.floor(e / 18).cast("int")))
    rows, episodes, tasks = augment.expand_prompts(ds.frames, own, "prompts")
    ends = rows.groupBy("episode_index", "task_index").agg(F.count("*").alias("length"), F.min("index").alias("low"), F.max("index").alias("high"), F.sum("source_index").alias("source"))
    return ends.join(tasks, "task_index").select("episode_index", "task", "length", "low", "high", "source")


# Comparison of datasets

EDITED = """SELECT user_id, event_id, event_type, CASE WHEN user_id % 40 = 7 AND event_id % 9 = 2 THEN value + 1 ELSE value END AS value,
  CASE WHEN user_id % 40 = 9 THEN NULL ELSE props END AS props FROM events WHERE user_id % 40 <> 11
UNION ALL SELECT -1 - user_id, event_id, event_type, value, props FROM events WHERE user_id % 40 = 3"""


@query(f"""WITH b AS ({EDITED}), j AS (SELECT coalesce(a.user_id, b.user_id) AS u, a.event_id IS NULL AS no_left, b.event_id IS NULL AS no_right,
  a.value IS DISTINCT FROM b.value AS v, a.props IS DISTINCT FROM b.props AS p FROM events a FULL JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id)
SELECT u AS user_id, CASE WHEN bool_and(no_right) THEN 'left only' WHEN bool_and(no_left) THEN 'right only' ELSE 'differs' END AS what,
  CASE WHEN bool_and(no_right) OR bool_and(no_left) THEN '' ELSE concat_ws(',', CASE WHEN bool_or(v) THEN 'value' END, CASE WHEN bool_or(p) THEN 'props' END) END AS columns
FROM j GROUP BY u HAVING bool_or(no_left) OR bool_or(no_right) OR bool_or(v) OR bool_or(p)""")
def dataset_differences(spark, sf_dir):
    """Events beside an edited copy: values and notes changed in some episodes, some gone, some new."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value", "props")
    user = F.col("user_id") % 40
    value = F.when((user == 7) & (F.col("event_id") % 9 == 2), F.col("value") + 1).otherwise(F.col("value"))
    edited = events.where(user != 11).withColumns({"value": value, "props": F.when(user != 9, F.col("props"))})
    edited = edited.unionByName(events.where(user == 3).withColumn("user_id", -1 - F.col("user_id")))
    out = compare.differences(events, edited, "user_id", ["event_id", "event_type", "value", "props"], bucket=16)
    return out.withColumn("columns", F.concat_ws(",", "columns"))


@query("""WITH f AS (SELECT source, master_id || '.' || field AS field, value FROM (
    SELECT source, master_id, unnest(['name', 'email', 'city', 'segment']) AS field, unnest([name, email, city, segment]) AS value FROM clients)
  WHERE source IS NOT NULL AND master_id IS NOT NULL AND value IS NOT NULL)
SELECT field, count(DISTINCT source) AS n_datasets, count(DISTINCT value) AS n_values,
  count(DISTINCT source) = (SELECT count(DISTINCT source) FROM clients) AND count(DISTINCT value) = 1 AS uniform FROM f GROUP BY field""")
def source_uniformity(spark, sf_dir):
    """Fields of the same client in all sources."""
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    fields = clients.unpivot(["source", "master_id"], ["name", "email", "city", "segment"], "field", "value").where("source IS NOT NULL AND value IS NOT NULL AND master_id IS NOT NULL")
    fields = fields.select(F.col("source").alias("dataset"), F.concat_ws(".", F.col("master_id").cast("string"), "field").alias("field"), "value")
    return report.uniformity(fields, clients.agg(F.count_distinct("source")).first()[0])
