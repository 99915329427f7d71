"""A query for each operator over the test tables, beside the SQL that says the same.

Frames are events (an episode is a user, its signal is value, its prompt the event type), vectors are embeddings
(an episode is a label), prompts come from parts, prompt lists from conversations, duplicates from documents.
Doubles are rounded where engines differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .operators import edit, greedy, intervals, joins, keys, sample, sketches, stats, trim
from .plans import checks, report, trials
from .storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("episode_index"), F.col("event_id").alias("index"), "value", F.col("event_type").alias("task"), "ts", "props")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("rn", keys.frame_index("index"))
    return rows.withColumn("timestamp", F.col("rn") / 10)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal prompts about parts: object is the noun, the ordinal follows the key."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    ordinal = F.get(F.array(F.lit("1st"), F.lit("2nd"), F.lit("3rd"), F.lit("2st")), (F.col("p_partkey") % 4).cast("int"))
    task = F.concat(F.lit("Put the "), words[1], F.lit(" into the "), ordinal, F.lit(" bowl from the left from the robot perspective"))
    color = F.concat(F.lit("Put the "), words[1], F.lit(" in the "), words[0], F.lit(" colored bowl"))
    return part.select("p_partkey", words[0].alias("adj"), words[1].alias("noun"), task.alias("task"), color.alias("color_task"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


#: The same relations for the other engine.
E = "SELECT user_id AS ep, event_id AS idx, value, event_type AS task, ts, props FROM events"
N = f"SELECT *, row_number() OVER (PARTITION BY ep ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY ep) AS n FROM ({E})"
PROMPTS = """SELECT p_partkey, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun,
  'Put the ' || split_part(p_name, ' ', 2) || ' into the ' || (['1st', '2nd', '3rd', '2st'])[p_partkey % 4 + 1] || ' bowl from the left from the robot perspective' AS task,
  'Put the ' || split_part(p_name, ' ', 2) || ' in the ' || split_part(p_name, ' ', 1) || ' colored bowl' AS color_task FROM part"""
VELOCITY = f"SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY ep ORDER BY idx)), 0.0) AS v FROM ({N})"
SPANS = f"""SELECT ep, length, row_number() OVER (ORDER BY ep) - 1 AS new_episode, (sum(length) OVER (ORDER BY ep) - length)::BIGINT AS start
  FROM (SELECT ep, count(*) AS length FROM ({E}) GROUP BY ep)"""
STATS = """min({x}) AS min, max({x}) AS max, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, count({x}) AS count,
  round(quantile_cont({x}, 0.01), 6) AS q01, round(quantile_cont({x}, 0.1), 6) AS q10, round(quantile_cont({x}, 0.5), 6) AS q50,
  round(quantile_cont({x}, 0.9), 6) AS q90, round(quantile_cont({x}, 0.99), 6) AS q99"""
ROUNDED = ("mean", "std", "q01", "q10", "q50", "q90", "q99")


# Scans, keys and dictionaries


@query("SELECT o_orderkey, o_custkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def scan_concat_sort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "o_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines")).orderBy("o_orderkey")


@query(f"SELECT idx AS index, ep AS episode_index, rn AS frame_index, new_episode, start + rn AS new_index FROM ({N}) JOIN ({SPANS}) USING (ep)")
def reindex_dense(spark, sf_dir):
    return keys.reindex(frames(spark, sf_dir)).select("index", "episode_index", F.col("frame_index").cast("long").alias("frame_index"), "new_episode", "new_index")


@query(f"""SELECT ep AS episode_index, length, new_episode, start AS dataset_from_index, start + length AS dataset_to_index, low, high
FROM ({SPANS}) JOIN (SELECT ep, min(idx) AS low, max(idx) AS high FROM ({E}) GROUP BY ep) USING (ep)""")
def episode_boundaries(spark, sf_dir):
    rows = frames(spark, sf_dir)
    ends = rows.groupBy("episode_index").agg(F.min("index").alias("low"), F.max("index").alias("high"))
    return keys.episode_spans(rows).join(ends, "episode_index")


MERGED = f"""SELECT *, ep % 3 AS source FROM ({E})"""
MERGED_EP = f"""SELECT source, ep, length, row_number() OVER (ORDER BY source, ep) - 1 AS episode_index,
  (sum(length) OVER (ORDER BY source, ep) - length)::BIGINT AS start FROM (SELECT source, ep, count(*) AS length FROM ({MERGED}) GROUP BY 1, 2)"""
DICTIONARY = f"""SELECT task, row_number() OVER (ORDER BY source, pos) - 1 AS task_index FROM
  (SELECT task, min(source) AS source, arg_min(pos, source) AS pos FROM
    (SELECT source, task, min(idx) AS pos FROM ({MERGED}) GROUP BY 1, 2) GROUP BY task)"""


def parts(spark, sf_dir, n: int = 3) -> list:
    """Events split into n datasets by user; each has its own dense ids and dictionary."""
    from .model import TrajectoryDataset

    out = []
    for i in range(n):
        rows = frames(spark, sf_dir).where(F.col("episode_index") % n == i)
        tasks = keys.first_seen(rows, "task", ["index"], "task_index").select("task_index", "task")
        own = keys.reindex(rows).join(F.broadcast(tasks), "task")  # a dictionary has one row a prompt
        ds_frames = own.select(
            F.col("new_index").alias("index"), F.col("new_episode").alias("episode_index"), "frame_index", "task_index", "value", F.col("index").alias("source_index")
        )
        spans = keys.episode_spans(rows)
        names = rows.groupBy("episode_index").agg(F.array_sort(F.collect_set("task")).alias("tasks"))
        episodes = spans.join(names, "episode_index").select(
            F.col("new_episode").alias("episode_index"), "length", "dataset_from_index", "dataset_to_index", "tasks"
        )
        out.append(TrajectoryDataset(ds_frames, episodes, tasks, {"fps": 10, "robot_type": "arm"}))
    return out


def tagged(spark, sf_dir, n: int = 3):
    """The same datasets in common tables, each read from one pass over the events, merged."""
    rows = frames(spark, sf_dir).withColumn("source", (F.col("episode_index") % n).cast("int"))
    first = rows.groupBy("source", "task").agg(F.min("index").alias("_first"))
    order = Window.partitionBy("source").orderBy("_first")  # a dictionary: a row a prompt
    tasks = first.select("source", "task", (F.row_number().over(order) - 1).cast("long").alias("task_index"))
    own = rows.withColumn("frame_index", keys.frame_index("index")).join(F.broadcast(tasks), ["source", "task"])
    own = own.select("source", "episode_index", "frame_index", "task_index", "value", F.col("index").alias("source_index"))
    episodes = rows.groupBy("source", "episode_index").agg(F.count("*").alias("length"), F.array_sort(F.collect_set("task")).alias("tasks"))
    return edit.merge_tagged(own, episodes, tasks, {"fps": 10, "robot_type": "arm"})


@query(f"""SELECT idx AS source_index, episode_index, start + rn AS index, rn AS frame_index, task_index, value FROM
(SELECT *, row_number() OVER (PARTITION BY ep ORDER BY idx) - 1 AS rn FROM ({MERGED})) JOIN ({MERGED_EP}) USING (source, ep) JOIN ({DICTIONARY}) USING (task)""")
def merge_datasets(spark, sf_dir):
    out = tagged(spark, sf_dir).frames
    return out.select("source_index", "episode_index", "index", F.col("frame_index").cast("long").alias("frame_index"), "task_index", "value")


@query(f"SELECT task_index, task FROM ({DICTIONARY})")
def merge_dictionary(spark, sf_dir):
    return edit.merge(parts(spark, sf_dir)).tasks


PART_STATS = f"SELECT ep % 3 AS source, {STATS.format(x='value')} FROM ({E}) GROUP BY 1"
RAW_STATS = PART_STATS.replace("round(", "(").replace(", 6) AS", ") AS")


@query(f"""SELECT min(min) AS min, max(max) AS max, sum(count)::BIGINT AS count, round(sum(count * mean) / sum(count), 6) AS mean,
round(sqrt(sum(count * (std * std + mean * mean)) / sum(count) - (sum(count * mean) / sum(count)) ** 2), 6) AS std,
round(sum(count * q01) / sum(count), 6) AS q01, round(sum(count * q10) / sum(count), 6) AS q10, round(sum(count * q50) / sum(count), 6) AS q50,
round(sum(count * q90) / sum(count), 6) AS q90, round(sum(count * q99) / sum(count), 6) AS q99 FROM ({RAW_STATS})""")
def merged_partial_stats(spark, sf_dir):
    rows = frames(spark, sf_dir).select((F.col("episode_index") % 3).alias("source"), F.col("value").cast("double").alias("x"))
    each = stats.ranked_stats(rows, ["source"])  # nothing bounds a source
    return r6(stats.merged(each), *ROUNDED)


LEVELS = {"dataset": "0", "source": "ep % 3", "file": "ep // 10"}


@query(" UNION ALL ".join(
    f"SELECT '{level}' AS level, {key} AS key, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, true AS within FROM ({E}) GROUP BY {key}"
    for level, key in LEVELS.items()
).replace("GROUP BY 0", ""))
def merged_sketches(spark, sf_dir):
    """Statistics of files, sources and the dataset from those of episodes; whether all ranks are within the sketch's error."""
    rows = frames(spark, sf_dir).withColumns({"file": F.floor(F.col("episode_index") / 10), "source": F.col("episode_index") % 3, "dataset": F.lit(0).cast("long")})
    episodes = Scratch(spark).table(sketches.sketched(rows, "value", ["episode_index", "file", "source", "dataset"]), "episodes")
    out = []
    for level in LEVELS:
        own = sketches.quantiles(sketches.merged(episodes, [level]))
        gaps = sketches.rank_gaps(rows, "value", own, [level])
        own = own.join(gaps, level).withColumn("within", F.col("gap") <= 2 * sketches.rank_error())
        out.append(own.select(F.lit(level).alias("level"), F.col(level).alias("key"), "count", "min", "max", "mean", "std", "within"))
    return r6(out[0].unionByName(out[1]).unionByName(out[2]), "mean", "std")


@query(f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY ep) - 1 AS dense FROM (SELECT ep, count(*) AS length FROM ({E}) GROUP BY ep)),
k AS (SELECT *, row_number() OVER (ORDER BY ep) - 1 AS new_ep, (sum(length) OVER (ORDER BY ep) - length)::BIGINT AS start FROM d WHERE dense NOT IN (1, 3))
SELECT idx AS source_index, new_ep AS episode_index, start + rn AS index FROM k JOIN ({N}) USING (ep)""")
def delete_episodes(spark, sf_dir):
    return edit.delete(parts(spark, sf_dir, 1)[0], [1, 3]).frames.select("source_index", "episode_index", "index")


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY ep % 2 ORDER BY ep) - 1 AS dense FROM (SELECT ep, count(*) AS length FROM ({E}) GROUP BY ep))
SELECT CASE WHEN ep % 2 = 0 AND dense NOT IN (1, 3) THEN 'source' ELSE 'target' END AS dataset, count(*) AS episodes, sum(length)::BIGINT AS frames FROM d GROUP BY 1""")
def move_episodes(spark, sf_dir):
    a, b = parts(spark, sf_dir, 2)
    source, target = edit.move(a, b, [1, 3])
    count = lambda name, ds: ds.frames.agg(F.lit(name).alias("dataset"), F.count_distinct("episode_index").alias("episodes"), F.count("*").alias("frames"))
    return count("source", source).unionByName(count("target", target))


@query(f"SELECT ep AS episode_index, idx AS index, ep % 3 AS source FROM ({E})")
def append_union(spark, sf_dir):
    rows = frames(spark, sf_dir).select("episode_index", "index")
    a, b, c = (rows.where(F.col("episode_index") % 3 == i).withColumn("source", F.lit(i).cast("long")) for i in range(3))
    return a.unionByName(b).unionByName(c)


@query("""WITH used AS (SELECT DISTINCT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49)
SELECT p_name AS task, row_number() OVER (ORDER BY first) - 1 AS task_index FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name) WHERE p_name IN (SELECT p_name FROM used)""")
def semi_compact_dictionary(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    used = part.join(lines.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi").select("p_name").distinct()
    rows = part.join(used, "p_name", "left_semi")
    return keys.first_seen(rows, "p_name", ["p_partkey"], "task_index").select(F.col("p_name").alias("task"), "task_index")


@query(f"SELECT task, min(idx) AS first_index, row_number() OVER (ORDER BY min(idx)) - 1 AS task_index FROM ({E}) GROUP BY task")
def union_distinct_ordered(spark, sf_dir):
    rows = frames(spark, sf_dir)
    first = rows.groupBy("task").agg(F.min("index").alias("first_index"))
    return keys.first_seen(rows, "task", ["index"], "task_index").join(first, "task").select("task", "first_index", "task_index")


@query(f"SELECT DISTINCT ep AS episode_index FROM ({E}) WHERE value > 100 EXCEPT SELECT DISTINCT ep FROM ({E}) WHERE value > 450")
def set_except(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.where("value > 100").select("episode_index").subtract(rows.where("value > 450").select("episode_index"))


@query(f"SELECT DISTINCT ep AS episode_index FROM ({E}) WHERE value > 300 INTERSECT SELECT DISTINCT ep FROM ({E}) WHERE value < 1")
def set_intersect(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.where("value > 300").select("episode_index").intersect(rows.where("value < 1").select("episode_index"))


# Updates and maps

MAPPING = [("click", "press"), ("view", "look"), ("purchase", "buy"), ("error", "fault"), ("signup", "enter")]


@query(f"SELECT idx AS index, CASE WHEN value > 200 THEN 'high' ELSE task END AS task, 7 AS fixed, idx + 1000 AS shifted FROM ({E})")
def cond_update(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.select("index", F.when(F.col("value") > 200, "high").otherwise(F.col("task")).alias("task"), F.lit(7).alias("fixed"), (F.col("index") + 1000).alias("shifted"))


@query(f"SELECT idx AS index, task, task_index FROM ({E}) JOIN (SELECT task, row_number() OVER (ORDER BY min(idx)) - 1 AS task_index FROM ({E}) GROUP BY task) USING (task)")
def dict_remap_strict(spark, sf_dir):
    rows = frames(spark, sf_dir)
    dictionary = keys.first_seen(rows, "task", ["index"], "task_index")
    return joins.strict_map(rows, "task", dictionary, "task", "task_index", "task_index").select("index", "task", "task_index")


@query(f"SELECT idx AS index, CASE task WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE task END AS task FROM ({E})")
def fallback_map(spark, sf_dir):
    rows = frames(spark, sf_dir)
    known = spark.createDataFrame(MAPPING[:2], "task string, new string")
    return rows.join(known, "task", "left").select("index", F.coalesce("new", "task").alias("task"))


@query(f"SELECT ep AS episode_index, list_sort(list(DISTINCT CASE task WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE task END)) AS tasks FROM ({E}) GROUP BY ep")
def list_replace(spark, sf_dir):
    rows = frames(spark, sf_dir).groupBy("episode_index").agg(F.collect_set("task").alias("tasks"))
    mapping = F.create_map(*[F.lit(x) for pair in MAPPING[:2] for x in pair])
    return rows.select("episode_index", F.array_sort(V.replace_values(F.col("tasks"), mapping)).alias("tasks"))


# Joins


@query(f"SELECT e.idx AS index, min(r.file) AS file FROM ({E}) e LEFT JOIN (SELECT range AS file, range * 777 AS start, range * 777 + 799 AS stop FROM range(0, (SELECT max(event_id) // 777 + 1 FROM events))) r ON e.idx BETWEEN r.start AND r.stop GROUP BY 1")
def range_lookup_file(spark, sf_dir):
    points = frames(spark, sf_dir).select("index")
    largest = points.agg(F.coalesce(F.max("index"), F.lit(0)).alias("largest"))
    ranges = largest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("largest") / 777))).alias("file"))
    ranges = ranges.select("file", (F.col("file") * 777).alias("start"), (F.col("file") * 777 + 799).alias("end"))
    return intervals.first_cover(points, "index", ranges)


@query(f"""WITH r AS (SELECT idx AS start, idx + CASE WHEN idx % 50 = 0 THEN 1000000000 ELSE floor(value * value / 8)::BIGINT END AS stop, idx * 7919 % 1000003 AS file, ep % 8 AS lane FROM ({E}) WHERE idx % 5 = 0),
m AS (SELECT e.idx, min(r.file) AS file, count(*) AS n FROM ({E}) e JOIN r ON r.lane = e.ep % 8 AND e.idx BETWEEN r.start AND r.stop GROUP BY 1)
SELECT e.idx AS index, m.file, coalesce(n, 0) AS n_ranges FROM ({E}) e LEFT JOIN m USING (idx)""")
def nested_range_lookup(spark, sf_dir):
    """Ranges from one id to the whole table, in eight lanes; a point meets those of its own lane."""
    rows = frames(spark, sf_dir).withColumn("lane", F.col("episode_index") % 8)
    i = F.col("index")
    length = F.when(i % 50 == 0, F.lit(1_000_000_000).cast("long")).otherwise(F.floor(F.col("value") * F.col("value") / 8))
    ranges = rows.where("index % 5 = 0").select("lane", i.alias("start"), (i + length).alias("end"), (i * 7919 % 1000003).alias("file"))
    return intervals.first_cover(rows.select("index", "lane"), "index", ranges, by=["lane"], count="n_ranges").drop("lane")


@query(f"""WITH q AS (SELECT ep, idx, rn / 10.0::DOUBLE + CASE WHEN idx % 3 = 0 THEN 0.03 ELSE 0.0 END AS t FROM ({N})),
t AS (SELECT ep, rn / 10.0::DOUBLE AS t FROM ({N}) WHERE rn % 7 <> 3),
b AS (SELECT q.idx, q.t, t.t AS before_t FROM q ASOF LEFT JOIN t ON q.ep = t.ep AND q.t >= t.t), a AS (SELECT q.idx, q.t, t.t AS after_t FROM q ASOF LEFT JOIN t ON q.ep = t.ep AND q.t <= t.t)
SELECT idx AS index, round(least(abs(b.t - before_t), abs(after_t - b.t)), 6) AS gap, coalesce(least(abs(b.t - before_t), abs(after_t - b.t)) <= 0.02, false) AS valid FROM b JOIN a USING (idx)""")
def nearest_timestamp(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    queries = rows.select("episode_index", "index", (F.col("timestamp") + F.when(F.col("index") % 3 == 0, 0.03).otherwise(0.0)).alias("t"))
    times = rows.where("rn % 7 <> 3").select("episode_index", F.col("timestamp").alias("t"))
    return r6(joins.nearest(queries, times, "episode_index", "t", 0.02).select("index", "gap", "valid"), "gap")


@query(f"""SELECT idx AS index, ep AS episode_index FROM ({N}) WHERE 0.5 + rn / 10.0::DOUBLE BETWEEN 1.0 - 0.0001 AND least(4.0 + ep % 5, 6.0) + 0.0001
AND 0.2 + rn / 10.0::DOUBLE BETWEEN 0.0 - 0.0001 AND 5.0 + 0.0001""")
def interval_clip(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    ids = rows.select("episode_index").distinct()
    front = ids.select("episode_index", F.lit(0.5).alias("from_ts"), F.lit(6.0).alias("to_ts"), F.lit(1.0).alias("low"), (F.lit(4.0) + F.col("episode_index") % 5).alias("high"))
    top = ids.select("episode_index", F.lit(0.2).alias("from_ts"), F.lit(5.0).alias("to_ts"), F.lit(0.0).alias("low"), F.lit(9.0).alias("high"))
    return trim.clip_to_intervals(rows.select("index", "episode_index", "timestamp"), front.unionByName(top)).select("index", "episode_index")


@query(f"""SELECT idx AS index, row_number() OVER (PARTITION BY ep ORDER BY idx) - 1 AS frame_index FROM ({N}) WHERE rn / 10.0::DOUBLE <= least(3.0 + ep % 4, 5.0) + 0.000001""")
def clip_min_over_keys(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    ids = rows.select("episode_index").distinct()
    limits = ids.select("episode_index", (F.lit(3.0) + F.col("episode_index") % 4).alias("limit")).unionByName(ids.select("episode_index", F.lit(5.0).alias("limit")))
    return trim.clip_to_limit(rows, limits).select("index", keys.frame_index("index").cast("long").alias("frame_index"))


@query(f"""SELECT task, CASE WHEN n_sources = 3 AND n_values <= 1 THEN true ELSE false END AS agrees, n_sources, n_values FROM
(SELECT task, count(DISTINCT ep % 3) AS n_sources, count(DISTINCT top) AS n_values FROM (SELECT task, ep, max(floor(value / 100)) OVER (PARTITION BY task, ep % 3) AS top FROM ({E})) GROUP BY task)""")
def full_outer_prompt_check(spark, sf_dir):
    rows = frames(spark, sf_dir)
    own = {
        f"part{i}": rows.where(F.col("episode_index") % 3 == i).groupBy("task").agg(F.max(F.floor(F.col("value") / 100)).alias("top")) for i in range(3)
    }
    return joins.presence(own, "task", "top")


@query(f"""WITH f AS (SELECT ep % 4 AS dataset, task || '.' || (props->>'$.k') AS field, (floor(max(value) / 100))::BIGINT AS value FROM ({E}) WHERE props->>'$.k' IS NOT NULL GROUP BY 1, 2)
SELECT field, count(DISTINCT dataset) AS n_datasets, count(DISTINCT value) AS n_values, count(DISTINCT dataset) = 4 AND count(DISTINCT value) = 1 AS uniform FROM f GROUP BY field""")
def field_uniformity(spark, sf_dir):
    """Fields named in the notes of events, over four datasets: their largest values by hundreds."""
    rows = frames(spark, sf_dir).withColumn("field", F.concat("task", F.lit("."), F.get_json_object("props", "$.k"))).where("field IS NOT NULL")
    fields = rows.groupBy((F.col("episode_index") % 4).alias("dataset"), "field").agg(F.floor(F.max("value") / 100).alias("value"))
    return report.uniformity(fields, 4)


COUNTS = f"SELECT ep, count(*) AS n, round(avg(value), 6) AS mean FROM ({E}) GROUP BY ep"


@query(f"SELECT a.ep AS episode_index, a.n, a.mean, b.n AS other_n, b.mean AS other_mean FROM ({COUNTS}) a LEFT JOIN ({COUNTS}) b ON b.ep = a.ep + 75")
def self_pair_counts(spark, sf_dir):
    own = r6(frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")
    return joins.pair_with_offset(own, "episode_index", 75, ["n", "mean"])


DIRECTIONS = [("north", [1.0] * 32 + [0.0] * 32), ("south", [0.0] * 32 + [1.0] * 32), ("mixed", [1.0, -1.0] * 32)]


@query(f"""WITH n AS (SELECT unnest(['north', 'south', 'mixed']) AS name, unnest([{', '.join(str(v) + '::DOUBLE[]' for _, v in DIRECTIONS)}]) AS v, unnest([0, 1, 2]) AS i),
s AS (SELECT vec_id, name, list_cosine_similarity(embedding::DOUBLE[], v) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, i) AS k FROM embeddings, n)
SELECT vec_id, name, round(sim, 6) AS similarity FROM s WHERE k = 1""")
def cosine_argmax(spark, sf_dir):
    return r6(joins.nearest_by_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIRECTIONS), "similarity")


@query(f"""SELECT ep AS episode_index, idx AS index, lag(task) OVER w AS left_task, lead(task) OVER w AS right_task FROM ({E}) WINDOW w AS (PARTITION BY ep ORDER BY idx)""")
def neighbour_lookup(spark, sf_dir):
    w = Window.partitionBy("episode_index").orderBy("index")
    return frames(spark, sf_dir).select("episode_index", "index", F.lag("task").over(w).alias("left_task"), F.lead("task").over(w).alias("right_task"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_missing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


# Statistics


@query(f"SELECT ep AS episode_index, {STATS.format(x='value')} FROM ({E}) GROUP BY ep")
def scalar_stats(spark, sf_dir):
    return r6(stats.scalar_stats(frames(spark, sf_dir), "value", ["episode_index"], "index"), *ROUNDED)


@query(f"""SELECT label, dim - 1 AS dim, {STATS.format(x='x')} FROM (SELECT label, unnest(generate_series(1, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""")
def vector_stats(spark, sf_dir):
    return r6(stats.vector_stats(table(spark, sf_dir, "embeddings"), "embedding", ["label"]), *ROUNDED)


@query(f"SELECT {STATS.format(x='value')} FROM ({E})")
def dataset_stats(spark, sf_dir):
    return r6(stats.scalar_stats(frames(spark, sf_dir), "value", []), *ROUNDED)


@query(f"""SELECT ep AS episode_index, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, count(value) AS n, round(avg(value), 6) AS mean,
round(stddev_pop(value), 4) AS std FROM ({E}) GROUP BY ep""")
def moment_stats(spark, sf_dir):
    out = stats.moments(frames(spark, sf_dir), "value", ["episode_index"]).drop("total_sq")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "std": F.round("std", 4)})


@query(f"SELECT ep AS episode_index, min(value) + 5 AS min, max(value) + 5 AS max, round(avg(value) + 5, 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS count FROM ({E}) GROUP BY ep")
def shifted_stats(spark, sf_dir):
    out = stats.shifted(stats.scalar_stats(frames(spark, sf_dir), "value", ["episode_index"], "index"), F.lit(5.0))
    return r6(out.select("episode_index", "min", "max", "mean", "std", "count"), "mean", "std")


@query(f"""WITH c AS (SELECT task, count(*) AS n, min(idx) AS first FROM ({E}) GROUP BY task)
SELECT task, n, round(100.0 * n / sum(n) OVER (), 6) AS percent, row_number() OVER (ORDER BY n DESC, first) AS place FROM c""")
def task_frequency_share(spark, sf_dir):
    return r6(report.prompt_frequency(frames(spark, sf_dir), "task", "index"), "percent")


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'segment' ELSE 'nation' END AS dimension, coalesce(c_mktsegment, n_name) AS value, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name))""")
def grouping_sets_summary(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").join(nation, "c_nationkey")
    out = rows.groupingSets([["c_mktsegment"], ["n_name"]], "c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").alias("g"))
    return out.select(F.when(F.col("g") == 0, "segment").otherwise("nation").alias("dimension"), F.coalesce("c_mktsegment", "n_name").alias("value"), "n")


@query("SELECT count(*) AS n, round(avg(length(p_name)), 6) AS mean, min(length(p_name)) AS low, max(length(p_name)) AS high FROM (SELECT DISTINCT p_name FROM part)")
def prompt_length_stats(spark, sf_dir):
    return r6(report.prompt_lengths(table(spark, sf_dir, "part"), "p_name"), "mean")


@query(r"""WITH d AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || '.' WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '  ') ELSE p_name END AS task FROM part),
k AS (SELECT task, regexp_replace(trim(regexp_replace(lower(task), '\s+', ' ', 'g')), '\.+$', '') AS key FROM d)
SELECT key, count(*) AS n, list_sort(list(task)) AS spellings FROM k GROUP BY key HAVING count(*) > 1""")
def near_duplicates(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    task = F.when(k == 0, F.concat(F.upper(name), F.lit("."))).when(k == 1, F.replace(name, F.lit(" "), F.lit("  "))).otherwise(name)
    return report.near_duplicate_groups(table(spark, sf_dir, "part").select(task.alias("task")), "task")


OUTCOMES = "SELECT d.lang AS class, l.quality = 1 AS hit, l.toxic = 1 AS lost FROM documents d JOIN labels l USING (doc_id)"


@query(f"""WITH o AS ({OUTCOMES}), c AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS class),
e AS (SELECT c.class, count(o.hit) AS total, count(*) FILTER (o.hit) AS correct, count(*) FILTER (o.lost) AS unparseable FROM c LEFT JOIN o USING (class) GROUP BY 1),
a AS (SELECT * FROM e UNION ALL SELECT NULL, sum(total)::BIGINT, sum(correct)::BIGINT, sum(unparseable)::BIGINT FROM e)
SELECT *, CASE WHEN total > 0 THEN round(correct / total, 6) ELSE 0.0 END AS accuracy FROM a""")
def accuracy_by_class(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("lost"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id")
    return r6(report.outcome_accuracy(rows, "lang", ["de", "en", "es", "fr", "it"]), "accuracy")


@query(f"SELECT ep AS episode_index, count(DISTINCT task) AS n_tasks, count(DISTINCT task) = 1 AS single, list_sort(list(DISTINCT task)) AS tasks FROM ({E}) GROUP BY ep")
def singleton_tasks(spark, sf_dir):
    out = frames(spark, sf_dir).groupBy("episode_index").agg(F.count_distinct("task").alias("n_tasks"), F.array_sort(F.collect_set("task")).alias("tasks"))
    return out.select("episode_index", "n_tasks", (F.col("n_tasks") == 1).alias("single"), "tasks")


@query(f"""SELECT ep AS episode_index, count(*) AS n_stale FROM ({N}) JOIN (SELECT ep, arg_min(task, idx) AS truth FROM ({E}) GROUP BY ep) USING (ep) WHERE task <> truth GROUP BY ep""")
def stale_tasks(spark, sf_dir):
    rows = frames(spark, sf_dir)
    truth = rows.groupBy("episode_index").agg(F.min_by("task", "index").alias("truth"))
    return rows.join(truth, "episode_index").where("task <> truth").groupBy("episode_index").agg(F.count("*").alias("n_stale"))


@query("SELECT l_orderkey AS duplicate_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return checks.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT unnest(generate_series(0, (SELECT max(l_orderkey) FROM lineitem))) AS missing_id EXCEPT SELECT l_orderkey FROM lineitem")
def missing_ids(spark, sf_dir):
    return checks.missing_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT count(*) - count(DISTINCT text) AS n_repeated, count(*) AS n, count(DISTINCT text) AS n_distinct FROM documents")
def row_key_counts(spark, sf_dir):
    out = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"))
    return out.withColumn("n_repeated", F.col("n") - F.col("n_distinct"))


@query("SELECT p_size AS k, sum(p_size * p_partkey)::BIGINT AS products FROM part GROUP BY 1")
def sum_of_products(spark, sf_dir):
    shape = F.array(F.col("p_size").cast("long"), F.col("p_partkey"))
    product = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.sum(product).alias("products"))


# Windows and trimming


@query(f"SELECT idx AS index, round(v, 6) AS velocity FROM ({VELOCITY})")
def velocity(spark, sf_dir):
    return r6(trim.velocity(frames(spark, sf_dir), "value").select("index", "velocity"), "velocity")


@query("""SELECT vec_id, round(coalesce(list_distance(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 0.0), 6) AS velocity FROM embeddings""")
def vector_velocity(spark, sf_dir):
    return r6(trim.velocity(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label").select("vec_id", "velocity"), "velocity")


BOUNDS = f"""WITH m AS (SELECT ep, max(n) AS n, min(rn) FILTER (v > 50) AS f, max(rn) FILTER (v > 50) AS l FROM ({VELOCITY}) GROUP BY ep),
a AS (SELECT ep, n, coalesce(f, n) AS lead, coalesce(n - 1 - l, n) AS trail FROM m),
b AS (SELECT *, least(lead + trail, greatest(0, lead + trail - (n - 50))) AS e, abs(lead - trail) AS d FROM a),
c AS (SELECT ep, n, CASE WHEN n <= 50 THEN 0 WHEN e <= d THEN CASE WHEN lead > trail THEN lead - e ELSE lead END ELSE least(lead, trail) - (e - d) // 2 END::BIGINT AS lead,
  CASE WHEN n <= 50 THEN 0 WHEN e <= d THEN CASE WHEN lead > trail THEN trail ELSE trail - e END ELSE least(lead, trail) - (e - d + 1) // 2 END::BIGINT AS trail FROM b)"""


@query(f"{BOUNDS} SELECT ep AS episode_index, n, lead, trail FROM c")
def frozen_bounds(spark, sf_dir):
    return trim.frozen_bounds(frames(spark, sf_dir), "value", threshold=50)


TRIMMED = f"""{BOUNDS}, t AS (SELECT x.ep, x.idx, x.value, row_number() OVER (PARTITION BY x.ep ORDER BY x.idx) - 1 AS frame_index, c.lead, c.trail
  FROM ({N}) x JOIN c USING (ep) WHERE x.rn >= c.lead AND x.rn < c.n - c.trail)"""


@query(f"""{TRIMMED}, s AS (SELECT ep, max(lead) AS lead, max(trail) AS trail, count(*) AS kept, avg(value) AS mean, stddev_pop(value) AS std FROM t GROUP BY ep)
SELECT ep AS episode_index, lead, trail, kept, row_number() OVER (ORDER BY ep) - 1 AS new_episode, (sum(kept) OVER (ORDER BY ep) - kept)::BIGINT AS dataset_from_index,
round(mean, 6) AS mean, round(std, 6) AS std FROM s""")
def trim_frozen(spark, sf_dir):
    rows = frames(spark, sf_dir)
    bounds = trim.frozen_bounds(rows, "value", threshold=50)
    left = trim.cut_ends(rows, bounds)
    own = left.groupBy("episode_index").agg(F.count("*").alias("kept"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    own = keys.prefixes(own, "episode_index", {"new_episode": F.lit(1).cast("long"), "dataset_from_index": F.col("kept")})
    return r6(own.join(bounds.drop("n"), "episode_index"), "mean", "std")


@query(f"""{TRIMMED} SELECT count(DISTINCT t.ep) AS episodes, count(*) AS kept_frames, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS kept_percent,
(SELECT count(*) FILTER (lead + trail > 0) FROM c) AS trimmed_episodes, (SELECT round(avg(lead), 6) FROM c) AS mean_lead FROM t""")
def trim_summary(spark, sf_dir):
    bounds = trim.frozen_bounds(frames(spark, sf_dir), "value", threshold=50)
    kept = F.col("n") - F.col("lead") - F.col("trail")
    return r6(
        bounds.agg(
            F.count_if(kept > 0).alias("episodes"), F.sum(kept).alias("kept_frames"), (100.0 * F.sum(kept) / F.sum("n")).alias("kept_percent"),
            F.count_if(F.col("lead") + F.col("trail") > 0).alias("trimmed_episodes"), F.avg("lead").alias("mean_lead"),
        ), "kept_percent", "mean_lead",
    )


RUNS = "SELECT ep, min(s) AS run_start FROM (SELECT ep, isl, min(rn) AS s, count(*) AS c FROM (SELECT *, sum((NOT flag)::INT) OVER (PARTITION BY ep ORDER BY rn) AS isl FROM ({x})) WHERE flag GROUP BY 1, 2) WHERE c >= 5 GROUP BY ep"


@query(f"SELECT ep AS episode_index, run_start FROM ({RUNS.format(x=f'SELECT *, value >= 20 AS flag FROM ({N})')})")
def first_stable_run(spark, sf_dir):
    return trim.first_run(numbered(spark, sf_dir), F.col("value") >= 20, 5).select("episode_index", F.col("run_start").cast("long").alias("run_start"))


@query(f"""WITH x AS ({N}), l AS (SELECT ep, max(n) AS n, quantile_cont(value, 0.5) FILTER (rn < greatest(3, least(10, n // 10))) AS early, min(value) AS low, max(value) AS high FROM x GROUP BY ep),
t AS (SELECT *, high - early >= early - low AS up, CASE WHEN high - early >= early - low THEN early + 0.45 * greatest(high - low, 0.000001) ELSE early - 0.45 * greatest(high - low, 0.000001) END AS threshold FROM l),
r AS ({RUNS.format(x='SELECT x.*, CASE WHEN t.up THEN x.value >= t.threshold ELSE x.value <= t.threshold END AS flag FROM x JOIN t USING (ep)')})
SELECT ep AS episode_index, n, round(early, 6) AS early, round(threshold, 6) AS threshold, up, run_start,
CASE WHEN n <= 20 THEN 0 ELSE greatest(0, least(coalesce(run_start + 8, round_even(n * 0.35::DOUBLE, 0)::BIGINT), n - 20)) END::BIGINT AS trim_start FROM t LEFT JOIN r USING (ep)""")
def post_grasp_plan(spark, sf_dir):
    out = trim.closing_plan(frames(spark, sf_dir), "value")
    return r6(out.withColumn("run_start", F.col("run_start").cast("long")), "early", "threshold")


DOWN = f"""SELECT ep, max(n) AS n, list_distinct(list_transform(generate_series(0, greatest(1, ceil(((max(n) - 1) / 10.0::DOUBLE + (1 / 3.0::DOUBLE) / 2) / (1 / 3.0::DOUBLE))::BIGINT) - 1),
lambda i: least(max(n) - 1, greatest(0, round_even((i * (1 / 3.0::DOUBLE)) * 10.0::DOUBLE, 0)))::INT)) AS kept FROM ({N}) GROUP BY ep"""


@query(f"SELECT ep AS episode_index, n, list_sort(kept) AS kept FROM ({DOWN})")
def downsample_indices(spark, sf_dir):
    lengths = frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("n"))
    return lengths.select("episode_index", "n", trim.kept_indices(F.col("n"), 10.0, 3.0).alias("kept"))


@query(f"""WITH k AS (SELECT ep, unnest(kept) AS rn FROM ({DOWN})) SELECT x.idx AS index, (row_number() OVER (PARTITION BY x.ep ORDER BY x.rn) - 1)::INT AS new_frame,
round((row_number() OVER (PARTITION BY x.ep ORDER BY x.rn) - 1) / 3.0::DOUBLE, 4) AS new_timestamp FROM ({N}) x JOIN k ON x.ep = k.ep AND x.rn = k.rn""")
def downsample_frames(spark, sf_dir):
    out = trim.downsample(frames(spark, sf_dir), 10.0, 3.0)
    return out.select("index", "new_frame", F.round(F.col("new_timestamp").cast("double"), 4).alias("new_timestamp"))


@query(f"""SELECT ep AS episode_index, file, round(coalesce(sum(n / 10.0::DOUBLE) OVER (PARTITION BY file ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS from_timestamp,
round(sum(n / 10.0::DOUBLE) OVER (PARTITION BY file ORDER BY ep ROWS UNBOUNDED PRECEDING), 6) AS to_timestamp FROM (SELECT ep, ep // 10 AS file, count(*) AS n FROM ({E}) GROUP BY 1, 2)""")
def video_prefix_ts(spark, sf_dir):
    own = frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("n")).withColumn("file", F.floor(F.col("episode_index") / 10))
    w = Window.partitionBy("file").orderBy("episode_index")
    seconds = F.col("n") / 10
    before = F.coalesce(F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r6(own.select("episode_index", "file", before.alias("from_timestamp"), upto.alias("to_timestamp")), "from_timestamp", "to_timestamp")


@query("SELECT max(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return trim.deduplicate(rows, "key", [F.col("doc_id").desc()])


DUP = f"SELECT ep, n, CASE WHEN k = 1 AND ep % 2 = 0 THEN n + 1 WHEN k = 2 AND ep % 3 = 0 THEN n - 1 ELSE n END AS length, k FROM (SELECT ep, count(*) AS n, unnest([1, 2, 3]) AS k FROM ({E}) GROUP BY ep)"


def duplicated(spark, sf_dir) -> DataFrame:
    """Episode rows three times over, of which some state a wrong length."""
    own = frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("n"))
    rows = own.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    wrong = F.when((F.col("k") == 1) & (F.col("episode_index") % 2 == 0), F.col("n") + 1).when((F.col("k") == 2) & (F.col("episode_index") % 3 == 0), F.col("n") - 1)
    return rows.withColumn("length", F.coalesce(wrong, F.col("n")))


@query(f"SELECT ep AS episode_index, length, k FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY (length = n) DESC, k) AS r FROM ({DUP})) WHERE r = 1")
def dedup_keep_match(spark, sf_dir):
    return trim.deduplicate(duplicated(spark, sf_dir), "episode_index", [(F.col("length") == F.col("n")).desc(), F.col("k")]).drop("n")


@query(f"SELECT ep AS episode_index, least(length, n) AS valid, k FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY least(length, n) DESC, (length = n) DESC, abs(length - n), k DESC) AS r FROM ({DUP})) WHERE r = 1")
def dedup_best_score(spark, sf_dir):
    rows = duplicated(spark, sf_dir).withColumn("valid", F.least("length", "n"))
    order = [F.col("valid").desc(), (F.col("length") == F.col("n")).desc(), F.abs(F.col("length") - F.col("n")), F.col("k").desc()]
    return trim.deduplicate(rows, "episode_index", order).select("episode_index", "valid", "k")


@query(f"""WITH x AS (SELECT ep, idx, rn / 10.0::DOUBLE AS t FROM ({N}) WHERE rn >= ep % 4)
SELECT idx AS index, round(CASE WHEN abs(min(t) OVER (PARTITION BY ep)) > 0.0001 THEN min(t) OVER (PARTITION BY ep) ELSE 0.0 END, 6) AS shift,
round(t - CASE WHEN abs(min(t) OVER (PARTITION BY ep)) > 0.0001 THEN min(t) OVER (PARTITION BY ep) ELSE 0.0 END, 6) AS timestamp FROM x""")
def rebase_timestamps(spark, sf_dir):
    rows = numbered(spark, sf_dir).where(F.col("rn") >= F.col("episode_index") % 4)
    return r6(trim.rebase(rows).select("index", "shift", "timestamp"), "shift", "timestamp")


@query(f"SELECT ep AS episode_index, floor((row_number() OVER (ORDER BY ep) - 1) * 4 / count(*) OVER ())::BIGINT AS slice FROM (SELECT DISTINCT ep FROM ({E}))")
def contiguous_partition(spark, sf_dir):
    ids = frames(spark, sf_dir).select("episode_index").distinct()
    total = F.broadcast(ids.agg(F.count("*").alias("total")))
    rows = keys.prefix(ids, "episode_index", F.lit(1).cast("long"), "place").crossJoin(total)
    return rows.select("episode_index", F.floor(F.col("place") * 4 / F.col("total")).alias("slice"))


@query(f"SELECT ep AS episode_index, idx AS index, list_extract(['a', 'b', 'c', 'd'], ((row_number() OVER (PARTITION BY task ORDER BY idx) - 1) % 4 + 1)::INT) AS variant FROM ({E})")
def rotating_variants(spark, sf_dir):
    rows = keys.positions(frames(spark, sf_dir), F.floor(F.col("index") / keys.BUCKET), ["index"], "turn", ["task"])
    turn = (F.col("turn") % 4).cast("int")
    return rows.select("episode_index", "index", F.get(F.array(*map(F.lit, "abcd")), turn).alias("variant"))


# Sampling

DRAW = "concat('0x', substr(md5(concat('42:', {k})), 1, 8))::BIGINT"


@query(f"SELECT ep AS episode_index FROM (SELECT ep, row_number() OVER (ORDER BY md5(concat('42:', ep)), ep) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ep FROM ({E}))) WHERE r <= round_even(n * 0.3::DOUBLE, 0)")
def seeded_sample(spark, sf_dir):
    return sample.fraction(frames(spark, sf_dir).select("episode_index").distinct(), "episode_index", 0.3, 42)


@query(f"SELECT ep AS episode_index, ([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2])[{DRAW.format(k='ep')} % 8 + 1]::DOUBLE AS level, round({DRAW.format(k='ep')} / 4294967296.0::DOUBLE, 6) AS u FROM (SELECT DISTINCT ep FROM ({E}))")
def seeded_choice(spark, sf_dir):
    key = F.col("episode_index")
    levels = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]
    rows = frames(spark, sf_dir).select("episode_index").distinct()
    return r6(rows.select("episode_index", sample.choice(key, 42, levels).alias("level"), sample.uniform(key, 42).alias("u")), "u")


@query(f"SELECT ep AS episode_index, (['x', 'y', 'z'])[(row_number() OVER (ORDER BY md5(concat('42:', ep)), ep) - 1) % 3 + 1] AS value FROM (SELECT DISTINCT ep FROM ({E}))")
def balanced_queue(spark, sf_dir):
    return sample.balanced(frames(spark, sf_dir).select("episode_index").distinct(), "episode_index", ["x", "y", "z"], 42)


@query(f"SELECT idx AS index FROM ({N}) WHERE rn % greatest(1, n // 7) = 0")
def stride_sample(spark, sf_dir):
    rows = numbered(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("episode_index")))
    return rows.where(sample.stride(F.col("rn"), F.col("n"), 7)).select("index")


@query(f"SELECT ep AS episode_index, list_sort(list_distinct(list_transform([0, 1, 2, 3, 4], lambda i: (i * (count(*) - 1)) // 4))) AS picks FROM ({E}) GROUP BY ep")
def linspace_sample(spark, sf_dir):
    own = frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("n"))
    return own.select("episode_index", sample.linspace(F.col("n")).alias("picks"))


@query("SELECT s_suppkey, i AS step, round(s_acctbal + (1000 - s_acctbal) * i / 4.0::DOUBLE, 6) AS pose FROM supplier, generate_series(1, 4) t(i)")
def interpolate_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"))
    pose = F.col("s_acctbal") + (1000 - F.col("s_acctbal")) * F.col("step") / 4.0
    return rows.select("s_suppkey", F.col("step").cast("long").alias("step"), F.round(pose, 6).alias("pose"))


@query(f"SELECT a.r_name AS a, b.r_name AS b, c.r_name AS c, d.r_name AS d FROM region a, region b, region c, region d WHERE a.r_name < b.r_name AND b.r_name < c.r_name AND c.r_name < d.r_name")
def four_combinations(spark, sf_dir):
    return sample.combinations(table(spark, sf_dir, "region"), "r_name", "abcd")


# Text

def _sub(text: str, position: int, color: str) -> str:
    pattern = X.ordinal_pattern(position).removeprefix("(?i)")
    return f"regexp_replace({text}, '{pattern}', 'in the {color} colored bowl', 'gi')"


@query(f"SELECT p_partkey, {_sub(_sub(_sub('task', 0, 'green'), 1, 'red'), 2, 'blue')} AS task FROM ({PROMPTS})")
def relabel_ordinal_color(spark, sf_dir):
    colors = [F.lit(c) for c in ("green", "red", "blue")]
    return prompts(spark, sf_dir).select("p_partkey", X.ordinal_to_color(F.col("task"), colors).alias("task"))


_DIGIT = r"regexp_extract(task, '^Put the (.+?) into the ([1-3])', 2)::INT"


@query(f"SELECT p_partkey, 'Put the ' || noun || ' into the bowl on the ' || (['left', 'center', 'right'])[{_DIGIT}] || ' from the robot perspective' AS task FROM ({PROMPTS})")
def relabel_position(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", X.ordinal_to_position(F.col("task")).alias("task"))


@query(f"SELECT p_partkey, 'Put the ' || noun || ' into the ' || (['3rd', '2nd', '1st'])[{_DIGIT}] || ' bowl from the right from the robot perspective' AS task FROM ({PROMPTS})")
def relabel_right_ordinal(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", X.ordinal_from_right(F.col("task")).alias("task"))


@query(f"""SELECT p_partkey, CASE adj WHEN 'red' THEN 'Put the ' || noun || ' into the bowl that is not green and not blue.' WHEN 'green' THEN 'Put the ' || noun || ' into the bowl that is not red and not blue.'
WHEN 'blue' THEN 'Put the ' || noun || ' into the bowl that is not red and not green.' ELSE color_task END AS task FROM ({PROMPTS})""")
def relabel_negation(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", X.negated(F.col("color_task")).alias("task"))


_SAID = "'Put the ' || noun || ' into the bowl on the {side} of the {color} bowl from the robot perspective'"


@query(f"""SELECT p_partkey, unnest(CASE {_DIGIT} WHEN 1 THEN [{_SAID.format(side='left', color='red')}] WHEN 3 THEN [{_SAID.format(side='right', color='red')}]
ELSE [{_SAID.format(side='right', color='green')}, {_SAID.format(side='left', color='blue')}] END) AS task FROM ({PROMPTS})""")
def expand_relative(spark, sf_dir):
    rows = prompts(spark, sf_dir)
    colors = F.array(*map(F.lit, ("green", "red", "blue")))
    return rows.select("p_partkey", F.explode(X.relative_prompts(F.col("noun"), X.ordinal_position(F.col("task")), colors)).alias("task"))


@query(f"SELECT p_partkey, CASE WHEN adj IN ('red', 'green', 'blue') THEN adj END AS color, noun AS object FROM ({PROMPTS})")
def color_object_extract(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", X.detect_color(F.col("color_task")).alias("color"), X.extract_object(F.col("color_task")).alias("object"))


_FILLED = ", ".join("'" + t.replace("{obj}", "' || noun || '").replace("{color}", "' || adj || '") + "'" for t in X.TEMPLATES)


@query(f"SELECT p_partkey, unnest(CASE WHEN adj IN ('red', 'green', 'blue') THEN [{_FILLED}] ELSE [color_task] END) AS variant FROM ({PROMPTS})")
def templates(spark, sf_dir):
    rows = prompts(spark, sf_dir)
    own = X.variants(F.col("color_task"), X.detect_color(F.col("color_task")), X.extract_object(F.col("color_task")))
    return rows.select("p_partkey", F.explode(own).alias("variant"))


ANSWER = "CASE event_id % 5 WHEN 0 THEN 'top_left' WHEN 1 THEN 'Top-Right.' WHEN 2 THEN ' it is bottom left ' WHEN 3 THEN 'dunno' ELSE 'BOTTOM RIGHT' END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'top_left' WHEN 1 THEN 'top_right' WHEN 2 THEN 'bottom_left' WHEN 3 THEN NULL ELSE 'bottom_right' END AS answer FROM events")
def answer_normalise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.normalise_answer(F.expr(ANSWER)).alias("answer"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'pump') THEN 'Pump' WHEN contains(lower(p_name), 'gear') THEN 'GEAR' WHEN contains(lower(p_name), 'e') THEN 'e' END AS hit FROM part")
def contains_lookup(spark, sf_dir):
    names = F.array(F.lit("Pump"), F.lit("GEAR"), F.lit("e"))
    return table(spark, sf_dir, "part").select("p_partkey", X.first_contained(F.col("p_name"), names).alias("hit"))


@query(r"""SELECT page_id, replace(lower(translate(split_part(url, '/', 3), '.''', '')), ' ', '_') AS slug, CASE WHEN length(url) > 20 THEN substr(url, 1, 19) || '…' ELSE url END AS short,
regexp_extract(url, '([^/]*)$', 1) AS last, lpad(page_id::VARCHAR, 6, '0') AS padded FROM pages""")
def slug_trunc_path(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        X.slug(F.split_part(url, F.lit("/"), F.lit(3))).alias("slug"),
        X.truncated(url, 20).alias("short"),
        F.element_at(F.split(url, "/"), -1).alias("last"),
        F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"),
    )


@query("SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'missing')::BIGINT, -1) AS missing FROM events")
def json_cells(spark, sf_dir):
    cell = F.from_json("props", "k long, missing long")
    return table(spark, sf_dir, "events").select("event_id", cell["k"].alias("k"), F.coalesce(cell["missing"], F.lit(-1).cast("long")).alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS gripper FROM part")
def gripper_index(spark, sf_dir):
    names = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("Gripper.pos"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return table(spark, sf_dir, "part").select("p_partkey", V.name_index(names, "gripper").alias("gripper"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['red', 'green', 'blue'] END AS colors FROM part""")
def config_parse(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, "some/place/config4-Red-green-blue/").otherwise("other-red-green-blue")
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_config(name).alias("colors"))


@query(r"SELECT p_partkey, regexp_matches(task, '\b(?:1st|1nd|1rd|1th|first|2nd|2st|2rd|2th|second|3rd|3st|3nd|3th|third)\b.*?bowl', 'i') AS ordinal, contains(lower(color_task), 'red colored bowl') AS red FROM (" + PROMPTS + ")")
def ordinal_detect(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", X.has_ordinal(F.col("task")).alias("ordinal"), F.lower("color_task").contains("red colored bowl").alias("red"))


@query("SELECT event_id, round_even(value, 0) AS whole, greatest(10.0, least(value, 100.0)) AS clamped, event_id // 7 AS chunk, event_id % 7 AS rest FROM events")
def round_half_even(spark, sf_dir):
    x, i = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.rint(x).alias("whole"), V.clamp(x, 10.0, 100.0).alias("clamped"), F.floor(i / 7).alias("chunk"), F.pmod(i, F.lit(7)).alias("rest"))


_RGB = "SELECT event_id, (event_id * 7 % 256) / 255.0::DOUBLE AS r, (event_id * 13 % 256) / 255.0::DOUBLE AS g, (event_id * 29 % 256) / 255.0::DOUBLE AS b FROM events"


@query(f"""WITH c AS ({_RGB}), m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM c),
h AS (SELECT event_id, CASE WHEN span = 0 THEN 0.0 WHEN hi = r THEN 60 * ((((g - b) / span) % 6.0 + 6.0) % 6.0) WHEN hi = g THEN 60 * ((b - r) / span + 2) ELSE 60 * ((r - g) / span + 4) END AS hue FROM m)
SELECT event_id, round(hue, 6) AS hue, round(least(abs(hue - 30), 360 - abs(hue - 30)), 6) AS gap FROM h""")
def hue_math(spark, sf_dir):
    i = F.col("event_id")
    rgb = [(i * k % 256) / 255.0 for k in (7, 13, 29)]
    rows = table(spark, sf_dir, "events").select("event_id", V.hue(*rgb).alias("hue"))
    return r6(rows.withColumn("gap", V.circular_difference(F.col("hue"), F.lit(30.0))), "hue", "gap")


_BOX = "SELECT event_id AS id, user_id, (event_id * 37 % 100)::DOUBLE AS x, (event_id * 53 % 100)::DOUBLE AS y, (20 + event_id % 30)::DOUBLE AS w, (20 + event_id % 17)::DOUBLE AS h FROM events"


def boxes(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    own = [(i * 37 % 100).alias("x"), (i * 53 % 100).alias("y"), (20 + i % 30).alias("w"), (20 + i % 17).alias("h")]
    return table(spark, sf_dir, "events").select(i.alias("id"), "user_id", *[c.cast("double").alias(n) for c, n in zip(own, "xywh", strict=True)])


@query(f"""WITH b AS ({_BOX}), p AS (SELECT a.id, b.id AS other, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i,
a.w * a.h + b.w * b.h AS s FROM b a JOIN b ON a.user_id = b.user_id AND a.id < b.id) SELECT id, other, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.35""")
def iou_pairs(spark, sf_dir):
    return r6(joins.overlapping_boxes(boxes(spark, sf_dir), "user_id").select("id", "other", "iou"), "iou")


_OVER = "(greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)))"


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w * h DESC, id) AS r FROM ({_BOX})),
g(user_id, r, kept) AS (SELECT user_id, r, [{{'id': id, 'x': x, 'y': y, 'w': w, 'h': h}}] FROM b WHERE r = 1 UNION ALL
SELECT b.user_id, b.r, CASE WHEN len(list_filter(g.kept, lambda k: {_OVER} / (k.w * k.h + b.w * b.h - {_OVER}) >= 0.35)) > 0 THEN g.kept
ELSE list_append(g.kept, {{'id': b.id, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END FROM g JOIN b ON b.user_id = g.user_id AND b.r = g.r + 1),
e AS (SELECT user_id, unnest(arg_max(kept, r)) AS k FROM g GROUP BY user_id) SELECT user_id, k.id AS id, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM e""")
def greedy_box_dedup(spark, sf_dir):
    return greedy.boxes(boxes(spark, sf_dir), "user_id", Scratch(spark))


# Plans and validators


LAYOUTS = ", ".join(f"({i}, '{name}', {list(own)})" for i, (name, *own) in enumerate(trials.CONFIGS))
#: Targets of all layouts for all suppliers; k is the place from the left, from 1.
_TARGETS = f"""SELECT s_name AS object, config, name, k, b[k] AS color, CASE WHEN k > 1 THEN b[k - 1] END AS l, CASE WHEN k < 3 THEN b[k + 1] END AS r
  FROM (VALUES {LAYOUTS}) c(config, name, b), (SELECT unnest([1, 2, 3]) AS k), supplier"""
_NEGATION = " ".join(f"WHEN '{color}' THEN '{text}'" for color, text in trials.NEGATIONS.items())


@query(f"""WITH t AS ({_TARGETS}), p AS (
SELECT object, 'color' AS family, replace(unnest({trials.COLOR_WORDINGS}), '{{color}}', color) AS prompt FROM t
UNION ALL SELECT object, 'negation', CASE color {_NEGATION} END FROM t
UNION ALL SELECT object, 'ordinal', 'Put the banana into the ' || unnest(({trials.ORDINAL_WORDINGS})[k]) || ' from the robot perspective.' FROM t
UNION ALL SELECT object, 'relative', 'Put the banana into the bowl on the right of the ' || l || ' bowl from the robot perspective.' FROM t WHERE k > 1
UNION ALL SELECT object, 'relative', 'Put the banana into the bowl on the left of the ' || r || ' bowl from the robot perspective.' FROM t WHERE k < 3
UNION ALL SELECT object, 'between', 'Put the banana into the bowl between the ' || CASE WHEN 'blue' IN (l, r) THEN 'blue' ELSE 'red' END || ' bowl and the ' ||
  CASE WHEN 'green' IN (l, r) THEN 'green' ELSE 'red' END || ' bowl.' FROM t WHERE k = 2)
SELECT object, family, count(*) AS n, md5(string_agg(replace(prompt, 'banana', object), '|' ORDER BY prompt)) AS prompts FROM p GROUP BY 1, 2""")
def plan_sizes(spark, sf_dir):
    """The full plan for each supplier's name as the object; a family's prompts, of which there are 72 at most, as a digest."""
    rows = trials.full(spark, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("object")))
    prompts = F.md5(F.array_join(F.array_sort(F.collect_list("prompt")), "|"))
    return rows.groupBy("object", F.col("prompt_family").alias("family")).agg(F.count("*").alias("n"), prompts.alias("prompts"))


_CHOSEN = ", ".join(f"({c}, {s}, {t + 1})" for c, own in enumerate(trials.COMPACT_TARGETS) for s, t in enumerate(own))


@query(f"""WITH t AS ({_TARGETS}), p AS (SELECT t.*, CASE slot WHEN 0 THEN 'color' WHEN 1 THEN 'color' WHEN 2 THEN 'negation' WHEN 3 THEN 'ordinal' ELSE CASE WHEN k = 2 THEN 'between' ELSE 'relative' END END AS family
  FROM t JOIN (VALUES {_CHOSEN}) c(config, slot, k) USING (config, k))
SELECT 'config_name' AS dimension, name AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'prompt_family', family, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'target_color', color, count(*) FROM p GROUP BY 2""")
def cross_plan(spark, sf_dir):
    """The compact plan for each supplier's name, counted."""
    objects = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("object"))
    return trials.summary(trials.plan(spark, "compact30", seed=None, objects=objects))


CONVERSATIONS = """WITH e AS (SELECT conv_id, count(*) AS n, min(turn) AS f0, max(turn) AS f1, count(DISTINCT turn) AS fn FROM conversations GROUP BY 1)"""


@query(f"{CONVERSATIONS} SELECT conv_id, n, f0 = 0 AND f1 = n - 1 AND fn = n AS valid FROM e")
def validate_dataset(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min("turn").alias("f0"), F.max("turn").alias("f1"), F.count_distinct("turn").alias("fn")
    )
    return own.select("conv_id", "n", ((F.col("f0") == 0) & (F.col("f1") == F.col("n") - 1) & (F.col("fn") == F.col("n"))).alias("valid"))


def damaged(spark, sf_dir):
    """The merged dataset with faults: no frames in episode 5, every 13th frame of episode 7 without a known prompt, and
    wrong lengths of every 10th episode."""
    ds = tagged(spark, sf_dir)
    unknown = F.when((F.col("episode_index") == 7) & (F.col("frame_index") % 13 == 0), F.lit(99).cast("long")).otherwise(F.col("task_index"))
    rows = ds.frames.where("episode_index <> 5").withColumn("task_index", unknown)
    wrong = F.when(F.col("episode_index") % 10 == 0, F.col("length") + 1).otherwise(F.col("length"))
    return type(ds)(rows, ds.episodes.withColumn("length", wrong), ds.tasks, ds.info)


#: What the faults above must show: ids of frames after the missing ones no longer follow each other.
DAMAGE = f"""WITH e AS (SELECT episode_index, length AS n, start FROM ({MERGED_EP}))
SELECT 'episode_without_frames' AS "check", episode_index, n::VARCHAR AS detail FROM e WHERE episode_index = 5
UNION ALL SELECT 'length', episode_index, n::VARCHAR FROM e WHERE episode_index % 10 = 0
UNION ALL SELECT 'unknown_task', 7, '99' FROM e WHERE episode_index = 7
UNION ALL SELECT 'frame_ids', episode_index, start::VARCHAR FROM e WHERE episode_index > 5"""


@query(DAMAGE)
def validation_report(spark, sf_dir):
    return checks.violations(damaged(spark, sf_dir))


@query("SELECT 'x' AS \"check\", 0::BIGINT AS episode_index, '' AS detail WHERE false")
def validation_of_merged(spark, sf_dir):
    return checks.violations(tagged(spark, sf_dir))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, min(event_id) AS low, max(event_id) AS high, count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AS dense FROM events")
def dense_id_check(spark, sf_dir):
    return checks.dense_ids(table(spark, sf_dir, "events"), "event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_task_counts(spark, sf_dir):
    from .streaming import counts

    return counts.counted(table(spark, sf_dir, "events"), f"{Scratch(spark).at}/counts", 2)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_moments(spark, sf_dir):
    from .streaming import counts

    rows = counts.counted(table(spark, sf_dir, "events"), f"{Scratch(spark).at}/windows", 2, groups=counts.windowed, keys=["start", "end", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    from .streaming import counts

    rows = counts.closed_sessions(table(spark, sf_dir, "events"), f"{Scratch(spark).at}/sessions", 2)
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


#: Days on which the recorder of `recorded_episodes` is stopped and started again.
STOPS = ("2024-02-10", "2024-03-20")


@query(f"""WITH p AS (SELECT *, (arrived_at >= TIMESTAMP '{STOPS[0]}')::INT + (arrived_at >= TIMESTAMP '{STOPS[1]}')::INT AS part FROM clicks
  WHERE client_id IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL AND arrived_at IS NOT NULL),
h AS (SELECT later AS part, max(ts) - INTERVAL 1 HOUR AS horizon FROM p JOIN (SELECT unnest([1, 2]) AS later) ON part < later GROUP BY 1),
d AS (SELECT DISTINCT client_id, click_id, ts, kind, value FROM p LEFT JOIN h USING (part) WHERE horizon IS NULL OR ts >= horizon),
o AS (SELECT *, coalesce(kind IN ('purchase', 'error'), false) AS control, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS rn FROM d),
a AS (SELECT *, min(CASE WHEN control THEN rn END) OVER (PARTITION BY client_id ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS stop FROM o)
SELECT f.client_id, s.click_id AS episode, row_number() OVER (PARTITION BY f.client_id, f.stop ORDER BY f.rn) - 1 AS frame_index, f.click_id, f.value
FROM a f JOIN o s ON s.client_id = f.client_id AND s.rn = f.stop WHERE NOT f.control AND s.kind = 'purchase'""")
def recorded_episodes(spark, sf_dir):
    """Clicks of a client as frames in the order of arrival: a purchase saves what came before it, an error drops it.
    Clicks more than an hour late when the recorder starts again are lost."""
    from .streaming import episodes, tables

    rows = table(spark, sf_dir, "clicks").where("arrived_at IS NOT NULL").select("client_id", "click_id", "ts", "kind", "value", "arrived_at")
    part = sum((F.col("arrived_at") >= F.lit(day).cast("timestamp_ntz")).cast("int") for day in STOPS)
    recorder = episodes.Recorder(rows.drop("arrived_at").schema, "client_id", "ts", "click_id", "kind", "purchase", "error")
    done = tables.replayed(rows, f"{Scratch(spark).at}/recording", part, len(STOPS) + 1, recorder)
    recorder.close(done)
    return recorder.read(done).select("client_id", "episode", "frame_index", "click_id", "value")


from . import dataset_queries as _more  # noqa: E402, F401  (its queries register themselves)
from . import media_queries as _media  # noqa: E402, F401
