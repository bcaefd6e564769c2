"""Every operator as a query over the shared tables, and its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import models, scalars, texts
from gaugeline.operators import catalog, mixture, sampling, series, thresholds, timeline, vectors
from gaugeline.plans import displays, tasks, vision
from gaugeline.sources import messages, results, shared

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in the last bits; adding zero makes -0.0 plain."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


# Recordings: a user's events are a run, times are seconds from its first event.

EV = """ev AS (
  SELECT user_id AS run_id, event_id AS seq, event_type, value,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time FROM events
)"""
MARK = "CASE event_type WHEN 'signup' THEN '1' WHEN 'view' THEN '2' WHEN 'purchase' THEN '3' ELSE 'Error' END"


def events(spark: SparkSession, d: str) -> DataFrame:
    us = scalars.micros(F.col("ts"))
    zero = F.min("us").over(W.partitionBy("run_id"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value", us.alias("us"))
    return rows.withColumn("time", (F.col("us") - zero) / F.lit(1e6)).drop("us")


def marked(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    mark = F.when(kind == "signup", " 1 ").when(kind == "view", "2").when(kind == "purchase", "+3").otherwise("Error")
    return events(spark, d).select("run_id", "seq", "time", mark.alias("marker"))


@query("SELECT event_type AS topic, 'events/' || event_type AS message_type, count(*)::BIGINT AS message_count FROM events GROUP BY ALL")
def topic_catalog(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("topic"), F.concat(F.lit("events/"), "event_type").alias("message_type"))
    return catalog.topic_catalog(rows)


@query("SELECT user_id AS run_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS duration_sec FROM events GROUP BY user_id")
def run_durations(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), (scalars.micros(F.col("ts")) * 1000).alias("time_ns"))
    return rounded(catalog.durations(rows), "duration_sec").select("run_id", "duration_sec")


BAGS = """bags AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_id AS seq, event_type,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, ts::DATE)) / 1e6 AS time FROM events
), manifest AS (
  SELECT run_id, 'ok' AS read_status, count(*)::BIGINT AS message_count, 3600.0::DOUBLE AS startup_ignore_sec,
    coalesce(string_agg(printf('%.6fs:%s', time, event_type), ' | ' ORDER BY time, seq) FILTER (event_type <> 'view' AND time < 3600), '') AS ignored_startup_markers,
    CASE WHEN count(*) FILTER (event_type <> 'view') > 0
         THEN coalesce(string_agg(printf('%.6fs:%s', time, event_type), ' | ' ORDER BY time, seq) FILTER (event_type <> 'view' AND time >= 3600), '')
         ELSE '<stage topic missing>' END AS used_stage_markers,
    coalesce(string_agg(printf('%.6fs:%s', time, event_type), ' | ' ORDER BY time, seq) FILTER (event_type = 'error' AND time >= 3600), '') AS failure_markers,
    CASE WHEN count(*) FILTER (event_type = 'error' AND time >= 3600) > 0 THEN 'fail'
         WHEN count(*) FILTER (event_type <> 'view' AND time >= 3600) > 0 THEN 'normal' ELSE 'unknown' END AS label
  FROM bags GROUP BY run_id
)"""


@query(f"WITH {BAGS} SELECT * FROM manifest")
def bag_manifest(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    run = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    rows = rows.select(run.alias("run_id"), F.col("event_id").alias("seq"), "event_type", scalars.micros(F.col("ts")).alias("us"))
    rows = rows.withColumn("time", (F.col("us") - F.min("us").over(W.partitionBy("run_id"))) / F.lit(1e6))
    is_marker = F.col("event_type") != "view"
    bags = rows.groupBy("run_id").agg(F.count("*").alias("message_count"), (F.count_if(is_marker) > 0).alias("has_markers"))
    return catalog.manifest(bags, rows.where(is_marker).select("run_id", "seq", "time", F.col("event_type").alias("marker")), 3600.0)


@query(f"WITH {BAGS} SELECT label, count(*)::BIGINT AS runs FROM manifest GROUP BY label")
def label_counts(spark, d):
    return catalog.label_counts(bag_manifest(spark, d))


@query(f"WITH {EV} SELECT run_id, string_agg(printf('%.6fs:%s', time, event_type), ' | ' ORDER BY time, seq) AS markers FROM ev WHERE event_type <> 'view' GROUP BY run_id")
def marker_text(spark, d):
    rows = events(spark, d).where("event_type <> 'view'")
    return catalog.marker_texts(rows.select("run_id", "seq", "time", F.col("event_type").alias("marker")))


@query("SELECT event_id, regexp_matches(m, '(^|[^a-z])(error|anomaly|fail|failure|failed|nok|not[_ -]?ok|fehler)($|[^a-z])', 'i') AS failure FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'stage_' || event_type || '_' || event_id WHEN 1 THEN event_type || 's' WHEN 2 THEN 'Not-OK ' || event_type WHEN 3 THEN upper(event_type) ELSE 'x' || event_type END AS m FROM events)")
def failure_markers(spark, d):
    rows, kind = spark.read.parquet(f"{d}/events.parquet"), F.col("event_type")
    k = F.col("event_id") % 5
    made = F.when(k == 0, F.concat(F.lit("stage_"), kind, F.lit("_"), "event_id")).when(k == 1, F.concat(kind, F.lit("s"))).when(k == 2, F.concat(F.lit("Not-OK "), kind)).when(k == 3, F.upper(kind)).otherwise(F.concat(F.lit("x"), kind))
    return rows.select("event_id", texts.is_failure(made).alias("failure"))


TIMELINE = f"""{EV}, ends AS (SELECT run_id, max(time) AS end_sec, greatest(0.05, max(time) * 0.001) AS gap FROM ev GROUP BY run_id),
st AS (SELECT run_id, time, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS stage FROM ev),
s3 AS (SELECT e.*, (SELECT max(time) FROM st WHERE st.run_id = e.run_id AND stage = 3) AS c3 FROM ends e),
s2 AS (SELECT e.*, (SELECT max(time) FROM st WHERE st.run_id = e.run_id AND stage = 2 AND time < e.c3 - e.gap) AS c2 FROM s3 e),
s1 AS (SELECT e.*, (SELECT max(time) FROM st WHERE st.run_id = e.run_id AND stage = 1 AND time < e.c2 - e.gap) AS c1 FROM s2 e),
tl AS (SELECT run_id, end_sec, coalesce(c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL AND NOT (c1 > end_sec OR c3 >= end_sec), false) AS ok, c1, c2, c3 FROM s1),
line AS (SELECT run_id, end_sec, CASE WHEN ok THEN [c1, c2, c3] ELSE [0.0, 1 * end_sec / 3, 2 * end_sec / 3]::DOUBLE[] END AS starts, CASE WHEN ok THEN 'recorded' ELSE 'equal_intervals' END AS source FROM tl)"""


def timelines(spark, d):
    rows = marked(spark, d)
    return timeline.stage_timeline(rows, rows.groupBy("run_id").agg(F.max("time").alias("end_sec")))


@query(f"WITH {TIMELINE} SELECT run_id, round(end_sec, 6) AS end_sec, round(starts[1], 6) AS start_1, round(starts[2], 6) AS start_2, round(starts[3], 6) AS start_3, source FROM line")
def stage_timeline(spark, d):
    rows = timelines(spark, d)
    return rounded(rows.select("run_id", "end_sec", *[F.get("starts", F.lit(k)).alias(f"start_{k + 1}") for k in range(3)], "source"), "end_sec", "start_1", "start_2", "start_3")


@query(f"""WITH {TIMELINE}, loc AS (
  SELECT ev.run_id, seq, least(greatest(time, 0), end_sec) AS t, starts, end_sec, source,
    least(greatest(len(list_filter(starts, lambda s: s <= least(greatest(time, 0), end_sec))) - 1, 0), 2) AS i FROM ev JOIN line USING (run_id)
), part AS (SELECT *, starts[i + 1] AS a, CASE WHEN i < 2 THEN starts[i + 2] ELSE end_sec END AS b FROM loc)
SELECT run_id, seq, (i + 1)::INT AS stage, round((i + CASE WHEN b > a THEN least(greatest((t - a) / (b - a), 0), 1) ELSE 0 END) / 3, 6) AS progress, source AS stage_source FROM part""")
def stage_locate(spark, d):
    found = timeline.locate(marked(spark, d).select("run_id", "seq", "time"), timelines(spark, d))
    return rounded(found.drop("time"), "progress")


@query(f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'view'), m AS (SELECT run_id, time, seq, event_type AS marker FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT p.run_id, p.seq, (SELECT arg_max(marker, struct_pack(time := time, seq := seq)) FROM m WHERE m.run_id = p.run_id AND m.time <= p.time) AS latest_marker FROM p""")
def latest_marker_asof(spark, d):
    rows = events(spark, d)
    points = rows.where("event_type = 'view'").select("run_id", "seq", "time")
    marks = rows.where("event_type in ('signup', 'purchase')").select("run_id", "seq", "time", F.col("event_type").alias("marker"))
    return timeline.latest_marker(points, marks).select("run_id", "seq", "latest_marker")


@query(f"""WITH {EV}, b AS (SELECT *, floor((time + 1e-9) / 65536) AS bucket FROM ev),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, bucket ORDER BY time, seq) AS k FROM b),
n AS (SELECT run_id, seq, round(time, 6) AS time, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) - 1 AS frame_id FROM f WHERE k = 1)
SELECT * FROM n""")
def frame_sample(spark, d):
    rows = sampling.sample_at_rate(events(spark, d).select("run_id", "seq", "time"), fps=2.0**-16)
    return rounded(rows.withColumn("frame_id", F.col("frame_id").cast("long")), "time")


LONG_FPS = 3 / 100_000


@query(f"""WITH RECURSIVE {EV}, due(due) AS (SELECT 0.0::DOUBLE UNION ALL SELECT due + {1.0 / LONG_FPS!r}::DOUBLE FROM due WHERE due <= (SELECT max(time) FROM ev)),
r AS MATERIALIZED (SELECT run_id, seq, time, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) AS i, (SELECT min(due) FROM due WHERE due > ev.time) AS after FROM ev),
taken(run_id, i, after) AS (
  SELECT run_id, min(i), arg_min(after, i) FROM r WHERE time + 1e-9 >= 0 GROUP BY run_id
  UNION ALL
  SELECT r.run_id, min(r.i), arg_min(r.after, r.i) FROM taken t JOIN r ON r.run_id = t.run_id AND r.i > t.i AND r.time + 1e-9 >= t.after GROUP BY r.run_id)
SELECT run_id, seq, round(time, 6) AS time, row_number() OVER (PARTITION BY run_id ORDER BY i) - 1 AS frame_id FROM taken JOIN r USING (run_id, i)""")
def frame_sample_exact(spark, d):
    """A period that is not exact in binary; the SQL follows the sums frame by frame."""
    rows = sampling.sample_at_rate(events(spark, d).select("run_id", "seq", "time"), fps=LONG_FPS)
    return rounded(rows.withColumn("frame_id", F.col("frame_id").cast("long")), "time")


@query(f"""WITH {EV}, r AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) - 1 AS position, count(*) OVER (PARTITION BY run_id) AS n FROM ev),
k AS (SELECT DISTINCT run_id, n, CASE WHEN n > 1 THEN round_even(j * ((n - 1) / (least(7, n) - 1)::DOUBLE), 0)::BIGINT ELSE 0 END AS position FROM (SELECT DISTINCT run_id, n FROM r), generate_series(0, 6) g(j) WHERE j < least(7, n))
SELECT r.run_id, r.seq, r.position FROM r JOIN k ON r.run_id = k.run_id AND r.position = k.position""")
def uniform_sample(spark, d):
    return sampling.sample_evenly(events(spark, d).select("run_id", "seq", "time"), 7).select("run_id", "seq", "position")


@query("SELECT event_id, event_id - 3 AS frame_index FROM events WHERE event_id >= 3 AND (event_id - 3) % 15 = 0")
def strided_frames(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_id").alias("frame_index"))
    return sampling.every_kth(rows, 0.0, 2.0, 3).select("event_id", (F.col("frame_index") - 3).alias("frame_index"))


GAPS = f"""{EV}, g AS (SELECT run_id, seq, time, CASE WHEN seq % 3 = 0 THEN value END AS v, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) AS i FROM ev),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, last_value(v IGNORE NULLS) OVER a AS lv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS hi, first_value(v IGNORE NULLS) OVER b AS hv FROM g
  WINDOW a AS (PARTITION BY run_id ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY run_id ORDER BY time, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT run_id, seq, time, i, coalesce(v, lv + (hv - lv) * ((i - li)::DOUBLE / (hi - li)), hv, lv) AS v FROM h)"""


def gapped(spark, d):
    return events(spark, d).select("run_id", "seq", "time", F.when(F.col("seq") % 3 == 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"))


@query(f"WITH {GAPS} SELECT run_id, seq, round(v, 6) AS v FROM filled")
def gap_fill(spark, d):
    return rounded(series.fill_gaps(gapped(spark, d), ["v"]).select("run_id", "seq", "v"), "v")


@query(f"""WITH {GAPS}, c AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM filled), j AS (
  SELECT run_id, n, s AS sample, s * (n - 1) / 37.0::DOUBLE AS x, least((s * (n - 1)) // 37, n - 2) AS lo FROM (SELECT DISTINCT run_id, n FROM c WHERE n > 1), generate_series(0, 37) g(s))
SELECT j.run_id, j.sample, round(j.sample / 37.0::DOUBLE, 6) AS phase, round(a.v + (b.v - a.v) * (x - lo), 6) AS v
FROM j JOIN c a ON a.run_id = j.run_id AND a.i = lo + 1 JOIN c b ON b.run_id = j.run_id AND b.i = lo + 2""")
def resample_phase(spark, d):
    return rounded(series.resample(series.fill_gaps(gapped(spark, d), ["v"]), ["v"], 38), "phase", "v")


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS force_mag FROM lineitem")
def force_magnitude(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("force_x"), F.col("l_discount").alias("force_y"), F.col("l_tax").alias("force_z"))
    return rounded(series.add_force_magnitude(rows).select("l_orderkey", "l_linenumber", "force_mag"), "force_mag")


SEGMENT = f"""{EV}, r AS (SELECT run_id, seq, time, CASE WHEN seq % 11 = 0 THEN 10 * value ELSE value / 10 END AS x, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ev),
h AS (SELECT *, i <= least(n, greatest(20, floor(n * 0.1))) AS head, least(n, greatest(20, floor(n * 0.1))) AS b FROM r),
q AS (SELECT run_id, quantile_cont(x, 0.75) AS q3 FROM h WHERE head GROUP BY run_id),
e AS (SELECT h.*, q3, count(*) FILTER (head AND x <= q3) OVER (PARTITION BY h.run_id) >= least(10, b) AS enough FROM h JOIN q USING (run_id)),
c AS (SELECT *, CASE WHEN head AND (NOT enough OR x <= q3) THEN x END AS cx FROM e),
m AS (SELECT run_id, quantile_cont(cx, 0.5) AS med, stddev_pop(cx) AS sd FROM c GROUP BY run_id),
a AS (SELECT c.run_id, any_value(med) AS med, any_value(sd) AS sd, 1.4826 * quantile_cont(abs(cx - med), 0.5) AS mad FROM c JOIN m USING (run_id) GROUP BY c.run_id),
t AS (SELECT run_id, med, CASE WHEN mad < 1e-6 THEN sd ELSE mad END AS std, med + greatest(4 * CASE WHEN mad < 1e-6 THEN sd ELSE mad END, 0.5) AS thr FROM a),
seg AS (SELECT c.run_id, any_value(med) AS baseline_median, any_value(std) AS baseline_std, any_value(thr) AS threshold, count(*) FILTER (x > thr) > 0 AS active_found,
  coalesce(greatest(min(time) FILTER (x > thr) - 3600, min(time)), min(time)) AS start_time, coalesce(least(max(time) FILTER (x > thr) + 3600, max(time)), max(time)) AS end_time FROM c JOIN t USING (run_id) GROUP BY c.run_id)"""


def bursts(spark, d):
    return events(spark, d).select("run_id", "seq", "time", F.when(F.col("seq") % 11 == 0, 10 * F.col("value")).otherwise(F.col("value") / 10).alias("x"))


@query(f"WITH {SEGMENT} SELECT run_id, round(baseline_median, 6) AS baseline_median, round(baseline_std, 6) AS baseline_std, round(threshold, 6) AS threshold, active_found, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM seg")
def active_segment(spark, d):
    found = series.active_segment(bursts(spark, d), "x", padding=3600.0)
    return rounded(found, "baseline_median", "baseline_std", "threshold", "start_time", "end_time")


@query(f"""WITH {SEGMENT}, w AS (SELECT r.run_id, seq, time, x, time BETWEEN start_time AND end_time AS inside, count(*) FILTER (time BETWEEN start_time AND end_time) OVER (PARTITION BY r.run_id) < 20 AS used_full_trajectory FROM r JOIN seg USING (run_id)),
k AS (SELECT * FROM w WHERE inside OR used_full_trajectory)
SELECT run_id, seq, round(time - min(time) OVER (PARTITION BY run_id), 6) AS time, used_full_trajectory FROM k""")
def trimmed_runs(spark, d):
    rows = bursts(spark, d)
    return rounded(series.trim(rows, series.active_segment(rows, "x", padding=3600.0)).select("run_id", "seq", "time", "used_full_trajectory"), "time")


@query("SELECT round(min(o_totalprice), 6) AS least, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 6) AS most, round(quantile_cont(o_totalprice, 0.999), 6) AS quantile FROM orders")
def quantile_summary(spark, d):
    return rounded(rounded(thresholds.summary(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 0.999), "least", "most", "quantile"), "mean", digits=4)


def _threshold_sql(rows: str, position: str, score: str, bins: int, quantile: float, margin: float, least: int, floor: float, smooth: int) -> str:
    half, step = smooth // 2, repr(1.0 / bins)
    edge = f"CASE WHEN {{}} = {bins} THEN 1.0 ELSE {{}} * {step}::DOUBLE END"
    return f"""sc AS ({rows}), edges AS (SELECT b, {edge.format('b', 'b')} AS lo, {edge.format('b + 1', '(b + 1)')} AS hi FROM generate_series(0, {bins - 1}) g(b)),
inb AS (SELECT b, quantile_cont({score}, {quantile}) AS q, count(*) AS n FROM sc JOIN edges ON {position} >= lo AND ({position} < hi OR (b = {bins - 1} AND {position} <= hi)) GROUP BY b),
al AS (SELECT quantile_cont({score}, {quantile}) * {margin} AS g, quantile_cont({score}, {floor}) AS fl FROM sc),
t0 AS (SELECT e.b, 0.5 * (lo + hi) AS center, coalesce(n, 0)::BIGINT AS n, CASE WHEN n >= {least} THEN q * {margin} END AS v FROM edges e LEFT JOIN inb USING (b)),
t1 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER x AS li, last_value(v IGNORE NULLS) OVER x AS lv, first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER y AS ri, first_value(v IGNORE NULLS) OVER y AS rv FROM t0
  WINDOW x AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t2 AS (SELECT b, center, n, greatest(coalesce(v, lv + (rv - lv) * ((b - li)::DOUBLE / (ri - li)), rv, lv, g), fl) AS v FROM t1, al),
curve AS (SELECT b, center, n, quantile_cont(v, 0.5) OVER (ORDER BY b ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS threshold FROM t2)"""


PHASED = f"""{EV}, ph AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY time, seq) - 1 AS "index", time / nullif(max(time) OVER (PARTITION BY run_id), 0) AS phase, value AS mahalanobis FROM ev)"""
PHASE_CURVE = PHASED + ", " + _threshold_sql("SELECT phase, mahalanobis FROM ph", "phase", "mahalanobis", 50, 0.999, 1.6, 5, 0.8, 5)


def phased(spark, d):
    run = W.partitionBy("run_id")
    rows = events(spark, d).withColumn("index", (F.row_number().over(run.orderBy("time", "seq")) - 1).cast("long"))
    last = F.max("time").over(run)
    return rows.select("run_id", "seq", "index", F.when(last != 0, F.col("time") / last).alias("phase"), F.col("value").alias("mahalanobis"))


def phase_curve(spark, d):
    return thresholds.phase_threshold(phased(spark, d))


@query(f"WITH {PHASE_CURVE} SELECT round(center, 6) AS phase_center, round(threshold, 6) AS threshold_mahalanobis, n AS count FROM curve")
def phase_threshold(spark, d):
    return rounded(phase_curve(spark, d), "phase_center", "threshold_mahalanobis")


VISUAL = _threshold_sql("SELECT vec_id / (SELECT max(vec_id) FROM embeddings)::DOUBLE AS p, abs(embedding[1]::DOUBLE) AS s FROM embeddings", "p", "s", 30, 0.95, 1.1, 3, 0.2, 3)


@query(f"WITH {VISUAL} SELECT round(center, 6) AS stage_center, round(threshold, 6) AS adaptive_threshold, n AS count FROM curve")
def visual_threshold(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    last = F.broadcast(rows.agg(F.max("vec_id").alias("last")).withColumn("_one", F.lit(1)))
    scores = rows.withColumn("_one", F.lit(1)).join(last, "_one").select((F.col("vec_id") / F.col("last")).alias("matched_progress"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("score"))
    return rounded(thresholds.visual_threshold(scores), "stage_center", "adaptive_threshold")


LOOKED = f"""{PHASE_CURVE}, seg AS (SELECT center AS c0, threshold AS v0, lead(center) OVER (ORDER BY b) AS c1, lead(threshold) OVER (ORDER BY b) AS v1 FROM curve),
ends AS (SELECT min(center) AS a, arg_min(threshold, center) AS va, max(center) AS z, arg_max(threshold, center) AS vz FROM curve),
lk AS (SELECT ph.*, CASE WHEN phase < a THEN va WHEN phase >= z THEN vz ELSE v0 + (v1 - v0) / (c1 - c0) * (phase - c0) END AS thr
  FROM ph CROSS JOIN ends LEFT JOIN seg ON phase >= c0 AND phase < c1)"""


@query(f"WITH {LOOKED} SELECT run_id, seq, round(thr, 6) AS threshold FROM lk WHERE phase IS NOT NULL")
def threshold_lookup(spark, d):
    found = thresholds.lookup(phased(spark, d).where("phase is not null"), "phase", phase_curve(spark, d), "phase_center", "threshold_mahalanobis", "threshold")
    return rounded(found.select("run_id", "seq", "threshold"), "threshold")


@query(f"""WITH {LOOKED}, ep AS (SELECT run_id, seq, "index", mahalanobis * 1.7 / greatest(thr, 1e-8) AS e FROM lk WHERE phase IS NOT NULL),
sm AS (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY run_id ORDER BY "index" ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM ep)
SELECT run_id, seq, round(e, 6) AS epsilon_adaptive, round(s, 6) AS epsilon_smooth, s > 1 AS alarm_raw,
  sum((s > 1)::INT) OVER (PARTITION BY run_id ORDER BY "index" ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 6 AS alarm_filtered FROM sm""")
def alarm_votes(spark, d):
    rows = phased(spark, d).where("phase is not null").withColumn("mahalanobis", F.col("mahalanobis") * 1.7)
    found = thresholds.apply_phase_threshold(rows, phase_curve(spark, d))
    return rounded(found.select("run_id", "seq", "epsilon_adaptive", "epsilon_smooth", "alarm_raw", "alarm_filtered"), "epsilon_adaptive", "epsilon_smooth")


@query("SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_pop(l_quantity), 6) AS std_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(stddev_pop(l_discount), 6) AS std_l_discount FROM lineitem")
def scaler(spark, d):
    found = mixture.scaler(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_discount"])
    return rounded(found, *found.columns)


SINGLE = f"""{PHASED}, s AS (SELECT avg(phase) AS mx, stddev_pop(phase) AS sx, avg(mahalanobis) AS my, stddev_pop(mahalanobis) AS sy, covar_pop(phase, mahalanobis) AS cxy FROM ph WHERE phase IS NOT NULL),
z AS (SELECT run_id, seq, (phase - mx) / sx AS a, (mahalanobis - my) / sy AS b, cxy / (sx * sy) AS r FROM ph, s WHERE phase IS NOT NULL),
dist AS (SELECT run_id, seq, sqrt(power(b - r / (1 + 2e-5) * a, 2) / (1 + 1e-5 - r * r / (1 + 2e-5) + 2e-5)) AS m FROM z)"""


@query(f"WITH {SINGLE} SELECT run_id, seq, round(m, 5) AS mahalanobis FROM dist")
def gmr_single(spark, d):
    """One component: the mixture regression in closed form."""
    rows = phased(spark, d).where("phase is not null").select("run_id", "seq", "phase", F.col("mahalanobis").alias("value"))
    return rounded(mixture.single_distance(rows, "phase", "value").select("run_id", "seq", "mahalanobis"), "mahalanobis", digits=5)


@query(f"WITH {SINGLE} SELECT run_id, seq, round(m, 5) AS mahalanobis FROM dist")
def gmr_one_component(spark, d):
    """The general fit and scoring with one component: the same numbers."""
    rows = phased(spark, d).where("phase is not null").select("run_id", "seq", "phase", F.col("mahalanobis").alias("value"))
    model = mixture.fit(rows, ["phase"], ["value"], components=1)[None]
    return rounded(mixture.score(rows, model).select("run_id", "seq", "mahalanobis"), "mahalanobis", digits=5)


HELD_OUT = f"""{PHASED}, own AS (SELECT run_id, count(*) AS n, sum(phase) AS x, sum(mahalanobis) AS y, sum(phase * phase) AS xx, sum(mahalanobis * mahalanobis) AS yy, sum(phase * mahalanobis) AS xy FROM ph WHERE phase IS NOT NULL GROUP BY run_id),
rest AS (SELECT o.run_id, sum(p.n) AS n, sum(p.x) / sum(p.n) AS mx, sum(p.y) / sum(p.n) AS my, sum(p.xx) / sum(p.n) AS xx, sum(p.yy) / sum(p.n) AS yy, sum(p.xy) / sum(p.n) AS xy FROM own o JOIN own p ON p.run_id <> o.run_id GROUP BY o.run_id),
st AS (SELECT run_id, mx, my, sqrt(xx - mx * mx) AS sx, sqrt(yy - my * my) AS sy, xy - mx * my AS cxy FROM rest),
hz AS (SELECT run_id, seq, "index", phase, (phase - mx) / sx AS a, (mahalanobis - my) / sy AS b, cxy / (sx * sy) AS r FROM ph JOIN st USING (run_id) WHERE phase IS NOT NULL),
held AS (SELECT run_id, seq, "index", phase, sqrt(power(b - r / (1 + 2e-5) * a, 2) / (1 + 1e-5 - r * r / (1 + 2e-5) + 2e-5)) AS m FROM hz)"""


def held_out(spark, d):
    rows = phased(spark, d).where("phase is not null").select("run_id", "seq", "index", "phase", F.col("mahalanobis").alias("value"))
    return mixture.leave_one_out(rows, ["phase"], ["value"], components=1, limits=False)


@query(f"WITH {HELD_OUT} SELECT run_id, seq, round(m, 4) AS mahalanobis, run_id AS held_out_run FROM held")
def held_out_scores(spark, d):
    """Every run under a model of all other runs."""
    return rounded(held_out(spark, d).select("run_id", "seq", "mahalanobis", "held_out_run"), "mahalanobis", digits=4)


HELD_CURVE = HELD_OUT + ", " + _threshold_sql("SELECT phase, m AS mahalanobis FROM held", "phase", "mahalanobis", 50, 0.999, 1.6, 5, 0.8, 5)


@query(f"WITH {HELD_CURVE} SELECT round(center, 6) AS phase_center, round(threshold, 4) AS threshold_mahalanobis, n AS count FROM curve")
def held_out_threshold(spark, d):
    """The threshold over the phase from scores that no run's own model gave."""
    found = thresholds.phase_threshold(held_out(spark, d))
    return rounded(rounded(found, "phase_center"), "threshold_mahalanobis", digits=4)


@query(f"WITH {HELD_CURVE} SELECT round(center, 6) AS phase_center, round(threshold, 4) AS threshold_mahalanobis, n AS count FROM curve ORDER BY center LIMIT 5")
def threshold_head(spark, d):
    """The first rows of a threshold curve, as a report shows them."""
    return held_out_threshold(spark, d).orderBy("phase_center").limit(5)


def _mixture_sql(held_out: bool, rounds: int = 60, tolerance: float = 1e-3, reg: float = mixture.REG) -> str:
    """Rounds of expectation and maximization for three components over (phase, value), from equal parts by phase.

    h names a model: the run that it leaves out, or none.  A model that has
    stopped to gain stays as it is.
    """
    each = lambda text, glue=", ": glue.join(text.replace("#", str(k)) for k in (1, 2, 3))
    sums = each("sum(r#) AS n#, sum(r# * a) AS a#, sum(r# * b) AS b#, sum(r# * a * a) AS aa#, sum(r# * a * b) AS ab#, sum(r# * b * b) AS bb#")
    names = each("w#, m#, v#, c#, d#, e#")
    model = each(f"n# / (n1 + n2 + n3) AS w#, a# / n# AS m#, b# / n# AS v#, aa# / n# - (a# / n#) * (a# / n#) + {reg} AS c#, ab# / n# - (a# / n#) * (b# / n#) AS d#, bb# / n# - (b# / n#) * (b# / n#) + {reg} AS e#")
    density = each("ln(w#) - 0.5 * (ln(c# * e# - d# * d#) + (e# * (a - m#) * (a - m#) - 2 * d# * (a - m#) * (b - v#) + c# * (b - v#) * (b - v#)) / (c# * e# - d# * d#)) AS l#")
    models, others = ("SELECT DISTINCT run_id AS h FROM raw", "raw.run_id <> hs.h") if held_out else ("SELECT NULL AS h", "true")
    out = f"""{PHASED}, raw AS (SELECT run_id, seq, phase, mahalanobis AS value FROM ph WHERE phase IS NOT NULL), hs AS ({models}),
cut AS (SELECT quantile_cont(phase, 1.0 / 3) AS p1, quantile_cont(phase, 2.0 / 3) AS p2 FROM raw),
sc AS (SELECT h, avg(phase) AS mx, stddev_pop(phase) AS sx, avg(value) AS my, stddev_pop(value) AS sy FROM hs JOIN raw ON {others} GROUP BY h),
x AS MATERIALIZED (SELECT hs.h, (phase - mx) / sx AS a, (value - my) / sy AS b, (phase >= p1)::INT + (phase >= p2)::INT + 1 AS k FROM hs JOIN raw ON {others} JOIN sc ON sc.h IS NOT DISTINCT FROM hs.h, cut),
r1 AS (SELECT h, a, b, {each("(k = #)::DOUBLE AS r#")} FROM x), s1 AS (SELECT h, {sums} FROM r1 GROUP BY h),
g1 AS MATERIALIZED (SELECT h, {model}, NULL::DOUBLE AS ll, false AS done FROM s1)"""
    for t in range(2, rounds + 1):
        out += f""",
l{t} AS (SELECT x.h, a, b, {density} FROM x JOIN g{t - 1} g ON g.h IS NOT DISTINCT FROM x.h WHERE NOT done),
q{t} AS (SELECT *, greatest(l1, l2, l3) AS top FROM l{t}), z{t} AS (SELECT *, {each("exp(l# - top)", " + ")} AS total FROM q{t}),
r{t} AS (SELECT h, a, b, top + ln(total) AS ll, {each("exp(l# - top) / total AS r#")} FROM z{t}), s{t} AS (SELECT h, {sums}, avg(ll) AS ll FROM r{t} GROUP BY h),
g{t} AS MATERIALIZED (SELECT n.h, {model}, n.ll, coalesce(abs(n.ll - o.ll) < {tolerance}, false) AS done FROM s{t} n JOIN g{t - 1} o ON n.h IS NOT DISTINCT FROM o.h UNION ALL SELECT h, {names}, ll, done FROM g{t - 1} WHERE done)"""
    density = each(f"ln(w# + 1e-12) - 0.5 * (ln(c# + {reg}) + (a - m#) * (a - m#) / (c# + {reg})) AS l#, sqrt(power(b - v# - (a - m#) * d# / (c# + {reg}), 2) / (e# - d# * d# / (c# + {reg}) + 2 * {reg})) AS m#_")
    scored = "raw.run_id = hs.h" if held_out else "true"
    return out + f""",
y AS (SELECT run_id, seq, hs.h, (phase - mx) / sx AS a, (value - my) / sy AS b FROM hs JOIN raw ON {scored} JOIN sc ON sc.h IS NOT DISTINCT FROM hs.h),
d AS (SELECT run_id, seq, {density} FROM y JOIN g{rounds} g ON g.h IS NOT DISTINCT FROM y.h),
found AS (SELECT run_id, seq, CASE WHEN l1 >= l2 AND l1 >= l3 THEN 0 WHEN l2 >= l3 THEN 1 ELSE 2 END AS k, CASE WHEN l1 >= l2 AND l1 >= l3 THEN m1_ WHEN l2 >= l3 THEN m2_ ELSE m3_ END AS m FROM d)"""


@query(f"WITH {_mixture_sql(False)}, lim AS (SELECT k, greatest(max(m), 1e-6) * 1.1 AS lim FROM found GROUP BY k) SELECT run_id, seq, k::INT AS component, round(m, 4) AS mahalanobis, round(m / lim, 4) AS epsilon, m / lim > 1 AS anomaly FROM found JOIN lim USING (k)")
def gmr_mixture(spark, d):
    """Three components, fitted until they stop to gain, the component that predicts, and its limit."""
    rows = phased(spark, d).where("phase is not null").select("run_id", "seq", "index", "phase", F.col("mahalanobis").alias("value"))
    model = mixture.fit(rows, ["phase"], ["value"])[None]
    return rounded(mixture.score(rows, model).select("run_id", "seq", "component", "mahalanobis", "epsilon", "anomaly"), "mahalanobis", "epsilon", digits=4)


@query(f"WITH {_mixture_sql(True)} SELECT run_id, seq, run_id AS held_out_run, k::INT AS component, round(m, 4) AS mahalanobis FROM found")
def held_out_mixture(spark, d):
    """Every run under a mixture of all other runs, with the defaults: three components, until each stops to gain."""
    rows = phased(spark, d).where("phase is not null").select("run_id", "seq", "phase", F.col("mahalanobis").alias("value"))
    found = mixture.leave_one_out(rows, ["phase"], ["value"], limits=False)
    return rounded(found.select("run_id", "seq", "held_out_run", "component", "mahalanobis"), "mahalanobis", digits=4)


@query("WITH s AS (SELECT l_linenumber - 1 AS component, l_quantity * 1.0 AS mahalanobis FROM lineitem), k AS (SELECT g AS component FROM generate_series(0, 7) t(g)) SELECT k.component::INT AS component, round(greatest(coalesce((SELECT max(mahalanobis) FROM s WHERE s.component = k.component), (SELECT max(mahalanobis) FROM s)), 1e-6) * 1.1, 6) AS \"limit\" FROM k")
def component_limits(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") - 1).alias("component"), F.col("l_quantity").alias("mahalanobis"))
    return rounded(mixture.component_limits(rows, 8, 1.1), "limit")


KNN = """pairs AS (SELECT q.vec_id AS query_id, m.vec_id AS item_id, 1 - list_dot_product(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS distance, q.label AS ql, m.label AS ml,
  q.embedding::DOUBLE[] AS qe, m.embedding::DOUBLE[] AS me FROM embeddings q JOIN embeddings m ON {where}),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id)::INT AS rank FROM pairs QUALIFY rank <= 5)"""
APART = KNN.format(where="q.label <> m.label")
BY_STAGE = KNN.format(where="q.label % 3 = m.label % 3 AND q.label <> m.label")


def memory(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    patches = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    attention = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    return rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("cls"), F.col("label").alias("group"), (F.col("label") % 3).alias("stage"), patches.alias("features"), attention.alias("attention"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") / 2.0).alias("timestamp_sec"))


def _as_queries(m: DataFrame) -> DataFrame:
    return m.withColumnRenamed("item_id", "query_id")


@query(f"WITH {APART} SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM knn")
def knn_cls(spark, d):
    m = memory(spark, d)
    return rounded(vectors.nearest(_as_queries(m), m, 5, apart=True), "distance")


@query(f"WITH {BY_STAGE} SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM knn")
def knn_stage(spark, d):
    m = memory(spark, d)
    return rounded(vectors.nearest(_as_queries(m), m, 5, by_stage=True, apart=True), "distance")


RERANK = """att AS (SELECT *, list_transform(generate_series(1, 8), lambda k: greatest(abs(qe[k]), abs(me[k]))) AS c FROM knn),
wt AS (SELECT *, list_transform(c, lambda x: 0.15 + 0.85 * pow((x - list_min(c)) / (list_max(c) - list_min(c) + 1e-8), 1.5)) AS w,
  list_transform(generate_series(0, 7), lambda p: sqrt(list_sum(list_transform(generate_series(1, 8), lambda k: pow(qe[p * 8 + k] - me[p * 8 + k], 2))) / 8)) AS ps FROM att),
scored AS (SELECT query_id, item_id, ql, ml, distance, rank, list_sum(list_transform(generate_series(1, 8), lambda k: ps[k] * w[k])) / list_sum(w) AS score FROM wt),
best AS (SELECT query_id, any_value(ql) AS ql, arg_min(struct_pack(i := item_id, l := ml, d := distance, s := score), struct_pack(s := score, r := rank)) AS b FROM scored GROUP BY query_id)"""


@query(f"WITH {APART}, {RERANK} SELECT query_id, b.i AS item_id, round(b.d, 6) AS cls_distance, round(b.s, 6) AS score FROM best")
def rerank_weighted(spark, d):
    m = memory(spark, d)
    return rounded(vectors.compare(_as_queries(m), m, apart=True), "cls_distance", "score")


@query(f"WITH {APART}, {RERANK} SELECT round(quantile_cont(b.s, 0.95) * 1.1, 6) AS threshold, count(*)::BIGINT AS scores FROM best")
def fixed_threshold(spark, d):
    return rounded(vectors.fixed_threshold(memory(spark, d)), "threshold")


CALIBRATED = f"""{APART}, {RERANK}, pr AS (SELECT vec_id, label, CASE WHEN max(vec_id) OVER (PARTITION BY label) > 0 THEN vec_id / (max(vec_id) OVER (PARTITION BY label))::DOUBLE ELSE 0 END AS progress FROM embeddings),
cal AS (SELECT ql AS held_out_video_id, query_id AS query_frame_id, q.progress AS query_progress, b.l AS matched_video_id, b.i AS matched_frame_id, m.progress AS matched_progress, b.s AS score, b.d AS cls_distance,
  least(3, floor(q.progress * 3)::INT + 1) AS query_stage, least(3, floor(m.progress * 3)::INT + 1) AS matched_stage FROM best JOIN pr q ON q.vec_id = query_id JOIN pr m ON m.vec_id = b.i)"""


def calibrated(spark, d):
    return vectors.calibrate(vectors.with_progress(memory(spark, d).drop("stage")))


@query(f"WITH {CALIBRATED} SELECT held_out_video_id, query_frame_id, round(query_progress, 6) AS query_progress, matched_video_id, matched_frame_id, round(matched_progress, 6) AS matched_progress, round(score, 6) AS score, round(cls_distance, 6) AS cls_distance, query_stage, matched_stage FROM cal")
def calibration_scores(spark, d):
    return rounded(calibrated(spark, d)[1].drop("matched_timestamp_sec"), "query_progress", "matched_progress", "score", "cls_distance")


CURVE = CALIBRATED + ", " + _threshold_sql("SELECT score, matched_progress FROM cal", "matched_progress", "score", 30, 0.95, 1.1, 3, 0.2, 3)


@query(f"WITH {CURVE} SELECT round(center, 6) AS stage_center, round(threshold, 6) AS adaptive_threshold, n AS count FROM curve")
def adaptive_calibration(spark, d):
    return rounded(calibrated(spark, d)[0], "stage_center", "adaptive_threshold")


@query(f"""WITH {CURVE}, seg AS (SELECT center AS c0, threshold AS v0, lead(center) OVER (ORDER BY b) AS c1, lead(threshold) OVER (ORDER BY b) AS v1 FROM curve),
en AS (SELECT min(center) AS a, arg_min(threshold, center) AS va, max(center) AS z, arg_max(threshold, center) AS vz FROM curve),
jd AS (SELECT query_frame_id, score, CASE WHEN matched_progress < a THEN va WHEN matched_progress >= z THEN vz ELSE v0 + (v1 - v0) / (c1 - c0) * (matched_progress - c0) END AS threshold
  FROM cal CROSS JOIN en LEFT JOIN seg ON matched_progress >= c0 AND matched_progress < c1)
SELECT query_frame_id, round(threshold, 6) AS threshold, round(score / greatest(threshold, 1e-8), 6) AS epsilon, score / greatest(threshold, 1e-8) > 1 AS alarm, 'adaptive' AS threshold_mode FROM jd""")
def judged_matches(spark, d):
    curve, rows = calibrated(spark, d)
    return rounded(vectors.judge(rows, curve).select("query_frame_id", "threshold", "epsilon", "alarm", "threshold_mode"), "threshold", "epsilon")


@query("SELECT page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS slug FROM pages")
def slug(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.slug(F.col("url")).alias("slug"))


RESPONSE = """r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || text || '</think> Decision : SUCCESS' WHEN 1 THEN 'answer: ' || text || ' decision:uncertain Confidence: Low'
  WHEN 2 THEN text || '#### Confidence : high' ELSE text END AS t FROM conversations),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', ' ', 'g'), '(?i)</?answer>|####', ' ', 'g'), '(?i)^\\s*answer\\s*:\\s*', '', 'g') AS seen FROM r)"""


@query(f"""WITH {RESPONSE} SELECT conv_id, turn, coalesce(nullif(lower(regexp_extract(t, '(?i)Decision\\s*:\\s*(success|failure|uncertain)', 1)), ''), 'not_parsed') AS decision,
  coalesce(nullif(lower(regexp_extract(t, '(?i)Confidence\\s*:\\s*(high|medium|low)', 1)), ''), 'not_parsed') AS confidence,
  length(regexp_replace(seen, '^\\s+|\\s+$', '', 'g')) >= 40 AND len(regexp_extract_all(seen, '[A-Za-z]{{2,}}')) >= 8 AS meaningful FROM v""")
def parse_decision(spark, d):
    rows, k, t = spark.read.parquet(f"{d}/conversations.parquet"), F.col("turn") % 4, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</think> Decision : SUCCESS"))).when(k == 1, F.concat(F.lit("answer: "), t, F.lit(" decision:uncertain Confidence: Low"))).when(k == 2, F.concat(t, F.lit("#### Confidence : high"))).otherwise(t)
    r = rows.withColumn("r", made)
    return r.select("conv_id", "turn", texts.decision(F.col("r")).alias("decision"), texts.confidence(F.col("r")).alias("confidence"), texts.is_meaningful(F.col("r")).alias("meaningful"))


INTERLEAVED = f"""{EV}, tp AS (SELECT run_id, event_type AS topic, row_number() OVER (PARTITION BY run_id, event_type ORDER BY seq) - 1 AS time_index, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS o FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
il AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY time_index, o) - 1 AS input_index, 'Time ' || (time_index + 1) || ', camera ' || topic || ':' AS label, topic, time_index FROM tp WHERE time_index < 4)"""


def interleaved(spark, d, word="camera"):
    rows = events(spark, d).select("run_id", F.col("event_type").alias("topic"), F.col("seq").alias("position"))
    return sampling.interleave(rows, ["view", "click", "purchase"], 4, word)


@query(f"WITH {INTERLEAVED} SELECT run_id, input_index::INT AS input_index, label FROM il")
def interleave(spark, d):
    return interleaved(spark, d).select("run_id", "input_index", "label")


@query(f"WITH {INTERLEAVED} SELECT run_id, input_index::INT AS input_index, side::INT AS side, CASE side WHEN 0 THEN label ELSE replace(label, 'camera', 'heatmap') END AS label FROM il, generate_series(0, 1) g(side) WHERE side = 0 OR side = 1")
def paired_inputs(spark, d):
    return sampling.paired(interleaved(spark, d), interleaved(spark, d, "heatmap"))


@query("SELECT printf('%s_%02d', lower(replace(n_name, ' ', '_')), r) AS run_name, n_nationkey AS item, r::INT AS repetition FROM nation, generate_series(1, 5) g(r)")
def run_grid(spark, d):
    """Names of all recordings of a plan: every item as often as it is repeated."""
    rows = spark.read.parquet(f"{d}/nation.parquet").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rows.select(F.format_string("%s_%02d", scalars.slug(F.col("n_name")), F.col("repetition")).alias("run_name"), F.col("n_nationkey").alias("item"), "repetition")


@query("SELECT n_nationkey, lower(trim(regexp_replace(n_name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) = n_name AND n_name <> '' AS as_is, lower(trim(regexp_replace(lower(n_name), '[^a-zA-Z0-9]+', '_', 'g'), '_')) = lower(n_name) AS lowered FROM nation")
def slug_validity(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet")
    return rows.select("n_nationkey", scalars.is_slug(F.col("n_name")).alias("as_is"), scalars.is_slug(F.lower("n_name")).alias("lowered"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS u FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda p: p[1] * p[2] / greatest(sqrt(list_dot_product(u, u)), 1e-12))), 6) AS projection,
  round(list_sum(list_transform(u, lambda x: (x - list_min(u)) / (list_max(u) - list_min(u) + 1e-8))), 6) AS attention FROM e""")
def normalized_vectors(spark, d):
    """Unit length, and attention spread between 0 and 1."""
    u = F.transform("embedding", lambda x: x.cast("double") * 3 + 1)
    total = F.aggregate(scalars.spread(u), F.lit(0.0), lambda s, x: s + x)
    return rounded(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", scalars.dot(F.col("embedding"), scalars.unit(u)).alias("projection"), total.alias("attention")), "projection", "attention")


ALARMS = f"""{LOOKED}, ep AS (SELECT run_id, phase, mahalanobis * 1.7 / greatest(thr, 1e-8) AS e FROM lk WHERE phase IS NOT NULL)"""


def judged_phases(spark, d):
    rows = phased(spark, d).where("phase is not null").withColumn("mahalanobis", F.col("mahalanobis") * 1.7)
    found = thresholds.lookup(rows, "phase", phase_curve(spark, d), "phase_center", "threshold_mahalanobis", "threshold")
    return found.withColumn("epsilon", scalars.ratio(F.col("mahalanobis"), F.col("threshold"))).withColumn("alarm", F.col("epsilon") > 1)


@query(f"WITH {ALARMS} SELECT run_id, round(phase, 6) AS position, round(e, 6) AS value FROM ep WHERE e > 1")
def alarm_points(spark, d):
    return rounded(displays.alarm_points(judged_phases(spark, d), "phase", "epsilon"), "position", "value")


@query(f"WITH {ALARMS} SELECT run_id, count(*)::BIGINT AS rows, count(*) FILTER (e > 1)::BIGINT AS alarms, round(max(e), 6) AS most, round(count(*) FILTER (e > 1) / count(*), 6) AS alarm_ratio FROM ep GROUP BY run_id")
def alarm_summary(spark, d):
    return rounded(thresholds.alarm_summary(judged_phases(spark, d)), "most", "alarm_ratio")


@query(f"WITH {ALARMS} SELECT run_id, round(phase, 6) AS position, line, round(value, 6) AS value FROM (SELECT run_id, phase, unnest(['epsilon', 'thr']) AS line, unnest([e, e / 2]) AS value FROM ep)")
def plot_curves(spark, d):
    rows = judged_phases(spark, d).withColumn("thr", F.col("epsilon") / 2)
    return rounded(displays.curves(rows.select("run_id", "phase", "epsilon", "thr"), "phase", "epsilon", "thr"), "position", "value")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substring(url, 8) ELSE url END AS path FROM pages")
def relative_paths(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", catalog.relative_path(F.col("url"), "https:/").alias("path"))


@query("""SELECT task, part, length(string_agg('Run ' || page_id || ':\n' || coalesce(html, ''), '\n\n' ORDER BY page_id))::BIGINT AS chars, md5(string_agg('Run ' || page_id || ':\n' || html, '\n\n' ORDER BY page_id)) AS digest
FROM (SELECT *, split_part(url, '/', 3) AS task, ((row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1) // 16)::BIGINT AS part FROM pages) GROUP BY ALL""")
def merged_descriptions(spark, d):
    """Texts of the runs of each task (a page's host) joined in order of their runs, as prompts of bounded size hold them."""
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.col("page_id").alias("run_id"), F.col("html").alias("response"), F.lit(True).alias("ok"))
    found = F.replace(F.col("prompt"), F.lit(tasks.MERGE.split("{")[0]), F.lit(""))
    return tasks.merged(rows, by="host").select("task", "part", F.length(found).cast("long").alias("chars"), F.md5(found).alias("digest"))


def made_markers(spark, d) -> DataFrame:
    """Serialized text messages: a head of four bytes, a length, the bytes and a zero."""
    raw = F.encode(F.concat("event_type", F.lit(" \u00e9 "), F.col("event_id").cast("string")), "UTF-8")
    size = F.reverse(F.unhex(F.lpad(F.hex(F.length(raw) + 1), 8, "0"))).cast("binary")
    ns = scalars.micros(F.col("ts")) * 1000
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), ns.alias("time_ns"), F.concat(F.unhex(F.lit("00010000")), size, raw, F.unhex(F.lit("00"))).alias("payload"))
    rows = rows.withColumn("start_ns", F.min("time_ns").over(W.partitionBy("run_id")))
    return rows.select("*", F.lit("/recording_stage").alias("topic"), F.lit(messages.TEXT).alias("message_type"))


@query("SELECT user_id::VARCHAR AS run_id, event_id AS seq, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS time, event_type || ' é ' || event_id AS marker FROM events")
def stage_events(spark, d):
    return rounded(messages.stage_events(made_markers(spark, d)).select("run_id", "seq", "time", "marker"), "time")


def made_signals(spark, d) -> DataFrame:
    """Serialized wrenches (odd keys) and joint states (even keys) of orders."""

    def run(parts):
        for part in parts:
            payload = []
            for key, *v in zip(part["seq"], part["q"], part["d"], part["t"], part["p"]):
                if key % 2:
                    payload.append(b"\0\1\0\0" + struct.pack("<6d", *v, -v[0], -v[1]))
                else:  # a head (two numbers and a text), two names, and three lists of numbers
                    body = struct.pack("<iII5s", 0, 0, 5, b"base\0") + b"\0" * 3
                    body += struct.pack("<II8sI2s", 2, 8, b"Joint A\0", 2, b"b\0")
                    body += b"\0" * (-len(body) % 4) + struct.pack("<I", 2)
                    body += b"\0" * (-len(body) % 8) + struct.pack("<2dI", v[0], v[1], 1)
                    body += b"\0" * (-len(body) % 8) + struct.pack("<dI", v[2], 0)
                    payload.append(b"\0\1\0\0" + body)
            yield part[["run_id", "seq"]].assign(payload=payload)

    price = F.col("o_totalprice").cast("double")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("seq"), price.alias("q"), (price / 2).alias("d"), (F.col("o_orderkey") / 4).alias("t"), F.col("o_custkey").cast("double").alias("p"))
    odd = F.col("seq") % 2 == 1
    made = rows.mapInPandas(run, "run_id string, seq long, payload binary")
    return made.select("run_id", "seq", (F.col("seq") * 1_000_000_000).alias("time_ns"), F.lit(1_000_000_000).cast("long").alias("start_ns"), F.when(odd, "/force").otherwise("/joints").alias("topic"), F.when(odd, "geometry_msgs/msg/Wrench").otherwise(messages.JOINTS).alias("message_type"), "payload")


SIGNALS = "l AS (SELECT o_custkey::VARCHAR AS run_id, o_orderkey::BIGINT AS seq, (o_orderkey - 1)::DOUBLE AS time, o_totalprice::DOUBLE AS q, o_totalprice::DOUBLE / 2 AS d, o_orderkey / 4.0::DOUBLE AS t, o_custkey::DOUBLE AS p FROM orders)"


@query(f"""WITH {SIGNALS}
SELECT run_id, '/force' AS topic, seq, time, unnest(['force_x', 'force_y', 'force_z', 'torque_x', 'torque_y', 'torque_z']) AS channel, round(unnest([q, d, t, p, -q, -d]), 6) + 0.0::DOUBLE AS value FROM l WHERE seq % 2 = 1
UNION ALL SELECT run_id, '/joints', seq, time, unnest(['joint_a_position', 'b_position', 'joint_a_velocity']), round(unnest([q, d, t]), 6) FROM l WHERE seq % 2 = 0""")
def numeric_channels(spark, d):
    """Wrenches and joint states decoded from their bytes, a row a channel."""
    return rounded(messages.numeric_channels(made_signals(spark, d)).select("run_id", "topic", "seq", "time", "channel", "value"), "value")


@query(f"WITH {SIGNALS} SELECT run_id, seq, time, round(q, 6) AS force_x, round(t, 6) AS force_z, round(-q, 6) AS torque_y FROM l WHERE seq % 2 = 1")
def wrench_topic(spark, d):
    """One topic as a wide table by run and time."""
    found = messages.numeric_topic(made_signals(spark, d), "/force", messages.WRENCH_FIELDS)
    return rounded(found.select("run_id", "seq", "time", "force_x", "force_z", "torque_y"), "force_x", "force_z", "torque_y")


@query("SELECT vec_id AS item_id, label::BIGINT AS \"group\", round(embedding[1]::DOUBLE, 6) AS first, 30 AS bins, 'kept' AS signature FROM embeddings UNION ALL SELECT NULL, NULL, NULL, 30, 'other signature'")
def memory_round_trip(spark, d):
    """A nominal memory written and read back, and asked for under another signature."""
    rows = vectors.with_progress(memory(spark, d).drop("stage"))
    curve = thresholds.visual_threshold(rows.select(F.col("progress").alias("matched_progress"), F.abs(F.get("embedding" if "embedding" in rows.columns else "cls", F.lit(0)).cast("double")).alias("score")))
    path, signature = shared.fresh_path(spark, "memory"), {"topic": "/camera", "stage_count": 3, "size": 518}
    results.save_memory(rows, curve, rows.select("item_id", "progress"), path, signature)
    held, table, _ = results.load_memory(spark, path, {"size": 518, "topic": "/camera"})
    assert results.load_memory(spark, shared.fresh_path(spark, "no-memory"), signature) is None
    bins, lost = table.count(), results.load_memory(spark, path, {**signature, "size": 224})
    found = held.select("item_id", F.col("group").cast("long").alias("group"), F.get("cls", F.lit(0)).cast("double").alias("first"), F.lit(bins).alias("bins"), F.lit("kept").alias("signature"))
    other = spark.range(1).select(F.lit(None).cast(held.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("long").alias("group"), F.lit(None).cast("double").alias("first"), F.lit(bins).alias("bins"), F.lit("other signature" if lost is None else "wrong").alias("signature"))
    return rounded(found.unionByName(other), "first")


@query(f"""WITH {SIGNALS} SELECT '/force' AS topic, run_id, seq, round(q, 6) AS first, round(-d, 6) AS last FROM l WHERE seq % 2 = 1
UNION ALL SELECT '/joints', run_id, seq, round(q, 6), round(t, 6) FROM l WHERE seq % 2 = 0""")
def selected_topics(spark, d):
    """Several topics as tables of their own."""
    wanted = {"/force": ["force_x", "torque_z"], "/joints": ["joint_a_position", "joint_a_velocity"]}
    found = messages.numeric_topics(made_signals(spark, d), wanted)
    rows = [found[t].select("topic", "run_id", "seq", F.col(names[0]).alias("first"), F.col(names[1]).alias("last")) for t, names in wanted.items()]
    return rounded(rows[0].unionByName(rows[1]), "first", "last")


@query(f"WITH {SIGNALS} SELECT run_id, seq, round(time - min(time) OVER (PARTITION BY run_id), 6) AS time, round(q, 6) AS force_x FROM l WHERE seq % 2 = 1")
def first_sample_time(spark, d):
    """A wrench by time since the run's first sample of the topic."""
    rows = series.first_sample_time(messages.numeric_topic(made_signals(spark, d), "/force", ["force_x"]))
    return rounded(rows.select("run_id", "seq", "time", "force_x"), "time", "force_x")


def made_images(spark, d) -> DataFrame:
    """Serialized images of one by two pixels of each event, in five encodings and with rows of odd lengths."""

    def run(parts):
        for part in parts:
            payload = []
            for seq in part["seq"]:
                encoding, depth = [("rgb8", 3), ("bgr8", 3), ("rgba8", 4), ("bgra8", 4), ("mono8", 1)][seq % 5]
                step = 2 * depth + seq % 3
                body = struct.pack("<iII2s2xII", 0, 0, 2, b"c\0", 1, 2) + struct.pack("<I", len(encoding) + 1) + encoding.encode() + b"\0\0"
                body += b"\0" * (-len(body) % 4) + struct.pack("<II", step, step) + bytes(seq * (k + 1) % 256 for k in range(step))
                payload.append(b"\0\1\0\0" + body)
            yield part.assign(payload=payload)

    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"))
    made = rows.mapInPandas(run, "run_id string, seq long, payload binary")
    return made.select("run_id", "seq", F.col("seq").alias("time_ns"), F.lit(0).cast("long").alias("start_ns"), F.lit("/camera").alias("topic"), F.lit("sensor_msgs/msg/Image").alias("message_type"), "payload")


@query("""SELECT user_id::VARCHAR AS run_id, event_id AS seq, ['rgb8', 'bgr8', 'rgba8', 'bgra8', 'mono8'][event_id % 5 + 1] AS encoding, 1 AS height, 2 AS width,
  array_to_string(list_transform(range(6), lambda j: printf('%02X', (event_id * (1 + CASE event_id % 5 WHEN 0 THEN j WHEN 1 THEN (j // 3) * 3 + 2 - j % 3 WHEN 2 THEN (j // 3) * 4 + j % 3 WHEN 3 THEN (j // 3) * 4 + 2 - j % 3 ELSE j // 3 END)) % 256)), '') AS rgb FROM events""")
def image_frames(spark, d):
    """Images of five encodings decoded to packed RGB."""
    return messages.frames(made_images(spark, d), "/camera").select("run_id", "seq", "encoding", "height", "width", F.hex("image").alias("rgb"))


@query("""SELECT vec_id AS frame_id, label::BIGINT AS "group", round(vec_id / greatest(max(vec_id) OVER (PARTITION BY label), 1), 6) AS progress,
  least(3, floor(3.0 * vec_id / greatest(max(vec_id) OVER (PARTITION BY label), 1))::INT + 1) AS stage, 'frame_progress' AS stage_source, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings""")
def nominal_memory(spark, d):
    """A memory of embedded frames with the progress and stage of each."""
    found = vision.nominal_memory(memory(spark, d).drop("item_id", "stage"))
    return rounded(found.select("frame_id", F.col("group").cast("long").alias("group"), "progress", F.col("stage").cast("int").alias("stage"), "stage_source", F.get("cls", F.lit(0)).cast("double").alias("first")), "progress", "first")


@query(f"WITH {SIGNALS} SELECT run_id, count(*)::BIGINT AS messages, round(max(time), 6) AS last FROM l WHERE seq % 2 = 1 GROUP BY run_id")
def topic_messages(spark, d):
    """Messages of one topic that must be there and of an allowed type."""
    log = made_signals(spark, d)
    found = catalog.require_topic(log, "/force", messages.WRENCH)
    for topic, types in (("/nothing", None), ("/force", messages.POSE)):
        try:
            catalog.require_topic(log, topic, types)
        except (ValueError, TypeError):
            continue
        raise AssertionError(f"{topic} was taken")
    last = F.max((F.col("time_ns") - F.col("start_ns")) / F.lit(1e9)).alias("last")
    return rounded(found.groupBy("run_id").agg(F.count("*").alias("messages"), last), "last")


@query("SELECT event_id, ((event_id % 7) // 3)::INT AS \"row\", ((event_id % 7) % 3)::INT AS \"column\", left('Time ' || event_id || ', camera of the ' || event_type || ' with a name that goes on and on:', 55) AS caption FROM events")
def sheet_layout(spark, d):
    """Places and captions of inputs on a sheet of three columns."""
    label = F.format_string("Time %d, camera of the %s with a name that goes on and on:", F.col("event_id"), F.col("event_type"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 7).alias("input_index"), label.alias("label"))
    return displays.storyboard(rows, 3).select("event_id", "row", "column", "caption")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(list_max(u), 6) AS most, round(list_sum(u), 6) AS total FROM (SELECT vec_id, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v) + 1e-8)) AS u FROM e)""")
def overlay_strength(spark, d):
    """Weighted patch scores as the strength of a heat map."""
    strength = displays.overlay(F.transform("embedding", lambda x: x.cast("double")))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", strength.alias("s"))
    return rounded(rows.select("vec_id", F.array_max("s").alias("most"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total")), "most", "total")


@query("""SELECT event_id, printf('t %.2f s', event_id / 4.0) || '|' || printf('score %.4f / %.4f (adaptive)', event_id / 8.0, 2.5) || '|' || printf('ratio %.2f ', event_id / 20.0) || CASE WHEN event_id / 20.0 > 1 THEN 'ALARM' ELSE 'normal' END
  || '|' || printf('match %s frame %d at %.2f', event_type, event_id % 90, 0.5) || '|' || printf('distance %.4f', event_id / 16.0) AS lines FROM events""")
def panel_lines(spark, d):
    """Lines of text that stand on the frames of a result video; the numbers here need no rounding."""
    e = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        e.alias("frame_id"), F.col("user_id").alias("run_id"), (e / 4).alias("timestamp_sec"), (e / 8).alias("score"), F.lit(2.5).alias("threshold"), F.lit("adaptive").alias("threshold_mode"), (e / 20).alias("epsilon"), (e / 20 > 1).alias("alarm"),
        F.col("event_type").alias("matched_video_id"), (e % 90).alias("matched_frame_id"), F.lit(0.5).alias("matched_progress"), (e / 16).alias("cls_distance"),
    )
    return displays.panel(rows).select(F.col("frame_id").alias("event_id"), F.array_join("lines", "|").alias("lines"))


@query("SELECT page_id, url, length(html)::BIGINT AS chars FROM pages")
def csv_round_trip(spark, d):
    """A table written as CSV with a head and read back."""
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("chars"))
    path = shared.fresh_path(spark, "csv")
    results.write_csv(results.csv_ready(rows), path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("""WITH p AS (SELECT event_id, list_transform(range(6), lambda j: (event_id * (1 + CASE event_id % 5 WHEN 0 THEN j WHEN 1 THEN (j // 3) * 3 + 2 - j % 3 WHEN 2 THEN (j // 3) * 4 + j % 3 WHEN 3 THEN (j // 3) * 4 + 2 - j % 3 ELSE j // 3 END)) % 256) AS v FROM events)
SELECT event_id AS seq, list_sum(v[1:3])::DOUBLE AS patch_1, list_sum(v[4:6])::DOUBLE AS patch_2, round(list_max(v) / 255.0, 6) AS attention, 2 AS grid_size FROM p""")
def model_features(spark, d):
    """Features of decoded images by a caller's model: here one that adds up the pixels."""

    def extract(model, batch):
        for image in batch["image"]:
            yield [[float(sum(image[:3]))], [float(sum(image[3:]))]], [max(image) / 255.0], [model], 2

    found = models.embed(messages.frames(made_images(spark, d), "/camera"), "pixel sums", float, extract)
    patch = lambda k: F.get(F.get("features", F.lit(k)), F.lit(0))
    return rounded(found.select("seq", patch(0).alias("patch_1"), patch(1).alias("patch_2"), F.get("attention", F.lit(0)).alias("attention"), "grid_size"), "attention")
