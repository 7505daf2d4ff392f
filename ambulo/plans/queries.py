"""Queries over the driver tables, each with its DuckDB SQL.

The tables stand in for recordings: a user of ``events`` is a recording, an
event an initial contact, a stride or a walking bout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambulo.functions import columns as C
from ambulo.operators import bouts as B
from ambulo.operators import dmo as D
from ambulo.operators import intervals as I
from ambulo.operators import scores as S
from ambulo.operators import series as R
from ambulo.sources import loaders as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEYS = ["visit_type", "participant_id", "measurement_date"]
BY = ["rec"]
COHORTS = ["CHF", "COPD", "HA", "MS", "PD", "PFF"]

#: Views over events, as expressions that both engines read.  {second} is the second of ts since 2024.
VIEWS: dict[str, dict[str, str]] = {
    "bouts": {
        "visit_type": "'T1'", "participant_id": "user_id", "measurement_date": "CAST(CAST(ts AS DATE) AS STRING)", "wb_id": "event_id",
        "duration_s": "CASE WHEN event_id % 23 <> 0 THEN value END", "cadence_spm": "6e1 + event_id % 97",
        "stride_length_m": "CASE WHEN event_id % 19 <> 0 THEN 2e-1 + (event_id % 150) / 1e2 END", "stride_duration_s": "12e1 / (6e1 + event_id % 97)",
        "walking_speed_mps": "(2e-1 + (event_id % 150) / 1e2) * (6e1 + event_id % 97) / 12e1", "n_turns": "event_id % 4",
        "n_raw_initial_contacts": "CAST(floor(value * (6e1 + event_id % 97) / 6e1) AS BIGINT)",
        "cohort": "CASE user_id % 6 WHEN 0 THEN 'CHF' WHEN 1 THEN 'COPD' WHEN 2 THEN 'HA' WHEN 3 THEN 'MS' WHEN 4 THEN 'PD' ELSE 'PFF' END", "height_m": "15e-1 + (user_id % 50) / 1e2",
    },
    "mask": {
        "visit_type": "'T1'", "participant_id": "user_id", "measurement_date": "CAST(CAST(ts AS DATE) AS STRING)", "wb_id": "event_id",
        "duration_s": "CASE WHEN event_id % 11 <> 0 THEN event_id % 13 <> 0 END", "cadence_spm": "event_id % 7 <> 0", "stride_length_m": "event_id % 5 <> 0",
        "walking_speed_mps": "event_id % 17 <> 0", "n_turns": "event_id % 9 <> 0",
    },
    "contacts": {"rec": "user_id", "id": "event_id", "ic": "{second}", "lr_label": "CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END"},
    "reference": {"rec": "user_id", "id": "event_id", "start": "{second}", "end": "{second} + CAST(floor(value * 100) AS BIGINT) + 10", "value": "value"},
    "detected": {"rec": "user_id", "id": "event_id", "start": "{second} + (event_id % 7) * 30", "end": "{second} + CAST(floor(value * (100 - 45 * CAST(event_id % 5 = 0 AS INT))) AS BIGINT) + 10 + (event_id % 7) * 30 + (event_id % 3) * 40", "value": "value * (1 + (event_id % 11) / 1e2)"},
    "strides": {"rec": "user_id", "s_id": "event_id", "start": "{second}", "end": "{second} + CAST(floor(value * 100) AS BIGINT) + 10", "lr_label": "CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END", "stride_length_m": "CASE WHEN event_id % 19 <> 0 THEN (event_id % 150) / 1e2 END"},
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    second = "(unix_seconds(CAST(ts AS TIMESTAMP)) - 1704067200)"
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.selectExpr(*[f"{e.replace('{second}', second)} AS `{n}`" for n, e in VIEWS[name].items()])


def with_views(names: str, sql: str) -> str:
    """SQL with the named views in front."""
    second = "(CAST(floor(epoch(ts)) AS BIGINT) - 1704067200)"
    parts = []
    for name in names.split():
        fields = ", ".join(f'{e.replace("{second}", second)} AS "{n}"' for n, e in VIEWS[name].items())
        parts.append(f"{name} AS (SELECT {fields} FROM events)")
    parts.append("series AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, value, value - 40 AS centred FROM events)")
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"


def series(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    events = spark.read.parquet(f"{folder}/events.parquet")
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return events.select(F.col("user_id").alias("rec"), number.alias("sample"), "value", (F.col("value") - 40).alias("centred"))


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(names: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
        ORACLES[f.__name__] = with_views(names, sql)
        return f

    return add


def rd(e: str, name: str) -> str:
    return f"round({e} + 1e-9, 6) AS {name}"


#: The outcomes written out: name, long name, stratum of duration_s, value.
_OUTCOMES = """
wb_all_sum | wb_all__count | true | CAST(count(duration_s) FILTER (S) AS BIGINT)
walkdur_all_sum | total_walking_duration_min | true | R(coalesce(sum(duration_s) FILTER (S), 0) / 60)
wbsteps_all_sum | wb_all__n_raw_initial_contacts__sum | true | CAST(coalesce(sum(n_raw_initial_contacts) FILTER (S), 0) AS BIGINT)
turns_all_sum | wb_all__n_turns__sum | true | CAST(coalesce(sum(n_turns) FILTER (S), 0) AS BIGINT)
wbdur_all_avg | wb_all__duration_s__avg | true | R(median(duration_s) FILTER (S))
wbdur_all_p90 | wb_all__duration_s__p90 | true | R(quantile_cont(duration_s, 0.9) FILTER (S))
wbdur_all_var | wb_all__duration_s__var | true | R(stddev_samp(duration_s) FILTER (S) / nullif(avg(duration_s) FILTER (S), 0))
cadence_all_avg | wb_all__cadence_spm__avg | true | R(avg(cadence_spm) FILTER (S))
strdur_all_avg | wb_all__stride_duration_s__avg | true | R(avg(stride_duration_s) FILTER (S))
cadence_all_var | wb_all__cadence_spm__var | true | R(stddev_samp(cadence_spm) FILTER (S) / nullif(avg(cadence_spm) FILTER (S), 0))
strdur_all_var | wb_all__stride_duration_s__var | true | R(stddev_samp(stride_duration_s) FILTER (S) / nullif(avg(stride_duration_s) FILTER (S), 0))
wb_1030_sum | wb_10_30__count | duration_s > 10 AND duration_s <= 30 | CAST(nullif(count(duration_s) FILTER (S), 0) AS BIGINT)
ws_1030_avg | wb_10_30__walking_speed_mps__avg | duration_s > 10 AND duration_s <= 30 | R(avg(walking_speed_mps) FILTER (S))
strlen_1030_avg | wb_10_30__stride_length_m__avg | duration_s > 10 AND duration_s <= 30 | R(avg(stride_length_m) FILTER (S))
wb_10_sum | wb_10__count | duration_s > 10 | CAST(count(duration_s) FILTER (S) AS BIGINT)
ws_10_p90 | wb_10__walking_speed_mps__p90 | duration_s > 10 | R(quantile_cont(walking_speed_mps, 0.9) FILTER (S))
wb_30_sum | wb_30__count | duration_s > 30 | CAST(count(duration_s) FILTER (S) AS BIGINT)
ws_30_avg | wb_30__walking_speed_mps__avg | duration_s > 30 | R(avg(walking_speed_mps) FILTER (S))
strlen_30_avg | wb_30__stride_length_m__avg | duration_s > 30 | R(avg(stride_length_m) FILTER (S))
cadence_30_avg | wb_30__cadence_spm__avg | duration_s > 30 | R(avg(cadence_spm) FILTER (S))
strdur_30_avg | wb_30__stride_duration_s__avg | duration_s > 30 | R(avg(stride_duration_s) FILTER (S))
ws_30_p90 | wb_30__walking_speed_mps__p90 | duration_s > 30 | R(quantile_cont(walking_speed_mps, 0.9) FILTER (S))
cadence_30_p90 | wb_30__cadence_spm__p90 | duration_s > 30 | R(quantile_cont(cadence_spm, 0.9) FILTER (S))
ws_30_var | wb_30__walking_speed_mps__var | duration_s > 30 | R(stddev_samp(walking_speed_mps) FILTER (S) / nullif(avg(walking_speed_mps) FILTER (S), 0))
strlen_30_var | wb_30__stride_length_m__var | duration_s > 30 | R(stddev_samp(stride_length_m) FILTER (S) / nullif(avg(stride_length_m) FILTER (S), 0))
wb_60_sum | wb_60__count | duration_s > 60 | CAST(count(duration_s) FILTER (S) AS BIGINT)
"""


def _aggregate_sql(original: bool = True) -> str:
    out = []
    for line in _OUTCOMES.strip().splitlines():
        name, long_name, stratum, value = line.split(" | ")
        value = value.replace("FILTER (S)", f"FILTER ({stratum})")
        value = f"round({value[2:-1]} + 1e-9, 6)" if value.startswith("R(") else value
        out.append(f"{value} AS {name if original else long_name}")
    return ", ".join(out)


@query("bouts", f"SELECT {', '.join(KEYS)}, {_aggregate_sql()} FROM bouts GROUP BY ALL")
def dmo_daily(spark, folder):
    return D.DAILY(view(spark, folder, "bouts"))


@query("bouts", f"SELECT 'all_wbs' AS \"group\", {_aggregate_sql(False)} FROM bouts")
def dmo_global(spark, folder):
    return D.SINGLE_RECORDING(view(spark, folder, "bouts"))


@query("bouts mask", f"""
, masked AS (SELECT b.visit_type, b.participant_id, b.measurement_date, coalesce(m.duration_s, true) AS ok,
  CASE WHEN ok THEN b.duration_s END AS duration_s, CASE WHEN ok AND m.cadence_spm THEN b.cadence_spm END AS cadence_spm, CASE WHEN ok AND m.stride_length_m THEN b.stride_length_m END AS stride_length_m,
  CASE WHEN ok THEN b.stride_duration_s END AS stride_duration_s, CASE WHEN ok AND m.walking_speed_mps AND m.stride_length_m AND m.cadence_spm THEN b.walking_speed_mps END AS walking_speed_mps,
  CASE WHEN ok AND m.n_turns THEN b.n_turns END AS n_turns, CASE WHEN ok THEN b.n_raw_initial_contacts END AS n_raw_initial_contacts
  FROM bouts b JOIN mask m USING (wb_id))
SELECT {', '.join(KEYS)}, {_aggregate_sql()} FROM masked GROUP BY ALL""")
def dmo_masked(spark, folder):
    masked = D.mask_bouts(view(spark, folder, "bouts"), view(spark, folder, "mask"), [*KEYS, "wb_id"])
    return D.DAILY(masked)


#: Widest free-living ranges by outcome and cohort, missing entries filled from the rows below, written out.
_RANGES = """('cadence_spm', 'CHF', 36.2, 172.9), ('cadence_spm', 'COPD', 38.88048357, 172.9), ('cadence_spm', 'HA', 35.751898, 172.9), ('cadence_spm', 'MS', 38.44321135, 172.9), ('cadence_spm', 'PD', 33.8, 172.9),
('cadence_spm', 'PFF', 40.0, 172.9), ('stride_duration_s', 'CHF', 0.46, 3.03085714), ('stride_duration_s', 'COPD', 0.46, 3.0), ('stride_duration_s', 'HA', 0.46, 3.2544), ('stride_duration_s', 'MS', 0.46, 3.05775),
('stride_duration_s', 'PD', 0.46, 3.0), ('stride_duration_s', 'PFF', 0.14, 3.0)"""
_COHORTS = "(VALUES ('CHF'), ('COPD'), ('HA'), ('MS'), ('PD'), ('PFF')) c(cohort)"


def _threshold_sql() -> str:
    rows = f"SELECT dmo, cohort, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES {_RANGES}) v(dmo, cohort, lo, hi)"
    same = [f"SELECT '{d}', cohort, {lo}::DOUBLE, {hi}::DOUBLE FROM {_COHORTS}" for d, lo, hi in (("walking_speed_mps", 0.08151492, 2.22), ("stride_length_m", 0.1505232, 2.19))]
    return f", t AS ({' UNION ALL '.join([rows, *same])})"


_CHECKED = ("cadence_spm", "walking_speed_mps", "stride_length_m", "stride_duration_s")
_HEIGHT = "4 * sqrt(2 * (0.53 * height_m) * (9.80665 * 0.53 * height_m * 0.038) - power(9.80665 * 0.53 * height_m * 0.038, 2))"


def _mask_sql() -> str:
    checks = []
    for d in _CHECKED:
        hi = f"greatest({d}_t.hi, {_HEIGHT})" if d == "stride_length_m" else f"{d}_t.hi"
        checks.append(f"b.{d} BETWEEN {d}_t.lo AND {hi} AS {d}")
    joins = " ".join(f"JOIN t {d}_t ON {d}_t.cohort = b.cohort AND {d}_t.dmo = '{d}'" for d in _CHECKED)
    return f"{_threshold_sql()} SELECT b.wb_id, {', '.join(checks)} FROM bouts b {joins}"


@query("bouts", _mask_sql())
def threshold_mask(spark, folder):
    return D.apply_thresholds(view(spark, folder, "bouts"), D.threshold_table(spark), "free_living", keys=["wb_id"], height="height_m")


@query("bouts", f"""
, daily AS (SELECT {', '.join(KEYS)}, {_aggregate_sql()} FROM bouts GROUP BY ALL),
wear AS (SELECT DISTINCT {', '.join(KEYS)}, CAST(8 + participant_id % 9 AS DOUBLE) AS h FROM bouts)
SELECT visit_type, participant_id, round(avg(wb_all_sum) + 1e-9, 6) AS wb_all_sum, round(avg(wbdur_all_avg) + 1e-9, 5) AS wbdur_all_avg, round(avg(ws_30_p90) + 1e-9, 5) AS ws_30_p90, count(walkdur_all_sum) AS n_days
FROM daily JOIN wear USING ({', '.join(KEYS)}) WHERE h > 12 GROUP BY ALL HAVING count(walkdur_all_sum) >= 3""")
def weekly_rollup(spark, folder):
    bouts = view(spark, folder, "bouts")
    wear = bouts.select(*KEYS).distinct().withColumn("total_worn_during_waking_h", (8 + F.col("participant_id") % 9).cast("double"))
    daily = rounded(D.DAILY(bouts))
    found = D.weekly(daily, wear)
    return found.select("visit_type", "participant_id", "wb_all_sum", F.round(F.col("wbdur_all_avg") + 1e-9, 5).alias("wbdur_all_avg"), F.round(F.col("ws_30_p90") + 1e-9, 5).alias("ws_30_p90"), "n_days")


@query("bouts", f"""
, d AS (SELECT DISTINCT {', '.join(KEYS)} FROM bouts)
SELECT visit_type, participant_id, min(measurement_date) AS first_day, max(measurement_date) AS last_day, count(*) AS n_days,
CAST(datediff('day', CAST(min(measurement_date) AS DATE), CAST(max(measurement_date) AS DATE)) AS BIGINT) AS span_days, count(*) > 7 AS too_many, span_days > 6 AS too_long FROM d GROUP BY ALL""")
def visit_spans(spark, folder):
    return D.visit_spans(view(spark, folder, "bouts").select(*KEYS).distinct())


@query("bouts", "SELECT participant_id, measurement_date, count(*) AS count FROM bouts GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return D.duplicate_keys(view(spark, folder, "bouts"), ["participant_id", "measurement_date"])


@query("", """SELECT user_id AS rec, CAST(CAST(ts AS DATE) AS STRING) AS measurement_date, round(sum(value) / 3600 + 1e-9, 6) AS total_worn_h,
round(coalesce(sum(value) FILTER (hour(ts) >= 7 AND hour(ts) < 22), 0) / 3600 + 1e-9, 6) AS total_worn_during_waking_h FROM events GROUP BY ALL""")
def weartime_daily(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumnRenamed("user_id", "rec")
    found = L.daily_weartime(events, BY, start="ts", worn="value")
    return found.withColumn("measurement_date", F.col("measurement_date").cast("string"))


_ISLANDS = """, r AS (SELECT *, max("end") OVER (PARTITION BY rec ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)"""


@query("reference", _ISLANDS.format(src="reference", gap=20_000) + 'SELECT rec, min("start") AS "start", max("end") AS "end" FROM i GROUP BY rec, island')
def merge_intervals(spark, folder):
    return I.merge(view(spark, folder, "reference"), BY, 20_000)


@query("detected reference", """, p AS (SELECT d.rec, greatest(d."start", r."start") AS "start", least(d."end", r."end") AS "end" FROM detected d JOIN reference r ON d.rec = r.rec AND d."start" < r."end" AND r."start" < d."end")"""
       + _ISLANDS.format(src="p", gap=0) + 'SELECT rec, min("start") AS "start", max("end") AS "end" FROM i GROUP BY rec, island')
def interval_intersection(spark, folder):
    return I.intersect(view(spark, folder, "detected"), view(spark, folder, "reference"), BY)


_SWEEP = """, e AS (SELECT rec, "start" AS pos, 1 AS d, 0 AS r FROM detected UNION ALL SELECT rec, "end", -1, 0 FROM detected UNION ALL SELECT rec, "start", 0, 1 FROM reference UNION ALL SELECT rec, "end", 0, -1 FROM reference),
g AS (SELECT rec, pos, sum(d) AS d, sum(r) AS r FROM e GROUP BY ALL),
c AS (SELECT rec, pos AS "start", lead(pos) OVER w AS "end", sum(d) OVER w AS d, sum(r) OVER w AS r FROM g WINDOW w AS (PARTITION BY rec ORDER BY pos)),
k AS (SELECT rec, "start", "end", CASE WHEN d > 0 AND r > 0 THEN 'tp' WHEN d > 0 THEN 'fp' WHEN r > 0 THEN 'fn' ELSE 'tn' END AS match_type FROM c WHERE "end" IS NOT NULL
  UNION ALL SELECT rec, 0, min("start"), 'tn' FROM c GROUP BY rec HAVING min("start") > 0),
n AS (SELECT *, CASE WHEN lag(match_type) OVER w = match_type THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY rec ORDER BY "start")),
s AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY "start") AS island FROM n),
m AS (SELECT rec, min("start") AS "start", max("end") AS "end", match_type FROM s GROUP BY rec, island, match_type
  UNION ALL SELECT rec, max("end"), max("end") + 1000, 'tn' FROM c GROUP BY rec)"""


def _categorized(spark, folder):
    d, r = view(spark, folder, "detected"), view(spark, folder, "reference")
    ends = d.unionByName(r).groupBy("rec").agg((F.max("end") + 1001).alias("n_samples"))
    return I.categorize_per_sample(d, r, BY, ends)


@query("detected reference", _SWEEP + 'SELECT rec, "start", "end", match_type FROM m')
def categorize_per_sample(spark, folder):
    return _categorized(spark, folder)


_SCORES = """, q AS (SELECT rec, coalesce(sum("end" - "start" + 1) FILTER (match_type = 'tp'), 0)::DOUBLE AS tp_samples, coalesce(sum("end" - "start" + 1) FILTER (match_type = 'fp'), 0)::DOUBLE AS fp_samples,
  coalesce(sum("end" - "start" + 1) FILTER (match_type = 'fn'), 0)::DOUBLE AS fn_samples, coalesce(sum("end" - "start" + 1) FILTER (match_type = 'tn'), 0)::DOUBLE AS tn_samples FROM m GROUP BY GROUPING SETS ((rec), ())),
x AS (SELECT rec, tp_samples, fp_samples, fn_samples, tn_samples, coalesce(tp_samples / nullif(tp_samples + fp_samples, 0), 0) AS precision, coalesce(tp_samples / nullif(tp_samples + fn_samples, 0), 0) AS recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score, coalesce(tn_samples / nullif(tn_samples + fp_samples, 0), 0) AS specificity,
  coalesce((tp_samples + tn_samples) / nullif(tp_samples + fp_samples + fn_samples + tn_samples, 0), 0) AS accuracy, coalesce(tn_samples / nullif(tn_samples + fn_samples, 0), 0) AS npv FROM q)"""
_SIX = ("precision", "recall", "f1_score", "specificity", "accuracy", "npv")


@query("detected reference", _SWEEP + _SCORES + "SELECT rec, tp_samples, fp_samples, fn_samples, tn_samples, " + ", ".join(rd(c, c) for c in _SIX) + " FROM x WHERE rec IS NOT NULL")
def gsd_scores(spark, folder):
    return S.interval_scores(_categorized(spark, folder), BY)


@query("detected reference", _SWEEP + _SCORES + "SELECT 'single' AS weighting, " + ", ".join(rd(f"avg({c})", c) for c in _SIX) + " FROM x WHERE rec IS NOT NULL UNION ALL SELECT 'combined', " + ", ".join(rd(c, c) for c in _SIX) + " FROM x WHERE rec IS NULL")
def gsd_final_scores(spark, folder):
    return S.macro_and_micro(_categorized(spark, folder), "rec")


_TOTALS = """, d AS (SELECT rec, sum("end" - "start") / 100.0::DOUBLE AS detected_duration_s, count(*) AS detected_n FROM detected GROUP BY rec), r AS (SELECT rec, sum("end" - "start") / 100.0::DOUBLE AS reference_duration_s, count(*) AS reference_n FROM reference GROUP BY rec)
SELECT rec, round(detected_duration_s + 1e-9, 6) AS detected_duration_s, detected_n, round(reference_duration_s + 1e-9, 6) AS reference_duration_s, reference_n,
round(detected_duration_s - reference_duration_s + 1e-9, 6) AS duration_error, round((detected_duration_s - reference_duration_s) / reference_duration_s + 1e-9, 6) AS duration_rel_error, round(abs(detected_duration_s - reference_duration_s) + 1e-9, 6) AS duration_abs_error,
round(abs((detected_duration_s - reference_duration_s) / reference_duration_s) + 1e-9, 6) AS duration_abs_rel_error, round(ln(1 + abs((detected_duration_s - reference_duration_s) / reference_duration_s)) + 1e-9, 6) AS duration_abs_rel_error_log,
detected_n - reference_n AS n_error, round((detected_n - reference_n) / reference_n::DOUBLE + 1e-9, 6) AS n_rel_error, abs(detected_n - reference_n) AS n_abs_error, round(abs((detected_n - reference_n) / reference_n::DOUBLE) + 1e-9, 6) AS n_abs_rel_error,
round(ln(1 + abs((detected_n - reference_n) / reference_n::DOUBLE)) + 1e-9, 6) AS n_abs_rel_error_log FROM d JOIN r USING (rec)"""


@query("detected reference", _TOTALS)
def gsd_unmatched(spark, folder):
    return S.unmatched_totals(view(spark, folder, "detected"), view(spark, folder, "reference"), BY, 100)


_OVERLAP = """, p AS (SELECT d.rec, d.id AS id_detected, r.id AS id_reference, d.value AS dv, r.value AS rv FROM detected d JOIN reference r ON d.rec = r.rec AND least(d."end", r."end") - greatest(d."start", r."start") > 0
  AND least(d."end", r."end") - greatest(d."start", r."start") >= 0.8 * (d."end" - d."start") AND least(d."end", r."end") - greatest(d."start", r."start") >= 0.8 * (r."end" - r."start"))"""


@query("detected reference", _OVERLAP + """ SELECT rec, id_detected, id_reference, 'tp' AS match_type FROM p UNION ALL SELECT rec, id, NULL, 'fp' FROM detected WHERE (rec, id) NOT IN (SELECT rec, id_detected FROM p)
UNION ALL SELECT rec, NULL, id, 'fn' FROM reference WHERE (rec, id) NOT IN (SELECT rec, id_reference FROM p)""")
def match_overlap(spark, folder):
    return I.match_overlap(view(spark, folder, "detected"), view(spark, folder, "reference"), BY)


def _matched(spark, folder):
    d, r = view(spark, folder, "detected"), view(spark, folder, "reference")
    return I.side_by_side(I.match_overlap(d, r, BY), d, r, BY)


@query("detected reference", _OVERLAP + f" SELECT rec, id_detected, id_reference, {rd('dv', 'value__detected')}, {rd('rv', 'value__reference')}, {rd('dv - rv', 'value__error')}, {rd('(dv - rv) / nullif(rv, 0)', 'value__rel_error')}, {rd('abs(dv - rv)', 'value__abs_error')}, {rd('abs((dv - rv) / nullif(rv, 0))', 'value__abs_rel_error')} FROM p")
def error_transforms(spark, folder):
    rows = S.with_errors(_matched(spark, folder), "value")
    return rows.select("rec", "id_detected", "id_reference", *[c for c in rows.columns if c.startswith("value__")])


@query("detected reference", _OVERLAP + f""" SELECT {rd('avg(dv - rv)', 'mean')}, {rd('quantile_cont(dv - rv, 0.05)', 'quantile_lower')}, {rd('quantile_cont(dv - rv, 0.95)', 'quantile_upper')}, {rd('avg(dv - rv) - 1.96 * stddev_samp(dv - rv)', 'loa_lower')}, {rd('avg(dv - rv) + 1.96 * stddev_samp(dv - rv)', 'loa_upper')},
{rd('avg(dv - rv) - 1.96 * stddev_samp(dv - rv) / sqrt(count(*))', 'ci_lower')}, {rd('avg(dv - rv) + 1.96 * stddev_samp(dv - rv) / sqrt(count(*))', 'ci_upper')}, count(*) AS n_datapoints FROM p""")
def error_aggs(spark, folder):
    return S.error_statistics(S.with_errors(_matched(spark, folder), "value"), [], "value__error")


@query("detected reference", _OVERLAP + """, a AS (SELECT count(*) AS n, avg(dv) AS md, avg(rv) AS mr, avg((dv + rv) / 2) AS mm, any_value(1) AS one FROM p),
b AS (SELECT n, sum(2 * power((dv + rv) / 2 - mm, 2)) / (n - 1) AS msr, n * (power(md - mm, 2) + power(mr - mm, 2)) AS msc, sum(power(dv - (dv + rv) / 2 - md + mm, 2) + power(rv - (dv + rv) / 2 - mr + mm, 2)) / (n - 1) AS mse FROM p, a GROUP BY n, md, mr, mm)
SELECT n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n) + 1e-9, 6) AS icc FROM b""")
def icc(spark, folder):
    return S.icc(_matched(spark, folder), [], "value__reference", "value__detected")


_SHARE = "list_sum(list_transform(range(40001), lambda i: CASE WHEN i = 0 THEN 0 ELSE CASE WHEN i = 40000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(x * i / 40000) + (b - 1) * ln(1 - x * i / 40000)) END)) * x / 120000"


@query("detected reference", _OVERLAP + f""", m AS (SELECT count(*)::DOUBLE AS n, avg(dv) AS md, avg(rv) AS mr, avg((dv + rv) / 2) AS mm FROM p),
s AS (SELECT n, sum(2 * power((dv + rv) / 2 - mm, 2)) / (n - 1) AS msr, n * (power(md - mm, 2) + power(mr - mm, 2)) AS msc, sum(power(dv - (dv + rv) / 2 - md + mm, 2) + power(rv - (dv + rv) / 2 - mr + mm, 2)) / (n - 1) AS mse FROM p, m GROUP BY n, md, mr, mm),
v AS (SELECT *, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM s),
f AS (SELECT *, (n - 1) * power(2 * icc * msc / mse + n * (1 + icc) - 2 * icc, 2) / ((n - 1) * 4 * power(icc * msc / mse, 2) + power(n * (1 + icc) - 2 * icc, 2)) AS dof FROM v),
q AS (SELECT 0 AS k, side, CASE side WHEN 'up' THEN n - 1 ELSE dof END / 2 AS a, CASE side WHEN 'up' THEN dof ELSE n - 1 END / 2 AS b, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM f, (VALUES ('up'), ('down')) z(side)
  UNION ALL SELECT k + 1, side, a, b, CASE WHEN under THEN x ELSE lo END, CASE WHEN under THEN hi ELSE x END FROM (SELECT *, {_SHARE} < 0.975 AS under FROM (SELECT *, (lo + hi) / 2 AS x FROM q WHERE k < 45))),
e AS (SELECT max(b / a * lo / (1 - lo)) FILTER (side = 'up') AS up, max(b / a * lo / (1 - lo)) FILTER (side = 'down') AS down FROM q WHERE k = 45)
SELECT n::BIGINT AS n, {rd('icc', 'icc')}, {rd('n * (msr - up * mse) / (up * (2 * msc + (n - 2) * mse) + n * msr)', 'icc_ci_lower')}, {rd('n * (down * msr - mse) / (2 * msc + (n - 2) * mse + n * down * msr)', 'icc_ci_upper')} FROM f, e""")
def icc_ci(spark, folder):
    return S.icc(_matched(spark, folder), [], "value__reference", "value__detected", interval=True)


_NEAREST = """, d AS (SELECT rec, id, ic + (id % 5) * 200 + CASE WHEN id % 4 = 0 THEN 9000 ELSE 0 END AS ic FROM contacts), r AS (SELECT rec, id, ic FROM contacts),
pairs AS (SELECT d.rec, d.id AS di, r.id AS ri, abs(d.ic - r.ic) AS far, d.ic AS dic, r.ic AS ric FROM d JOIN r ON d.rec = r.rec),
nd AS (SELECT *, row_number() OVER (PARTITION BY rec, di ORDER BY far, ric, ri) AS k FROM pairs), nr AS (SELECT *, row_number() OVER (PARTITION BY rec, ri ORDER BY far, dic, di) AS k FROM pairs),
p AS (SELECT nd.rec, nd.di, nd.ri FROM nd JOIN nr ON nd.rec = nr.rec AND nd.di = nr.di AND nd.ri = nr.ri WHERE nd.k = 1 AND nr.k = 1 AND nd.far <= 5000),
m AS (SELECT rec, di AS id_detected, ri AS id_reference, 'tp' AS match_type FROM p UNION ALL SELECT rec, id, NULL, 'fp' FROM d WHERE (rec, id) NOT IN (SELECT rec, di FROM p) UNION ALL SELECT rec, NULL, id, 'fn' FROM r WHERE (rec, id) NOT IN (SELECT rec, ri FROM p))"""


def _nearest(spark, folder):
    c = view(spark, folder, "contacts")
    d = c.withColumn("ic", F.col("ic") + (F.col("id") % 5) * 200 + F.when(F.col("id") % 4 == 0, 9000).otherwise(0))
    return I.match_nearest(d, c, BY, "ic", 5000)


@query("contacts", _NEAREST + " SELECT * FROM m")
def match_nearest(spark, folder):
    return _nearest(spark, folder)


@query("contacts", _NEAREST + """, q AS (SELECT rec, count(*) FILTER (match_type = 'tp')::DOUBLE AS tp, count(*) FILTER (match_type = 'fp')::DOUBLE AS fp, count(*) FILTER (match_type = 'fn')::DOUBLE AS fn FROM m GROUP BY rec),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM q)
SELECT rec, tp, fp, fn, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) + 1e-9, 6) AS f1_score FROM x""")
def ic_scores(spark, folder):
    return S.event_scores(_nearest(spark, folder), BY)


@query("contacts", 'SELECT * FROM (SELECT rec, id, lr_label, ic AS "start", lead(ic) OVER (PARTITION BY rec, lr_label ORDER BY ic) AS "end" FROM contacts) WHERE "end" IS NOT NULL')
def stride_list(spark, folder):
    return B.strides_per_foot(view(spark, folder, "contacts"), BY, ident="id").drop("ic")


@query("strides", """SELECT s_id, CASE WHEN NOT (("end" - "start") / 10000.0 > 0.2 AND ("end" - "start") / 10000.0 <= 3) THEN 'stride_duration_thres' WHEN NOT coalesce(stride_length_m > 0.15, false) THEN 'stride_length_thres' END AS exclusion_reason FROM strides""")
def stride_selection(spark, folder):
    return B.select_strides(view(spark, folder, "strides"), 10_000).select("s_id", "exclusion_reason")


_BOUTS = """, n AS (SELECT *, CASE WHEN ("start" - lag("end") OVER w) / 10000.0 > 3 THEN 1 ELSE 0 END AS brk FROM strides WINDOW w AS (PARTITION BY rec ORDER BY "start", "end", s_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY rec ORDER BY "start", "end", s_id) AS pre_bout FROM n), z AS (SELECT rec, pre_bout, count(*) AS size, min("start") AS s0, max("end") AS e1, avg(stride_length_m) AS sl FROM i GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pre_bout) - 1 AS wb_id FROM z WHERE size >= 4)"""


@query("strides", _BOUTS + " SELECT rec, s_id, CAST(pre_bout AS BIGINT) AS pre_bout, wb_id, CASE WHEN wb_id IS NULL THEN 'min_strides' END AS bout_reason FROM i LEFT JOIN g USING (rec, pre_bout)")
def wb_assembly(spark, folder):
    rows = B.assemble_bouts(view(spark, folder, "strides"), BY, 10_000)
    return rows.select("rec", "s_id", F.col("pre_bout").cast("long"), F.col("wb_id").cast("long"), "bout_reason")


@query("strides contacts", _BOUTS + """ SELECT g.rec, wb_id, s0 AS "start", e1 AS "end", size AS n_strides, round(sl + 1e-9, 6) AS stride_length_m, round((e1 - s0) / 10000.0::DOUBLE + 1e-9, 6) AS duration_s,
(SELECT count(*) FROM contacts c WHERE c.rec = g.rec AND c.ic BETWEEN s0 AND e1) AS n_raw_initial_contacts FROM g""")
def wb_meta(spark, folder):
    rows = B.assemble_bouts(view(spark, folder, "strides"), BY, 10_000)
    found = B.bout_summary(rows, BY, 10_000, view(spark, folder, "contacts"), means=("stride_length_m",))
    return found.withColumn("wb_id", F.col("wb_id").cast("long"))


@query("contacts", 'SELECT rec, min(ic) AS "start", max(ic) + 1 AS "end" FROM contacts GROUP BY rec')
def refine_regions(spark, folder):
    return B.refine_regions(view(spark, folder, "contacts"), BY)


@query("bouts", """SELECT wb_id, b.bin FROM bouts JOIN (VALUES ('all', -1.0, 1e9), ('10-30', 10, 30), ('over 10', 10, 1e9), ('over 30', 30, 1e9), ('over 60', 60, 1e9)) b(bin, lo, hi) ON duration_s > lo AND duration_s <= hi""")
def overlapping_bins(spark, folder):
    bins = {"all": (-1.0, 1e9), "10-30": (10, 30), "over 10": (10, 1e9), "over 30": (30, 1e9), "over 60": (60, 1e9)}
    return I.overlapping_bins(view(spark, folder, "bouts"), "duration_s", bins).select("wb_id", "bin")


@query("reference contacts", """SELECT r.rec, r.id, round(avg(c.id) + 1e-9, 6) AS id2_mean FROM reference r LEFT JOIN (SELECT rec AS crec, id, ic FROM contacts) c ON crec = rec AND ic BETWEEN "start" AND "end" GROUP BY ALL""")
def interval_mean(spark, folder):
    c = view(spark, folder, "contacts").withColumnRenamed("id", "id2")
    return I.interval_mean(view(spark, folder, "reference"), c, BY, "ic", "id2")


@query("", """, reg AS (SELECT rec, sample AS wb_id, sample * 3 AS "start", sample * 3 + 5 + sample % 7 AS "end" FROM series)
SELECT g.rec, g.wb_id, count(*) AS n, CAST(sum(s.sample - g."start") AS BIGINT) AS offsets, round(sum(s.value) + 1e-9, 6) AS value FROM reg g JOIN series s ON s.rec = g.rec AND s.sample >= g."start" AND s.sample < g."end" GROUP BY ALL""")
def region_samples(spark, folder):
    s, at = series(spark, folder), F.col("sample")
    regions = s.select("rec", at.alias("wb_id"), (at * 3).alias("start"), (at * 3 + 5 + at % 7).alias("end"))
    inside = B.regions_of(s, regions, BY, bucket=64)
    return inside.groupBy("rec", "wb_id").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"), F.sum("value").alias("value"))


@query("", """, m AS (SELECT *, list(value) OVER w AS near, median(value) OVER w AS mid FROM series WINDOW w AS (PARTITION BY rec ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT rec, sample, round(value + 1e-9, 6) AS value, round(CASE WHEN abs(value - mid) > 2 * 1.4826 * list_aggregate([abs(x - mid) FOR x IN near], 'median') THEN mid ELSE value END + 1e-9, 6) AS filtered FROM m""")
def hampel(spark, folder):
    return R.hampel(series(spark, folder).drop("centred"), BY, "sample", "value", 3, 2.0)


@query("", """, h AS (SELECT rec, sample, CASE WHEN sample % 7 NOT IN (2, 3) AND sample % 31 NOT BETWEEN 10 AND 16 THEN value END AS v FROM series),
k AS (SELECT rec, sample AS p0, v AS v0, lead(sample) OVER w AS p1, lead(v) OVER w AS v1 FROM h WHERE v IS NOT NULL WINDOW w AS (PARTITION BY rec ORDER BY sample))
SELECT h.rec, h.sample, round(v + 1e-9, 6) AS v, round(CASE WHEN v IS NOT NULL THEN v WHEN p1 - p0 - 1 <= 3 THEN v0 + (v1 - v0) * (h.sample - p0) / (p1 - p0) END + 1e-9, 6) AS filled FROM h LEFT JOIN k ON h.rec = k.rec AND h.sample > p0 AND h.sample < p1""")
def gap_interpolate(spark, folder):
    v = F.when(~(F.col("sample") % 7).isin(2, 3) & ~(F.col("sample") % 31).between(10, 16), F.col("value"))
    rows = series(spark, folder).select("rec", "sample", v.alias("v"))
    return R.interpolate_gaps(rows, BY, "sample", "v", 3)


@query("", """, s AS (SELECT rec, sample, value AS v, sum(value) OVER (PARTITION BY rec ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM series),
reg AS (SELECT rec, sample AS id, sample * 100 + sample % 53 AS "start", sample * 100 + sample % 53 + 150 + sample % 97 AS "end" FROM series), n AS (SELECT rec, count(*) AS n FROM series GROUP BY rec),
a AS (SELECT reg.*, n, least("start" // 100, n - 1) AS k0, least("end" // 100, n - 1) AS k1 FROM reg JOIN n USING (rec))
SELECT a.rec, a.id, a."start", a."end", CASE WHEN "end" <= n * 100 THEN round(((coalesce(y.upto, 0) + ("end" / 100.0 - k1) * y.v) - (coalesce(x.upto, 0) + ("start" / 100.0 - k0) * x.v)) * 100 / ("end" - "start") + 1e-9, 6) END AS v FROM a JOIN s x ON x.rec = a.rec AND x.sample = k0 JOIN s y ON y.rec = a.rec AND y.sample = k1""")
def sec_to_stride(spark, folder):
    s = series(spark, folder)
    at = F.col("sample")
    regions = s.select("rec", at.alias("id"), (at * 100 + at % 53).alias("start"), (at * 100 + at % 53 + 150 + at % 97).alias("end"))
    seconds = s.select("rec", (at * 100 + 50).alias("sec_center_samples"), F.col("value").alias("v"))
    return R.seconds_to_regions(regions, seconds, BY, ["v"], 100)


@query("contacts", """, b AS (SELECT rec, ic // 100 AS second, id FROM contacts UNION ALL SELECT rec, ic // 100 - 1, id FROM contacts WHERE ic % 100 = 0)
SELECT rec, second, round(avg(id) + 1e-9, 6) AS id, CAST((second + 0.5) * 100 AS BIGINT) AS sec_center_samples FROM b WHERE second >= 0 GROUP BY rec, second""")
def per_second_means(spark, folder):
    return R.seconds_of(view(spark, folder, "contacts"), BY, "ic", "id", 100).select("rec", "second", "id", "sec_center_samples")


@query("", """SELECT rec, round(sample + abs(centred / (centred - nxt)) + 1e-9, 6) AS crossing, centred < 0 AS rising FROM (SELECT *, lead(centred) OVER (PARTITION BY rec ORDER BY sample) AS nxt FROM series) WHERE nxt IS NOT NULL AND (centred < 0) <> (nxt < 0)""")
def zero_crossings(spark, folder):
    return R.zero_crossings(series(spark, folder), BY, "sample", "centred")


@query("", """, x AS (SELECT *, CASE WHEN (centred < 0) <> lag(centred < 0) OVER w THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY rec ORDER BY sample)), y AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY sample) AS run FROM x),
z AS (SELECT *, max(run) OVER (PARTITION BY rec) AS last FROM y) SELECT rec, arg_min(sample, (centred, sample)) AS ic FROM z WHERE centred < 0 AND run > 0 AND run < last GROUP BY rec, run""")
def minima_between_crossings(spark, folder):
    return R.minima_between_crossings(series(spark, folder), BY, "sample", "centred")


@query("", """SELECT rec, "window", round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std, count(*) AS n, stddev_pop(value) > 25 AS active FROM series JOIN (SELECT rec AS r, unnest(range(0, max(sample) + 1)) AS "window" FROM series GROUP BY rec) ON r = rec AND sample >= "window" * 5 AND sample < "window" * 5 + 10
GROUP BY rec, "window" HAVING count(*) = 10""")
def sliding_window_gates(spark, folder):
    return R.windowed_gates(I.sliding_windows(series(spark, folder), BY, "sample", 10, 5), BY, "value", 25)


@query("", """SELECT rec, sample, round(coalesce((nxt - prv) / 2, nxt - value, value - prv) + 1e-9, 6) AS gradient FROM (SELECT *, lag(value) OVER w AS prv, lead(value) OVER w AS nxt FROM series WINDOW w AS (PARTITION BY rec ORDER BY sample))""")
def gradient(spark, folder):
    return R.gradient(series(spark, folder), BY, "sample", "value").select("rec", "sample", "gradient")


@query("", """, f AS (SELECT *, centred > 0 AS up FROM series), g AS (SELECT *, sample - row_number() OVER (PARTITION BY rec ORDER BY sample) AS island FROM f WHERE up) SELECT rec, min(sample) AS "start", max(sample) + 1 AS "end" FROM g GROUP BY rec, island""")
def bool_runs(spark, folder):
    return I.runs_of(series(spark, folder).withColumn("up", F.col("centred") > 0), BY, "up")


@query("", """SELECT event_id, round(-value + 1e-9, 6) AS acc_x, round(event_id % 10 + 1e-9, 6) AS acc_y, round(value * 2 + 1e-9, 6) AS acc_z, CAST(event_id % 3 AS BIGINT) AS gyr_x, CAST(event_id % 4 AS BIGINT) AS gyr_y, CAST(-(event_id % 5) AS BIGINT) AS gyr_z FROM events""")
def frame_flip(spark, folder):
    imu = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", "value AS acc_z", "CAST(event_id % 10 AS DOUBLE) AS acc_y", "value * 2 AS acc_x", "event_id % 5 AS gyr_x", "event_id % 4 AS gyr_y", "event_id % 3 AS gyr_z")
    turned = C.flip(imu, [[0, 0, 1], [0, 1, 0], [-1, 0, 0]])
    body = C.to_sensor_frame(C.to_body_frame(turned))
    return body.select("event_id", (-F.col("acc_x")).alias("acc_x"), "acc_y", (-F.col("acc_z")).alias("acc_z"), "gyr_x", "gyr_y", "gyr_z")


@query("bouts", f"SELECT wb_id, {rd('stride_length_m * cadence_spm / 120', 'walking_speed_mps')} FROM bouts")
def walking_speed(spark, folder):
    return view(spark, folder, "bouts").select("wb_id", C.walking_speed(F.col("stride_length_m"), F.col("cadence_spm")).alias("walking_speed_mps"))


@query("bouts", f"""SELECT cohort, {rd('(m0 - m) / sqrt(v / n + v0 / n0)', 't')}, {rd('power(v / n + v0 / n0, 2) / (power(v / n, 2) / (n - 1) + power(v0 / n0, 2) / (n0 - 1))', 'dof')} FROM (SELECT cohort, avg(duration_s) AS m, var_samp(duration_s) AS v, count(duration_s) AS n FROM bouts WHERE cohort <> 'HA' GROUP BY cohort),
(SELECT avg(duration_s) AS m0, var_samp(duration_s) AS v0, count(duration_s) AS n0 FROM bouts WHERE cohort = 'HA')""")
def pairwise_welch_t(spark, folder):
    return S.pairwise_welch(view(spark, folder, "bouts"), "cohort", "duration_s", "HA")


@query("bouts", """, g AS (SELECT cohort, avg(duration_s) AS m, var_samp(duration_s) AS v, count(duration_s) AS n FROM bouts WHERE duration_s IS NOT NULL GROUP BY cohort),
w AS (SELECT g.cohort, (r.m - g.m) / sqrt(g.v / g.n + r.v / r.n) AS t, CASE WHEN g.n = r.n THEN g.n + r.n - 2 ELSE power(g.v / g.n + r.v / r.n, 2) / (power(g.v / g.n, 2) / (g.n - 1) + power(r.v / r.n, 2) / (r.n - 1)) END::DOUBLE AS dof FROM g, g r WHERE r.cohort = 'HA' AND g.cohort <> 'HA'),
k AS (SELECT *, unnest(range(4001)) AS i FROM w),
d AS (SELECT cohort, t, dof, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(dof * pi()) / 2 - (dof + 1) / 2 * ln(1 + power(t * i / 4000, 2) / dof)) AS part FROM k)
SELECT cohort, round(t + 1e-9, 6) AS t, round(dof + 1e-9, 6) AS dof, round(1 - 2 * sum(part) * abs(t) / 4000 / 3 + 1e-9, 6) AS p FROM d GROUP BY cohort, t, dof""")
def welch_p(spark, folder):
    return S.pairwise_tests(view(spark, folder, "bouts"), "cohort", "duration_s", "HA")


@query("", "SELECT event_type, " + ", ".join(f"count(*) FILTER (event_id % 6 = {i}) AS {c}" for i, c in enumerate(COHORTS)) + " FROM events GROUP BY event_type")
def confusion_matrix(spark, folder):
    labels = F.element_at(F.array(*map(F.lit, COHORTS)), (F.col("event_id") % 6 + 1).cast("int"))
    return S.confusion(spark.read.parquet(f"{folder}/events.parquet").withColumn("label", labels), "event_type", "label", COHORTS)


@query("bouts", """SELECT participant_id, measurement_date, CAST(count(wb_id) AS BIGINT) AS n_wb, round(avg(cadence_spm) + 1e-9, 6) AS cadence, any_value(t.total) AS total FROM bouts JOIN (SELECT participant_id, count(*) AS total FROM bouts GROUP BY participant_id) t USING (participant_id) GROUP BY participant_id, measurement_date""")
def multilevel_merge(spark, folder):
    b = view(spark, folder, "bouts")
    return S.multilevel(b, [(["participant_id", "measurement_date"], [F.count("wb_id").alias("n_wb"), F.avg("cadence_spm").alias("cadence")]), (["participant_id"], [F.count("*").alias("total")])])


@query("contacts", """, l AS (SELECT rec, ic, lr_label AS ref, CASE WHEN id % 7 < 3 THEN 'left' ELSE 'right' END AS det FROM contacts), x AS (SELECT *, ((ref <> lag(ref) OVER w) = (det <> lag(det) OVER w))::INT::DOUBLE AS same FROM l WINDOW w AS (PARTITION BY rec ORDER BY ic))
SELECT rec, round(avg((ref = det)::INT::DOUBLE) + 1e-9, 6) AS accuracy, round(avg(same) + 1e-9, 6) AS accuracy_pairwise FROM x GROUP BY rec""")
def laterality_scores(spark, folder):
    c = view(spark, folder, "contacts").withColumn("det", F.when(F.col("id") % 7 < 3, "left").otherwise("right"))
    return S.laterality_scores(c, BY, "ic", "lr_label", "det", "id")


@query("", """SELECT user_id AS rec, event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE user_id % 3 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'Europe/London' ELSE 'Asia/Jerusalem' END, '%Y-%m-%d') AS local_date FROM events""")
def local_date_by_site(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    sites = spark.createDataFrame([(0, "Europe/Berlin"), (1, "Europe/London"), (2, "Asia/Jerusalem")], "site long, tz string")
    # three rows
    joined = events.withColumn("site", F.col("user_id") % 3).join(F.broadcast(sites), "site")
    return joined.select(F.col("user_id").alias("rec"), "event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.col("tz")), "yyyy-MM-dd").alias("local_date"))


@query("", """SELECT user_id AS rec, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def nested_metadata(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(F.col("user_id").alias("rec"), F.from_json("props", "k bigint")["k"].alias("k")).groupBy("rec", "k").agg(F.count("*").alias("n"))


@query("", f"""SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, {rd('sum(l_quantity)', 'quantity')}, {rd('median(l_quantity)', 'median')}, {rd('quantile_cont(l_quantity, 0.9)', 'p90')} FROM lineitem GROUP BY ALL""")
def supplier_months(spark, folder):
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    q = F.col("l_quantity").cast("double")
    return items.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(q).alias("quantity"), F.median(q).alias("median"), F.percentile(q, 0.9).alias("p90"))


@query("contacts", """, d AS (SELECT rec, id, ic + (id % 5) * 200 AS ic FROM contacts), r AS (SELECT rec, id, ic FROM contacts),
s AS (SELECT rec, avg(step) / 100.0 AS step_s FROM (SELECT rec, ic - lag(ic) OVER (PARTITION BY rec ORDER BY ic) AS step FROM r) GROUP BY rec)
SELECT d.rec, round(avg(abs(d.ic - r.ic) / 100.0) + 1e-9, 6) AS tp_absolute_timing_error_s, round(avg(abs(d.ic - r.ic) / 100.0 / step_s) + 1e-9, 6) AS tp_relative_timing_error FROM d JOIN r ON d.rec = r.rec AND d.id = r.id JOIN s ON s.rec = d.rec GROUP BY d.rec""")
def ic_timing_errors(spark, folder):
    c = view(spark, folder, "contacts").withColumn("bout", F.lit(0))
    r = c
    d = c.select("rec", "id", (F.col("ic") + (F.col("id") % 5) * 200).alias("ic__detected"))
    matched = d.join(r.select("rec", "id", "bout", F.col("ic").alias("ic__reference")), ["rec", "id"])
    return S.timing_errors(r, matched, BY, "bout", 100)


@query("contacts reference", """SELECT c.rec, c.id, c.ic - r."start" AS ic FROM contacts c JOIN reference r ON r.rec = c.rec AND r.id = c.id""")
def relative_to_region(spark, folder):
    moved = I.relative_to(view(spark, folder, "contacts"), view(spark, folder, "reference"), ["rec", "id"], ["ic"])
    return moved.select("rec", "id", "ic")


@query("bouts", """SELECT cohort, CASE WHEN cohort IN ('HA', 'COPD', 'CHF') THEN 'regular' ELSE 'impaired' END AS settings, count(*) AS n, round(avg(duration_s) + 1e-9, 6) AS duration_s FROM bouts GROUP BY ALL""")
def cohort_route(spark, folder):
    from ambulo.plans import walking as W

    names = {c: tag for tag, s in (("regular", W.REGULAR), ("impaired", W.IMPAIRED)) for c in s.cohorts}
    routes = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return view(spark, folder, "bouts").groupBy("cohort", routes[F.col("cohort")].alias("settings")).agg(F.count("*").alias("n"), F.avg("duration_s").alias("duration_s"))


@query("detected reference", """SELECT d.rec, CAST(count(DISTINCT d.id) AS BIGINT) AS n_detected, CAST((SELECT count(*) FROM reference r WHERE r.rec = d.rec AND r.value > 400) AS BIGINT) AS n_reference FROM detected d GROUP BY d.rec""")
def multi_groupby_left(spark, folder):
    import pandas as pd

    d, r = view(spark, folder, "detected").select("rec", "id"), view(spark, folder, "reference").where("value > 400").select("rec", "id")
    count = lambda x, y: pd.DataFrame({"rec": [x.rec.iloc[0]], "n_detected": [len(x)], "n_reference": [len(y)]})
    return S.apply_with(d, r, BY, count, "rec long, n_detected long, n_reference long")


@query("bouts", """, a AS (SELECT participant_id, avg(duration_s)::DOUBLE AS mean, median(duration_s)::DOUBLE AS mid, count(duration_s)::DOUBLE AS n FROM bouts GROUP BY participant_id)
SELECT participant_id, aggregation, round(value + 1e-9, 6) AS value FROM (UNPIVOT a ON mean, mid, n INTO NAME aggregation VALUE value)""")
def aggregates_long(spark, folder):
    from ambulo.operators import evaluation as E

    return E.aggregate_long(view(spark, folder, "bouts"), ["participant_id"], {"mean": F.avg("duration_s"), "mid": F.median("duration_s"), "n": F.count("duration_s")})


@query("", """SELECT event_id, o.orientation, round(value * o.a + (event_id % 10) * o.b + 1e-9, 6) AS acc_is, round(value * o.c + (event_id % 10) * o.d + 1e-9, 6) AS acc_ml, round(value * 2 * o.e + 1e-9, 6) AS acc_pa FROM events,
(VALUES ('identity', 1, 0, 0, 1, 1), ('pa_normal__rot_pa_pos90', 0, -1, 1, 0, 1), ('pa_normal__rot_pa_180', -1, 0, 0, -1, 1), ('pa_normal__rot_pa_neg90', 0, 1, -1, 0, 1),
('pa_flipped__rot_pa_0', 1, 0, 0, -1, -1), ('pa_flipped__rot_pa_pos90', 0, 1, 1, 0, -1), ('pa_flipped__rot_pa_180', -1, 0, 0, 1, -1), ('pa_flipped__rot_pa_neg90', 0, -1, -1, 0, -1)) o(orientation, a, b, c, d, e)""")
def misoriented(spark, folder):
    from ambulo.operators import evaluation as E

    imu = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", "value AS acc_is", "CAST(event_id % 10 AS DOUBLE) AS acc_ml", "value * 2 AS acc_pa")
    return E.misoriented(imu, sensors=("acc",)).select("event_id", "orientation", "acc_is", "acc_ml", "acc_pa")


@query("", """SELECT event_id, round(cos(a) * value - sin(a) * (event_id % 10) + 1e-9, 6) AS acc_gx, round(sin(a) * value + cos(a) * (event_id % 10) + 1e-9, 6) AS acc_gy, round(value * 2 + 1e-9, 6) AS acc_gz FROM (SELECT *, (event_id % 7) / 7.0::DOUBLE AS a FROM events)""")
def global_frame(spark, folder):
    imu = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", "value AS acc_x", "CAST(event_id % 10 AS DOUBLE) AS acc_y", "value * 2 AS acc_z")
    turned = C.rotate(imu.withColumn("q", C.quaternion_about((0, 0, 1), (F.col("event_id") % 7) / 7.0)), "q", sensors=("acc",))
    return turned.drop("q")


@query("", """SELECT rec, round(avg(value) + 1e-9, 6) AS value, CASE WHEN abs(avg(value)) > 50 THEN CASE WHEN avg(value) > 0 THEN '+value' ELSE '-value' END WHEN abs(avg(centred)) > 50 THEN CASE WHEN avg(centred) > 0 THEN '+centred' ELSE '-centred' END END AS gravity, round(avg(centred) + 1e-9, 6) AS centred FROM series GROUP BY rec""")
def gravity_vote(spark, folder):
    return R.gravity_axis(series(spark, folder), BY, ("value", "centred"), 50)


@query("bouts", """SELECT participant_id, wb_id, round(duration_s + 1e-9, 6) AS duration_s FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY duration_s DESC NULLS LAST, wb_id) AS k FROM bouts) WHERE k = 1""")
def best_bout(spark, folder):
    from ambulo.operators import evaluation as E

    return E.best_in_group(view(spark, folder, "bouts").select("participant_id", "wb_id", "duration_s"), ["participant_id"], "duration_s")


@query("contacts", """SELECT rec, ic // 1000 AS ic, CASE WHEN count(DISTINCT lr_label) = 1 THEN min(lr_label) END AS lr_label FROM contacts GROUP BY rec, ic // 1000""")
def clean_contacts(spark, folder):
    rows = view(spark, folder, "contacts").withColumn("ic", F.floor(F.col("ic") / 1000))
    return L.clean_contacts(rows, BY)


@query("strides", _BOUTS + """, k AS (SELECT *, coalesce(lead(brk) OVER (PARTITION BY rec ORDER BY "start", "end", s_id), 0) AS nxt FROM i), zz AS (SELECT rec, pre_bout, count(*) AS size FROM k WHERE nxt = 0 GROUP BY ALL)
SELECT rec, CAST(pre_bout AS BIGINT) AS pre_bout, size, size < 4 AS voided FROM zz""")
def wb_assembly_trimmed(spark, folder):
    rows = B.assemble_bouts(view(spark, folder, "strides"), BY, 10_000, drop_last=True)
    return rows.groupBy("rec", F.col("pre_bout").cast("long").alias("pre_bout")).agg(F.count("*").alias("size"), F.max(F.col("wb_id").isNull()).alias("voided"))


@query("strides", _BOUTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY rec, pre_bout ORDER BY "start" DESC, "end" DESC, s_id DESC) AS back FROM i),
z2 AS (SELECT rec, pre_bout, count(*) AS size, max(lr_label) FILTER (back = 1) AS foot1, max(lr_label) FILTER (back = 2) AS foot2 FROM p GROUP BY ALL),
t AS (SELECT p.*, size - back + 1 AS k, CASE WHEN size < 3 THEN 1 WHEN foot1 <> foot2 THEN size - 2 ELSE size - 1 END AS keep FROM p JOIN z2 USING (rec, pre_bout)),
v AS (SELECT rec, pre_bout, count(*) FILTER (lr_label = 'left') >= 2 AS ok FROM t WHERE k <= keep GROUP BY ALL),
n2 AS (SELECT rec, pre_bout, row_number() OVER (PARTITION BY rec ORDER BY pre_bout) - 1 AS wb FROM v WHERE ok)
SELECT t.rec, t.s_id, CASE WHEN k <= keep THEN CAST(t.pre_bout AS BIGINT) END AS pre_bout, CASE WHEN k <= keep THEN n2.wb END AS wb_id, 'max_break' AS end_rule, CASE WHEN k <= keep AND n2.wb IS NULL THEN 'few_left' END AS exclude_rule
FROM t LEFT JOIN n2 ON n2.rec = t.rec AND n2.pre_bout = t.pre_bout""")
def wb_rules(spark, folder):
    from ambulo.operators import rules as W

    rules = {"max_break": W.MaxBreak(3, trim="per_foot"), "few_left": W.MinStrides(left=2)}
    return W.assemble_by_rules(view(spark, folder, "strides"), BY, rules, 10_000).select("rec", "s_id", "pre_bout", "wb_id", "end_rule", "exclude_rule")


_STRIDES = "SELECT user_id AS rec, event_id % 40 AS wb_id, CASE WHEN event_id % 13 <> 0 THEN 1 + (event_id % 7) / 1e1 END AS duration_s, 6e1 + event_id % 59 AS cadence_spm, CASE WHEN event_id % 17 <> 0 THEN 8e-1 + (event_id % 9) / 1e1 END AS length_m, 7e-1 + (event_id % 11) / 1e1 AS stride_length_m FROM events"
_OWN = "SELECT user_id AS rec, event_id % 40 AS wb_id, max(7e1 + event_id % 37) AS avg_cadence_spm, max(9e-1 + (event_id % 5) / 1e1) AS avg_stride_length_m FROM events GROUP BY user_id, event_id % 40"
_PARTS = ("d", "r", "d - r", "(d - r) / nullif(r, 0)", "abs(d - r)", "abs((d - r) / nullif(r, 0))")


def _scorer_sql(stride_columns: str, own: str) -> str:
    names = ("detected", "reference", "error", "rel_error", "abs_error", "abs_rel_error")
    means = lambda prefix: ", ".join(rd(f"avg({p})", f"{prefix}__{n}") for p, n in zip(_PARTS, names, strict=True))
    return f""", s AS (SELECT rec, wb_id, {stride_columns} FROM ({_STRIDES})), k AS (SELECT * FROM s WHERE r IS NOT NULL), o AS (SELECT rec, wb_id, {own} AS r FROM ({_OWN})),
b AS (SELECT k2.rec, k2.wb_id, k2.d, o.r FROM (SELECT rec, wb_id, avg(d) AS d FROM k GROUP BY ALL) k2 LEFT JOIN o USING (rec, wb_id)),
x AS (SELECT rec, {means('stride')} FROM k GROUP BY rec), y AS (SELECT rec, {means('wb')} FROM b GROUP BY rec) SELECT * FROM x JOIN y USING (rec)"""


def _scored(spark, folder):
    spark.read.parquet(f"{folder}/events.parquet").createOrReplaceTempView("events__")
    return spark.sql(_STRIDES.replace("FROM events", "FROM events__")), spark.sql(_OWN.replace("FROM events", "FROM events__"))


@query("", _scorer_sql("cadence_spm AS d, 120 / duration_s AS r", "avg_cadence_spm"))
def scorer_cadence(spark, folder):
    from ambulo.plans import scoring

    return scoring.cadence_scores(*_scored(spark, folder), BY)


@query("", _scorer_sql("stride_length_m AS d, length_m AS r", "avg_stride_length_m"))
def scorer_stride_length(spark, folder):
    from ambulo.plans import scoring

    return scoring.stride_length_scores(*_scored(spark, folder), BY)


@query("detected reference", _OVERLAP + f""", md AS (SELECT rec, median(value) AS d FROM detected GROUP BY rec), mr AS (SELECT rec, median(value) AS r FROM reference GROUP BY rec),
c AS (SELECT md.rec, {", ".join(rd(p, f"combined__value__{n}") for p, n in zip(_PARTS, ("detected", "reference", "error", "rel_error", "abs_error", "abs_rel_error"), strict=True))} FROM md JOIN mr USING (rec)),
q AS (SELECT rec, count(*) AS matched__n_matched_wbs, {", ".join(rd(f"avg({p})", f"matched__value__{n}") for p, n in zip(_PARTS, ("detected", "reference", "error", "rel_error", "abs_error", "abs_rel_error"), strict=True))} FROM (SELECT rec, dv AS d, rv AS r FROM p) GROUP BY rec)
SELECT c.*, coalesce(q.matched__n_matched_wbs, 0) AS matched__n_matched_wbs, q.* EXCLUDE (rec, matched__n_matched_wbs) FROM c LEFT JOIN q USING (rec)""")
def scorer_pipeline(spark, folder):
    from ambulo.plans import scoring

    return scoring.pipeline_scores(view(spark, folder, "detected"), view(spark, folder, "reference"), BY, "id", ("value",))


@query("bouts", f"""
, daily AS (SELECT {', '.join(KEYS)}, {_aggregate_sql()} FROM bouts GROUP BY ALL), wear AS (SELECT DISTINCT {', '.join(KEYS)}, CAST(8 + participant_id % 9 AS DOUBLE) AS h FROM bouts)
SELECT visit_type, participant_id, round_even(avg(round_even(walkdur_all_sum, 3)), 0) AS walkdur_all_sum_w, round_even(avg(wb_60_sum), 0) AS wb_60_sum_w, count(walkdur_all_sum) AS n_days_w FROM daily JOIN wear USING ({', '.join(KEYS)}) WHERE h > 12 GROUP BY ALL HAVING count(walkdur_all_sum) >= 3""")
def study_weeks(spark, folder):
    from ambulo.plans import cohort

    bouts = view(spark, folder, "bouts")
    hours = (8 + F.col("participant_id") % 9).cast("double")
    wear = bouts.select(*KEYS).distinct().withColumn("total_worn_h", hours).withColumn("total_worn_during_waking_h", hours)
    return cohort.study_tables(bouts, wear)["weekly_agg_filtered"].select("visit_type", "participant_id", "walkdur_all_sum_w", "wb_60_sum_w", "n_days_w")


@query("bouts", "SELECT participant_id, wb_id, measurement_date FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY measurement_date DESC, wb_id DESC) AS k FROM bouts) WHERE k = 1")
def last_bout(spark, folder):
    return D.keep_last(view(spark, folder, "bouts").select("participant_id", "wb_id", "measurement_date"), ["participant_id"], [F.col("measurement_date"), F.col("wb_id")])


@query("bouts", f"SELECT wb_id, {rd(_HEIGHT, 'longest_m')}, CAST(round_even(height_m * 12.5, 0) AS BIGINT) AS n_samples FROM bouts")
def longest_strides(spark, folder):
    return view(spark, folder, "bouts").select("wb_id", C.longest_stride(F.col("height_m")).alias("longest_m"), C.as_samples(F.col("height_m"), 12.5).alias("n_samples"))


_VISIT = "CASE event_id % 9 WHEN 0 THEN 'Baseline Visit (T1)' WHEN 1 THEN 'Follow-up (T2) - 6 months' WHEN 2 THEN 'Follow-up (T3)' WHEN 3 THEN 'Follow-up (T4)' WHEN 4 THEN 'Follow-up (T5)' WHEN 5 THEN 'Follow-up (T6)' WHEN 6 THEN 'Unscheduled Visit' WHEN 7 THEN 'Screening' END"


@query("", f"""SELECT event_id, CASE WHEN raw LIKE 'Baseline Visit%' THEN 'T1' WHEN raw LIKE 'Unscheduled Vi%' THEN 'UV' WHEN regexp_matches(raw, '^Follow-up \\(T[2-6]\\)') THEN raw[12:13] END AS visit_type FROM (SELECT event_id, {_VISIT} AS raw FROM events)""")
def visit_names(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", f"{_VISIT} AS raw")
    return events.select("event_id", L.visit_name(F.col("raw")).alias("visit_type"))


@query("", """, w AS (SELECT user_id AS rec, CAST(ts AS DATE) AS day, event_id, round_even(value / 10, 3) AS hours, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS k FROM events),
i AS (SELECT DISTINCT user_id AS rec, CAST(ts AS DATE) AS day FROM events UNION SELECT DISTINCT user_id, CAST(ts AS DATE) + 1 FROM events) SELECT i.rec, strftime(i.day, '%Y-%m-%d') AS day, round(w.hours + 1e-9, 6) AS hours FROM i LEFT JOIN w ON w.rec = i.rec AND w.day = i.day AND w.k = 1""")
def weartime_latest(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("rec"), F.to_date("ts").alias("day"), "event_id", (F.col("value") / 10).alias("hours"))
    days = events.select("rec", "day")
    # some days of the index have no report
    index = days.unionByName(days.withColumn("day", F.date_add("day", 1))).distinct()
    found = L.weartime_for(index, events, ["rec", "day"], "event_id")
    return found.select("rec", F.col("day").cast("string").alias("day"), "hours")


@query("", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 'sensors are missing: gyr' WHEN event_id % 4 = 1 THEN 'sensors are missing: acc' ELSE 'sensors are missing: acc, gyr' END AS sensor_warning FROM events""")
def sensor_warnings(spark, folder):
    held = F.expr("CASE event_id % 4 WHEN 3 THEN array('gyr', 'acc', 'mag') WHEN 2 THEN array('acc') WHEN 1 THEN array('gyr', 'bar') ELSE array() END")
    tests = spark.read.parquet(f"{folder}/events.parquet").select("event_id", held.cast("array<string>").alias("available_sensors"))
    return L.sensors_of(tests, ["acc", "gyr"], "warn").select("event_id", "sensor_warning")


def _statistics_sql() -> str:
    exact = {"detected": "dv", "reference": "rv", "abs_error": "abs(dv - rv)", "abs_rel_error": "abs((dv - rv) / nullif(rv, 0))"}
    signed = {"error": "dv - rv", "rel_error": "(dv - rv) / nullif(rv, 0)"}
    rows = ["SELECT 'all' AS measure, 'all' AS origin, 'n_datapoints' AS statistic, count(*)::DOUBLE AS value FROM p"]
    for origin, e in (exact | signed).items():
        ends = {"quantile_lower": f"quantile_cont({e}, 0.05)", "quantile_upper": f"quantile_cont({e}, 0.95)"} if origin in exact else {"loa_lower": f"avg({e}) - 1.96 * stddev_samp({e})", "loa_upper": f"avg({e}) + 1.96 * stddev_samp({e})"}
        rows += [f"SELECT 'value', '{origin}', '{k}', {v} FROM p" for k, v in ({"mean": f"avg({e})"} | ends).items()]
    return "SELECT measure, origin, statistic, round(value + 1e-9, 6) AS value FROM (" + " UNION ALL ".join(rows) + ")"


@query("detected reference", _OVERLAP + " " + _statistics_sql())
def default_statistics(spark, folder):
    return S.default_error_statistics(_matched(spark, folder), [], ("value",)).where("statistic NOT LIKE 'icc%'")


@query("contacts", """, b AS (SELECT rec, id % 20 AS part, id, ic, lr_label FROM contacts), o AS (SELECT rec, part, dense_rank() OVER (PARTITION BY rec ORDER BY part) - 1 AS wb_id, min(ic) AS first, max(ic) - 5000 AS last FROM b GROUP BY rec, part),
c AS (SELECT o.rec, o.wb_id, (b.ic // 400) * 4 AS sec, o.last, b.lr_label FROM b JOIN o ON o.rec = b.rec AND o.part = b.part)
SELECT rec, wb_id, sec * 100 - 1 AS ic, CASE WHEN count(DISTINCT lr_label) = 1 THEN any_value(lr_label) END AS lr_label FROM c WHERE sec * 100 <= last GROUP BY rec, wb_id, sec""")
def reference_contacts(spark, folder):
    from ambulo.sources import reference as P

    c = view(spark, folder, "contacts").withColumn("part", F.col("id") % 20).withColumn("at", (F.floor(F.col("ic") / 400) * 4).cast("double"))
    ics = F.sort_array(F.collect_list(F.struct("at", F.initcap("lr_label").alias("foot"))))
    bouts = c.groupBy("rec", "part").agg(F.min("ic").alias("a"), (F.max("ic") - 5000).alias("b"), ics.alias("ics"))
    given = {"Start": F.col("a") / 100, "End": F.col("b") / 100, "InitialContact_Event": F.col("ics.at"), "InitialContact_LeftRight": F.col("ics.foot")}
    names = [x.split(":")[0].strip() for x in P.WB.removeprefix("array<struct<").removesuffix(">>").split(", ")]
    wb = F.struct(F.col("part"), F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).alias("w"))
    rows = bouts.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(wb)), lambda x: x["w"]).cast(P.WB).alias("wb"))
    return P.reference_parameters(rows, BY, 100, 100).contacts.select("rec", "wb_id", "ic", "lr_label")


@query("", """, a AS (SELECT rec, sample, centred AS r, abs(centred) AS a, lag(abs(centred)) OVER w AS before, lead(abs(centred)) OVER w AS behind, coalesce((centred + lag(centred) OVER w) / 20, 0) AS step FROM series WINDOW w AS (PARTITION BY rec ORDER BY sample)),
y AS (SELECT rec, sample, sum(step) OVER (PARTITION BY rec ORDER BY sample) AS yaw FROM a),
c AS (SELECT rec, sample FROM a WHERE (a < 5) <> (behind < 5)), e AS (SELECT rec, min(sample) AS first, max(sample) AS last FROM a GROUP BY rec),
p AS (SELECT a.rec, coalesce((SELECT max(c.sample) FROM c WHERE c.rec = a.rec AND c.sample < a.sample), e.first) AS "start", coalesce((SELECT min(c.sample) FROM c WHERE c.rec = a.rec AND c.sample >= a.sample), e.last) + 1 AS "end"
  FROM a JOIN e ON e.rec = a.rec WHERE a.a >= 15 AND a.a > a.before AND a.a > a.behind AND a.rec IN (SELECT rec FROM c)),
m AS (SELECT DISTINCT p.rec, p."start", p."end", CASE WHEN z.yaw - x.yaw > 0 THEN 1 WHEN z.yaw - x.yaw < 0 THEN -1 ELSE 0 END AS side FROM p JOIN y x ON x.rec = p.rec AND x.sample = p."start" JOIN y z ON z.rec = p.rec AND z.sample = p."end" - 1),
r AS (SELECT *, max("end") OVER (PARTITION BY rec, side ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec, side ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
u AS (SELECT rec, min("start") AS "start", max("end") AS "end" FROM i GROUP BY rec, side, island),
t AS (SELECT u.*, z.yaw - x.yaw AS angle FROM u JOIN y x ON x.rec = u.rec AND x.sample = u."start" JOIN y z ON z.rec = u.rec AND z.sample = u."end" - 1)
SELECT rec, "start", "end", round(angle + 1e-9, 6) AS angle_deg, round(("end" - "start") / 10.0::DOUBLE + 1e-9, 6) AS duration_s, CASE WHEN angle > 0 THEN 'left' WHEN angle < 0 THEN 'right' ELSE 'none' END AS direction FROM t
WHERE ("end" - "start") / 10.0 BETWEEN 0.2 AND 10 AND abs(angle) >= 5""")
def turn_list(spark, folder):
    return R.turns(series(spark, folder), BY, "sample", "centred", 10, duration_s=(0.2, 10), angle=(5, float("inf")))
