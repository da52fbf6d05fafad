"""Registered queries of the attribution engine and their DuckDB twins.

Floats are rounded to six places on both sides, timestamps are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators import attribution as att
from credence.operators import audits, corruption, duplicates, journeys, quality, robustness, sampling
from credence.sources.tables import order_stream, touch_stream, with_copies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev AS (SELECT event_id AS row_id, user_id*10 + event_id % 10 AS user_id, CAST(ts AS TIMESTAMP) AS ts,
 'ch' || (CAST(json_extract_string(props,'$.k') AS BIGINT) % 6) AS channel, 'c' || (CAST(json_extract_string(props,'$.k') AS BIGINT) % 20) AS campaign_id,
 event_type = 'purchase' AS conversion, event_type = 'view' AS impression, event_type = 'click' AS click, value AS conversion_value FROM events)"""
EV_DUP = EV + ", base AS (SELECT * FROM ev UNION ALL SELECT row_id + 100000000, user_id, ts, channel, campaign_id, conversion, impression, click, conversion_value FROM ev WHERE row_id % 50 = 0)"


def journeys_sql(days: float = 30, window: float | None = None, source: str = "ev", tag: str = "", own: str = "") -> str:
    """CTEs that end in ``j{tag}``: the touches of all journeys of ``source``; ``own`` adds partition columns."""
    keys, pick = (f"{own}, ", f"{own}, ") if own else ("", "")
    short = min(days, window) if window is not None else days
    return f"""s1{tag} AS (SELECT *, CAST(COALESCE(SUM(CAST(conversion AS INT)) OVER (PARTITION BY {keys}user_id ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg,
 MAX(CAST(conversion AS INT)) OVER (PARTITION BY {keys}user_id) = 1 AS converted FROM {source}),
s2{tag} AS (SELECT *, CASE WHEN converted THEN MAX(CASE WHEN conversion THEN ts END) OVER (PARTITION BY {keys}user_id, seg) ELSE MAX(ts) OVER (PARTITION BY {keys}user_id) END AS end_ts,
 MAX(CASE WHEN conversion THEN COALESCE(conversion_value, 1.0) END) OVER (PARTITION BY {keys}user_id, seg) AS value FROM s1{tag}),
j{tag} AS (SELECT {pick}user_id, seg, ROW_NUMBER() OVER (PARTITION BY {keys}user_id, seg ORDER BY ts, row_id) AS pos, COUNT(*) OVER (PARTITION BY {keys}user_id, seg) AS n, channel, ts, row_id, converted, end_ts, value
 FROM s2{tag} WHERE epoch_us(ts) >= epoch_us(end_ts) - (CASE WHEN converted THEN {int(short * 86_400_000_000)} ELSE {int(days * 86_400_000_000)} END))"""


J = f"{EV}, {journeys_sql()}"
PATHS = """p AS (SELECT user_id, seg, BOOL_OR(converted) AS converted, MAX(value) AS value, COUNT(*) AS touches, COUNT(DISTINCT channel) AS channels,
 MIN(ts) AS start_ts, MAX(end_ts) AS end_ts, STRING_AGG(channel, '>' ORDER BY pos) AS path FROM j GROUP BY user_id, seg)"""
WEIGHT = {"first_touch": "CASE WHEN pos = 1 THEN 1.0 ELSE 0.0 END", "last_touch": "CASE WHEN pos = n THEN 1.0 ELSE 0.0 END", "linear": "1.0 / n"}


def credit_sql(model: str, source: str = "j", by: str = "") -> str:
    """A subquery: channel, attribution_credit, share, conversions (with ``by`` in front)."""
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {keys}channel, c AS attribution_credit, CASE WHEN SUM(c) OVER ({over}) = 0 THEN 0.0 ELSE c / SUM(c) OVER ({over}) END AS share, k AS conversions FROM
 (SELECT {keys}channel, CAST(SUM(w * value) AS DOUBLE) AS c, CAST(SUM(w) AS DOUBLE) AS k FROM (SELECT *, CAST({WEIGHT[model]} AS DOUBLE) AS w FROM {source} WHERE converted) WHERE w > 0 GROUP BY {keys}channel))"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floats to six places, counts as BIGINT, timestamps as microseconds."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "timestamp":
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; its frame is rounded for comparison."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _j(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return journeys.build_journeys(touch_stream(spark, sf_dir), **options)


def r(expr: str, name: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


# --- ingest and validation


@query("canonical_events", f"WITH {EV} SELECT row_id, user_id, epoch_us(ts) AS timestamp, channel, campaign_id, conversion, impression, click, {r('conversion_value', 'conversion_value')} FROM ev")
def _canonical(spark, sf):
    return touch_stream(spark, sf)


@query("validation_summary", f"WITH {EV} SELECT COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users, CAST(COUNT(*) FILTER (conversion) AS BIGINT) AS conversions FROM ev")
def _validation(spark, sf):
    from credence.schema import canonical

    return canonical(touch_stream(spark, sf)).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.count_if("conversion").alias("conversions"))


DQ_BASE = f"""WITH {EV}, b AS (SELECT row_id, CASE WHEN row_id % 97 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN row_id % 89 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS raw,
 CASE WHEN row_id % 83 = 0 THEN '  ' ELSE channel END AS channel, conversion, CAST(row_id // 3 AS VARCHAR) AS conversion_id, conversion_value FROM ev),
t AS (SELECT *, TRY_CAST(raw AS TIMESTAMP) AS ts FROM b)"""


def _damaged(spark, sf):
    e = touch_stream(spark, sf)
    k = F.col("row_id")
    return e.select(
        "row_id", F.when(k % 97 != 0, F.col("user_id")).alias("user_id"), F.when(k % 89 == 0, "bad").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(k % 83 == 0, "  ").otherwise(F.col("channel")).alias("channel"), "conversion", F.floor(k / 3).cast("string").alias("conversion_id"), "conversion_value",
    )


@query(
    "dq_counts",
    DQ_BASE + f""" SELECT COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users, COUNT(*) FILTER (conversion) AS conversions, COUNT(*) FILTER (user_id IS NULL) AS null_user_id,
 COUNT(*) FILTER (raw IS NOT NULL AND ts IS NULL) AS invalid_timestamp, COUNT(*) FILTER (ts > TIMESTAMP '2024-01-15') AS future_timestamps, COUNT(*) FILTER (ts < TIMESTAMP '2024-01-03') AS impossible_timestamps,
 COUNT(*) FILTER (TRIM(channel) = '') AS empty_channel, {r('SUM(CASE WHEN conversion THEN conversion_value END)', 'conversion_value')} FROM t""",
)
def _dq(spark, sf):
    got = quality.quality_counts(_damaged(spark, sf), reference_time="2024-01-15", minimum_timestamp="2024-01-03")
    return got.select("rows", "users", "conversions", "null_user_id", "invalid_timestamp", "future_timestamps", "impossible_timestamps", "empty_channel", "conversion_value")


@query(
    "dq_user_checks",
    DQ_BASE + """, x AS (SELECT *, MIN(CASE WHEN NOT conversion THEN ts END) OVER (PARTITION BY user_id) AS fe, MAX(CASE WHEN NOT conversion THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AND user_id IS NOT NULL AS he, COUNT(*) OVER (PARTITION BY conversion_id) AS times FROM t)
 SELECT COUNT(*) FILTER (conversion AND (fe IS NULL OR ts < fe)) AS conversion_before_exposure, COUNT(*) FILTER (conversion AND NOT he) AS malformed_journeys, COUNT(*) FILTER (conversion AND conversion_id IS NOT NULL AND times > 1) AS repeated_conversion_ids FROM x""",
)
def _dq_users(spark, sf):
    return quality.quality_counts(_damaged(spark, sf)).select("conversion_before_exposure", "malformed_journeys", "repeated_conversion_ids")


# --- duplicates

DUP = f"""WITH {EV_DUP}, m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, ts, channel, campaign_id, conversion, impression, click, conversion_value ORDER BY row_id) > 1 AS exact,
 ROW_NUMBER() OVER (PARTITION BY user_id, ts, channel ORDER BY row_id) > 1 AS ident, epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id, channel ORDER BY ts, row_id)) AS gap FROM base)"""


@query(
    "dup_counts",
    DUP + """ SELECT COUNT(*) AS rows, COUNT(*) FILTER (exact) AS exact, GREATEST(COUNT(*) FILTER (ident) - COUNT(*) FILTER (exact), 0) AS identity, COUNT(*) FILTER (gap > 0 AND gap <= 1000000 AND NOT exact) AS near,
 COUNT(*) FILTER (impression) AS impressions, COUNT(*) FILTER (impression AND ident AND NOT exact) AS repeated_impressions, COUNT(*) FILTER (click) AS clicks, COUNT(*) FILTER (click AND ident AND NOT exact) AS repeated_clicks,
 COUNT(*) FILTER (conversion) AS conversions, COUNT(*) FILTER (conversion AND ident AND NOT exact) AS repeated_conversions, AVG(CASE WHEN ts = date_trunc('day', ts) THEN 1.0 ELSE 0.0 END) >= 0.9 AS date_grain, COUNT(*) FILTER (ident) AS all_identity FROM m""",
)
def _dups(spark, sf):
    return duplicates.duplicate_counts(with_copies(touch_stream(spark, sf)))


@query(
    "dup_date_grain",
    """WITH o AS (SELECT o_custkey AS u, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS c, o_orderstatus = 'F' AS cv, o_totalprice AS v, o_orderkey AS k FROM orders),
 m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, ts, c, cv, v ORDER BY k) > 1 AS exact, ROW_NUMBER() OVER (PARTITION BY u, ts, c ORDER BY k) > 1 AS ident FROM o)
 SELECT AVG(CASE WHEN ts = date_trunc('day', ts) THEN 1.0 ELSE 0.0 END) >= 0.9 AS date_grain, GREATEST(COUNT(*) FILTER (exact), COUNT(*) FILTER (ident)) AS repeated_touches FROM m""",
)
def _date_grain(spark, sf):
    return duplicates.duplicate_counts(order_stream(spark, sf)).select("date_grain", F.greatest("exact", "all_identity").alias("repeated_touches"))


@query(
    "detect_duplicates",
    f"""WITH {EV_DUP}, m AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, ts, channel, campaign_id, conversion, impression, click, conversion_value) > 1 AS e,
 ABS(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id, channel, conversion ORDER BY ts, row_id))) <= 1000000 AS g, COUNT(*) OVER (PARTITION BY user_id, channel, conversion) > 1 AS rp FROM base)
 SELECT row_id, CASE WHEN e THEN 'exact' WHEN COALESCE(g, FALSE) THEN 'near' WHEN rp THEN 'repeated' ELSE 'unique' END AS kind, e OR COALESCE(g, FALSE) OR rp AS is_duplicate FROM m""",
)
def _detect(spark, sf):
    return duplicates.detect_duplicates(with_copies(touch_stream(spark, sf))).select("row_id", "kind", "is_duplicate")


@query("deduplicate", f"WITH {EV} SELECT row_id, user_id FROM ev")
def _dedup(spark, sf):
    return duplicates.deduplicate(with_copies(touch_stream(spark, sf))).select("row_id", "user_id")


@query(
    "deduplicate_near",
    f"""WITH {EV}, g AS (SELECT *, epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id, channel, conversion ORDER BY ts, row_id)) AS gap FROM ev)
 SELECT row_id FROM g WHERE gap IS NULL OR gap > 7200000000""",
)
def _dedup_near(spark, sf):
    return duplicates.deduplicate(with_copies(touch_stream(spark, sf)), near_tolerance="2h").select("row_id")


# --- journeys


@query("journeys", f"WITH {J} SELECT user_id, seg, pos, n, channel, epoch_us(ts) AS timestamp, row_id, converted, epoch_us(end_ts) AS end_ts, {r('value', 'value')} FROM j")
def _journeys(spark, sf):
    return _j(spark, sf)


@query("journeys_short_window", f"WITH {EV}, {journeys_sql(30, 3)} SELECT user_id, seg, pos, n, channel, row_id, converted FROM j")
def _journeys_short(spark, sf):
    return _j(spark, sf, conversion_window="3D").select("user_id", "seg", "pos", "n", "channel", "row_id", "converted")


@query("journeys_general", f"WITH {J} SELECT user_id, seg, pos, channel, row_id, converted FROM j")
def _journeys_general(spark, sf):
    """The general plan with conversion timestamps equal to the event's: the same journeys."""
    frame = touch_stream(spark, sf).withColumn("conversion_timestamp", F.when(F.col("conversion"), F.col("timestamp")))
    return journeys.build_journeys(frame).select("user_id", "seg", "pos", "channel", "row_id", "converted")


@query(
    "journey_summary",
    f"""WITH {J}, {PATHS} SELECT COUNT(*) AS journeys, COUNT(*) FILTER (converted) AS converted_journeys, COUNT(*) FILTER (NOT converted) AS non_converted_journeys, CAST(SUM(touches) AS BIGINT) AS touchpoints,
 {r('AVG(touches)', 'mean_length')}, {r('MEDIAN(touches)', 'median_length')}, MIN(touches) AS min_length, MAX(touches) AS max_length, {r('AVG(CASE WHEN converted THEN 1.0 ELSE 0.0 END)', 'conversion_rate')},
 {r('AVG((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6)', 'mean_duration_s')}, COUNT(DISTINCT path) AS unique_paths, {r('AVG(CASE WHEN converted THEN touches END)', 'converted_mean_length')}, {r('MEDIAN(CASE WHEN converted THEN touches END)', 'converted_median_length')},
 {r('AVG(CASE WHEN NOT converted THEN touches END)', 'non_converted_mean_length')}, {r('MEDIAN(CASE WHEN NOT converted THEN touches END)', 'non_converted_median_length')}, {r('SUM(touches - channels) * 1.0 / SUM(touches)', 'repeated_touch_rate')} FROM p""",
)
def _summary(spark, sf):
    return journeys.summary(_j(spark, sf))


@query("channel_frequency", f"WITH {J} SELECT channel, COUNT(*) AS touches, COUNT(*) FILTER (converted) AS converted_touches FROM j GROUP BY channel")
def _channels(spark, sf):
    return journeys.channel_frequency(_j(spark, sf))


@query("path_frequency", f"WITH {J}, {PATHS} SELECT path, COUNT(*) AS journeys, COUNT(*) FILTER (converted) AS conversions FROM p GROUP BY path")
def _path_frequency(spark, sf):
    return journeys.path_frequency(_j(spark, sf))


@query(
    "path_sparsity",
    f"""WITH {J}, {PATHS}, f AS (SELECT path, COUNT(*) AS c FROM p GROUP BY path) SELECT CAST(SUM(c) AS BIGINT) AS journeys, COUNT(*) AS unique_paths, {r('COUNT(*) * 1.0 / SUM(c)', 'unique_path_ratio')},
 COUNT(*) FILTER (c = 1) AS singleton_paths, {r('COUNT(*) FILTER (c = 1) * 1.0 / COUNT(*)', 'singleton_share')}, {r('AVG(c)', 'mean_frequency')}, MAX(c) AS max_frequency FROM f""",
)
def _sparsity(spark, sf):
    return audits.path_sparsity(_j(spark, sf))


# --- attribution

for _model in ("first_touch", "last_touch", "linear"):
    _name = f"attribution_{_model.removesuffix('_touch')}"
    QUERIES[_name] = lambda spark, sf, m=_model: rounded(att.attribute(_j(spark, sf), m))
    ORACLE_SQL[_name] = f"WITH {J} SELECT channel, {r('attribution_credit', 'attribution_credit')}, {r('share', 'share')}, {r('conversions', 'conversions')} FROM {credit_sql(_model)}"


@query(
    "attribution_custom",
    f"""WITH {J}, w AS (SELECT *, pos * 1.0 / SUM(pos) OVER (PARTITION BY user_id, seg) AS w FROM j WHERE converted), c AS (SELECT channel, SUM(w * value) AS c, SUM(w) AS k FROM w GROUP BY channel)
 SELECT channel, {r('c', 'attribution_credit')}, {r('c / SUM(c) OVER ()', 'share')}, {r('k', 'conversions')} FROM c""",
)
def _custom(spark, sf):
    """A user-defined model: later touches weigh more."""
    return robustness.custom_credit(_j(spark, sf), F.col("pos").cast("double"))


def edges_sql(source: str = "j", by: str = "") -> str:
    """CTEs that end in ``edges``: src, dst, cnt, prob."""
    keys = f"{by}, " if by else ""
    return f"""steps AS (SELECT {keys}channel AS src, COALESCE(LEAD(channel) OVER (PARTITION BY {keys}user_id, seg ORDER BY pos), CASE WHEN converted THEN 'CONVERSION' ELSE 'NULL' END) AS dst, pos FROM {source}),
 allsteps AS (SELECT {keys}src, dst FROM steps UNION ALL SELECT {keys}'START', src FROM steps WHERE pos = 1), counted AS (SELECT {keys}src, dst, COUNT(*) AS cnt FROM allsteps GROUP BY {keys}src, dst),
 edges AS (SELECT {keys}src, dst, cnt, cnt * 1.0 / SUM(cnt) OVER (PARTITION BY {keys}src) AS prob FROM counted)"""


@query("markov_transitions", f"WITH {J}, {edges_sql()} SELECT src, dst, cnt, {r('prob', 'prob')} FROM edges")
def _transitions(spark, sf):
    return att.transitions(_j(spark, sf))


@query(
    "markov_collapse",
    f"""WITH {J}, k AS (SELECT channel FROM j GROUP BY channel ORDER BY COUNT(*) DESC, MIN((ts, row_id)) LIMIT 3) SELECT COALESCE(k.channel, '__OTHER__') AS channel, COUNT(*) AS touches FROM j LEFT JOIN k ON j.channel = k.channel GROUP BY 1""",
)
def _collapse(spark, sf):
    return att.collapse(_j(spark, sf), 4).groupBy("channel").agg(F.count(F.lit(1)).alias("touches"))


def _absorb_sql(start: str, name: str, variants: str) -> str:
    """Power iteration over ``variants`` (v, src, dst, prob): mass in CONVERSION after 300 steps."""
    return f"""{name}_it(v, step, state, mass) AS (SELECT v, 0, 'START', CAST(1.0 AS DOUBLE) FROM (SELECT DISTINCT v FROM {variants}) UNION ALL
 SELECT i.v, i.step + 1, e.dst, SUM(i.mass * e.prob) FROM {name}_it i JOIN (SELECT v, src, dst, prob FROM {variants} UNION ALL SELECT DISTINCT v, 'CONVERSION', 'CONVERSION', 1.0 FROM {variants}) e ON e.v = i.v AND e.src = i.state WHERE i.step < 300 GROUP BY i.v, i.step, e.dst)"""


VARIANTS = """ch AS (SELECT DISTINCT src AS c FROM edges WHERE src <> 'START'),
 vr AS (SELECT '' AS v, src, dst, CAST(prob AS DOUBLE) AS prob FROM edges UNION ALL SELECT c, src, dst, CAST(cnt * 1.0 / SUM(cnt) OVER (PARTITION BY c, src) AS DOUBLE) FROM edges, ch WHERE src <> c AND dst <> c)"""
REMOVAL = f"WITH RECURSIVE {J}, {edges_sql()}, {VARIANTS}, {_absorb_sql('', 'a', 'vr')}, pr AS (SELECT v, MAX(mass) FILTER (state = 'CONVERSION') AS p FROM a_it WHERE step = 300 GROUP BY v), "
REMOVAL += "fx AS (SELECT c AS channel, (SELECT p FROM pr WHERE v = '') AS baseline, COALESCE(p, 0) AS without, GREATEST(0, 1 - COALESCE(p, 0) / (SELECT p FROM pr WHERE v = '')) AS effect FROM ch LEFT JOIN pr ON pr.v = ch.c)"


@query("markov_removal", f"{REMOVAL} SELECT channel, {r('baseline', 'baseline')}, {r('without', 'without')}, {r('effect', 'effect')}, {r('effect / SUM(effect) OVER ()', 'share')} FROM fx")
def _removal(spark, sf):
    return att.markov_effects(_j(spark, sf))


@query("markov_baseline", f"{REMOVAL} SELECT {r('MAX(baseline)', 'baseline')} FROM fx")
def _baseline(spark, sf):
    return att.markov_effects(_j(spark, sf)).agg(F.max("baseline").alias("baseline"))


@query(
    "attribution_markov",
    f"""{REMOVAL}, t AS (SELECT SUM(value) AS total, COUNT(*) AS n FROM j WHERE converted AND pos = 1) SELECT channel, {r('effect / SUM(effect) OVER () * total', 'attribution_credit')}, {r('effect / SUM(effect) OVER ()', 'share')}, {r('effect / SUM(effect) OVER () * n', 'conversions')} FROM fx, t""",
)
def _markov(spark, sf):
    return att.markov(_j(spark, sf))


REDIRECT = REMOVAL.replace("SELECT c, src, dst, CAST(cnt * 1.0 / SUM(cnt) OVER (PARTITION BY c, src) AS DOUBLE)", "SELECT c, src, dst, CAST(prob AS DOUBLE)")


@query("markov_removal_redirect", f"{REDIRECT} SELECT channel, {r('baseline', 'baseline')}, {r('without', 'without')}, {r('effect', 'effect')}, {r('effect / SUM(effect) OVER ()', 'share')} FROM fx")
def _redirect(spark, sf):
    return att.markov_effects(_j(spark, sf), strategy="redirect_to_null")


# --- audits

MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model, channel, attribution_credit, share, conversions FROM {credit_sql(m)}" for m in WEIGHT)


def _all_models(spark, sf) -> DataFrame:
    return att.attribute_all(_j(spark, sf), list(WEIGHT))


@query(
    "concentration",
    f"""WITH {J}, models AS ({MODELS}), a AS (SELECT 'touch' AS measure, channel, CAST(COUNT(*) AS DOUBLE) AS x FROM j GROUP BY channel UNION ALL SELECT 'conversion', channel, SUM(1.0 / n) FROM j WHERE converted GROUP BY channel
 UNION ALL SELECT 'model:' || model, channel, share FROM models), s AS (SELECT *, x / SUM(x) OVER (PARTITION BY measure) AS s FROM a), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY measure ORDER BY ROUND(s, 12) DESC, channel) AS k FROM s)
 SELECT measure, {r('SUM(s * s)', 'hhi')}, {r('SUM(CASE WHEN k <= 1 THEN s END)', 'top1')}, {r('SUM(CASE WHEN k <= 3 THEN s END)', 'top3')} FROM k GROUP BY measure""",
)
def _concentration(spark, sf):
    return audits.concentration(_j(spark, sf), _all_models(spark, sf))


WINDOWS = (7, 14, 30)
WC = f"WITH {EV}, " + ", ".join(journeys_sql(30, w, tag=str(w)) for w in WINDOWS) + ", wc AS (" + " UNION ALL ".join(f"SELECT {w * 86_400_000_000} AS scenario, channel, attribution_credit, share FROM {credit_sql('linear', f'j{w}')}" for w in WINDOWS) + ")"
OWN = "own AS (SELECT *, RANK() OVER (PARTITION BY scenario ORDER BY ROUND(attribution_credit, 9) DESC) AS rk FROM wc)"
GRID = OWN + """, g AS (SELECT a.scenario, b.channel, COALESCE(w.attribution_credit, 0.0) AS credit, COALESCE(w.share, 0.0) AS share, COALESCE(w.rk, 1 + COUNT(*) OVER (PARTITION BY a.scenario)) AS rk
 FROM (SELECT DISTINCT scenario FROM wc) a CROSS JOIN (SELECT DISTINCT channel FROM wc) b LEFT JOIN own w ON w.scenario = a.scenario AND w.channel = b.channel)"""


@query(
    "window_comparison",
    f"""{WC}, {GRID} SELECT channel, {r('MIN_BY(credit, scenario)', 'credit_first')}, {r('MAX_BY(credit, scenario)', 'credit_last')}, {r('MAX_BY(credit, scenario) - MIN_BY(credit, scenario)', 'credit_change')},
 {r('(MAX_BY(credit, scenario) - MIN_BY(credit, scenario)) / NULLIF(MIN_BY(credit, scenario), 0)', 'credit_change_ratio')}, CAST(MAX_BY(rk, scenario) - MIN_BY(rk, scenario) AS BIGINT) AS rank_change, {r('MAX(share) - MIN(share)', 'share_volatility')} FROM g GROUP BY channel""",
)
def _windows(spark, sf):
    return audits.window_comparison(audits.window_credits(touch_stream(spark, sf), WINDOWS))


SPEARMAN = """av AS (SELECT *, RANK() OVER (PARTITION BY {s} ORDER BY x) + (COUNT(*) OVER (PARTITION BY {s}, x) - 1) / 2.0 AS r FROM {g}),
 pr AS (SELECT l.{s} AS a, r.{s} AS b, l.r AS ra, r.r AS rb, l.share AS pa, r.share AS pb FROM av l JOIN av r ON l.channel = r.channel AND l.{s} < r.{s})"""
RHO = "CASE WHEN STDDEV_POP(ra) < 1e-12 OR STDDEV_POP(rb) < 1e-12 THEN (CASE WHEN MAX(ABS(ra - rb)) < 1e-12 THEN 1.0 ELSE 0.0 END) ELSE COVAR_POP(ra, rb) / (STDDEV_POP(ra) * STDDEV_POP(rb)) END"


@query("window_rank_corr", f"{WC}, {GRID}, pr AS (SELECT l.scenario AS a, r.scenario AS b, l.rk AS ra, r.rk AS rb FROM g l JOIN g r ON l.channel = r.channel AND l.scenario < r.scenario) SELECT a, b, {r(RHO, 'spearman')} FROM pr GROUP BY a, b")
def _window_corr(spark, sf):
    return audits.rank_correlations(audits.window_credits(touch_stream(spark, sf), WINDOWS))


CONT = f"""WITH {EV}, u AS (SELECT user_id, MIN(ts) AS f, MIN_BY(channel, (ts, row_id)) AS first_channel, MIN_BY(campaign_id, (ts, row_id)) AS first_campaign, MIN(CASE WHEN conversion THEN ts END) AS c FROM ev GROUP BY user_id),
 k AS (SELECT *, CASE WHEN c IS NULL THEN 'none' WHEN c - f <= INTERVAL 7 DAY THEN 'short' WHEN c - f <= INTERVAL 30 DAY THEN 'delayed' ELSE 'post' END AS class FROM u)"""
CLASSES = "COUNT(*) AS users, COUNT(*) FILTER (class = 'short') AS short, COUNT(*) FILTER (class = 'delayed') AS delayed, COUNT(*) FILTER (class = 'post') AS post, COUNT(*) FILTER (class = 'none') AS \"none\", " + r("COUNT(*) FILTER (class = 'delayed') * 1.0 / COUNT(*)", "delayed_rate")


@query("contamination", f"{CONT} SELECT {CLASSES} FROM k")
def _contamination(spark, sf):
    return audits.contamination(touch_stream(spark, sf))


@query("contamination_by_channel", f"{CONT} SELECT first_channel, {CLASSES} FROM k GROUP BY first_channel")
def _contamination_channel(spark, sf):
    return audits.contamination(touch_stream(spark, sf), "first_channel")


@query("contamination_by_campaign", f"{CONT} SELECT first_campaign, {CLASSES} FROM k GROUP BY first_campaign")
def _contamination_campaign(spark, sf):
    return audits.contamination(touch_stream(spark, sf), "first_campaign")


EXPO = f"""WITH {EV}, e1 AS (SELECT *, MAX(CAST(conversion AS INT)) OVER (PARTITION BY user_id) = 1 AS converted, COALESCE(MIN(CASE WHEN conversion THEN ts END) OVER (PARTITION BY user_id), MAX(ts) OVER (PARTITION BY user_id)) AS endpoint FROM ev),
 x AS (SELECT * FROM e1 WHERE ts <= endpoint)"""


@query(
    "exposure_stats",
    f"""{EXPO}, u AS (SELECT user_id, BOOL_OR(converted) AS converted, COUNT(*) AS t, STRING_AGG(channel, '>' ORDER BY ts, row_id) AS path, MAX(endpoint) AS e, MAX(CASE WHEN NOT conversion THEN ts END) AS l FROM x GROUP BY user_id)
 SELECT converted, COUNT(*) AS users, {r('AVG(t)', 'mean_touches')}, {r('MEDIAN(t)', 'median_touches')}, {r('STDDEV_POP(t)', 'std_touches')}, COUNT(DISTINCT path) AS unique_paths, {r('COUNT(DISTINCT path) * 1.0 / COUNT(*)', 'path_diversity')},
 {r('AVG(CASE WHEN converted THEN (epoch_us(e) - epoch_us(l)) / 86400e6 END)', 'mean_recency_days')} FROM u GROUP BY converted""",
)
def _exposure(spark, sf):
    return audits.exposure_stats(touch_stream(spark, sf))


@query(
    "exposure_mix_distance",
    f"{EXPO}, m AS (SELECT channel, COUNT(*) FILTER (converted) AS a, COUNT(*) FILTER (NOT converted) AS b FROM x GROUP BY channel) SELECT {r('0.5 * SUM(ABS(a * 1.0 / (SELECT SUM(a) FROM m) - b * 1.0 / (SELECT SUM(b) FROM m)))', 'distance')} FROM m",
)
def _mix(spark, sf):
    return audits.exposure_mix_distance(touch_stream(spark, sf))


PER = "per AS (SELECT *, strftime(date_trunc('week', end_ts), '%Y-%m-%d') AS scenario FROM j)"


@query("temporal_summary", f"WITH {J}, {PER} SELECT scenario, COUNT(*) AS journeys, COUNT(*) FILTER (converted) AS conversions, {r('AVG(CASE WHEN converted THEN 1.0 ELSE 0.0 END)', 'conversion_rate')} FROM per WHERE pos = 1 GROUP BY scenario")
def _temporal(spark, sf):
    return audits.period_summary(_j(spark, sf))


@query("temporal_shares", f"WITH {J}, {PER} SELECT scenario, channel, {r('attribution_credit', 'attribution_credit')}, {r('share', 'share')}, {r('conversions', 'conversions')} FROM {credit_sql('linear', 'per', 'scenario')}")
def _temporal_shares(spark, sf):
    return audits.period_credits(_j(spark, sf))


PERIOD_RANKS = f"WITH {J}, {PER}, wc AS (SELECT * FROM {credit_sql('linear', 'per', 'scenario')}), {GRID}, gx AS (SELECT *, -ROUND(share, 12) AS x FROM g), " + SPEARMAN.format(s="scenario", g="gx")


@query("temporal_ranges", f"{PERIOD_RANKS} SELECT channel, {r('MAX(share) - MIN(share)', 'share_range')}, {r('MAX(r) - MIN(r)', 'rank_range')} FROM av GROUP BY channel")
def _temporal_ranges(spark, sf):
    return audits.period_ranges(audits.period_credits(_j(spark, sf)))


@query("temporal_rank_corr", f"{PERIOD_RANKS} SELECT a, b, {r(RHO, 'spearman')} FROM pr GROUP BY a, b")
def _temporal_rank_corr(spark, sf):
    return audits.period_correlations(audits.period_credits(_j(spark, sf)))


@query(
    "temporal_transition_similarity",
    f"""WITH {J}, {PER}, {edges_sql('per', 'scenario')}, st AS (SELECT DISTINCT scenario, UNNEST([src, dst]) AS s FROM edges), sc AS (SELECT DISTINCT scenario FROM edges), pairs AS (SELECT x.scenario AS a, y.scenario AS b FROM sc x, sc y WHERE x.scenario < y.scenario),
 k AS (SELECT a, b, COUNT(DISTINCT s) AS k FROM pairs JOIN st ON st.scenario IN (a, b) GROUP BY a, b),
 d AS (SELECT p.a, p.b, SUM(ABS(COALESCE(l.prob, 0) - COALESCE(q.prob, 0))) AS d FROM pairs p, (SELECT DISTINCT src, dst FROM edges) c LEFT JOIN edges l ON l.scenario = p.a AND l.src = c.src AND l.dst = c.dst LEFT JOIN edges q ON q.scenario = p.b AND q.src = c.src AND q.dst = c.dst GROUP BY p.a, p.b)
 SELECT k.a, k.b, {r('1 - d.d / (k.k * k.k)', 'similarity')} FROM k JOIN d ON k.a = d.a AND k.b = d.b""",
)
def _similarity(spark, sf):
    return audits.transition_similarity(att.transitions(audits.by_period(_j(spark, sf)), ["scenario"]))


@query(
    "model_disagreement",
    f"""WITH {J}, models AS ({MODELS}), g0 AS (SELECT a.model, b.channel, ROUND(COALESCE(m.share, 0.0), 12) AS share FROM (SELECT DISTINCT model FROM models) a CROSS JOIN (SELECT DISTINCT channel FROM models) b LEFT JOIN models m ON m.model = a.model AND m.channel = b.channel),
 gx AS (SELECT model, channel, share / SUM(share) OVER (PARTITION BY model) AS share, ROUND(share / SUM(share) OVER (PARTITION BY model), 12) AS x FROM g0), {SPEARMAN.format(s='model', g='gx')}
 SELECT a, b, {r(RHO, 'spearman')}, {r('SUM(CASE WHEN pa > 0 THEN pa * log2(pa / ((pa + pb) / 2)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * log2(pb / ((pa + pb) / 2)) ELSE 0 END) / 2', 'jensen_shannon')}, {r('MAX(ABS(pa - pb))', 'max_share_difference')} FROM pr GROUP BY a, b""",
)
def _disagreement(spark, sf):
    return audits.model_disagreement(_all_models(spark, sf))


@query("markov_identification", f"WITH {J} SELECT COUNT(*) FILTER (pos = 1) AS journeys, COUNT(*) FILTER (pos = 1 AND NOT converted) AS null_paths, COUNT(DISTINCT channel) AS channels FROM j")
def _identification(spark, sf):
    return audits.identification(_j(spark, sf))


# --- sampling and damage


def _key(stage: str, column: str, seed: int = 42) -> str:
    return f"md5('{seed}:{stage}:' || CAST({column} AS VARCHAR))"


@query(
    "sample_users",
    f"""WITH {EV}, u AS (SELECT user_id, BOOL_OR(conversion) AS cv FROM ev GROUP BY user_id), t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (cv) AS w FROM u),
 k AS (SELECT LEAST(w, GREATEST(1, CAST(round_even(200.0 * w / n, 0) AS BIGINT))) AS kw FROM t), rk AS (SELECT user_id, cv, ROW_NUMBER() OVER (PARTITION BY cv ORDER BY {_key('users', 'user_id')}, user_id) AS i FROM u)
 SELECT ev.user_id, COUNT(*) AS events FROM ev JOIN rk ON rk.user_id = ev.user_id, k WHERE (rk.cv AND i <= kw) OR (NOT rk.cv AND i <= 200 - kw) GROUP BY ev.user_id""",
)
def _sample(spark, sf):
    return sampling.sample_users(touch_stream(spark, sf), 200)[0].groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


LOST = f"""lost AS (SELECT row_id FROM ev WHERE NOT conversion ORDER BY {_key('touchpoint', 'row_id')}, row_id LIMIT (SELECT CAST(round_even(0.1 * COUNT(*), 0) AS BIGINT) FROM ev WHERE NOT conversion)), kept AS (SELECT * FROM ev WHERE row_id NOT IN (SELECT row_id FROM lost))"""


@query("corrupt_touchpoint", f"WITH {EV}, {LOST} SELECT row_id, user_id FROM kept")
def _touchpoint(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), touchpoint_loss=0.1).frame.select("row_id", "user_id")


@query(
    "corrupt_event_loss",
    f"""WITH {EV}, l AS (SELECT row_id FROM ev WHERE impression AND NOT conversion ORDER BY {_key('impression', 'row_id')}, row_id LIMIT (SELECT CAST(round_even(0.2 * COUNT(*), 0) AS BIGINT) FROM ev WHERE impression AND NOT conversion)) SELECT row_id FROM ev WHERE row_id NOT IN (SELECT row_id FROM l)""",
)
def _event_loss(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), impression_loss=0.2).frame.select("row_id")


@query(
    "corrupt_identity",
    f"""WITH {EV}, x AS (SELECT user_id, COUNT(*) FILTER (NOT conversion) AS n, BOOL_OR(conversion) AS cv FROM ev GROUP BY user_id), el AS (SELECT * FROM x WHERE n >= 1 AND (n >= 2 OR cv)),
 ch AS (SELECT user_id, GREATEST(n // 2, 1) AS m FROM el ORDER BY {_key('identity', 'user_id')}, user_id LIMIT (SELECT CAST(round_even(0.1 * COUNT(*), 0) AS BIGINT) FROM el)),
 rk AS (SELECT ev.*, ROW_NUMBER() OVER (PARTITION BY user_id, conversion ORDER BY {_key('fragment', 'row_id')}, row_id) AS i FROM ev)
 SELECT row_id, CASE WHEN ch.m IS NOT NULL AND NOT conversion AND i <= m THEN '__fragment__' || CAST(rk.user_id AS VARCHAR) ELSE CAST(rk.user_id AS VARCHAR) END AS user_id FROM rk LEFT JOIN ch ON ch.user_id = rk.user_id""",
)
def _identity(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), identity_loss=0.1).frame.select("row_id", "user_id")


@query("corrupt_shift", f"WITH {EV} SELECT row_id, epoch_us(CASE WHEN conversion THEN ts + INTERVAL 2 DAY ELSE ts END) AS timestamp FROM ev")
def _shift(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), conversion_delay_shift="2D").frame.select("row_id", "timestamp")


@query(
    "corrupt_missing_channel",
    f"WITH {EV}, l AS (SELECT row_id FROM ev ORDER BY {_key('channel', 'row_id')}, row_id LIMIT (SELECT CAST(round_even(0.05 * COUNT(*), 0) AS BIGINT) FROM ev)) SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM l) THEN NULL ELSE channel END AS channel FROM ev",
)
def _missing(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), missing_channel_rate=0.05).frame.select("row_id", "channel")


@query(
    "corrupt_duplicates",
    f"WITH {EV}, l AS (SELECT * FROM ev ORDER BY {_key('duplicate', 'row_id')}, row_id LIMIT (SELECT CAST(round_even(0.05 * COUNT(*), 0) AS BIGINT) FROM ev)) SELECT row_id, epoch_us(ts) AS timestamp FROM ev UNION ALL SELECT row_id + 1125899906842624, epoch_us(ts) + 1 FROM l",
)
def _copies(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), duplicate_rate=0.05, duplicate_kind="near").frame.select("row_id", "timestamp")


DRIFT = f"WITH {EV}, {LOST}, {journeys_sql()}, {journeys_sql(source='kept', tag='k')}, dr AS (SELECT COALESCE(a.channel, b.channel) AS channel, COALESCE(a.share, 0.0) AS share_base, COALESCE(b.share, 0.0) AS share_new FROM {credit_sql('linear')} a FULL JOIN {credit_sql('linear', 'jk')} b ON a.channel = b.channel)"


def _drift(spark, sf) -> DataFrame:
    frame = touch_stream(spark, sf)
    damaged = corruption.corrupt(frame, touchpoint_loss=0.1).frame
    return audits.share_drift(att.attribute(journeys.build_journeys(frame), "linear"), att.attribute(journeys.build_journeys(damaged), "linear"), [])


@query("loss_drift", f"{DRIFT} SELECT channel, {r('share_base', 'share_base')}, {r('share_new', 'share_new')}, {r('share_new - share_base', 'drift')} FROM dr")
def _loss_drift(spark, sf):
    return _drift(spark, sf)


@query("loss_total_variation", f"{DRIFT} SELECT {r('0.5 * SUM(ABS(share_new - share_base))', 'total_variation')}, {r('MAX(ABS(share_new - share_base))', 'max_drift')} FROM dr")
def _loss_tv(spark, sf):
    return audits.total_variation(_drift(spark, sf), [])


# --- sensitivity, robustness, bootstrap

SENS = f"WITH {EV}, {journeys_sql()}, " + ", ".join(journeys_sql(30, w, tag=str(w)) for w in (7, 14)) + ", sc AS (" + " UNION ALL ".join([f"SELECT 'model:{m}' AS scenario, channel, share FROM {credit_sql(m)}" for m in WEIGHT] + [f"SELECT 'conversion_window:{w}' AS scenario, channel, share FROM {credit_sql('linear', f'j{w}')}" for w in (7, 14)]) + """),
 mx AS (SELECT a.scenario, b.channel, ROUND(COALESCE(s.share, 0.0), 12) AS share FROM (SELECT DISTINCT scenario FROM sc) a CROSS JOIN (SELECT DISTINCT channel FROM sc) b LEFT JOIN sc s ON s.scenario = a.scenario AND s.channel = b.channel),
 mr AS (SELECT *, RANK() OVER (PARTITION BY scenario ORDER BY share DESC) AS rk FROM mx)"""


def _scenarios(spark, sf) -> DataFrame:
    frame = touch_stream(spark, sf)
    out = _all_models(spark, sf).select(F.concat(F.lit("model:"), "model").alias("scenario"), "channel", "share")
    for w in (7, 14):
        one = att.attribute(journeys.build_journeys(frame, "30D", w), "linear")
        out = out.unionByName(one.select(F.lit(f"conversion_window:{w}").alias("scenario"), "channel", "share"))
    return out


@query("sensitivity_matrix", f"{SENS} SELECT scenario, channel, {r('share', 'share')}, rk AS rank FROM mr")
def _sensitivity(spark, sf):
    return robustness.matrix(_scenarios(spark, sf))


@query(
    "decision_robustness",
    f"""{SENS}, st AS (SELECT channel, MAX(CASE WHEN scenario = 'model:linear' THEN rk END) AS baseline_rank, MEDIAN(rk) AS median_rank, QUANTILE_CONT(rk, 0.05) AS p5_rank, QUANTILE_CONT(rk, 0.95) AS p95_rank, AVG(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END) AS p_top1,
 AVG(CASE WHEN rk <= 2 THEN 1.0 ELSE 0.0 END) AS p_top2, AVG(CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END) AS p_top3, MIN(share) AS share_min, MAX(share) AS share_max, STDDEV_POP(rk) AS rank_std FROM mr GROUP BY channel)
 SELECT channel, baseline_rank, {r('median_rank', 'median_rank')}, {r('p5_rank', 'p5_rank')}, {r('p95_rank', 'p95_rank')}, {r('p_top1', 'p_top1')}, {r('p_top2', 'p_top2')}, {r('p_top3', 'p_top3')}, {r('share_min', 'share_min')}, {r('share_max', 'share_max')}, {r('rank_std', 'rank_std')},
 CASE WHEN p_top1 >= 0.75 AND p_top2 >= 0.90 AND p95_rank - p5_rank <= 1 THEN 'Robust' WHEN p_top1 >= 0.50 AND p_top2 >= 0.75 AND p95_rank - p5_rank <= 2 THEN 'Stable' WHEN p_top2 >= 0.50 THEN 'Uncertain' ELSE 'Fragile' END AS class FROM st""",
)
def _robustness(spark, sf):
    return robustness.decision_robustness(_scenarios(spark, sf), "model:linear")


@query("bootstrap_stats")
def _bootstrap(spark, sf):
    return robustness.bootstrap_statistics(robustness.bootstrap_draws(_j(spark, sf), ["first_touch", "linear"]))


# --- adapters, on touches reshaped to their layouts


@query(
    "adapter_impression_log",
    f"""WITH {EV}, raw AS (SELECT row_id, user_id AS uid, epoch_us(ts) // 1000000 AS t, channel AS campaign, CASE WHEN row_id % 4 = 0 THEN 1 ELSE 0 END AS conversion, epoch_us(ts) // 1000000 + 3600 AS ct, user_id % 7 AS cid, click FROM ev),
 a AS (SELECT *, conversion = 1 AND t <= ct AS able FROM raw), k AS (SELECT *, able AND ROW_NUMBER() OVER (PARTITION BY uid, cid, able ORDER BY t DESC, row_id) = 1 AS chosen FROM a) SELECT row_id, uid AS user_id, campaign AS channel, chosen AS conversion, click FROM k""",
)
def _impression_log(spark, sf):
    from credence.sources.adapters import impression_log_events

    e = touch_stream(spark, sf)
    seconds = F.floor(F.unix_micros("timestamp") / 1_000_000).cast("long")
    raw = e.select("row_id", F.col("user_id").alias("uid"), seconds.alias("timestamp"), F.col("channel").alias("campaign"), (F.col("row_id") % 4 == 0).cast("int").alias("conversion"), (seconds + 3600).alias("conversion_timestamp"), (F.col("user_id") % 7).alias("conversion_id"), F.col("click").cast("int").alias("click"))
    return impression_log_events(raw).select("row_id", "user_id", "channel", "conversion", "click")


@query(
    "adapter_journey_steps",
    f"""WITH {EV}, t AS (SELECT row_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, row_id) AS step, channel FROM ev) SELECT row_id, user_id, channel, user_id % 3 = 0 AND step = MAX(step) OVER (PARTITION BY user_id) AS conversion FROM t""",
)
def _journey_steps(spark, sf):
    from pyspark.sql import Window

    from credence.sources.adapters import journey_steps_events

    e = touch_stream(spark, sf)
    touches = e.select("row_id", F.col("user_id").alias("journey_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("timestamp", "row_id")).alias("step"), "channel")
    flags = e.select(F.col("user_id").alias("journey_id")).distinct().withColumn("converted", (F.col("journey_id") % 3 == 0).cast("int"))
    return journey_steps_events(touches, flags).select("row_id", "user_id", "channel", "conversion")


# --- scores


@query("score_components")
def _score(spark, sf):
    """The whole audit's checks, one row each."""
    from credence.audit import ReliabilityAudit

    report = ReliabilityAudit(touch_stream(spark, sf), models=("first_touch", "last_touch", "linear", "markov")).run()
    rows = report.to_dataframe(spark).select("check", "status", "severity", "score")
    report.unpersist()
    return rows


#: Weights of the four policies (of the components that the published run has), and the edges of the three sets of bands.
POLICIES = {
    "default": {"data_quality": 0.20, "path_quality": 0.15, "model_agreement": 0.20},
    "equal": {"data_quality": 1.0, "path_quality": 1.0, "model_agreement": 1.0},
    "quality_heavy": {"data_quality": 0.50, "path_quality": 0.10, "model_agreement": 0.10},
    "agreement_heavy": {"data_quality": 0.10, "path_quality": 0.10, "model_agreement": 0.50},
}
EDGES = {"default": (90, 80, 70, 60), "stricter": (95, 85, 75, 65), "looser": (85, 75, 65, 55)}


@query(
    "score_policy",
    "WITH p(policy, s) AS (VALUES ('default', (0.2 * 59.25 + 0.15 * 61.81 + 0.2 * 93.34) / 0.55), ('equal', (59.25 + 61.81 + 93.34) / 3), ('quality_heavy', (0.5 * 59.25 + 0.1 * 61.81 + 0.1 * 93.34) / 0.7), ('agreement_heavy', (0.1 * 59.25 + 0.1 * 61.81 + 0.5 * 93.34) / 0.7)),"
    " b(bands, shift) AS (VALUES ('default', 0), ('stricter', 5), ('looser', -5))"
    " SELECT policy, bands, ROUND(CAST(s AS DOUBLE), 6) AS score, CASE WHEN s >= 90 + shift THEN 'Robust' WHEN s >= 80 + shift THEN 'Stable' WHEN s >= 70 + shift THEN 'Caution' WHEN s >= 60 + shift THEN 'Fragile' ELSE 'Highly Fragile' END AS label FROM p, b",
)
def _policy(spark, sf):
    from credence.scoring import ScoreThresholds, ScoringWeights, reliability_score, score_label

    scores = {"data_quality": 59.25, "path_sparsity": 61.81, "model_disagreement": 93.34}
    rest = {"window_stability": 0.0, "identity_robustness": 0.0, "temporal_stability": 0.0}
    rows = [(k, reliability_score(scores, ScoringWeights.of(rest | w))) for k, w in POLICIES.items()]
    listed = [(k, b, s, score_label(s, ScoreThresholds(*e))) for k, s in rows for b, e in EDGES.items()]
    return spark.createDataFrame(listed, "policy string, bands string, score double, label string").withColumn("score", F.round("score", 6))


@query(
    "dq_affected",
    DQ_BASE + """, x AS (SELECT *, MIN(CASE WHEN NOT conversion THEN ts END) OVER (PARTITION BY user_id) AS fe, MAX(CASE WHEN NOT conversion THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AND user_id IS NOT NULL AS he FROM t)
 SELECT COUNT(DISTINCT user_id) FILTER (raw IS NOT NULL AND ts IS NULL) AS users_invalid_timestamp, COUNT(DISTINCT user_id) FILTER (TRIM(channel) = '') AS users_empty_channel, COUNT(DISTINCT user_id) FILTER (conversion AND NOT he) AS users_malformed_journeys,
 COUNT(DISTINCT user_id) FILTER (conversion AND (fe IS NULL OR ts < fe)) AS users_conversion_before_exposure, COUNT(*) FILTER (conversion AND TRIM(channel) = '') AS conversions_empty_channel FROM x""",
)
def _dq_affected(spark, sf):
    """How many users and conversions each kind of bad row touches."""
    return quality.quality_counts(_damaged(spark, sf)).select("users_invalid_timestamp", "users_empty_channel", "users_malformed_journeys", "users_conversion_before_exposure", "conversions_empty_channel")


# --- more layouts, damage and agreement


@query("adapter_sequence", f"WITH {EV} SELECT row_id, user_id, 1704067200000000 + (row_id % 50) * 86400000000 AS timestamp, channel, conversion, CASE WHEN conversion THEN conversion_value ELSE 0.0 END AS conversion_value FROM ev")
def _sequence(spark, sf):
    from credence.sources.adapters import sequence_events

    e = touch_stream(spark, sf)
    raw = e.select("row_id", F.col("user_id").alias("uid"), (F.col("row_id") % 50 + 1).alias("touch_sequence"), "channel", F.col("conversion").cast("int").alias("conversion"), F.col("conversion_value").alias("monetary_value"))
    return sequence_events(raw).withColumn("timestamp", F.unix_micros("timestamp"))


@query(
    "adapter_funnel",
    f"""WITH {EV}, k AS (SELECT *, BOOL_OR(conversion) OVER (PARTITION BY user_id) AND ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY row_id DESC) = 1 AS last, MAX(conversion_value) OVER (PARTITION BY user_id) AS revenue FROM ev)
 SELECT row_id, user_id, epoch_us(ts) AS timestamp, channel, last AS conversion, CASE WHEN last THEN COALESCE(revenue, 1.0) ELSE 0.0 END AS conversion_value FROM k""",
)
def _funnel(spark, sf):
    from credence.sources.adapters import funnel_events

    e = touch_stream(spark, sf)
    raw = e.select("row_id", F.col("user_id").alias("journey_id"), "channel", F.col("row_id").alias("touch_position"), F.col("timestamp").alias("touch_timestamp"), F.col("conversion").cast("int").alias("converted"), F.col("conversion_value").alias("revenue"))
    return funnel_events(raw).withColumn("timestamp", F.unix_micros("timestamp"))


@query("adapter_daily", f"WITH {EV} SELECT row_id, user_id, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS timestamp, channel, conversion FROM ev")
def _daily(spark, sf):
    from credence.sources.adapters import daily_touch_events

    raw = touch_stream(spark, sf).select("row_id", "user_id", F.date_format("timestamp", "yyyy-MM-dd").alias("touchpoint_date"), "channel", F.col("conversion").cast("int").alias("conversion"))
    return daily_touch_events(raw).withColumn("timestamp", F.unix_micros("timestamp"))


@query("corrupt_noise", f"WITH {EV} SELECT row_id, epoch_us(ts) + CAST('0x' || SUBSTR({_key('noise', 'row_id')}, 1, 12) AS BIGINT) % 7200000001 - 3600000000 AS timestamp FROM ev")
def _noise(spark, sf):
    return corruption.corrupt(touch_stream(spark, sf), timestamp_noise="1h").frame.select("row_id", F.unix_micros("timestamp").alias("timestamp"))


@query("dq_conversion_timestamp", f"WITH {EV} SELECT COUNT(*) FILTER (row_id % 71 = 0) AS invalid_conversion_timestamp, COUNT(DISTINCT user_id) FILTER (row_id % 71 = 0) AS users_invalid_conversion_timestamp, COUNT(*) FILTER (row_id % 71 = 0 AND conversion) AS conversions_invalid_conversion_timestamp FROM ev")
def _dq_conversion_timestamp(spark, sf):
    at = F.when(F.col("row_id") % 71 == 0, "soon").when(F.col("row_id") % 3 == 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    got = quality.quality_counts(touch_stream(spark, sf).withColumn("conversion_timestamp", at))
    return got.select("invalid_conversion_timestamp", "users_invalid_conversion_timestamp", "conversions_invalid_conversion_timestamp")


@query(
    "model_agreement",
    f"""WITH {J}, models AS ({MODELS}), g0 AS (SELECT a.model, b.channel, ROUND(COALESCE(m.share, 0.0), 12) AS share FROM (SELECT DISTINCT model FROM models) a CROSS JOIN (SELECT DISTINCT channel FROM models) b LEFT JOIN models m ON m.model = a.model AND m.channel = b.channel),
 gx AS (SELECT model, channel, share / SUM(share) OVER (PARTITION BY model) AS share, ROUND(share / SUM(share) OVER (PARTITION BY model), 12) AS x FROM g0), {SPEARMAN.format(s='model', g='gx')},
 p AS (SELECT a, b, {RHO} AS rho, SUM(CASE WHEN pa > 0 THEN pa * log2(pa / ((pa + pb) / 2)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * log2(pb / ((pa + pb) / 2)) ELSE 0 END) / 2 AS js, MAX(ABS(pa - pb)) AS d FROM pr GROUP BY a, b),
 v AS (SELECT AVG(v) AS v, COUNT(*) AS n FROM (SELECT channel, VAR_POP(r) AS v FROM av GROUP BY channel)), t AS (SELECT AVG(rho) AS rho, AVG(js) AS js, MAX(d) AS d FROM p)
 SELECT {r('100 * ((rho + 1) / 2 + 1 - LEAST(1, js) + 1 - LEAST(1, d) + 1 - LEAST(1, v / GREATEST(1, (n - 1) * (n - 1) / 4.0))) / 4', 'agreement_score')}, {r('v', 'rank_variance')} FROM t, v""",
)
def _agreement(spark, sf):
    got = audits.agreement(_all_models(spark, sf))
    return spark.createDataFrame([(round(got["agreement_score"], 6), round(got["rank_variance"], 6))], "agreement_score double, rank_variance double")
