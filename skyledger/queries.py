"""Registered queries of the library's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import columns as c
from skyledger.operators import explain, gold, quality, rank, score
from skyledger.plans import binding as b
from skyledger.plans.shared import shared_folder  # noqa: F401
from skyledger.plans.binding import BAND_SQL, GOLD_SQL, OBJECTS_SQL, SCORE_SQL, SENTRY_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold(b.objects(spark, sf_dir), b.approaches(spark, sf_dir), b.sentry(spark, sf_dir), unique=True)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(gold_table(spark, sf_dir))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


DERIVED = ["log_diameter", "inverse_moid", "inverse_min_distance", "relative_velocity_score", "observation_quality_score", "uncertainty_proxy_score",
           "size_proxy_score", "proximity_proxy_score", "sentry_presence_score", "feature_completeness_ratio"]
PARTS = list(score.WEIGHTS)
AGGS = ["min_close_approach_dist", "min_close_approach_dist_min", "max_close_approach_v_rel"]


@query(f"with {GOLD_SQL} select object_key, des, full_name, next_close_approach_datetime, close_approach_count, sentry_flag, {s6(*AGGS, 'sentry_ip', *DERIVED)} from gold")
def gold_features(spark, d):
    return gold_table(spark, d).select("object_key", "des", "full_name", "next_close_approach_datetime", "close_approach_count", "sentry_flag", *r6(*AGGS, "sentry_ip", *DERIVED))


@query(f"with {OBJECTS_SQL}, {SENTRY_SQL} select o.spkid as object_key, o.des, round(g.sentry_ip, 10) as sentry_ip, round(g.sentry_ps_cum, 6) as sentry_ps_cum, g.sentry_n_imp from objects o left join groups g on o.des = g.des or o.spkid = g.spk")
def gold_or_join(spark, d):
    base = gold.base_objects(b.objects(spark, d), ["spkid", "des"])
    return gold.with_sentry(base, b.sentry(spark, d)).select("object_key", "des", F.round("sentry_ip", 10).alias("sentry_ip"), *r6("sentry_ps_cum"), "sentry_n_imp")


@query(f"""with {SENTRY_SQL}, cad as (select cast(l_partkey as varchar) as des, count(*) as close_approach_count, round(max(l_quantity), 6) as max_close_approach_v_rel from lineitem group by 1),
base as (select spk as object_key, min(des) as des from sentry group by 1), met as (select object_key, max(sentry_ip) as sentry_ip from base join groups g on base.des = g.des or base.object_key = g.spk group by 1)
select 'sentry' as base, object_key, des, round(sentry_ip, 10) as sentry_ip, close_approach_count, max_close_approach_v_rel, true as sentry_flag, round((1 + 2 * (cad.des is not null)::int) / 14e0, 6) as feature_completeness_ratio from base left join met using (object_key) left join cad using (des)
union all select 'approaches', des, des, null, close_approach_count, max_close_approach_v_rel, false, round(2 / 14e0, 6) from cad""")
def gold_without_objects(spark, d):
    """Gold tables whose base are the impact records, or the approaches where those are absent too."""
    frames = {"sentry": gold.gold(None, b.approaches(spark, d), b.sentry(spark, d), unique=True), "approaches": gold.gold(None, b.approaches(spark, d), None)}
    rows = [df.select(F.lit(name).alias("base"), "object_key", "des", F.round("sentry_ip", 10).alias("sentry_ip"), "close_approach_count", *r6("max_close_approach_v_rel"), "sentry_flag", *r6("feature_completeness_ratio")) for name, df in frames.items()]
    return rows[0].unionByName(rows[1])


@query(f"with {SCORE_SQL} select object_key, round(risk_score, 6) as risk_score, risk_category, {s6(*PARTS)} from scores")
def risk_scores(spark, d):
    return scores(spark, d).select("object_key", F.round("risk_score", 6).alias("risk_score"), "risk_category", *r6(*PARTS))


@query(f"with {SCORE_SQL} select object_key, name as component, round(value, 6) as value from scores unpivot (value for name in ({', '.join(PARTS)}))")
def risk_components_long(spark, d):
    return scores(spark, d).unpivot(["object_key"], PARTS, "component", "value").withColumn("value", F.round("value", 6))


_RANK = "order by risk_score_0_100 desc nulls last, uncertainty_risk_component desc nulls last, sentry_risk_component desc nulls last, object_key"


@query(f"with {SCORE_SQL} select object_key, round(risk_score, 6) as risk_score, risk_category, dominant_driver from scores {_RANK} limit 20")
def rank_top(spark, d):
    top = rank.rank(scores(spark, d), 20)
    return top.select("object_key", F.round("risk_score", 6).alias("risk_score"), "risk_category", score.dominant_driver().alias("dominant_driver"))


@query(f"with {SCORE_SQL} select object_key, risk_category, place from (select *, cast(row_number() over (partition by risk_category {_RANK}) as int) as place from scores) t where place <= 20")
def rank_by_category(spark, d):
    return rank.top_by_category(scores(spark, d), 20).select("object_key", "risk_category", "place")


@query(f"with {SCORE_SQL} select object_key, des, dominant_driver from scores where pha and risk_category = 'moderate' and not sentry_flag and lower(full_name) like '%a%' {_RANK} limit 50 offset 10")
def rank_page(spark, d):
    return rank.page(scores(spark, d), 50, 10, category="MODERATE", sentry=False, pha_only=True, contains="A").select("object_key", "des", "dominant_driver")


@query(f"with {SCORE_SQL} select count(*) as n_rows, round(min(risk_score_0_100), 5) as min_score, round(avg(risk_score_0_100), 5) as mean_score, round(median(risk_score_0_100), 5) as median_score, round(max(risk_score_0_100), 5) as max_score, arg_min(object_key, (-risk_score_0_100, object_key)) as top_object from scores")
def ranking_summary(spark, d):
    out = rank.summary(scores(spark, d))
    return out.select("n_rows", *[F.round(x, 5).alias(x) for x in ("min_score", "mean_score", "median_score", "max_score")], "top_object")


@query(f"with {SCORE_SQL} select risk_category as value, count(*) as n from scores group by 1")
def category_counts(spark, d):
    return rank.value_counts(scores(spark, d), "risk_category")


@query(f"with {SCORE_SQL}, top20 as (select * from scores {_RANK} limit 20) select dominant_driver, count(*) as n from top20 group by 1")
def driver_histogram(spark, d):
    return rank.rank(scores(spark, d), 20).groupBy(score.dominant_driver().alias("dominant_driver")).agg(F.count(F.lit(1)).alias("n"))


_DRIVER_LIST = "list_filter([" + ", ".join(f"{{'o': -{p}, 'k': {k}, 'f': '{n}'}}" for k, (p, n) in enumerate(score.DRIVERS.items())) + "], lambda x: x.o is not null)"


@query(f"""with {SCORE_SQL}, l as (select *, list_sort({_DRIVER_LIST}) as ranked from scores),
m as (select *, case when len(list_filter(ranked, lambda x: x.o <= -45e-2)) > 0 then list_filter(ranked, lambda x: x.o <= -45e-2)[1:4] else ranked[1:1] end as dr,
 list_filter([{', '.join(f"case when {x} is null then '{x}' end" for x in explain.LIMITING)}], lambda x: x is not null) as miss from l)
select object_key, array_to_string(list_transform(dr, lambda x: x.f), ',') as drivers,
 array_to_string(list_filter([case when orbital_risk_component <= 2e-1 then 'orbital_distance' end, case when sentry_risk_component <= 2e-1 then 'limited_sentry_signal' end,
  case when physical_risk_component <= 2e-1 then 'physical_size_signal' end, case when feature_completeness_ratio >= 75e-2 then 'feature_completeness' end], lambda x: x is not null), ',') as protective,
 array_to_string(list_filter([case when len(miss) >= 4 then 'without ' || array_to_string(miss[1:5], ', ') end,
  case when feature_completeness_ratio < 6e-1 then 'completeness under 0.60' end, case when arc_length < 30 then 'arc under 30 days' end,
  case when n_obs_used < 20 then 'fewer than 20 observations' end], lambda x: x is not null), '|') as limitations from m""")
def explanations(spark, d):
    out = explain.explained(scores(spark, d))
    return out.select("object_key", F.array_join("drivers", ",").alias("drivers"), F.array_join("protective", ",").alias("protective"), F.array_join("limitations", "|").alias("limitations"))


def half_up_sql(x: str, places: int) -> str:
    """Text of a number's six places rounded to ``places``, halves up as decimals; a product of doubles would leave them to chance."""
    return f"cast(round(cast({x} as decimal(9, 6)), {places}) as decimal(9, {places}))::varchar"


_TEXT = " || ', ' || ".join(f"(ranked[{k + 1}].f || ' ' || {half_up_sql(f'round(-ranked[{k + 1}].o, 6)', 2)})" for k in range(len(score.DRIVERS)))


@query(f"""with {SCORE_SQL}, l as (select *, list_sort({_DRIVER_LIST}) as ranked from scores)
select object_key, risk_category || ' priority, score ' || {half_up_sql('risk_score_0_100', 1)} || ', led by ' || replace(ranked[1].f, '_', ' ') as explanation, {_TEXT} as technical, coalesce(full_name, 'Unknown object') as display_name from l""")
def explanation_texts(spark, d):
    whole = explain.explained(scores(spark, d))
    return whole.select("object_key", "explanation", "technical", explain.display_name(whole).alias("display_name"))


@query(f"with {OBJECTS_SQL}, probes as (select o_orderkey % 500 as k, case o_orderkey % 3 when 0 then cast(o_orderkey % 500 as varchar) when 1 then '2' || lpad(cast(o_orderkey % 500 as varchar), 7, '0') else 'none such' end as probe from orders), "
       "hits as (select distinct p.probe, o.spkid as object_key, case when o.spkid = p.probe then 0 else 2 end as priority from probes p join objects o on o.spkid = p.probe or o.des = p.probe) "
       "select probe, object_key from (select *, row_number() over (partition by probe order by priority, object_key) as n from hits) t where n = 1")  # fmt: skip
def lookup_cascade(spark, d):
    probes = table(spark, d, "orders").select(F.expr("case o_orderkey % 3 when 0 then cast(o_orderkey % 500 as string) when 1 then concat('2', lpad(cast(o_orderkey % 500 as string), 7, '0')) else 'none such' end").alias("probe"))
    found = b.objects(spark, d).withColumn("object_key", F.col("spkid")).select("object_key", "spkid", "des")
    return rank.lookup(found, probes).select("probe", "object_key")


def mean_sql(parts: list[str]) -> str:
    return b.b(f"({' + '.join(f'coalesce({p}, 0e0)' for p in parts)}) / nullif({' + '.join(f'(case when ({p}) is not null then 1 else 0 end)' for p in parts)}, 0)")


_IND = {"proximity_indicator": b.b("1 / (1 + moid * 20)"),
        "uncertainty_indicator": mean_sql([b.b("cast(condition_code as double) / 9"), b.b("rms / 2"), b._ARC, b._OBS]),
        "size_indicator": f"coalesce(case when diameter > 0 then {b.b('ln(1 + diameter) / ln(11e0)')} end, {b.b('(30 - h) / 15')})",
        "approach_indicator": mean_sql([f"(case when min_close_approach_dist_min >= 0 then {b.b('1 / (1 + min_close_approach_dist_min * 25)')} end)", b.b("max_close_approach_v_rel / 50"), b.b("ln(1 + close_approach_count) / ln(26e0)")]),
        "sentry_indicator": mean_sql(["(case when sentry_flag then 1e0 else 0e0 end)", "(case when sentry_ip is not null then (log10(sentry_ip) + 10) / 10 end)", b.b("(sentry_ps_cum + 8) / 10"), b.b("(sentry_ps_max + 8) / 10"), b.b("sentry_ts_max / 10"), b.b("ln(1 + sentry_n_imp) / ln(101e0)")])}


@query(f"with {GOLD_SQL} select object_key, {', '.join(f'round({v}, 6) as {k}' for k, v in _IND.items())}, close_approach_count is not null as has_approach, sentry_flag as has_sentry from gold")
def indicators(spark, d):
    return explain.indicators(gold_table(spark, d)).select("object_key", *r6(*_IND), "has_approach", "has_sentry")


@query(f"with {SCORE_SQL}, h as (select user_id, arg_max(value, (ts, event_id)) as last_value from events group by 1) select s.object_key, s.full_name as name, round(s.moid, 6) as moid, s.risk_category, round(h.last_value, 6) as last_value from scores s left join h on s.des = cast(h.user_id as varchar)")
def entity_360(spark, d):
    whole = scores(spark, d)
    history = rank.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select(F.col("user_id").cast("string").alias("des"), F.round("value", 6).alias("last_value"))
    view = explain.nested(whole, "risk_category").select("object_key", F.col("identity.full_name").alias("name"), F.col("identity.des").alias("des"), F.round("orbit.moid", 6).alias("moid"), "risk_category")
    return view.join(history, "des", "left").drop("des")


RANGES = {"e": (0.0, 0.9), "h": (15.0, None), "moid": (0.0, None)}


@query(f"""with {OBJECTS_SQL}, a as (select count(*) as n, avg(case when diameter is null then 1e0 else 0 end) as nd, avg(case when h is null then 1e0 else 0 end) as nh, sum(case when e < 0 then 1 else 0 end) as el, sum(case when e > 9e-1 then 1 else 0 end) as eh,
 sum(case when h < 15 then 1 else 0 end) as hl, sum(case when moid < 0 then 1 else 0 end) as ml from objects), k as (select coalesce(sum(case when n > 1 then 1 else 0 end), 0) as d from (select spkid, count(*) as n from objects group by 1) t),
r(c, column_name, metric, v) as (select 'non_empty', '', 'row_count', n from a union all select 'null_ratio', 'diameter', 'ratio', nd from a union all select 'null_ratio', 'h', 'ratio', nh from a union all select 'null_ratio', 'albedo', 'ratio', null from a union all
 select 'range', 'e', 'below_min', el from a union all select 'range', 'e', 'above_max', eh from a union all select 'range', 'h', 'below_min', hl from a union all select 'range', 'moid', 'below_min', ml from a union all
 select 'duplicate_keys', 'spkid', 'keys', d from k union all select 'required', 'spkid', 'present', 1 union all select 'required', 'albedo', 'present', 0)
select c as check, column_name, metric, round(cast(v as double), 6) as value, case when c in ('required', 'non_empty') and v = 0 then 'fail' when v is null then 'warn' when c = 'null_ratio' and v > 95e-2 then 'warn' when c in ('duplicate_keys', 'range') and v > 0 then 'warn' else 'pass' end as status from r""")
def quality_report(spark, d):
    out = quality.report(b.objects(spark, d), ["spkid"], ["spkid", "albedo"], ["diameter", "h", "albedo"], RANGES)
    return out.withColumn("value", F.round("value", 6))


@query(f"with {OBJECTS_SQL} select count(*) as n_rows, count(*) filter (pha) as positive, count(*) filter (not pha) as negative, count(*) filter (pha is null) as missing, round(avg(case when pha then 1e0 else 0 end), 6) as positive_rate, case when count(*) < 100 then 'insufficient_data' else 'ok' end as status, '' as warnings from objects")
def target_volume(spark, d):
    return quality.target_volume(b.objects(spark, d), "pha").withColumn("positive_rate", F.round("positive_rate", 6))


@query("select count(*) filter (toxic = 1) as n_true, count(*) filter (toxic = 0) as n_false, count(*) filter (l.doc_id is null) as n_unknown from documents left join labels l using (doc_id)")
def bool_distribution(spark, d):
    return quality.bool_distribution(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "toxic")


@query(f"with {GOLD_SQL} select 'physical' as name, count(*) filter (diameter is not null or albedo is not null) as covered, round(avg(case when diameter is not null or albedo is not null then 1e0 else 0 end), 6) as ratio from (select *, cast(null as double) as albedo from gold) g union all select 'sentry', count(sentry_ip), round(count(sentry_ip) / cast(count(*) as double), 6) from gold")
def coverage(spark, d):
    out = quality.coverage(gold_table(spark, d).withColumn("albedo", F.lit(None).cast("double")), {"physical": ["diameter", "albedo"], "sentry": ["sentry_ip"]})
    return out.withColumn("ratio", F.round("ratio", 6))


@query(f"with {GOLD_SQL} select column_name, missing, round(ratio, 6) as ratio from (select 'diameter' as column_name, count(*) - count(diameter) as missing, (count(*) - count(diameter)) / cast(count(*) as double) as ratio from gold union all select 'sentry_ip', count(*) - count(sentry_ip), (count(*) - count(sentry_ip)) / cast(count(*) as double) from gold union all select 'h', count(*) - count(h), (count(*) - count(h)) / cast(count(*) as double) from gold union all select 'min_close_approach_dist', count(*) - count(min_close_approach_dist), (count(*) - count(min_close_approach_dist)) / cast(count(*) as double) from gold) t where missing > 0")
def missingness(spark, d):
    return quality.missingness(gold_table(spark, d), ["diameter", "sentry_ip", "h", "min_close_approach_dist"]).withColumn("ratio", F.round("ratio", 6))


_LAYERS = ["part", "lineitem", "supplier", "orders", "events", "documents"]


@query("select layer, n_rows, case when n_rows >= 4000 then 'strong' when n_rows >= 300 then 'usable' when n_rows >= 100 then 'minimal' else 'not_ready' end as band from (" + " union all ".join(f"select '{t}' as layer, count(*) as n_rows from {t}" for t in _LAYERS) + ") t")
def readiness(spark, d):
    return quality.readiness({t: table(spark, d, t) for t in _LAYERS})


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) t where n = 1")
def latest_per_key(spark, d):
    return rank.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("select page_id, case when s = '' then 'sample' else s end as slug from (select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_.\\-]+', '_', 'g'), '_+', '_', 'g'), '^[._\\-]+|[._\\-]+$', '', 'g') as s from pages) t")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", c.slug("url").alias("slug"))


@query("select event_id, event_type = 'click' as is_click, try_cast(json_extract_string(props, '$.k') as double) as k, case when event_id % 7 = 0 then null else 'type ' || event_type end as label from events")
def clean_values(spark, d):
    raw = table(spark, d, "events").withColumn("raw", F.expr("case event_id % 7 when 0 then ' NaN ' else concat('  type   ', event_type) end"))
    yes = c.flag(F.when(F.col("event_type") == "click", " YES ").otherwise("n"))
    return raw.select("event_id", yes.alias("is_click"), c.number(F.get_json_object("props", "$.k")).alias("k"), c.designation("raw").alias("label"))


# Simulations, orbits, graphs, metrics.
from skyledger.operators import graph, metrics, orbit, simulate  # noqa: E402

_U = "(('0x' || substr(md5({0}), 1, 13))::bigint / 4503599627370496e0)"


def normal_sql(key: str, name: str, index: str, seed: str) -> str:
    u = _U.format(f"concat_ws(':', {key}, '{name}', {index}, {seed}, 'u')")
    v = _U.format(f"concat_ws(':', {key}, '{name}', {index}, {seed}, 'v')")
    return f"sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * pi() * {v})"


#: Runs and clones of each object and days between its places, fewer than the operators' defaults; all objects take part.
RUNS, CLONES, ORBIT_STEP = 50, 20, 30


@query()
def score_simulation(spark, d):
    out = simulate.simulated(scores(spark, d), RUNS, limit=None)
    return out.select("object_key", "n_simulations", "base_category", *[F.round(x, 4).alias(x) for x in ("mean_score", "std_score", "p05_score", "median_score", "p95_score", "category_shift_probability")], "p95_category", "stability")


@query()
def simulation_rollup(spark, d):
    return simulate.rollup(simulate.simulated(scores(spark, d), RUNS, limit=None)).select("n_objects", F.round("mean_of_means", 4).alias("mean_of_means"), F.round("max_p95", 4).alias("max_p95"))


@query(f"with {OBJECTS_SQL}, k as (select sim from range(20) r(sim)) select spkid as object_key, cast(sim as int) as simulation_index, round(h + 3e-1 * ({normal_sql('spkid', 'h', 'sim', '7')}), 4) as h, round(case when moid > 0 then greatest(moid * exp(25e-2 * ({normal_sql('spkid', 'moid', 'sim', '7')})), 0) else greatest(moid + 25e-2 * ({normal_sql('spkid', 'moid', 'sim', '7')}), 0) end, 4) as moid from objects, k")
def perturbed_scenarios(spark, d):
    base = b.objects(spark, d).select(F.col("spkid").alias("object_key"), "h", "moid")
    return simulate.perturbed(base, 20, 7).select("object_key", "simulation_index", F.round("h", 4).alias("h"), F.round("moid", 4).alias("moid"))


@query()
def sensitivity(spark, d):
    return simulate.sensitivity(scores(spark, d), limit=5).select("object_key", "variable", F.round("absolute_effect", 4).alias("absolute_effect"), "direction", "place")


_UNC = "35e-2 * least(cast(condition_code as double), 9) / 9 + 25e-2 * least(rms, 2) / 2 + 2e-1 / (1 + arc_length / 365) + 2e-1 / (1 + n_obs_used / 250e0)"


@query(f"with {OBJECTS_SQL} select des, round({b.b(_UNC)}, 6) as uncertainty from objects")
def orbital_uncertainty(spark, d):
    return b.objects(spark, d).select("des", F.round(orbit.uncertainty(b.objects(spark, d)), 6).alias("uncertainty"))


@query(f"with {OBJECTS_SQL} select des, round(a, 6) as a, round(least(e, 98e-2), 6) as e, round(n, 6) as n, 0 as n_warnings from objects")
def orbital_elements(spark, d):
    return orbit.elements(b.objects(spark, d)).select("des", *r6("a", "e", "n"), F.size("element_warnings").alias("n_warnings"))


def _steps(n: int) -> str:
    """Kepler's equation in SQL, one common table for each Newton step."""
    out = "k0 as (select *, m as ea from mean)"
    for k in range(n):
        out += f", k{k + 1} as (select * replace (ea - (ea - e * sin(ea) - m) / greatest(1 - e * cos(ea), 1e-9) as ea) from k{k})"
    return out


_BASE_ORBIT = f"""with {OBJECTS_SQL}, grid as (select *, radians(ma + n * day) as raw from (select spkid as object_key, a, least(e, 98e-2) as e, i, om, w, ma, n, unnest(range(0, 361, 30)) as day from objects) t),
mean as (select *, raw - 2 * pi() * floor(raw / (2 * pi())) as m from grid), {_steps(8)},
plane as (select *, a * (cos(ea) - e) as px, a * sqrt(greatest(0, 1 - e * e)) * sin(ea) as py from k8),
turned as (select *, cos(radians(w)) * px - sin(radians(w)) * py as x1, sin(radians(w)) * px + cos(radians(w)) * py as y1 from plane),
far as (select *, sqrt(power(cos(radians(om)) * x1 - sin(radians(om)) * y1 * cos(radians(i)) - cos(0.017202098955e0 * day), 2) + power(sin(radians(om)) * x1 + cos(radians(om)) * y1 * cos(radians(i)) - sin(0.017202098955e0 * day), 2) + power(y1 * sin(radians(i)), 2)) as distance from turned)"""


@query(f"{_BASE_ORBIT} select object_key, round(min(distance), 4) as baseline_distance from far group by 1")
def orbital_baseline(spark, d):
    base = orbit.elements(b.objects(spark, d).withColumn("object_key", F.col("spkid")))
    return orbit.distances(base, 360, 30).groupBy("object_key").agg(F.round(F.min("distance"), 4).alias("baseline_distance"))


@query()
def orbital_scenarios(spark, d):
    out = orbit.scenarios(scores(spark, d), CLONES, 3650, ORBIT_STEP)
    return out.select("object_key", *[F.round(x, 4).alias(x) for x in ("baseline_distance", "mean_distance", "p05", "p50", "p95", "dispersion_index")], "scenario_category")


@query()
def orbital_trace(spark, d):
    return orbit.trace(scores(spark, d), CLONES, 3650, ORBIT_STEP).select("object_key", "day", *[F.round(x, 4).alias(x) for x in ("p05", "p50", "p95")])


@query()
def orbital_summary(spark, d):
    out = orbit.summary(orbit.scenarios(scores(spark, d), CLONES, 3650, ORBIT_STEP))
    return out.select("scenario_category", "n", *[F.round(x, 4).alias(x) for x in ("mean_dispersion", "max_dispersion", "min_p05")])


_KNN = """near as (select a.vec_id as src, b.vec_id as dst, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id),
knn as (select src, dst, d from (select *, row_number() over (partition by src order by d, dst) as n from near) t where n <= 5),
edges as (select least(src, dst) as a, greatest(src, dst) as b, min(d) as distance from knn group by 1, 2)"""


def embedding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query(f"with {_KNN} select a, b, round(distance, 6) as distance, round(1 / (1 + distance), 6) as similarity from edges")
def knn_edges(spark, d):
    return embedding_edges(spark, d).select("a", "b", *r6("distance", "similarity"))


@query(f"with {_KNN} select src as a, dst as b, round(d, 6) as distance from near where src < dst and d <= 11e-1")
def radius_edges(spark, d):
    return graph.radius_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 1.1).select("a", "b", *r6("distance"))


@query(f"with {_KNN}, c as (select count(*) as e from edges), v as (select count(*) as n from embeddings) select n as n_nodes, e as n_edges, round(2e0 * e / (n * (n - 1)), 6) as density, round(2e0 * e / n, 6) as mean_degree, case when n < 10 then 'insufficient_data' else 'ok' end as status from c, v")
def graph_summary(spark, d):
    return graph.summary(table(spark, d, "embeddings"), embedding_edges(spark, d), "vec_id").select("n_nodes", "n_edges", *r6("density", "mean_degree"), "status")


@query(f"with recursive {_KNN}, near2 as (select least(src, dst) as a, greatest(src, dst) as b from near where d <= 11e-1 and src < dst), ends as (select a, b from near2 union select b, a from near2), reach as (select vec_id as id, vec_id as low from embeddings union select ends.b, reach.low from reach join ends on ends.a = reach.id) select id as vec_id, min(low) as component from reach group by 1")
def graph_components(spark, d):
    return graph.radius_components(table(spark, d, "embeddings"), "vec_id", "embedding", 1.1)


@query(f"with {_KNN}, ends as (select a as src from edges union all select b from edges) select vec_id, count(src) as neighbours from embeddings left join ends on src = vec_id group by 1")
def neighbor_counts(spark, d):
    return graph.degrees(table(spark, d, "embeddings"), embedding_edges(spark, d), "vec_id")


@query(f"with {_KNN}, ends as (select a as src, b as dst, distance from edges union all select b, a, distance from edges) select src, dst, label, round(distance, 6) as distance from ends join embeddings on dst = vec_id")
def neighbors_of(spark, d):
    nodes = table(spark, d, "embeddings").select("vec_id", "label")
    return graph.neighbours_of(embedding_edges(spark, d), nodes, "vec_id", nodes).select("src", "dst", "label", *r6("distance"))


@query(f"with {_KNN}, f as (select vec_id from embeddings order by 1 limit 200) select a, b from edges where a in (select vec_id from f) and b in (select vec_id from f)")
def induced_subgraph(spark, d):
    return graph.induced(table(spark, d, "embeddings"), embedding_edges(spark, d), "vec_id", 200).select("a", "b")


@query(f"with {_KNN}, ends as (select a as src, b as dst from edges union all select b, a from edges), one as (select src, avg(label) as m from ends join embeddings on dst = vec_id group by 1), two as (select ends.src, avg(one.m) as m from ends join one on one.src = ends.dst group by 1) select vec_id, label, round(one.m, 6) as label_1, round(two.m, 6) as label_2 from embeddings left join one on one.src = vec_id left join two on two.src = vec_id")
def neighbor_features(spark, d):
    out = graph.neighbour_means(table(spark, d, "embeddings").select("vec_id", "label"), embedding_edges(spark, d), "vec_id", ["label"])
    return out.select("vec_id", "label", *r6("label_1", "label_2"))


@query(f"with {GOLD_SQL}, m as (select median(diameter) as md, median(h) as mh from gold), f as (select object_key, coalesce(diameter, md) as diameter, coalesce(h, mh) as h from gold, m), s as (select avg(diameter) as ad, stddev_pop(diameter) as sd, avg(h) as ah, stddev_pop(h) as sh from f) select object_key, round((diameter - ad) / sd, 5) as diameter, round((h - ah) / sh, 5) as h from f, s")
def impute_scale(spark, d):
    out = quality.impute_scale(gold_table(spark, d), ["diameter", "h"], "object_key")
    return out.select("object_key", F.round("diameter", 5).alias("diameter"), F.round("h", 5).alias("h"))


@query("with r as (select doc_id, quality, count(*) over (partition by quality) as n, row_number() over (partition by quality order by md5(concat_ws(':', cast(doc_id as varchar), '42')), doc_id) as k from labels) select doc_id, quality, case when n > 1 and k <= round(n * 25e-2) then 'test' else 'train' end as split from r")
def stratified_split(spark, d):
    return metrics.stratified(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


@query(f"with {OBJECTS_SQL}, p as (select case when pha then 1 else 0 end as y, case when moid <= 5e-2 and h <= 22 then 1 else 0 end as p from objects), c as (select count(*) filter (y = 1 and p = 1) as tp, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 0 and p = 0) as tn from p) select 'rule' as model, tp, fp, fn, tn, round((tp + tn) / cast(tp + fp + fn + tn as double), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(fn / nullif(tp + fn, 0), 6) as false_negative_rate from c")
def rule_baseline_metrics(spark, d):
    rows = b.objects(spark, d).select(F.lit("rule").alias("model"), F.col("pha").cast("int").alias("label"), c.rule_label().alias("predicted"))
    return metrics.confusion(rows, ["model"]).select("model", "tp", "fp", "fn", "tn", *r6("accuracy", "precision", "recall", "f1", "false_negative_rate"))


@query("""with r as (select quality as y, n_chars / 1e5 as s from labels join documents using (doc_id)), g as (select s, sum(y) as p, count(*) as n from r group by 1),
c as (select *, sum(p) over (order by s desc) as cp, sum(n) over (order by s desc) as cn, sum(p) over () as ap, sum(n) over () as an from g)
select 'chars' as model, round(sum(p * (an - ap - (cn - cp) + (n - p) / 2e0)) / max(ap * (an - ap)), 6) as roc_auc, round(sum(p * cp / cast(cn as double)) / max(ap), 6) as average_precision, (select round(avg((s - y) * (s - y)), 6) from r) as brier from c""")
def rank_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.lit("chars").alias("model"), F.col("quality").alias("label"), (F.col("n_chars") / 1e5).alias("score"))
    return metrics.ranked(rows, ["model"]).select("model", *r6("roc_auc", "average_precision", "brier"))


@query("with r as (select doc_id, quality as y, n_chars as s from labels join documents using (doc_id)), o as (select *, row_number() over (order by s desc, doc_id) as n from r) select k, round(sum(y) filter (n <= k) / cast((select sum(y) from r) as double), 6) as recall from o, (values (10), (25), (50)) t(k) group by k")
def topk_recall(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return metrics.top_k_recall(rows.withColumn("m", F.lit(1)), ["m"], "doc_id").select("k", *r6("recall"))


# Sources, sinks, streams, evidence.
from skyledger.operators import evidence, features  # noqa: E402
from skyledger.sources import bronze, sinks  # noqa: E402
from skyledger.streaming import intake  # noqa: E402


_CUSTOMER = "object struct<spkid:string,fullname:string,phys_par:array<struct<name:string,value:string>>>"


def captures(spark: SparkSession, sf_dir: str) -> str:
    """Customers landed as wrapped captures of two sources; returns the folder."""
    c_ = table(spark, sf_dir, "customer")
    item = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("string").alias("value"))
    obj = F.struct(F.col("c_custkey").cast("string").alias("spkid"), F.col("c_name").alias("fullname"), F.array(item("H", F.col("c_acctbal")), item("segment", F.col("c_mktsegment"))).alias("phys_par"))
    root = shared_folder(spark, "bronze")
    for source, rows in (("even", c_.where("c_custkey % 2 = 0")), ("odd", c_.where("c_custkey % 2 = 1"))):
        day = F.expr("timestamp '2026-05-28 00:00:00' + make_dt_interval(cast(c_custkey % 3 as int))")
        bronze.land(bronze.landed(rows, source, "c_custkey", day, F.struct(obj.alias("object"))), root)
    return root


@query("select 'even' as source, cast(c_custkey as varchar) as spkid, c_name as fullname, cast(date '2026-05-28' + cast(c_custkey % 3 as int) as varchar)[1:10] as ingest_date, c_acctbal as h, null::varchar as pdes from customer where c_custkey % 2 = 0")
def bronze_roundtrip(spark, d):
    df = bronze.read(spark, captures(spark, d), f"struct<{_CUSTOMER.replace('object struct', 'object:struct')}>", "even")
    return df.select("source", bronze.at(df, "data.object.spkid", "string").alias("spkid"), bronze.at(df, "data.object.fullname", "string").alias("fullname"),
                     "ingest_date", bronze.named_value(F.col("data.object.phys_par"), "h", "double").alias("h"), bronze.at(df, "data.object.pdes", "string").alias("pdes"))


@query("select case c_custkey % 2 when 0 then 'even' else 'odd' end as source, true as has_files from customer group by all")
def source_catalogue(spark, d):
    return bronze.inventory(spark, captures(spark, d)).select("source", (F.col("files") > 0).alias("has_files"))


@query("select cast(event_id as varchar) as id, event_type as type, value from events")
def header_rows_unpack(spark, d):
    packed = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("g")).agg(F.collect_list(F.array(F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"))).alias("rows"))
    packed = packed.select(F.struct(F.array(F.lit("id"), F.lit("type"), F.lit("value")).alias("fields"), F.col("rows").alias("data")).alias("data"))
    out = bronze.unpacked(packed)
    return out.select(F.try_element_at("record", F.lit("id")).alias("id"), F.try_element_at("record", F.lit("type")).alias("type"), F.try_element_at("record", F.lit("value")).try_cast("double").alias("value"))


@query("select event_id from events where event_type = 'click' or json_extract_string(props, '$.k') is not null")
def record_routing(spark, d):
    rec = F.map_filter(F.create_map(F.lit("click"), F.when(F.col("event_type") == "click", "1"), F.lit("k"), F.get_json_object("props", "$.k")), lambda k, v: v.isNotNull())
    return bronze.routed(table(spark, d, "events").withColumn("record", rec), ["click", "k"]).select("event_id")


@query("select 'orders' as source, cast(o_orderkey as varchar) as object_id, '{}' as params_json from orders union all select 'events', cast(event_id as varchar), props from events union all select source, cast(doc_id as varchar), '{}' from documents")
def lineage_events(spark, d):
    frames = {"orders": table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("object_id")),
              "events": table(spark, d, "events").select(F.col("event_id").cast("string").alias("object_id"), F.col("props").alias("params_json")),
              "documents": table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("object_id"))}
    return bronze.lineage(frames).select("source", "object_id", "params_json")


@query("with u as (select 1 as r, c_custkey as pos, c_mktsegment as v from customer union all select 2, s_suppkey, s_name from supplier union all select 3, p_partkey, upper(p_brand) from part union all select 4, p_partkey, p_brand from part) select r, v from (select *, row_number() over (partition by lower(v) order by r, pos) as n from u) t where n = 1")
def discover_union(spark, d):
    parts = [("customer", 1, "c_custkey", "c_mktsegment"), ("supplier", 2, "s_suppkey", "s_name"), ("part", 3, "p_partkey", "upper(p_brand)"), ("part", 4, "p_partkey", "p_brand")]
    out = None
    for name, r, pos, v in parts:
        one = table(spark, d, name).selectExpr(f"{r} as r", f"cast({pos} as long) as pos", f"{v} as v")
        out = one if out is None else out.unionByName(one)
    return bronze.unique_by_priority(out, c.designation("v"), [F.col("r"), F.col("pos")]).select("r", "v")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber > 3)")
def skip_existing(spark, d):
    have = table(spark, d, "lineitem").where("l_linenumber > 3")
    return bronze.missing_only(table(spark, d, "orders"), have, "o_orderkey", "l_orderkey").select("o_orderkey")


_ATTEMPT = "case when o_orderstatus = 'F' then 'success' when o_orderkey % 10 = 0 then 'failed' else 'skipped' end"


@query(f"with a as (select {_ATTEMPT} as s from orders) select count(*) as target, count(*) filter (s = 'success') as success, count(*) filter (s = 'failed') as failed, count(*) filter (s = 'skipped') as skipped, round(count(*) filter (s <> 'failed') / cast(count(*) as double), 6) as coverage, case when count(*) filter (s = 'failed') = 0 then 'success' when count(*) filter (s <> 'failed') > 0 then 'partial_success' else 'failed' end as run_status from a")
def attempt_accounting(spark, d):
    return evidence.attempts(table(spark, d, "orders").select(F.expr(_ATTEMPT).alias("status"))).withColumn("coverage", F.round("coverage", 6))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) t where n = 1")
def sink_append_latest(spark, d):
    e = table(spark, d, "events")
    return sinks.append_latest(spark, [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], shared_folder(spark, "history"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("select count(*) as row_count, 'written' as status, count(*) as rows_after from part union all select 0, 'skipped_empty', count(*) from part")
def sink_overwrite(spark, d):
    p, path = table(spark, d, "part"), shared_folder(spark, "table")
    done = []
    for df in (p, p.where("false")):  # the second leaves the first one's table alone
        at = sinks.write_table(df, path)
        done.append((at["row_count"], at["status"], spark.read.schema(p.schema).parquet(path).count()))
    return spark.createDataFrame(done, "row_count long, status string, rows_after long")


@query("select event_id, epoch_us(ts) as ts_us from events")
def intake_stream(spark, d):
    root = shared_folder(spark, "intake")
    table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")).write.json(f"{root}/in")
    intake.drained(intake.new_captures(spark, f"{root}/in", "event_id long, ts_us long"), f"{root}/out", f"{root}/state")
    return spark.read.schema("event_id long, ts_us long").parquet(f"{root}/out")


@query("select distinct user_id from events")
def intake_dedupe(spark, d):
    root = shared_folder(spark, "intake")
    table(spark, d, "events").select("user_id", "ts").write.json(f"{root}/in")
    stream = intake.once_per_object(intake.new_captures(spark, f"{root}/in", "user_id long, ts timestamp"), ["user_id"], "ts", "36500 days")
    intake.drained(stream.select("user_id"), f"{root}/out", f"{root}/state")
    return spark.read.schema("user_id long").parquet(f"{root}/out")


@query("select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2 having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) - interval 1 day from events)")
def intake_windows(spark, d):
    root = shared_folder(spark, "intake")
    table(spark, d, "events").select("event_type", "ts").write.json(f"{root}/in")
    intake.drained(intake.counts(intake.new_captures(spark, f"{root}/in", "event_type string, ts timestamp"), "ts", "event_type"), f"{root}/out", f"{root}/state")
    return spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{root}/out")


_MODELS = "with p as (select p_partkey, cast(p_size <= 15 as int) as label, p_partkey % 101 / 101e0 as s1, p_partkey % 37 / 37e0 as s2, p_partkey % 5 / 5e0 as s3 from part), m as (select p_partkey, label, 'm1' as model, s1 as score, 'full_features' as feature_set from p union all select p_partkey, label, 'm2', s2, 'orbital_only' from p union all select p_partkey, label, 'm3', s3, 'no_definition_features' from p), r as (select *, cast(score >= 5e-1 as int) as predicted, case when greatest(score, 1 - score) >= 85e-2 then 'high' when greatest(score, 1 - score) >= 65e-2 then 'medium' else 'low' end as confidence, case when feature_set = 'full_features' then 'high' else 'low' end as leakage_risk, case when p_partkey % 4 = 0 then 'eval' else 'full' end as prediction_mode from m)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule models over the objects."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") <= 15).cast("int").alias("label"), F.explode(F.expr("array(struct('m1' as model, p_partkey % 101 / 101D as score, 'full_features' as feature_set), struct('m2' as model, p_partkey % 37 / 37D as score, 'orbital_only' as feature_set), struct('m3' as model, p_partkey % 5 / 5D as score, 'no_definition_features' as feature_set))")).alias("m"))
    p = p.select("p_partkey", "label", "m.*").withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "confidence": evidence.confidence(F.col("score")), "leakage_risk": features.set_risk(F.col("feature_set"))})
    return p.withColumn("prediction_mode", F.when(F.col("p_partkey") % 4 == 0, "eval").otherwise("full"))


@query(f"{_MODELS} select p_partkey, count(distinct predicted) as labels, count(distinct model) as models, count(*) filter (confidence = 'high' and label <> predicted) as confident_errors, round(max(score), 6) as max_score, case when count(distinct predicted) > 1 then 'model_family_disagreement' else 'high_confidence_error' end as reason from r group by 1 having count(distinct predicted) > 1 or count(*) filter (confidence = 'high' and label <> predicted) > 0")
def disagreements(spark, d):
    return evidence.disagreements(predictions(spark, d), "p_partkey").withColumn("max_score", F.round("max_score", 6))


@query(f"{_MODELS} select model, confidence, count(*) as n from r group by 1, 2")
def confidence_subsets(spark, d):
    return predictions(spark, d).groupBy("model", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_MODELS} select p_partkey, model, case when label = 0 then 'false_positive' else 'false_negative' end as error from r where label <> predicted")
def error_subsets(spark, d):
    p = predictions(spark, d)
    return evidence.errors(p, 0, 1).select("p_partkey", "model", F.lit("false_positive").alias("error")).union(evidence.errors(p, 1, 0).select("p_partkey", "model", F.lit("false_negative").alias("error")))


@query(f"{_MODELS} select p_partkey, arg_max(confidence, case confidence when 'high' then 3 when 'medium' then 2 else 1 end) as best_confidence from r where leakage_risk <> 'high' group by 1")
def best_evidence_bucket(spark, d):
    return evidence.best_bucket(predictions(spark, d), "p_partkey")


@query(f"{_MODELS} select prediction_mode, count(distinct p_partkey) as objects, count(distinct model) as models, count(*) as n_rows from r group by 1")
def evidence_summary(spark, d):
    return evidence.summary(predictions(spark, d), "p_partkey")


@query(f"{_MODELS} select p_partkey, model from r where prediction_mode = 'eval'")
def sink_bundle(spark, d):
    p, path = predictions(spark, d), shared_folder(spark, "bundle")
    sinks.write_bundle(p, path, "p_partkey")
    return sinks.read_bundle(spark, path, p.withColumn("error_kind", F.lit("")), "eval").select("p_partkey", "model")


@query(f"{_MODELS} select p_partkey, model, feature_set, confidence, 'false_positive' as error_kind from r where prediction_mode = 'full' and confidence = 'high' and label = 0 and predicted = 1 and leakage_risk <> 'high'")
def evidence_subset(spark, d):
    """Confident false positives of defensible models, read back from their folder only."""
    p, path = predictions(spark, d), shared_folder(spark, "bundle")
    sinks.write_bundle(p, path, "p_partkey")
    like = p.withColumn("error_kind", F.lit(""))
    return sinks.read_bundle(spark, path, like, "full", "high", "false_positive", defensible=True).select("p_partkey", "model", "feature_set", "confidence", "error_kind")


@query(f"{_MODELS} select p_partkey, count(distinct predicted) as labels, count(*) filter (confidence = 'high' and label <> predicted) as confident_errors, case when count(distinct predicted) > 1 then 'model_family_disagreement' else 'high_confidence_error' end as reason from r where prediction_mode = 'full' group by 1 having count(distinct predicted) > 1 or count(*) filter (confidence = 'high' and label <> predicted) > 0")
def saved_disagreements(spark, d):
    path = shared_folder(spark, "bundle")
    sinks.write_bundle(predictions(spark, d), path, "p_partkey")
    return sinks.read_disagreements(spark, path).select("p_partkey", "labels", "confident_errors", "reason")


@query(f"{_MODELS}, f as (select * from r where prediction_mode = 'full'), a as (select count(*) as n from part) select count(*) as rows_full, count(distinct p_partkey) as objects_full, (select count(*) from r where prediction_mode = 'eval') as rows_eval, round(count(distinct p_partkey) / cast(any_value(n) as double), 6) as coverage_ratio from f, a")
def evidence_coverage(spark, d):
    return evidence.coverage(predictions(spark, d), table(spark, d, "part"), "p_partkey")


_F1 = "q as (select model, feature_set, round(2e0 * count(*) filter (label = 1 and predicted = 1) / (2 * count(*) filter (label = 1 and predicted = 1) + count(*) filter (label <> predicted)), 6) as f1 from r group by 1, 2)"


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), ["model", "feature_set"]).select("model", "feature_set", F.round("f1", 6).alias("f1"), F.lit(None).cast("double").alias("pr_auc"))


@query(f"{_MODELS}, {_F1} select 'overall' as scope, model, feature_set, f1 as value from (select * from q order by f1 desc, model limit 1) a union all select 'defensible', model, feature_set, f1 from (select * from q where feature_set <> 'full_features' order by f1 desc, model limit 1) b")
def best_models(spark, d):
    return evidence.best_models(model_metrics(spark, d))


@query(f"{_MODELS}, {_F1}, w as (select max(f1) filter (feature_set = 'full_features') as full_features, max(f1) filter (feature_set = 'no_definition_features') as no_definition_features, max(f1) filter (feature_set = 'definition_features_only') as definition_features_only from q) select *, full_features - no_definition_features >= 2e-1 as full_gap, definition_features_only >= 85e-2 as definition_strong, definition_features_only - no_definition_features >= 2e-1 as definition_gap from w")
def leakage_compare(spark, d):
    return evidence.leakage_signals(model_metrics(spark, d))


@query(f"with {SCORE_SQL}, s as (select count(*) as n, count(*) filter (pha) as pha, count(*) filter (sentry_flag) as sentry, count(diameter) as dia, count(close_approach_count) as ca, avg(risk_score) as mean, max(risk_score) as mx, count(*) filter (risk_score_0_100 >= 40) as high from scores), r(finding_group, title, metric, value) as (select 'dataset', 'objects', 'count', cast(n as double) from s union all select 'dataset', 'hazardous', 'count', pha from s union all select 'dataset', 'impact monitoring', 'count', sentry from s union all select 'dataset', 'size coverage', 'ratio', round(dia / cast(n as double), 6) from s union all select 'dataset', 'approach coverage', 'ratio', round(ca / cast(n as double), 6) from s union all select 'risk', 'score', 'mean', round(mean, 6) from s union all select 'risk', 'score', 'max', round(mx, 6) from s union all select 'risk', 'elevated or above', 'count', high from s) select * from r")
def findings(spark, d):
    return evidence.findings(scores(spark, d))


#: Rounds after which label propagation has settled, for SQL.
LABEL_STEPS = 40
# Models: no SQL; tests check that scores are probabilities and rank better than chance.
from skyledger.operators import models  # noqa: E402


def _predicted(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    rows = b.objects(spark, sf_dir).select(F.col("spkid").alias("object_key"), F.col("pha").cast("int").alias("label"), "moid", "h", "e", "a")
    return models.predictions(rows, model, ["moid", "h", "e", "a"])


@query()
def lr_predictions(spark, d):
    return _predicted(spark, d, "logistic_regression")


@query()
def rf_predictions(spark, d):
    return _predicted(spark, d, "random_forest")


@query()
def gbt_predictions(spark, d):
    return _predicted(spark, d, "gradient_boosting")


@query()
def mlp_predictions(spark, d):
    return _predicted(spark, d, "mlp")


@query(f"""with recursive {_KNN}, ends as (select a as src, b as dst, 1 / (1 + distance) as w from edges union all select b, a, 1 / (1 + distance) from edges),
known as (select vec_id, case when vec_id % 3 <> 0 then (label = 0)::int::double end as fixed from embeddings), listen as (select src, list(dst order by dst) as near, list(w order by dst) as w from ends join known on vec_id = src where fixed is null group by 1),
rounds as (select 0 as step, map_from_entries(list((vec_id, coalesce(fixed, 5e-1)))) as score from known
 union all select step + 1, map_concat(score, (select map_from_entries(list((src, list_sum(list_transform(near, lambda x, i: w[i] * score[x])) / list_sum(w)))) from listen)) from rounds where step < {LABEL_STEPS})
select vec_id, round(score[vec_id], 2) as score from rounds, known where step = {LABEL_STEPS}""")
def label_propagation(spark, d):
    nodes = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, (F.col("label") == 0).cast("int")).alias("known"))
    return models.label_propagation(nodes, embedding_edges(spark, d), "vec_id", "known", tolerance=1e-6).withColumn("score", F.round("score", 2))


from skyledger import layer_queries, model_queries, report_queries  # noqa: E402, F401  (they register their queries)
