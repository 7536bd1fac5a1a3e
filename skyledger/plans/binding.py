"""The domain's relations over the star-schema tables: objects, approaches and impact-monitoring records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as des", "concat('2', lpad(cast(p_partkey as string), 7, '0')) as spkid", "p_name as full_name",
        "p_type as orbit_class_code", "p_size <= 15 as pha", "14.0D + p_size % 17 as h",
        "case when p_partkey % 3 <> 0 then p_retailprice / 1000.0D end as diameter", "(p_partkey % 97) / 100.0D as e",
        "0.8D + (p_partkey % 53) / 50.0D as a", "(0.8D + (p_partkey % 53) / 50.0D) * (1 - (p_partkey % 97) / 100.0D) as q",
        "(p_partkey % 61) / 2.0D as i", "cast(p_partkey * 13 % 360 as double) as om", "cast(p_partkey * 17 % 360 as double) as w",
        "cast(p_partkey * 19 % 360 as double) as ma", "(p_partkey % 101) / 500.0D as moid", "cast(p_partkey % 10 as string) as condition_code",
        "cast(p_partkey * 7 % 4000 as double) as arc_length", "cast(p_partkey * 11 % 900 as int) as n_obs_used", "(p_partkey % 40) / 20.0D as rms",
    ).withColumns({"per": F.expr("365.25D * power(a, 1.5D)"), "moid_ld": F.when(F.col("moid") > 0, F.col("moid") * 389.174)}).withColumn(
        "n", F.expr("360.0D / per")
    )


def approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey as string) as des", "l_discount as dist", "l_discount / 2 as dist_min", "l_quantity as v_rel",
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm') as close_approach_datetime",
    )


def sentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as string) as des", "concat('2', lpad(cast(s_nationkey as string), 7, '0')) as spk",
        "power(10.0D, -(1 + s_suppkey % 9)) as ip", "-(s_suppkey % 70) / 10.0D as ps_cum", "-(s_suppkey % 70) / 10.0D - 0.3D as ps_max",
        "cast(s_suppkey % 3 as double) as ts_max", "cast(s_suppkey % 50 as int) as n_imp",
    )


OBJECT_COLUMNS = ["des", "spkid", "full_name", "orbit_class_code", "pha", "h", "diameter", "e", "a", "q", "i", "om", "w", "ma", "moid", "condition_code", "arc_length", "n_obs_used", "rms", "per", "moid_ld", "n"]

# The same relations in DuckDB's SQL.
OBJECTS_SQL = """objects as (select *, 365.25e0 * power(a, 1.5e0) as per, 360e0 / (365.25e0 * power(a, 1.5e0)) as n, case when moid > 0 then moid * 389.174e0 end as moid_ld from (
select cast(p_partkey as varchar) as des, '2' || lpad(cast(p_partkey as varchar), 7, '0') as spkid, p_name as full_name, p_type as orbit_class_code,
 p_size <= 15 as pha, 14e0 + p_size % 17 as h, case when p_partkey % 3 <> 0 then p_retailprice / 1000e0 end as diameter, (p_partkey % 97) / 100e0 as e,
 8e-1 + (p_partkey % 53) / 50e0 as a, (8e-1 + (p_partkey % 53) / 50e0) * (1 - (p_partkey % 97) / 100e0) as q, (p_partkey % 61) / 2e0 as i,
 cast(p_partkey * 13 % 360 as double) as om, cast(p_partkey * 17 % 360 as double) as w, cast(p_partkey * 19 % 360 as double) as ma,
 (p_partkey % 101) / 500e0 as moid, cast(p_partkey % 10 as varchar) as condition_code, cast(p_partkey * 7 % 4000 as double) as arc_length,
 cast(p_partkey * 11 % 900 as int) as n_obs_used, (p_partkey % 40) / 20e0 as rms from part) t)"""
SENTRY_SQL = """sentry as (select cast(s_suppkey as varchar) as des, '2' || lpad(cast(s_nationkey as varchar), 7, '0') as spk, power(10e0, -(1 + s_suppkey % 9)) as ip,
 -(s_suppkey % 70) / 10e0 as ps_cum, -(s_suppkey % 70) / 10e0 - 3e-1 as ps_max, cast(s_suppkey % 3 as double) as ts_max, cast(s_suppkey % 50 as int) as n_imp from supplier),
groups as (select des, spk, max(ip) as sentry_ip, max(ps_cum) as sentry_ps_cum, max(ps_max) as sentry_ps_max, max(ts_max) as sentry_ts_max, max(n_imp) as sentry_n_imp from sentry group by 1, 2)"""


def b(x: str) -> str:
    """Clip to [0, 1], null kept."""
    return f"(case when ({x}) is not null then least(greatest(({x}), 0e0), 1e0) end)"


GOLD_SQL = f"""{OBJECTS_SQL}, {SENTRY_SQL},
met as (select distinct o.spkid as object_key, g.* from objects o join groups g on o.des = g.des or o.spkid = g.spk),
most as (select object_key, max(sentry_ip) as sentry_ip, max(sentry_ps_cum) as sentry_ps_cum, max(sentry_ps_max) as sentry_ps_max, max(sentry_ts_max) as sentry_ts_max, max(sentry_n_imp) as sentry_n_imp from met group by 1),
cad as (select cast(l_partkey as varchar) as des, min(l_discount) as min_close_approach_dist, min(l_discount / 2) as min_close_approach_dist_min, max(l_quantity) as max_close_approach_v_rel,
 min(strftime(l_shipdate, '%Y-%m-%d %H:%M')) as next_close_approach_datetime, count(*) as close_approach_count from lineitem group by 1),
wide as (select o.spkid as object_key, o.*, cad.* exclude (des), most.* exclude (object_key) from objects o left join cad on o.des = cad.des left join most on o.spkid = most.object_key),
gold as (select *, sentry_ip is not null as sentry_flag, case when diameter > 0 then ln(1 + diameter) end as log_diameter, case when moid >= 0 then 1 / (1 + moid) end as inverse_moid,
 case when min_close_approach_dist >= 0 then 1 / (1 + min_close_approach_dist) end as inverse_min_distance, coalesce({b('max_close_approach_v_rel / 50')}, 0e0) as relative_velocity_score,
 {b(f"45e-2 * {b('ln(1 + coalesce(n_obs_used, 0)) / 9.21e0')} + 45e-2 * {b('ln(1 + coalesce(arc_length, 0)) / 10.5e0')} + 1e-1 * coalesce(1 / (1 + rms), 0)")} as observation_quality_score,
 {b("coalesce(cast(condition_code as double), 9e0) / 9")} as uncertainty_proxy_score,
 coalesce(case when diameter > 0 then {b('ln(1 + diameter) / 2.4e0')} end, {b('(30 - h) / 15')}, 0e0) as size_proxy_score,
 greatest(coalesce(case when min_close_approach_dist >= 0 then 1 / (1 + min_close_approach_dist) end, 0), coalesce(case when moid >= 0 then 1 / (1 + moid) end, 0)) as proximity_proxy_score,
 case when sentry_ip is not null then 1e0 else 0e0 end as sentry_presence_score,
 ({' + '.join(f"(case when {c} is not null then 1 else 0 end)" for c in ('h', 'diameter', 'e', 'a', 'q', 'i', 'moid', 'min_close_approach_dist', 'max_close_approach_v_rel', 'sentry_ip', 'condition_code', 'arc_length', 'n_obs_used', 'rms'))}) / 14e0 as feature_completeness_ratio from wide)"""


def weighted_sql(parts: list[tuple[str, str]], default: str) -> str:
    total = " + ".join(f"(case when ({v}) is not null then {w} else 0e0 end)" for v, w in parts)
    mean = " + ".join(f"coalesce({b(v)} * {w}, 0e0)" for v, w in parts)
    return b(f"coalesce(({mean}) / nullif({total}, 0), {default})")


_ARC, _OBS = f"1 - {b('ln(1 + greatest(arc_length, 0)) / ln(3651e0)')}", f"1 - {b('ln(1 + greatest(n_obs_used, 0)) / ln(1001e0)')}"


def components_sql() -> str:
    return ", ".join(f"{weighted_sql(parts, default)} as {name}" for name, parts, default in [
        ("physical_risk_component", [("ln(1 + nullif(diameter, 0)) / ln(11e0)", "35e-2"), ("(30 - h) / 15", "3e-1"), ("nullif(log_diameter, 0) / ln(11e0)", "15e-2"), ("size_proxy_score", "2e-1")], "0e0"),
        ("orbital_risk_component", [("1 / (1 + greatest(moid, 0) * 20)", "35e-2"), ("case when moid_ld is not null then 1 / (1 + greatest(moid_ld, 0) / 10) end", "2e-1"), ("inverse_moid", "15e-2"), ("(13e-1 - q) / 13e-1", "1e-1"), ("e", "12e-2"), ("i / 40", "8e-2")], "0e0"),
        ("approach_risk_component", [("case when min_close_approach_dist is not null then 1 / (1 + greatest(min_close_approach_dist, 0) * 25) end", "28e-2"), ("case when min_close_approach_dist_min is not null then 1 / (1 + greatest(min_close_approach_dist_min, 0) * 25) end", "2e-1"), ("inverse_min_distance", "14e-2"), ("max_close_approach_v_rel / 50", "16e-2"), ("relative_velocity_score", "12e-2"), ("case when close_approach_count is not null then ln(1 + greatest(close_approach_count, 0)) / ln(26e0) end", "1e-1")], "0e0"),
        ("sentry_risk_component", [("case when sentry_flag then 1e0 else 0e0 end", "2e-1"), ("sentry_presence_score", "15e-2"), ("case when sentry_ip is not null then case when sentry_ip <= 0 then 0e0 else (log10(least(sentry_ip, 1)) + 10) / 10 end end", "25e-2"), ("(sentry_ps_cum + 8) / 10", "13e-2"), ("(sentry_ps_max + 8) / 10", "12e-2"), ("sentry_ts_max / 10", "1e-1"), ("case when sentry_n_imp is not null then ln(1 + greatest(sentry_n_imp, 0)) / ln(101e0) end", "5e-2")], "0e0"),
        ("uncertainty_risk_component", [("cast(condition_code as double) / 9", "28e-2"), ("rms / 2", "18e-2"), (_ARC, "22e-2"), (_OBS, "2e-1"), ("uncertainty_proxy_score", "12e-2")], "35e-2"),
        ("data_quality_component", [("1 - feature_completeness_ratio", "5e-1"), (_ARC, "25e-2"), (_OBS, "25e-2")], "4e-1"),
    ])


BAND_SQL = "case when {0} >= 80 then 'critical' when {0} >= 60 then 'high' when {0} >= 40 then 'elevated' when {0} >= 20 then 'moderate' else 'low' end"
_TOTAL = "22e-2 * physical_risk_component + 25e-2 * orbital_risk_component + 18e-2 * approach_risk_component + 17e-2 * sentry_risk_component + 13e-2 * uncertainty_risk_component + 5e-2 * data_quality_component"
SCORE_SQL = f"""{GOLD_SQL}, parts as (select *, {components_sql()} from gold),
risk as (select *, {b(_TOTAL)} as risk_score, round(100 * {b(_TOTAL)}, 6) as risk_score_0_100 from parts),
scores as (select *, {BAND_SQL.format('risk_score_0_100')} as risk_category, case when physical_risk_component = top then 'physical' when orbital_risk_component = top then 'orbital'
 when approach_risk_component = top then 'approach' when sentry_risk_component = top then 'sentry' when uncertainty_risk_component = top then 'uncertainty' else 'data_quality' end as dominant_driver
 from (select *, greatest(physical_risk_component, orbital_risk_component, approach_risk_component, sentry_risk_component, uncertainty_risk_component, data_quality_component) as top from risk) t)"""
