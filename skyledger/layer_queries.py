"""Registered queries of silver tables and composed runs over landed captures, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import reports
from skyledger.plans import runs
from skyledger.plans.binding import table
from skyledger.plans.shared import shared_folder
from skyledger.queries import query
from skyledger.sources import bronze, silver, sinks

_DAY = "timestamp '2026-05-28 00:00:00'"


def _object_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested documents: even ones keep orbits in one place, odd ones in the other, and fields are missing here and there."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as id", f"""named_struct(
 'object', named_struct('spkid', concat('2', lpad(cast(p_partkey as string), 7, '0')), 'fullname', p_name, 'des', if(p_partkey % 5 <> 0, cast(p_partkey as string), null), 'name', if(p_partkey % 2 = 0, upper(p_name), null), 'shortname', p_brand,
  'orbit_id', if(p_partkey % 3 = 0, concat('o', p_partkey), null), 'neo', if(p_partkey % 2 = 0, 'Y', 'n'), 'pha', case when p_partkey % 7 = 0 then 'maybe' when p_size <= 15 then 'true' else '0' end, 'kind', 'an',
  'orbit_class', named_struct('code', p_type, 'name', if(p_partkey % 4 = 0, p_brand, null), 'description', p_type)),
 'orbit', named_struct('orbit_id', concat('x', p_partkey), 'moid', if(p_partkey % 2 = 0, (p_partkey % 101) / 500D, null), 'condition_code', if(p_partkey % 3 <> 0, cast(p_partkey % 10 as string), null), 'data_arc', if(p_partkey % 2 = 0, cast(p_partkey * 7 % 4000 as string), null),
  'n_obs_used', if(p_partkey % 4 <> 0, p_partkey * 11 % 900, null), 'rms', (p_partkey % 40) / 20D, 'first_obs', '1990', 'soln_date', if(p_partkey % 3 = 0, '2020', null),
  'elements', if(p_partkey % 2 = 0, array(named_struct('name', 'e', 'value', cast((p_partkey % 97) / 100D as string)), named_struct('name', 'A', 'value', cast(0.8D + (p_partkey % 53) / 50D as string)), named_struct('name', 'om', 'value', 'none')), null)),
 'orbit_defs', named_struct('moid', if(p_partkey % 2 = 1, (p_partkey % 77) / 400D, null), 'moid_ld', if(p_partkey % 4 = 1, p_partkey / 8D, null), 'condition_code', '9', 'data_arc', '12.5', 'n_obs_used', 3, 'e', 0.5D, 'i', (p_partkey % 61) / 2D, 'soln_date', '2001', 'last_obs', '2022'),
 'phys_par', array(named_struct('name', 'H', 'value', cast(14 + p_size % 17 as string)), named_struct('name', 'diameter', 'value', if(p_partkey % 3 <> 0, cast(p_retailprice / 1000D as string), null)))) as data""")  # fmt: skip


_OBJECTS_SQL = """select cast(p_partkey as varchar) as object_id, 'objects' as source, '2026-05-28T00:00:00' as ingested_at_utc, '2' || lpad(cast(p_partkey as varchar), 7, '0') as spkid, p_name as full_name, case when p_partkey % 5 <> 0 then cast(p_partkey as varchar) end as pdes,
 case when p_partkey % 2 = 0 then upper(p_name) else p_brand end as name, null::varchar as prefix, case when p_partkey % 3 = 0 then 'o' else 'x' end || p_partkey as orbit_id, p_partkey % 2 = 0 as neo, case when p_partkey % 7 = 0 then null else p_size <= 15 end as pha, 'an' as kind, p_type as orbit_class_code,
 case when p_partkey % 4 = 0 then p_brand else p_type end as orbit_class_name, case when p_partkey % 3 <> 0 then cast(p_partkey % 10 as varchar) else '9' end as condition_code, case when p_partkey % 3 = 0 then '2020' else '2001' end as orbit_solution_date, '1990' as first_obs, '2022' as last_obs,
 case when p_partkey % 2 = 0 then cast(p_partkey * 7 % 4000 as double) else 12.5e0 end as arc_length, cast(case when p_partkey % 4 <> 0 then p_partkey * 11 % 900 else 3 end as int) as n_obs_used, (p_partkey % 40) / 20e0 as rms, cast(14 + p_size % 17 as double) as h,
 case when p_partkey % 3 <> 0 then round(p_retailprice / 1000e0, 6) end as diameter, null::double as albedo, moid, round(case when p_partkey % 4 = 1 then p_partkey / 8e0 when moid > 0 then moid * 389.174e0 end, 6) as moid_ld,
 case when p_partkey % 2 = 0 then (p_partkey % 97) / 100e0 else 5e-1 end as e, round(case when p_partkey % 2 = 0 then 8e-1 + (p_partkey % 53) / 50e0 end, 6) as a, null::double as q, (p_partkey % 61) / 2e0 as i, null::double as om, null::double as w, null::double as ma, null::double as n, null::double as tp, null::double as per, null::double as ad, true as has_json
 from (select *, case when p_partkey % 2 = 0 then (p_partkey % 101) / 500e0 else (p_partkey % 77) / 400e0 end as moid from part) p"""


def _sentry_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed records, a hundred to a capture: even ones summaries, odd ones impactors."""
    item = """named_struct('des', cast(s_suppkey as string), 'fullname', s_name, 'spk', if(s_suppkey % 3 = 0, concat('2', lpad(cast(s_suppkey as string), 7, '0')), null), 'spkid', concat('3', s_suppkey), 'ip', power(10D, -(1 + s_suppkey % 9)),
 'ps_cum', if(s_suppkey % 2 = 0, -(s_suppkey % 70) / 10D, null), 'n_imp', if(s_suppkey % 2 = 0, s_suppkey % 50, null), 'date', if(s_suppkey % 2 = 1, '2090-01-02', null), 'sigma_imp', if(s_suppkey % 5 = 0, 1.5D, null), 'sigma_vi', if(s_suppkey % 2 = 1, 0.25D, null), 'v_inf', if(s_suppkey % 2 = 1, s_suppkey / 4D, null))"""
    rows = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey div 100 as string) as id", f"{item} as item")
    return rows.groupBy("id").agg(F.struct(F.collect_list("item").alias("data")).alias("data"))


def _approach_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each part as headers and rows. Lines are dealt out by part first: hardly any two of a part meet in a task before."""
    row = F.array(F.col("l_partkey").cast("string"), F.col("l_discount").cast("string"), (F.col("l_discount") / 2).cast("string"), F.col("l_quantity").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_quantity", "l_shipdate").repartition("l_partkey")
    rows = lines.groupBy("l_partkey").agg(F.collect_list(row).alias("rows"))
    return rows.select(F.col("l_partkey").cast("string").alias("id"), F.struct(F.array(*[F.lit(c) for c in ("des", "dist", "dist_min", "v_rel", "cd")]).alias("fields"), F.col("rows").alias("data")).alias("data"))


def _landed(spark: SparkSession, sf_dir: str, *sources: str) -> str:
    root = shared_folder(spark, "captures")
    for name in sources:
        rows = {"objects": _object_captures, "sentry": _sentry_captures, "approaches": _approach_captures}[name](spark, sf_dir)
        bronze.land(bronze.landed(rows, name, "id", F.expr(_DAY), F.col("data"), F.create_map(F.lit("body"), F.lit("Earth"))), root)
    return root


@query(_OBJECTS_SQL)
def silver_objects(spark, d):
    """All 38 columns of the flattened objects; of the document itself, whether it is there."""
    found = silver.objects(bronze.read(spark, _landed(spark, d, "objects"), source="objects"))
    return found.withColumns({c: F.round(c, 6) for c in ("diameter", "moid_ld", "a")}).withColumn("has_json", F.col("raw_json").contains("orbit_defs")).drop("raw_json")


_SPK = "case when s_suppkey % 3 = 0 then '2' || lpad(cast(s_suppkey as varchar), 7, '0') else '3' || s_suppkey end"


@query(f"select 'sentry' as source, cast(s_suppkey as varchar) as des, s_name as fullname, {_SPK} as spk, round(power(10e0, -(1 + s_suppkey % 9)), 12) as ip, '2090-01-02' as date, null::double as dist, case when s_suppkey % 5 = 0 then 1.5e0 else 25e-2 end as sigma_imp, s_suppkey / 4e0 as vinf from supplier where s_suppkey % 2 = 1")
def silver_impactors(spark, d):
    found = silver.impactors(bronze.read(spark, _landed(spark, d, "sentry"), source="sentry"))
    return found.select("source", "des", "fullname", "spk", F.round("ip", 12).alias("ip"), "date", "dist", "sigma_imp", "vinf")


@query(f"select cast(s_suppkey as varchar) as des, {_SPK} as spk, round(-(s_suppkey % 70) / 10e0, 6) as ps_cum, null::double as ts_max, cast(s_suppkey % 50 as int) as n_imp from supplier where s_suppkey % 2 = 0")
def silver_summaries(spark, d):
    found = silver.summaries(bronze.read(spark, _landed(spark, d, "sentry"), source="sentry"))
    return found.select("des", "spk", F.round("ps_cum", 6).alias("ps_cum"), "ts_max", "n_imp")


@query("select cast(l_partkey as varchar) as des, 'Earth' as body, round(l_discount, 6) as dist, round(l_quantity, 6) as v_rel, strftime(l_shipdate, '%Y-%m-%d %H:%M') as close_approach_datetime, null::double as jd from lineitem")
def silver_approaches(spark, d):
    found = silver.approaches(bronze.read(spark, _landed(spark, d, "approaches"), source="approaches"))
    return found.select("des", "body", F.round("dist", 6).alias("dist"), F.round("v_rel", 6).alias("v_rel"), "close_approach_datetime", "jd")


@query("""with n as (select (select count(*) from part) as parts, (select count(*) from lineitem) as lines, (select count(distinct l_partkey) from lineitem) as captured, (select count(*) from supplier where s_suppkey % 2 = 0) as summaries, (select count(*) from supplier where s_suppkey % 2 = 1) as impactors, (select count(distinct s_suppkey // 100) from supplier) as lists),
t as (select 'silver' as layer, 'objects' as name, parts as row_count from n union all select 'silver', 'approaches', lines from n union all select 'silver', 'sentry', summaries from n union all select 'silver', 'impactors', impactors from n union all select 'silver', 'events', parts + captured + lists from n union all select 'gold', 'features', parts from n union all select 'gold', 'scores', parts from n)
select 'etl' as run_type, 'success' as status, layer, name, 'written' as table_status, row_count, 2 as n_runs from t""")
def run_manifest(spark, d):
    """Two runs over all captures; the tables of the later one, from the run log (but for its quality report)."""
    root, out = _landed(spark, d, "objects", "approaches", "sentry"), shared_folder(spark, "run")
    for _ in range(2):
        runs.run_all(spark, root, out)
    log = sinks.runs(spark, f"{out}/runs")
    last = reports.latest_runs(log, started="ended_at").join(F.broadcast(log.agg(F.count(F.lit(1)).cast("int").alias("n_runs"))))
    rows = last.select("run_type", "status", "n_runs", F.explode("tables").alias("t")).where("t.name <> 'quality'")
    return rows.select("run_type", "status", "t.layer", "t.name", F.col("t.status").alias("table_status"), "t.row_count", "n_runs")


@query("""with n as (select (select count(*) from part) as parts, (select count(*) from supplier where s_suppkey % 2 = 0) as summaries, (select count(*) from supplier where s_suppkey % 2 = 1) as impactors, (select count(distinct s_suppkey // 100) from supplier) as lists)
select 'partial_success' as status, 'silver' as layer, 4 as n_tables, 4 as n_written, parts + summaries + impactors + parts + lists as row_count from n union all select 'partial_success', 'gold', 3, 3, 2 * parts + 15 from n""")
def layer_rollup(spark, d):
    """A run without one of its sources: rows and tables of each layer."""
    out = shared_folder(spark, "run")
    runs.run_all(spark, _landed(spark, d, "objects", "sentry"), out)
    return runs.rollup(sinks.runs(spark, f"{out}/runs")).select("status", "layer", "n_tables", "n_written", "row_count")
