"""Silver rows from bronze captures: one projection for each declared table, over whatever the captures' schema has."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.columns import flag
from skyledger.sources.bronze import as_json, at, field_type, header_rows, named_value


def _both(name: str, stored: str | None = None) -> list[str]:
    """An orbit's field in either of its places."""
    return [f"data.orbit.{stored or name}", f"data.orbit_defs.{stored or name}"]


def _element(name: str) -> list[str]:
    return [f"data.orbit.elements[{name}]", f"data.orbit_defs.{name}"]


# Columns of each table, their types, and where a value is found, in this order; list[name] is the value of
# a named item, flag and json are read from the one path given. LUNAR is the number of lunar distances in an AU.
LUNAR = 389.174
OBJECTS: list[tuple[str, str, list[str]]] = [
    ("object_id", "string", ["metadata.object_id", "data.object.des", "data.object.spkid"]), ("source", "source", ["metadata.source"]), ("ingested_at_utc", "string", ["metadata.ingested_at_utc"]),
    ("spkid", "string", ["data.object.spkid"]), ("full_name", "string", ["data.object.fullname"]), ("pdes", "string", ["data.object.des"]), ("name", "string", ["data.object.name", "data.object.shortname"]),
    ("prefix", "string", ["data.object.prefix"]), ("orbit_id", "string", ["data.object.orbit_id", "data.orbit.orbit_id"]), ("neo", "flag", ["data.object.neo"]), ("pha", "flag", ["data.object.pha"]),
    ("kind", "string", ["data.object.kind"]), ("orbit_class_code", "string", ["data.object.orbit_class.code"]),
    ("orbit_class_name", "string", ["data.object.orbit_class.name", "data.object.orbit_class.description"]), ("condition_code", "string", _both("condition_code")),
    ("orbit_solution_date", "string", _both("soln_date")), ("first_obs", "string", _both("first_obs")), ("last_obs", "string", _both("last_obs")), ("arc_length", "double", _both("data_arc")),
    ("n_obs_used", "int", _both("n_obs_used")), ("rms", "double", _both("rms")), ("h", "double", ["data.phys_par[h]", "data.object.h"]), ("diameter", "double", ["data.phys_par[diameter]"]),
    ("albedo", "double", ["data.phys_par[albedo]"]), ("moid", "double", _both("moid")), ("moid_ld", "double", _both("moid_ld")),
    *[(c, "double", _element(c)) for c in ("e", "a", "q", "i", "om", "w", "ma", "n", "tp", "per", "ad")], ("raw_json", "json", ["data"]),
]
_ITEM = [("source", "source", ["metadata.source"]), ("ingested_at_utc", "string", ["metadata.ingested_at_utc"]), ("des", "string", ["_item.des"]), ("fullname", "string", ["_item.fullname"]), ("spk", "string", ["_item.spk", "_item.spkid"])]
SUMMARIES = [*_ITEM, *[(c, t, [f"_item.{c}"]) for c, t in (("h", "double"), ("diameter", "double"), ("ip", "double"), ("ps_cum", "double"), ("ps_max", "double"), ("ts_max", "double"), ("last_obs", "string"), ("n_imp", "int"), ("last_obs_jd", "double"))], ("raw_json", "json", ["_item"])]
IMPACTORS = [*_ITEM, *[(c, t, p) for c, t, p in (("ip", "double", ["_item.ip"]), ("date", "string", ["_item.date"]), ("dist", "double", ["_item.dist"]), ("width", "double", ["_item.width"]),
             ("sigma_imp", "double", ["_item.sigma_imp", "_item.sigma_vi"]), ("ps", "double", ["_item.ps"]), ("ts", "double", ["_item.ts"]), ("energy", "double", ["_item.energy"]), ("vinf", "double", ["_item.vinf", "_item.v_inf"]))], ("raw_json", "json", ["_item"])]
MARKERS = {"summaries": ["ps_cum", "n_imp", "last_obs"], "impactors": ["date", "ps", "sigma_vi", "energy"]}
APPROACHES = {"des": "string", "orbit_id": "string", "jd": "double", "cd": "string", "dist": "double", "dist_min": "double", "dist_max": "double", "v_rel": "double", "v_inf": "double", "t_sigma_f": "string",
              "body": "string", "h": "double", "diameter": "double", "diameter_sigma": "double", "fullname": "string"}
_TYPES = {"source": "string", "flag": "boolean", "json": "string"}


def _value(df: DataFrame, path: str, kind: str) -> Column:
    listed = re.fullmatch(r"(.+)\[(\w+)\]", path)
    if listed:
        there = isinstance(field_type(df, listed[1]), T.ArrayType) and field_type(df, f"{listed[1]}.name") is not None
        return named_value(F.col(listed[1]), listed[2], kind) if there else F.lit(None).cast(kind)
    return at(df, path, kind)


def projected(df: DataFrame, table: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Exactly the columns of ``table``: the first place that the schema has and that holds a value; typed nulls else."""
    columns = []
    for name, kind, paths in table:
        if kind == "json":
            value = as_json(df, paths[0])
        elif kind == "flag":
            value = flag(at(df, paths[0], "string"))
        else:
            value = F.coalesce(*[_value(df, p, _TYPES.get(kind, kind)) for p in paths], *([F.lit("unknown")] if kind == "source" else []))
        columns.append(value.alias(name))
    return df.select(*columns)


def objects(captures: DataFrame) -> DataFrame:
    """A row for each captured object; the distance in lunar distances follows from that in AU where it isn't stored."""
    derived = F.coalesce("moid_ld", F.when(F.col("moid") > 0, F.col("moid") * LUNAR))
    return projected(captures, OBJECTS).withColumn("moid_ld", derived)


def records(captures: DataFrame, table: list[tuple[str, str, list[str]]], markers: list[str], listed: str = "data.data") -> DataFrame:
    """A row for each listed record that carries any of the markers; none if the captures' schema has none of them."""
    own = [m for m in markers if field_type(captures, f"{listed}.{m}") is not None]
    if not own or not isinstance(field_type(captures, listed), T.ArrayType):
        return projected(captures.withColumn("_item", F.lit(None).cast("struct<des:string>")), table).where("false")
    items = captures.withColumn("_item", F.explode(listed))
    return projected(items.where(reduce(or_, [F.col(f"_item.{m}").isNotNull() for m in own])), table)


def summaries(captures: DataFrame) -> DataFrame:
    return records(captures, SUMMARIES, MARKERS["summaries"])


def impactors(captures: DataFrame) -> DataFrame:
    return records(captures, IMPACTORS, MARKERS["impactors"])


def approaches(captures: DataFrame) -> DataFrame:
    """A row for each row of header-and-rows captures; the body comes from the request where a row has none."""
    if field_type(captures, "data.fields") is None or field_type(captures, "data.data") is None:
        captures = captures.withColumn("data", F.lit(None).cast("struct<fields:array<string>,data:array<array<string>>>"))
    rows = header_rows(captures, names=list(APPROACHES))
    of = lambda c, t: F.get("_r", F.col(f"_at_{c}")).try_cast(t).alias(c)
    params = field_type(rows, "metadata.query_params")
    asked = F.try_element_at("metadata.query_params", F.lit("body")) if isinstance(params, T.MapType) else at(rows, "metadata.query_params.body", "string")
    columns = [F.coalesce(of(c, t), asked).alias(c) if c == "body" else of(c, t) for c, t in APPROACHES.items()]
    head = [F.coalesce(at(rows, "metadata.source", "string"), F.lit("unknown")).alias("source"), at(rows, "metadata.ingested_at_utc", "string").alias("ingested_at_utc")]
    return rows.select(*head, *columns, of("cd", "string").alias("close_approach_datetime"), F.to_json(F.map_from_arrays("_f", "_r")).alias("raw_json"))


def events(captures: DataFrame) -> DataFrame:
    """A row for each capture: where it came from, when, and for what."""
    return captures.select(
        F.coalesce(at(captures, "metadata.source", "string"), F.lit("unknown")).alias("source"), at(captures, "metadata.ingested_at_utc", "string").alias("ingested_at_utc"),
        at(captures, "ingest_date", "string").alias("ingest_date"), at(captures, "metadata.object_id", "string").alias("object_id"), F.coalesce(as_json(captures, "metadata.query_params"), F.lit("{}")).alias("query_params_json"),
        at(captures, "metadata.api_signature.version", "string").alias("api_signature_version"), at(captures, "bronze_file_path", "string").alias("bronze_file_path"),
    )
