"""Column builders: lenient values, bounded signals, weighted means, bands and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the bands of twenty points.
BANDS = ["low", "moderate", "elevated", "high", "critical"]
MISSING_WORDS = ["", "nan", "none", "null"]
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A finite double, or null for blanks, text, NaN and infinities."""
    x = col(c).try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN compares as greater


def flag(c: Column | str) -> Column:
    """Tri-state boolean of Y/N, 1/0, true/false and the like."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def text(c: Column | str) -> Column:
    """Trimmed text, null where it is blank or a word for missing."""
    value = F.trim(col(c).cast("string"))
    return F.when(~F.lower(value).isin(MISSING_WORDS), value)


def designation(c: Column | str) -> Column:
    """Text with single spaces."""
    return text(F.regexp_replace(col(c).cast("string"), r"\s+", " "))


def slug(c: Column | str) -> Column:
    """Lower case, other characters than letters, digits, point, hyphen and underscore as one underscore."""
    value = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), r"[^a-z0-9_.\-]+", "_")
    value = F.regexp_replace(F.regexp_replace(value, "_+", "_"), r"^[._\-]+|[._\-]+$", "")
    return F.when(F.coalesce(value, F.lit("")) == "", "sample").otherwise(value)


def bounded(c: Column) -> Column:
    """Clipped to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)))


def in_unit(x: str) -> str:
    """SQL text of x clipped to [0, 1]; null stays null."""
    return f"if(({x}) is null, null, least(greatest({x}, 0D), 1D))"


def at_least(c: Column, low: float = 0.0) -> Column:
    return F.when(c < low, low).otherwise(c.cast("double"))


def staged(df: DataFrame, columns: dict, make) -> DataFrame:
    """``df`` with ``make(parts)`` for each of ``columns``, its parts being columns of a stage of their own.

    A part stands several times in what is made of it; as a column it is computed once, and the generated code stays small.
    """
    named = {f"_{name}_{k}": part for name, parts in columns.items() for k, part in enumerate(parts)}
    out = df.withColumns(named)
    made = {name: make(name, [F.col(f"_{name}_{k}") for k in range(len(parts))]) for name, parts in columns.items()}
    return out.withColumns(made).drop(*named)


def mean_of(parts: list[Column]) -> Column:
    """Plain mean of the parts that are not null; null if there is none."""
    total = reduce(lambda a, b: a + b, [v.isNotNull().cast("double") for v in parts])
    return bounded(F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in parts]), total))


def probability_signal(p: Column) -> Column:
    return F.when(p <= 1e-10, 0.0).when(p >= 1, 1.0).otherwise((F.log10(p) + 10.0) / 10.0)


def palermo_signal(p: Column) -> Column:
    return bounded((p + 8.0) / 10.0)


def log_share(c: Column, top: float) -> Column:
    """log1p of a non-negative value against that of ``top``."""
    return bounded(F.log1p(at_least(c)) / F.log1p(F.lit(top)))


def band(score: Column) -> Column:
    """Name of the score's band of twenty points; null and NaN count as 0."""
    step = F.least(F.floor(F.greatest(F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) / 20.0), F.lit(len(BANDS) - 1))
    return F.element_at(F.array(*[F.lit(name) for name in BANDS]), step.cast("int") + 1)


def uniform(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) for a row, whatever its partition: 52 bits of md5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(16**13)


def normal(*parts: Column) -> Column:
    """A reproducible standard normal number (Box-Muller)."""
    u = F.greatest(uniform(*parts, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * uniform(*parts, F.lit("v")))


# Thresholds of the rule.
RULE_MOID, RULE_H = 0.05, 22.0


def rule_label(moid: Column | str = "moid", h: Column | str = "h") -> Column:
    """1 for objects that are near and large by the rule, else 0; 0 too where either is unknown."""
    return F.coalesce((col(moid) <= RULE_MOID) & (col(h) <= RULE_H), F.lit(False)).cast("int")
