"""Scalar rules as column expressions (F4-F18): name tokens, clamps, grades,
health, bands, request flags and display rounding.  All are built-in
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# ---------------------------------------------------------------------------
# F4-F6 name rules on string columns (the driver-side twins live in encode)
# ---------------------------------------------------------------------------
def suffix_token(name) -> Column:
    """text after the last '_' (null when there is none)."""
    n = _c(name)
    return F.when(n.contains("_"), F.regexp_extract(n, r"(?s).*_(.*)$", 1))


def base_name(name, suffix: str) -> Column:
    """strip a final ``_<digits>_<suffix>``; unchanged without a match."""
    return F.regexp_replace(_c(name), r"_\d+_" + _java_quote(suffix) + "$", "")


def contains_token(name, suffix: str) -> Column:
    """``_suffix`` occurs anywhere in the name."""
    return _c(name).contains(f"_{suffix}")


# ---------------------------------------------------------------------------
# F7-F9 score bounds and grades
# ---------------------------------------------------------------------------
def clamp(x, lo: float = 0.0, hi: float = 5.0) -> Column:
    """bound to [lo, hi]; null stays null."""
    v = _c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def floor_zero(x) -> Column:
    """F7 (lower bound only), as in the degradation curve."""
    v = _c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), v))


def grade_threshold(x) -> Column:
    """F8: >=4.5 Excellent, >=3.5 Very Good, >=2.5 Average,
    >=1.5 Below Average, else Poor."""
    v = _c(x)
    expr = None
    for bound, text in S.GRADE_THRESHOLDS:
        expr = F.when(v >= bound, text) if expr is None else expr.when(v >= bound, text)
    return F.when(v.isNotNull(), expr.otherwise(S.GRADE_FLOOR_TEXT))


def rounded_grade_value(x) -> Column:
    """Half-even rounded score clamped to 0..5, as an int."""
    r = F.bround(_c(x), 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(5), r))


def grade_rounded(x) -> Column:
    """half-even rounding (4.5 -> 4), clamp 0-5, 5..0 -> Excellent..Critical."""
    v = _c(x)
    r = rounded_grade_value(v)
    expr = None
    for k in sorted(S.GRADE_ROUNDED, reverse=True):
        expr = F.when(r == k, S.GRADE_ROUNDED[k]) if expr is None else expr.when(r == k, S.GRADE_ROUNDED[k])
    return F.when(v.isNotNull(), expr)


# ---------------------------------------------------------------------------
# F10-F12 health of the six diagnostic checks
# ---------------------------------------------------------------------------
def diagnostic_flag(diagnostics, key: str) -> Column:
    """F17 for one key: the map value, an absent key is false."""
    return F.coalesce(F.try_element_at(_c(diagnostics), F.lit(key)), F.lit(False))


def failed_checks(diagnostics) -> Column:
    parts = [diagnostic_flag(diagnostics, k).cast("int") for k in S.DIAGNOSTIC_FLAGS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def health_columns(diagnostics) -> list[Column]:
    """failed count, health %, healthy/issue counts and the labels."""
    failed = failed_checks(diagnostics)
    pct = (F.lit(S.TOTAL_CHECKS) - failed) / F.lit(float(S.TOTAL_CHECKS)) * 100
    return [
        failed.alias("failed_checks"),
        (F.lit(S.TOTAL_CHECKS) - failed).alias("healthy_checks"),
        pct.alias("health_pct"),
        F.concat(F.bround(pct, 0).cast("int").cast("string"), F.lit("%")).alias("health_text"),
        F.when(failed > 0, F.concat(F.lit("-"), failed.cast("string"), F.lit(" Flags")))
         .otherwise(F.lit("Optimal")).alias("health_delta"),
    ]


def usage_band(odometer) -> Column:
    """above 100000 km is High, else Normal."""
    v = _c(odometer)
    return F.when(v.isNotNull(), F.when(v > S.HIGH_USAGE_KM, "High").otherwise("Normal"))


def component_scores(df: DataFrame, diagnostics: str = "diagnostics", keep=(S.KEY,)) -> DataFrame:
    """one row per (record, component): 100 when clear, else the
    component's flagged score."""
    keep = [c for c in keep if c in df.columns]
    wide = df.select(*keep, *[
        F.when(diagnostic_flag(diagnostics, key), F.lit(score)).otherwise(F.lit(100)).alias(label)
        for label, key, score in S.COMPONENT_SCORES])
    labels = [label for label, _, _ in S.COMPONENT_SCORES]
    return wide.unpivot(keep, [F.col(f"`{lb}`").alias(lb) for lb in labels], "component", "score")


# ---------------------------------------------------------------------------
# F13-F15 result-card bands
# ---------------------------------------------------------------------------
def _band(x, bounds, otherwise: str, strict: bool) -> Column:
    v = _c(x)
    expr = None
    for bound, text in bounds:
        cond = (v > bound) if strict else (v >= bound)
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return F.when(v.isNotNull(), expr.otherwise(otherwise))


def rating_color(x) -> Column:
    """>=4 green, >=3 yellow, else red."""
    return _band(x, S.RATING_COLORS, "red", strict=False)


def condition_text(x) -> Column:
    """>4 optimal, >2.5 acceptable, else critical."""
    return _band(x, S.CONDITION_TEXT, "critical", strict=True)


def market_value_band(x) -> Column:
    """>4 High, >2 Medium, else Low."""
    return _band(x, S.MARKET_VALUE, "Low", strict=True)


# ---------------------------------------------------------------------------
# F16-F17 request flags
# ---------------------------------------------------------------------------
def fuel_flags(fuel) -> list[Column]:
    """F16: one 0/1 flag per known fuel choice; Diesel/unknown/null = all 0."""
    f = _c(fuel)
    return [F.coalesce((f == F.lit(choice)).cast("int"), F.lit(0)).alias(name)
            for choice, name in S.FUEL_FLAGS.items()]


def diagnostic_flags(diagnostics) -> list[Column]:
    """the six map keys as the six trained feature flags (0/1)."""
    return [diagnostic_flag(diagnostics, key).cast("int").alias(name) for key, name in S.DIAGNOSTIC_FLAGS.items()]


# ---------------------------------------------------------------------------
# F18 display rounding
# ---------------------------------------------------------------------------
def round_display(x, digits: int) -> Column:
    """numeric rounding for display (half-even, like Python's format)."""
    return F.bround(_c(x), digits)


def format_display(x, digits: int) -> Column:
    """F18 as text with a fixed number of decimals; null stays null."""
    return F.when(_c(x).isNotNull(), F.format_string(f"%.{digits}f", F.bround(_c(x), digits)))
