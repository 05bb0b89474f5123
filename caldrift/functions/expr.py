"""Column helpers. Times are microseconds since 1970 (BIGINT), so grid and window arithmetic is exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
MINUTE = 60_000_000


def micros(name: str) -> Column:
    """Microseconds of a timestamp column with or without zone; the latter is read as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def utc_now() -> Column:
    """The instant at which the query began, in microseconds, whatever the session's zone."""
    return F.unix_micros(F.current_timestamp())


def moment(us: Column | str) -> Column:
    """Timestamp without zone of microseconds."""
    c = F.col(us) if isinstance(us, str) else us
    return F.timestamp_add("MICROSECOND", c, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def flag(c: Column) -> Column:
    """1 or 0; 0 for null."""
    return F.when(c, 1).otherwise(0)


def quality_direction(name: Column) -> Column:
    """Whether smaller or larger values of a property are better; "infidelity" is met before "fidelity"."""
    n = F.lower(F.trim(name))
    return (
        F.when(n.contains("error") | n.contains("infidelity"), "lower_is_better")
        .when(n.isin("t1", "t2") | n.contains("fidelity"), "higher_is_better")
    )


def edge_id(a: Column, b: Column, mode: str = "undirected") -> Column:
    if mode not in ("undirected", "directed"):
        raise ValueError(f"unknown edge mode {mode!r}")
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b)) if mode == "undirected" else F.concat_ws("-", a, b)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Non-negative seconds; null where either is unknown (``greatest`` alone would skip the null)."""
    gap = (later - earlier) / F.lit(1e6)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "yes"), ("false", "0", "no")


def operational_value(text: Column) -> tuple[Column, Column]:
    """(value, error) of an operational state reported as a text: one of the texts above; anything else, "1.0" too, is an error."""
    t = F.lower(F.trim(text))
    value = F.when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False)
    return value, value.isNull()


def lenient_bool(text: Column) -> Column:
    """The same texts, and otherwise whether the text is non-empty."""
    value, _ = operational_value(text)
    return F.when(text.isNotNull(), F.coalesce(value, F.length(text) > 0))


NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def variant_kind(v: Column) -> Column:
    """The schema of a variant as a text, VOID for a JSON null; null for no variant."""
    return F.schema_of_variant(v)


def variant_operational(v: Column) -> Column:
    """The operational state in a variant: a boolean, the numbers 0 and 1, or a text for one; null for anything else."""
    kind = variant_kind(v)
    number = F.try_variant_get(v, "$", "double")
    of_number = F.when(number == 1, True).when(number == 0, False)
    of_text = operational_value(F.try_variant_get(v, "$", "string"))[0]
    # a flag or number whose text is one of those for a state has that state too, so the kind is only looked at for other texts
    return F.coalesce(of_text, F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.rlike(NUMBERS), of_number))


def variant_truth(v: Column) -> Column:
    """Leniently: texts for true and false, otherwise whether the value is neither empty nor zero; null for a JSON null."""
    kind = variant_kind(v)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.rlike(NUMBERS), F.try_variant_get(v, "$", "double") != 0)
        .when(kind == "STRING", lenient_bool(F.try_variant_get(v, "$", "string")))
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), kind != "OBJECT<>")
    )


def operational_from_name(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.isin("online", "active", "available", "running"), True).when(n.isin("offline", "paused", "maintenance", "unavailable"), False)


def parse_timestamp(text: Column) -> Column:
    """Microseconds of an ISO-8601 text (naive ones are UTC); null for anything else, shorter forms included."""
    full = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & text.contains(":"), text).otherwise(F.concat(F.trim(text), F.when(text.contains(":"), "Z").otherwise("T00:00:00Z")))
    return F.when(full, F.unix_micros(zoned.try_cast("timestamp")))
