"""Column expressions that the reference semantics need and Spark doesn't name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes.
_EDGES = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def stripped(text: Column | str) -> Column:
    """text without Unicode white space at its ends; F.trim removes spaces only."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, _EDGES, "")


def is_blank(text: Column | str) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def frame_count(duration: Column, rate: float) -> Column:
    """Frames of a grid: floor(duration * rate), guarded against a representation error below a whole number."""
    return F.floor(duration * F.lit(float(rate)) + F.lit(1e-9)).cast("int")


def nearest_frame(t: Column, rate: float, frames: Column) -> Column:
    """The frame nearest to t, halves to even, clipped to the grid; events outside pile up at its ends."""
    return F.least(F.greatest(F.rint(t * F.lit(float(rate))), F.lit(0.0)), F.greatest(frames - 1, F.lit(0)).cast("double")).cast("int")


def guarded_ratio(delta: Column, full: Column, epsilon: float = 0.0) -> Column:
    """delta / full where full exceeds epsilon, else NaN: an undefined ratio, which is not a missing one."""
    return F.when(full > epsilon, delta / full).otherwise(F.lit(float("nan")))


def nan_to_null(x: Column | str) -> Column:
    """NULL for NaN: aggregates then skip it."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def is_finite(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def all_finite(array: Column | str) -> Column:
    """Whether every element of an array is a finite number; a null array is not."""
    return F.coalesce(F.forall(array, is_finite), F.lit(False))


def rounded(x: Column | str, places: int = 6) -> Column:
    """For published and compared figures; never negative zero."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, places) + F.lit(0.0)


def percent_encoded(text: Column | str) -> Column:
    """A path component: everything but letters, digits and -_.~ encoded."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.url_encode(c)
    for form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # form encoding differs in these
        out = F.replace(out, F.lit(form), F.lit(wanted))
    return out


def path_safe(text: Column | str) -> Column:
    """Whether an id can be a file name as it is."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNotNull() & (c != "") & ~c.isin(".", "..") & ~c.rlike(r"[/\\\x00]")


def first_failure(*checks: tuple[Column, str], ok: str = "ok") -> Column:
    """The code of the first check, in order, whose condition holds."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for condition, code in checks], F.lit(ok))


def severity(status: Column | str) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.when(c == "FAIL", 2).when(c == "WARN", 1).otherwise(0)


def worst(status: Column | str) -> Column:
    """Aggregate: the worst of PASS < WARN < FAIL."""
    return F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.max(severity(status)) + 1)
