"""Small Column helpers shared by the record and analytics operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when there is nothing to divide by."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def percent(num: Column, den: Column, digits: int = 1) -> Column:
    return F.round(safe_ratio(num * 100.0, den), digits)


def one_of(value: Column, domain: list[str], default: str) -> Column:
    """Lower-cased value if it is in the domain, else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(domain), low).otherwise(F.lit(default))


def ordinal(value: Column, domain: list[str]) -> Column:
    """Position of a value in an ordered domain, 1-based; 0 when absent."""
    return F.array_position(F.array(*[F.lit(d) for d in domain]), value).cast("int")


def by_rules(value: Column, rules, default: Column) -> Column:
    """Ordered (words, label) rules: the first with a word contained in the value wins."""
    out = None
    for words, label in rules:
        hit = None
        for w in words:
            hit = value.contains(w) if hit is None else hit | value.contains(w)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(default)


def shortened(text: Column, width: int | None) -> Column:
    """The first ``width`` characters; all of them without a width."""
    return text if width is None else F.substring(text, 1, width)


def require(value: str, domain: list[str], what: str) -> str:
    if value not in domain:
        raise ValueError(f"invalid {what}: {value!r}")
    return value


def positive(n: int, what: str = "limit") -> int:
    if n <= 0:
        raise ValueError(f"{what} must be greater than 0")
    return n
