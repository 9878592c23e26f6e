"""Scalar expressions with one meaning on all engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounded half towards plus infinity, as a whole number."""
    return F.floor(x + F.lit(0.5)).cast("long")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def size_scale(n: Column, start: float, slope: float, floor: float) -> Column:
    """How much a deduction weighs in a project of ``n`` parts: 1 up to ``start``, then less by decades."""
    return F.when(n <= start, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), 1.0 - slope * F.log10(n / F.lit(float(start)))))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def completeness_multiplier(s: Column) -> Column:
    """Piecewise linear: 1 at 100, 0.85 at 75, 0.65 at 50, 0.45 at 25, 0.20 at 0."""
    return (
        F.when(s >= 75, 0.85 + 0.15 * (s - 75) / 25)
        .when(s >= 50, 0.65 + 0.20 * (s - 50) / 25)
        .when(s >= 25, 0.45 + 0.20 * (s - 25) / 25)
        .otherwise(0.20 + 0.01 * s)
    )


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a text's characters; null for null or empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, total)


def extension(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(F.instr(base, ".") > 1, F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` resolved."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All proper ancestor directories of a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def badge_url(label: Column, score: Column) -> Column:
    """A badge address with encoded label and a colour by score."""
    colour = F.when(score >= 90, "brightgreen").when(score >= 75, "green").when(score >= 60, "yellow").when(score >= 40, "orange").otherwise("red")
    safe = F.replace(F.url_encode(label), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://img.shields.io/badge/"), safe, F.lit("-"), half_up(score).cast("string"), F.lit("%2F100-"), colour)
