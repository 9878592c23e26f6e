"""The score of every check, as an expression over its counts.

All scores are clamped to 0 to 100; the floor of 25 is applied where categories are formed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import clamp, half_up, size_scale


def _cut(points: Column, n: Column, start: float, slope: float, floor: float) -> Column:
    return clamp(100.0 - size_scale(n, start, slope, floor) * points)


def most(limit: float, points: Column) -> Column:
    return F.least(F.lit(float(limit)), points.cast("double"))


def scan(critical: Column, high: Column) -> Column:
    return clamp(100.0 - 40 * critical - 15 * high)


def config(exists: Column, complete: Column, consistent: Column, specific: Column, no_ignore: Column) -> Column:
    """Sub-scores from 0 to 10."""
    return clamp(10 * (0.2 * exists + 0.3 * complete + 0.25 * consistent + 0.25 * specific) - F.when(no_ignore, 10).otherwise(0))


def models(errors: Column, ai_framework: Column) -> Column:
    score = clamp(100.0 - 20 * errors)
    return F.when(ai_framework, F.greatest(F.lit(70.0), score)).otherwise(score)


def owasp(deductions: Column) -> Column:
    return clamp(100.0 - deductions)


def sandbox(points: Column) -> Column:
    return half_up(10 * clamp(10.0 - points, 0, 10)).cast("double")


def integrity(files: Column, unresolved: Column, empty_catch: Column, stubs: Column, awaits: Column) -> Column:
    scale = size_scale(files, 10, 0.4, 0.3)
    return clamp(100.0 - scale * (10 * unresolved + 3 * empty_catch + 5 * stubs) - most(15, scale * 3 * awaits))


def compact(instructions: Column, paths: Column, identifiers: Column) -> Column:
    return clamp(100.0 - 30 * instructions - 15 * paths - 5 * identifiers)


def memory(stale: Column, broken: Column, contradictions: Column, bloat: Column) -> Column:
    return clamp(100.0 - 10 * stale - 15 * broken - 10 * contradictions - 5 * bloat)


def verify(verified: Column, failed: Column) -> Column:
    return F.when(verified + failed == 0, 100.0).otherwise(half_up(100.0 * verified / (verified + failed)).cast("double"))


def tests(files: Column, errors: Column, warnings: Column, infos: Column) -> Column:
    return _cut(8 * errors + 4 * warnings + 2 * infos, files, 5, 0.5, 0.15)


def loop(iterations: Column, cost: Column, files: Column, busy: Column) -> Column:
    """``busy``: iterations with over five changes."""
    return clamp(100.0 - F.when(iterations > 10, 30).otherwise(0) - F.when(cost > 1, 20).otherwise(0) - F.when(files > 20, 10).otherwise(0) - 5 * busy)


def debt(files: Column, duplicates: Column, orphans: Column) -> Column:
    return _cut(most(50, 8 * duplicates) + most(30, 5 * orphans), files, 10, 0.4, 0.3)


def bloat(ratio: Column, grown: Column, large: Column, padded: Column) -> Column:
    by_ratio = F.when(ratio > 20, 40).when(ratio > 10, 30).when(ratio > 5, 20).otherwise(0)
    return clamp(100.0 - by_ratio - most(30, 5 * grown) - most(20, 10 * large) - most(20, 5 * padded))


def clones(rate: Column) -> Column:
    return F.greatest(F.lit(25.0), half_up(100 - 400 * rate).cast("double"))


def split(deductions: Column) -> Column:
    return clamp(100.0 - deductions)


def architecture(modules: Column, cycles: Column, hubs: Column, unstable: Column, violations: Column, q: Column) -> Column:
    scale = size_scale(modules, 5, 0.3, 0.3)
    cut = scale * (most(30, 15 * cycles) + most(20, 10 * hubs) + most(15, 5 * unstable) + most(10, 3 * F.floor(violations / 3)))
    loose = F.when((modules >= 5) & (q < 0.3), most(15, half_up(50 * (0.3 - q)))).otherwise(0.0)
    return F.greatest(F.lit(25.0), 100.0 - cut - loose)


def aiready(context: Column, clarity: Column, types: Column, discover: Column, modify: Column, fit: Column) -> Column:
    return F.greatest(F.lit(25.0), half_up(0.25 * context + 0.20 * clarity + 0.20 * types + 0.15 * discover + 0.10 * modify + 0.10 * fit).cast("double"))


def deep(complexity: Column, nesting: Column, errors: Column, names: Column, maintainability: Column) -> Column:
    return F.greatest(F.lit(25.0), half_up(0.25 * complexity + 0.20 * nesting + 0.20 * errors + 0.10 * names + 0.25 * maintainability).cast("double"))


def semantic(match_rate: Column) -> Column:
    return F.greatest(F.lit(25.0), half_up(100 - 200 * match_rate).cast("double"))


def context(large: Column, stale: Column, tokens: Column) -> Column:
    return clamp(100.0 - 5 * large - most(40, 10 * stale) - F.greatest(F.lit(0.0), most(30, 5 * F.floor((tokens - 8000) / 2000))))


def hotspots(high: Column, sources: Column, couplings: Column) -> Column:
    risk = F.greatest(F.lit(25.0), half_up(100 - 500 * high / F.greatest(sources, F.lit(1))).cast("double"))
    return F.greatest(F.lit(25.0), risk - most(30, 5 * couplings))


def visibility(seen: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(half_up(100.0 * seen / total).cast("double"))


def fleet(silent: Column, conflicts: Column) -> Column:
    return clamp(100.0 - 25 * silent - 15 * conflicts)


def triage(critical: Column, high: Column, medium: Column) -> Column:
    return clamp(100.0 - 25 * critical - 10 * high - 5 * medium)


def too_small(n: Column, least: int, score: Column) -> Column:
    """A project of under ``least`` sources is not judged."""
    return F.when(n < least, 100.0).otherwise(score)
