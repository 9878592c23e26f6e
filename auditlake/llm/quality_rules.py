"""Quality rules as a learned decision list, in DataFrame expressions alone.

Text statistics are native expressions.  For training, each statistic of a bounded sample of
labelled documents is cut at its quantiles, and one aggregation counts good and bad
documents by cell.  On these counts sequential covering grows one rule after another: for either
verdict a conjunction of thresholds that gains most on the documents not yet covered, pruned
against a part that it was not grown on.  The one that is right more often joins the list, with
its verdict, and what it covers is left to it.  The list ends where no rule does better than the
verdict that most of the rest have, which is the last arm.  It is emitted as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick
from .labelled import labelled_sample

#: Characters counted as symbols, and the separators of words.
SYMBOLS = "#*$%&|<>"
_SPACE = "\\u0020\\u0009-\\u000D"

# The statement `transform(array(x), v -> f(v))[0]` binds x once.
_REPEATED = """
transform(array(transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))), h ->
 transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS p)))), s ->
  transform(array(sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h OR get(s, i + 1).h <=> x.h), x -> x.p))), r ->
   aggregate(transform(r, (p, i) -> least(3, coalesce(get(r, i + 1) - p, 3))), 0L, (n, x) -> n + x))[0])[0])[0]
"""


def _count(characters: str) -> Column:
    return (F.length("_text") - F.length(F.translate("_text", characters, ""))).cast("long")


def with_statistics(df: DataFrame) -> DataFrame:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and further counts of ``_text``."""
    df = df.withColumn("_w", F.expr(f"filter(split(coalesce(_text, ''), '[{_SPACE}]+'), x -> x <> '')"))
    df = df.withColumn("_l", F.expr(f"filter(split(coalesce(_text, ''), '\\n'), x -> x rlike '[^{_SPACE}]')"))
    return df.select(
        *[c for c in df.columns if c not in ("_w", "_l")],
        F.size("_w").cast("long").alias("n_words"),
        F.coalesce(F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(_count(SYMBOLS), F.lit(0)).alias("n_symbols"),
        F.size("_l").cast("long").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_w) < 4 THEN 0L ELSE {_REPEATED} END").cast("long").alias("n_repeat_words"),
        F.coalesce(_count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(0)).alias("_n_upper"),
        F.coalesce(_count("0123456789"), F.lit(0)).alias("_n_digits"),
        F.coalesce(_count("!?"), F.lit(0)).alias("_n_calls"),
        F.coalesce(_count(".,;:"), F.lit(0)).alias("_n_stops"),
    )


#: What rules may test, by name: expressions over the statistics.
FEATURES = {
    "words": "cast(n_words AS double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(_n_lines, 1)",
    "dup_line_share": "n_dup_lines / greatest(_n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "_n_upper / greatest(word_chars, 1)",
    "digit_share": "_n_digits / greatest(word_chars, 1)",
    "calls_per_word": "_n_calls / greatest(n_words, 1)",
    "stops_per_word": "_n_stops / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each with its verdict, and the verdict on what no rule covers."""

    rules: tuple[tuple[tuple[Condition, ...], bool], ...] = ()
    rest: bool = True

    def sql(self) -> str:
        arms = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {str(keep).lower()}" for rule, keep in self.rules)
        return f"CASE {arms} ELSE {str(self.rest).lower()} END" if arms else str(self.rest).lower()


def learn_rules(
    cells: list[tuple[tuple[int, ...], int, int, bool]], cuts: dict[str, list[float]], *, most_rules: int = 24, most_conditions: int = 4, least: int = 8
) -> DecisionList:
    """From cells: place between the cuts of each feature, good and bad documents, grown on or not."""
    if not cells:
        return DecisionList()
    place = np.array([c[0] for c in cells])
    counts = np.array([[c[2], c[1]] for c in cells], float).T  # bad, good
    grown = np.array([c[3] for c in cells])
    tests = [
        (Condition(f, above, cut), (place[:, i] > k) == above)
        for i, f in enumerate(FEATURES)
        for k, cut in enumerate(cuts[f])
        for above in (True, False)
    ]
    masks = np.array([hit for _, hit in tests]).reshape(len(tests), len(cells)).astype(np.float32)

    def grow(left: np.ndarray, keep: int) -> list[int]:
        rule: list[int] = []
        at = left & grown
        while len(rule) < most_conditions:
            p, n = counts[keep][at].sum(), counts[1 - keep][at].sum()
            if not p or not n:
                break
            q, m = (masks @ (counts[c] * at).astype(np.float32) for c in (keep, 1 - keep))
            # Information gained by the documents that the verdict is right for (FOIL).
            gain = np.where(q >= least, q * (np.log2((q + 1) / (q + m + 2)) - np.log2((p + 1) / (p + n + 2))), 0)
            best = int(np.argmax(gain))
            if gain[best] <= 1e-6:
                break
            rule.append(best)
            at = at & tests[best][1]
        return rule

    def covers(left: np.ndarray, rule: list[int]) -> np.ndarray:
        for i in rule:
            left = left & tests[i][1]
        return left

    def right(at: np.ndarray, keep: int) -> float:
        return (counts[keep][at].sum() + 1) / (counts[:, at].sum() + 2)

    left, rules = np.ones(len(cells), bool), []
    while len(rules) < most_rules:
        shown = left & ~grown
        found = []
        for keep in (0, 1):
            rule = grow(left, keep)
            sizes = [(right(covers(shown, rule[:k]), keep), -k) for k in range(1, len(rule) + 1)]
            if sizes:
                worth, size = max(sizes)
                # Better than a guess, and than the share the verdict has in what is left.
                if worth > max(0.5, right(shown, keep)):
                    found.append((worth, keep, rule[:-size]))
        if not found:
            break
        _, keep, rule = max(found)
        rules.append((tuple(tests[i][0] for i in rule), bool(keep)))
        left &= ~covers(left, rule)
    bad, good = counts[:, left].sum(axis=1)
    return DecisionList(tuple(rules), bool(good >= bad))


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    workspace: Workspace,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: tuple[str, ...] = ("doc_id",),
    per_class: int = 8_000,
    cuts: int = 24,
    least_words: int = 50,
    most_repeat_percent: int = 50,
) -> DataFrame:
    """Statistics and verdict for every whole text.

    Returns the columns ``carry`` of ``docs``, then ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` and ``kept``.  A null or empty text has no words
    and fails the base rules.  Labels 0 and 1 of about ``per_class`` documents each teach the rules;
    null labels and labels without a text are left out.  Without labels of both kinds there are no learned
    rules.  Repeated rows are judged alike.
    """
    workspace = workspace.scope()
    sample, _ = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, parts=1, held_out=1, per_class=per_class)
    shown = with_statistics(sample).select(
        "label", (F.pmod(F.xxhash64(F.lit("grow"), "id"), F.lit(3)) > 0).alias("grown"), *[F.expr(e).alias(f) for f, e in FEATURES.items()]
    )
    shown = workspace.write(shown, "statistics")
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    found = shown.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    places = {f: sorted({x for x in found[f] or []}) for f in FEATURES}
    cell = [sum(((F.col(f) > F.lit(x)).cast("int") for x in places[f]), F.lit(0)).alias(f) for f in FEATURES]
    counted = shown.select("label", "grown", *cell).groupBy("grown", *FEATURES).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    # No more cells than rows of the sample.
    cells = [(tuple(r[f] for f in FEATURES), r["good"], r["bad"], r["grown"]) for r in counted.collect()]
    rules = learn_rules(cells, places) if sum(c[2] for c in cells) and sum(c[1] for c in cells) else DecisionList()
    workspace.close()
    out = with_statistics(pick(docs, carry, text_col))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & F.expr(rules.sql())}).select(
        *[F.col(f"`{c}`") for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
