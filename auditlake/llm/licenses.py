"""Licence scan with a trained paragraph classifier, in DataFrame expressions alone.

Paragraphs are described by which word n-grams of the training wording they hold.  A line is one, and so are
consecutive non-blank lines, joined, between those that are confirmed alone: wrapped wording is judged whole.
A multinomial logistic regression with an L1 penalty, trained by Spark's own optimiser on
licence wording, variations of it, licence-like wording of no family and ordinary paragraphs
of the corpus, leaves weights on few n-grams.  A temperature fitted on variations that
were not trained on calibrates its probabilities.  The most likely family of a paragraph
counts from ``least_probability`` on, or if its wording is there; else the paragraph is of an unknown licence if it is
more likely than not about licences at all.  A family is *confirmed* if a wording of it and the
paragraph share enough five-word shingles.

Scoring is a row expression: nothing is shuffled.  Paragraphs without any word that the
weighted n-grams need are passed over; their score would be that of no n-gram.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, pick
from .license_templates import ORDINARY, TEMPLATES, UNKNOWN

NONE, OTHER = "none", "unknown"
_WORDS = "filter(split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')"


def _grams(words: str, most: int = 3) -> str:
    """Distinct n-grams of 1 to ``most`` words of an array expression."""
    parts = [f"transform(sequence(0, size({words}) - {n}), i -> concat_ws(' ', slice({words}, i + 1, {n})))" for n in range(1, most + 1)]
    some = [f"CASE WHEN size({words}) >= {n} THEN {p} ELSE cast(array() AS array<string>) END" for n, p in enumerate(parts, 1)]
    return f"array_distinct(concat({', '.join(some)}))"


def shingles(words: list[str], size: int = 5) -> list[str]:
    """Runs of ``size`` words; fewer words are one run."""
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}) if words else []


def word_list(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]
    constant: list[float]
    weights: dict[str, list[float]]  # of n-grams with any weight, by family
    temperature: float
    cues: list[str]  # a word of each such n-gram


def _variants(spark: SparkSession) -> DataFrame:
    """Wording of families and of unknown licences, and ordinary text with such words: whole, and without some of its words."""
    rows = [(f, t) for f, t in TEMPLATES] + [(OTHER, t) for t in UNKNOWN] + [(NONE, t) for t in ORDINARY]
    base = spark.createDataFrame(rows, "family string, text string").withColumn("w", F.expr(_WORDS.format("text")))
    base = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(11))))
    # Variant 0 is whole; the others lack each word whose hash says so, one in seven.
    kept = "filter(w, (x, i) -> v = 0 OR pmod(xxhash64(x, i, v), 7) <> 0)"
    return base.select("family", F.expr(kept).alias("w"), "v")


def train_license_model(docs: DataFrame, workspace: Workspace, *, text_col: str = "text", ordinary: int = 4_000, everyday_share: float = 0.005) -> LicenseModel:
    """``ordinary`` bounds the paragraphs of the corpus that stand for text without licences.

    Words in over ``everyday_share`` of these are everyday words.
    """
    spark, workspace = docs.sparkSession, workspace.scope()
    positive = _variants(spark)
    # A paragraph each of about `ordinary` documents, drawn by hash.  One that speaks of licences is ordinary
    # only if it shares no three words in a row with any wording.
    n = max(1, docs.count())
    drawn = pick(docs, (), text_col).where("_text is not null")
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit("ordinary"), "_text"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, ordinary / n)) + 1))
    lines = drawn.withColumn("l", F.split("_text", "\n")).select(F.expr("get(l, cast(pmod(xxhash64(_text), size(l)) AS int))").alias("text"))
    spoken = F.expr("lower(text) rlike 'licen|copyright|rights reserved|permission|redistribut'")
    threes = sorted({x for t in [t for _, t in TEMPLATES] + UNKNOWN for x in shingles(word_list(t), 3)})
    own = "transform(sequence(0, greatest(size(w) - 3, 0)), i -> concat_ws(' ', slice(w, i + 1, 3)))"
    shares = F.expr(f"transform(array({_WORDS.format('text')}), w -> arrays_overlap({own}, {_strings(threes)}))[0]")
    lines = lines.where(~(spoken & shares))
    negative = lines.select(F.lit(NONE).alias("family"), F.expr(_WORDS.format("text")).alias("w"), F.expr("cast(pmod(xxhash64(text), 12) AS int)").alias("v"))
    rows = positive.unionByName(negative).withColumn("grams", F.expr(_grams("w")))
    families = [NONE, OTHER, *sorted({f for f, _ in TEMPLATES})]
    index = F.lit(None).cast("double")
    for i, f in enumerate(families):
        index = F.when(F.col("family") == f, F.lit(float(i))).otherwise(index)
    # Families have unlike numbers of rows: each class weighs the same, text without licences as all others.
    sizes = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    weight = F.lit(1.0)
    for f, size in sizes.items():
        share = (len(families) - 1 if f == NONE else 1) / size
        weight = F.when(F.col("family") == f, F.lit(100.0 * share)).otherwise(weight)
    rows = workspace.write(rows.select("grams", "w", "v", index.alias("label"), weight.alias("weight")), "training")
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2, vocabSize=1 << 14)
    terms = counter.fit(rows.where("label > 0")).vocabulary
    # N-grams made of everyday words alone tell nothing; each that stays has a rare word, its cue.
    words = sorted({x for g in terms for x in g.split(" ")})
    common = rows.where("label = 0").select(F.explode(F.array_distinct("w")).alias("x")).where(F.col("x").isin(words))
    often = {r["x"]: r["count"] for r in common.groupBy("x").count().collect()}  # at most a row for each word of the wording
    everyday = max(2, everyday_share * rows.where("label = 0").count())
    terms = [g for g in terms if min(often.get(x, 0) for x in g.split(" ")) <= everyday]
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="features").setBinary(True)
    ready = counter.transform(rows)
    fit = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, elasticNetParam=0.9, maxIter=100)
    fit = fit.fit(ready.where("v % 4 <> 3"))
    matrix, constant = fit.coefficientMatrix.toArray(), list(map(float, fit.interceptVector.toArray()))
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(terms) if abs(matrix[:, i]).max() > 1e-4}
    cues = sorted({min(g.split(" "), key=lambda x: (often.get(x, 0), x)) for g in weights})
    model = LicenseModel(families, constant, weights, 1.0, cues)
    logits = ready.where("v % 4 = 3").select("label", "weight", F.expr(_logits(model, "grams")).alias("z"))
    choices = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    loss = [
        F.sum(F.col("weight") * (F.expr(f"ln(aggregate(transform(z, x -> exp((x - array_max(z)) / {t}D)), 0D, (a, x) -> a + x))") - F.expr(f"(get(z, cast(label AS int)) - array_max(z)) / {t}D"))).alias(f"t{i}")
        for i, t in enumerate(choices)
    ]
    losses = logits.agg(*loss).first()
    best = min(range(len(choices)), key=lambda i: losses[i] if losses[i] is not None and not math.isnan(losses[i]) else math.inf)
    workspace.close()
    return LicenseModel(families, constant, weights, choices[best], cues)


def _array(values: list[float]) -> str:
    return f"array({', '.join(f'{x!r}D' for x in values)})"


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _logits(model: LicenseModel, grams: str) -> str:
    names = list(model.weights)
    if not names:
        return _array(model.constant)
    table = f"map_from_arrays({_strings(names)}, array({', '.join(_array(model.weights[g]) for g in names)}))"
    hits = f"array_intersect({grams}, {_strings(names)})"
    return f"aggregate({hits}, {_array(model.constant)}, (z, g) -> zip_with(z, element_at({table}, g), (a, b) -> a + b))"


def scan_licenses(
    docs: DataFrame,
    workspace: Workspace,
    *,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    least_probability: float = 0.5,
    least_similarity: float = 0.8,
    model: LicenseModel | None = None,
) -> DataFrame:
    """Licence paragraphs of every whole text.

    Returns the columns ``carry`` of ``docs``, then ``n_paragraphs`` (lines with a word) and ``found``: for
    each licence paragraph, in order, its first line's number from 0, ``family``, ``probability``,
    ``similarity`` (the largest share of a wording's five-word shingles that the paragraph holds; a wording
    of fewer words is one shingle) and ``confirmed``.  An unknown licence has the probability that the
    paragraph is about licences at all, and is never confirmed.  Lines that a confirmed paragraph of several
    lines explains (its family, or of no family and with half of their three-word runs from its wording) are not
    found once more; such a paragraph that is not confirmed counts if none of its lines does.  Null and empty texts have no paragraphs.
    Repeated rows are scanned alike; an empty table trains on the wording alone.
    """
    model = model or train_license_model(docs, workspace, text_col=text_col)
    words = _WORDS.format("p")
    by_family: dict[str, list[list[str]]] = {}
    for family, text in TEMPLATES:
        own = word_list(text)
        by_family.setdefault(family, []).append(own)
    forms = [f for f in by_family for _ in by_family[f]]
    runs_ = [shingles(own) for f in by_family for own in by_family[f]]
    sizes = [min(5, len(own)) for f in by_family for own in by_family[f]]
    wording = ", ".join(
        f"named_struct('family', '{f}', 'size', {n}, 'runs', {_strings(r)})" for f, r, n in zip(forms, runs_, sizes, strict=True)
    )
    z = _logits(model, _grams("w"))
    t = model.temperature
    names = _strings(model.families)
    own_runs = "transform(sequence(0, greatest(size(w) - t.size, 0)), i -> concat_ws(' ', slice(w, i + 1, t.size)))"
    likeness = (
        f"coalesce(array_max(transform(filter(array({wording}), t -> t.family = f), "
        f"t -> size(array_intersect({own_runs}, t.runs)) / size(t.runs))), 0D)"
    )
    # For each paragraph in turn: words, logits, probabilities, the likeliest licence, its likeness.
    judged = (
        f"transform(array({words}), w -> transform(array({z}), z -> "
        f"transform(array(transform(z, x -> exp((x - array_max(z)) / {t!r}D))), e -> "
        f"transform(array(transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))), q -> "
        f"transform(array(array_position(q, array_max(slice(q, 3, size(q) - 2)))), k -> "
        f"transform(array(get({names}, cast(k - 1 AS int))), f -> transform(array({likeness}), s -> "
        f"transform(array(CASE WHEN get(q, cast(k - 1 AS int)) >= {least_probability!r}D OR s >= {least_similarity!r}D THEN f "
        f"WHEN get(q, 0) < 0.5D THEN '{OTHER}' ELSE '{NONE}' END), c -> named_struct('family', c, "
        f"'probability', if(c = '{OTHER}', 1D - get(q, 0), get(q, cast(k - 1 AS int))), 'similarity', if(c = f, s, 0D)))[0])[0])[0])[0])[0])[0])[0])[0]"
    )
    lines = pick(docs, carry, text_col).withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n"))
    cues = f"arrays_overlap({words}, {_strings(model.cues)})" if model.cues else "false"
    near = F.expr(f"filter(transform(_lines, (p, i) -> struct(i AS line, p AS p)), s -> transform(array(s.p), p -> {cues})[0])")
    lines = lines.withColumn("_near", near)
    found = F.expr(f"transform(_near, s -> named_struct('line', s.line, 'n', 1, 'j', transform(array(s.p), p -> {judged})[0]))")
    lines = lines.withColumn("_found", found)
    # Runs of lines lie between breaks: blank lines and lines that are confirmed alone.  Without a cue a run scores nothing.
    sure = f"(x.j.family <> '{NONE}' AND x.j.similarity >= {least_similarity!r}D)"
    lines = lines.withColumn("_alone", F.expr(f"transform(filter(_found, x -> {sure}), x -> x.line)"))
    edge = "i < 0 OR i = size(_lines) OR NOT get(_lines, i) rlike '[^\\\\s]' OR array_contains(_alone, i)"
    lines = lines.withColumn("_breaks", F.expr(f"CASE WHEN size(_near) = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(-1, size(_lines)), i -> {edge}) END"))
    lines = lines.withColumn("_runs", F.expr("transform(_breaks, (b, k) -> named_struct('line', b + 1, 'n', coalesce(get(_breaks, k + 1) - b - 1, 0)))"))
    lines = lines.withColumn("_runs", F.expr("filter(_runs, r -> r.n > 1 AND exists(_near, s -> s.line >= r.line AND s.line < r.line + r.n))"))
    joined = "array_join(slice(_lines, r.line + 1, r.n), ' ')"
    lines = lines.withColumn("_runs", F.expr(f"transform(_runs, r -> named_struct('line', r.line, 'n', r.n, 'j', transform(array({joined}), p -> {judged})[0]))"))
    within = "x.line >= r.line AND x.line < r.line + r.n"
    kept = f"filter(_runs, r -> r.j.family <> '{NONE}' AND (r.j.similarity >= {least_similarity!r}D OR NOT exists(_found, x -> x.j.family <> '{NONE}' AND {within})))"
    lines = lines.withColumn("_runs", F.expr(kept))
    threes = {f: _strings(sorted({x for own in by_family[f] for x in shingles(own, 3)})) for f in by_family}
    wording_runs = "CASE r.j.family " + " ".join(f"WHEN '{f}' THEN {x}" for f, x in threes.items()) + " ELSE cast(array() AS array<string>) END"
    own_threes = "array_distinct(transform(sequence(0, greatest(size(w) - 3, 0)), i -> concat_ws(' ', slice(w, i + 1, 3))))"
    of_line = _WORDS.format("get(_lines, x.line)")
    from_it = f"transform(array({of_line}), w -> 2 * size(array_intersect({own_threes}, {wording_runs})) >= size({own_threes}))[0]"
    explained = f"exists(_runs, r -> {within} AND r.j.similarity >= {least_similarity!r}D AND NOT {sure} AND (x.j.family = r.j.family OR (x.j.family = '{OTHER}' AND {from_it})))"
    lines = lines.withColumn("_found", F.expr(f"array_sort(concat(filter(_found, x -> x.j.family <> '{NONE}' AND NOT {explained}), _runs), (a, b) -> a.line - b.line)"))
    tidy = F.expr(
        "transform(_found, x -> named_struct('line', x.line, 'family', x.j.family, "
        f"'probability', x.j.probability, 'similarity', x.j.similarity, 'confirmed', x.j.similarity >= {least_similarity!r}D))"
    )
    has_word = F.expr("cast(size(filter(_lines, p -> p rlike '[\\\\p{L}\\\\p{N}]')) AS bigint)")
    return lines.select(*[F.col(f"`{c}`") for c in carry], has_word.alias("n_paragraphs"), tidy.alias("found"))


def families(found: Column) -> Column:
    """The families that are confirmed or unknown, sorted and comma-joined."""
    kept = F.filter(found, lambda x: x["confirmed"] | (x["family"] == OTHER))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["family"]))), ",")
