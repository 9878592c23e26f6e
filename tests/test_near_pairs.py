"""Near pairs: none is lost, and what is shuffled stays small."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import similarity

WORDS = ["the ", "and ", "ing ", "tion", "re", "er ", "on", "Grüße ", "été ", "字符 ", "😀"]


def near_copies(seed, groups, copies):
    """Texts of few words; of each some copies with 0 to 10 % of their characters changed, put in or left out."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        text = "".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 140)))
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.randrange(max(1, len(text) // 10))):
                at = rng.randrange(len(own))
                own[at] = rng.choice([own[at] + "x", "", "z", own[at][:1]])
            out.append("".join(own))
    return out + ["ab" * n for n in range(30, 60)] + out[:20]  # long runs of one gram; copies


@pytest.mark.parametrize(("ratio", "least"), [(0.92, 65), (0.8, 10), (0.5, 5)])
def test_no_pair_is_lost(spark, ratio, least):
    rows = [(i, i % 2, t) for i, t in enumerate(near_copies(least, 12, 6))]
    frame = spark.createDataFrame(rows, "k long, side int, t string")
    texts = {}
    for k, side, t in rows:
        if len(t) >= least:
            texts.setdefault((side, t), k)
    plain = list(texts.items())

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    slow = set()
    for j, ((side, b), y) in enumerate(plain):
        for (other, a), x in plain[:j]:
            n = max(len(a), len(b))
            if side == other and min(len(a), len(b)) > ratio * n and 1 - far(a, b) / n > ratio:
                slow.add((side, min(x, y), max(x, y)))
    got = similarity.near_pairs(frame, "k", "t", ratio=ratio, least=least, block=["side"]).collect()
    assert len(got) == len(slow) > 10
    assert {(r["side"], r["a"], r["b"]) for r in got} == slow


def test_shuffled_choices_are_small(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(WORDS) for _ in range(200))) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, t string").withColumn("s", F.lit(0).cast("long"))
    rare = similarity._Rare(0.92, 65)
    similarity._count_grams(frame, rare)
    sent = similarity._choices(frame, rare, 4).select(sum(F.octet_length(c) for c in ("grams", "places", "who", "ids", "lengths")).alias("n"))
    assert sent.agg(F.sum("n")).first()[0] < 5 * sum(len(t.encode()) for _, t in rows)  # every offset twice is over 30 times that
