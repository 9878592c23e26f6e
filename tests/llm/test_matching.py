"""Near-duplicates, benchmark passages and repeated passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm.common import gram_hashes, mix, winnow
from auditlake.llm.components import connected_components
from auditlake.llm.decontaminate import BenchmarkIndex, mark_contamination, match_words
from auditlake.llm.simhash import _link_groups, near_duplicates, near_links, simhash
from auditlake.llm.substring_dedup import remove_repeats

from .conftest import prose


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbZ É\t\n\x0b日", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash(text.encode()) % (1 << 64) == slow_fingerprint(text)


@given(st.lists(st.integers(0, 6), min_size=0, max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_winnow_takes_rightmost_least(values, w):
    h = mix(np.array(values, np.uint64))
    got = winnow(h, w).tolist()
    for i, at in enumerate(got):
        own = (h[i : i + w] >> np.uint64(24)).tolist()
        assert at == i + max(k for k, x in enumerate(own) if x == min(own))
    assert len(got) == max(0, len(values) - w + 1)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 10, 35])
def test_gram_hashes_follow_content(k):
    rng = random.Random(k)
    words = [rng.randrange(2) for _ in range(400)]
    got = gram_hashes(mix(np.array(words, np.uint64)), k).tolist()
    by = {}
    for i, h in enumerate(got):
        assert by.setdefault(tuple(words[i : i + k]), h) == h
    assert len(set(by.values())) == len(by)


def clustered(n, seed):
    """Fingerprints around few centres, so that groups are dense."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_gray_index_links_like_brute_force():
    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    codes = np.array(sorted(clustered(900, 1), key=rank), np.uint64)
    near = [(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 3) + i + 1]
    assert _link_groups(np.zeros(len(codes), np.int64), codes, 3).tolist() == roots(len(codes), near)


@pytest.mark.parametrize("group_rows", [8, 16_384])
def test_hot_groups_are_dealt_again_without_loss(spark, workspace, group_rows):
    codes = clustered(400, 2) + [(0xABCD << 48) | x for x in range(300)]  # one shared block
    codes = sorted({c - (1 << 64) if c >> 63 else c for c in codes})
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    links = near_links(frame, workspace, group_rows=group_rows)
    got = {r["node"]: r["root"] for r in connected_components(links, workspace).collect()}
    a = np.array(codes, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1]
    assert [got.get(c, c) for c in codes] == [codes[r] for r in roots(len(codes), near)]


def test_components_of_a_chain_and_a_star(spark, workspace):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long"), workspace).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs, workspace):
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in near_duplicates(odd_docs, workspace).collect())
    by = {d: (f, c) for d, f, c in got}
    assert len(got) == 12
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[7][1] == 6
    assert by[-1][1] is None
    assert near_duplicates(no_docs, workspace).collect() == []


def slow_marks(words, items):
    hit, found = set(), set()
    for name, own in items.items():
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return hit, found


@given(
    st.lists(st.sampled_from("ab"), max_size=45),
    st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=4),
)
@settings(max_examples=150, deadline=None)
def test_benchmark_index_finds_every_window(words, items):
    named = {str(i): [w.encode() for w in x] for i, x in enumerate(items)}
    index = BenchmarkIndex([(k, b" ".join(x)) for k, x in named.items()], 10, 5)
    own = [w.encode() for w in words]
    hit, found = index.match(own)
    slow = slow_marks(own, named)
    assert set(np.flatnonzero(hit).tolist()) == slow[0]
    assert {index.names[i] for i in found} == slow[1]


@pytest.mark.parametrize("options", [{"index_bytes": 200}, {"index_bytes": 0, "bloom_bits": 64, "salts": 2}, {}])
def test_contamination_broadcast_and_joined(spark, options):
    docs = [(i, prose(i, 80)) for i in range(30)]
    items = [(i, " ".join(docs[i][1].split()[20 : 20 + n])) for i, n in ((0, 30), (1, 10), (2, 9), (3, 1), (4, 12))]
    items += [(9, None), (10, ""), (None, " ".join(docs[5][1].split()[:15])), (0, items[0][1])]
    got = mark_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options
    )
    named = {}
    for n, (k, text) in enumerate(items):
        named[(k, n)] = match_words((text or "").encode())
    for r in got.collect():
        hit, found = slow_marks(match_words(docs[r["doc_id"]][1].encode()), named)
        assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == hit
        assert r["items"] == sorted({str(k) for k, _ in found if k is not None})


@pytest.mark.parametrize("index_bytes", [-1, 1000])
def test_contamination_of_odd_rows(odd_docs, no_docs, spark, index_bytes):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r["spans"]) for r in mark_contamination(odd_docs, none, index_bytes=index_bytes).collect()} == {0}
    tie = spark.createDataFrame([(1, "tie tie")], "item_id long, text string")
    got = {r["doc_id"]: r for r in mark_contamination(odd_docs, tie, index_bytes=index_bytes).collect()}
    assert [tuple(s) for s in got[9]["spans"]] == [(0, 120)]
    assert got[1]["n_words"] == 0
    assert mark_contamination(no_docs, tie, index_bytes=index_bytes).collect() == []


def slow_removal(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"phrases_per_shard": 3, "regions_per_task": 2}, {"bloom_bits": 64}])
def test_repeats_are_removed_like_brute_force(spark, workspace, options):
    passage, other = prose(100, 50), prose(101, 36)
    texts = [f"{prose(i, 40)} {passage}\n{prose(i + 50, 30)}" for i in range(6)]
    texts += [f"{other} {prose(70, 20)} {other}", other, "a b " * 60, "c " * 35, "c " * 36, prose(9, 34), prose(9, 34), None, ""]
    texts += [" ".join(passage.split()[5:45]), " ".join([*passage.split()[:25], "x", *passage.split()[25:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = remove_repeats(docs, workspace, **options).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == slow_removal(texts, 35)
    assert [r["clean_text"] for r in got if not r["n_removed"]] == [t for t, r in zip(texts, got, strict=True) if not r["n_removed"]]
    assert all(" ".join((r["clean_text"] or "").split()) == r["kept"] for r in got if r["n_removed"])


def test_repeats_of_odd_rows(odd_docs, no_docs, workspace):
    rows = odd_docs.collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(odd_docs, workspace).collect())
    slow = slow_removal([r["text"] for r in rows], 35)
    assert got == Counter((r["doc_id"], n, m) for r, (n, m, _) in zip(rows, slow, strict=True))
    from auditlake.llm.common import Workspace

    assert remove_repeats(no_docs, Workspace(no_docs.sparkSession)).collect() == []


def test_words_of_equal_crc_are_told_apart(spark, workspace):
    """'plumless' and 'buckeroo' have one CRC32."""
    own = prose(4, 34)
    docs = spark.createDataFrame([(0, f"{own} plumless"), (1, f"{own} buckeroo")], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(docs, workspace).collect()] == [0, 0]


def test_the_automaton_decides(spark, workspace, monkeypatch):
    """Occurrences come from the automaton alone: a phrase it lacks leaves its windows in place."""
    import auditlake.llm.substring_dedup as sd

    passage = prose(5, 60)
    docs = spark.createDataFrame([(i, f"{prose(i + 20, 30)} {passage}") for i in range(3)], "doc_id long, text string")
    regions = sd.Regions(sd.pa.array([passage.encode(), b"x " + passage.encode()], sd.pa.binary()), 35)
    places, hashes = sd._anchors(regions.codes[0], 35, sd.GRAM)
    at = np.flatnonzero(regions.valid)
    hashes = hashes & sd._TAG
    own = np.column_stack((regions.own[0][at], (regions.own[1][at] & ~sd._TAG) | hashes[at]))
    phrases = {int(hashes[i]): b" ".join(regions.words[places[i] : places[i] + sd.GRAM]) for i in at}
    whole = sd.PhraseAutomaton(own, list(phrases.items()), 35).locate(regions)
    assert [x.tolist() for x in whole] == [[0, 61], [60, 122]]
    assert len(phrases) > 1
    for left_out in phrases:
        less = sd.PhraseAutomaton(own, [(k, v) for k, v in phrases.items() if k != left_out], 35).locate(regions)
        assert (less[1] - less[0]).sum() < 121
    unconfirmed = sd.PhraseAutomaton(own[hashes[at] != left_out], list(phrases.items()), 35)
    assert len(unconfirmed.automaton) == len(phrases) - 1
    assert [r["n_removed"] for r in remove_repeats(docs, workspace).collect()] == [60] * 3


def test_copies_of_a_text_go_to_all_tasks_of_their_shard(spark, workspace, monkeypatch):
    import auditlake.llm.substring_dedup as sd

    kind, seen = type(spark.range(0)), []
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: seen.append((a, self.where("kind = 2").groupBy("shard", "salt").count().collect())) or real(self, *a))
    docs = spark.createDataFrame([(i, prose(1, 40)) for i in range(400)], "doc_id long, text string")
    spans = sd.find_repeats(docs, workspace, regions_per_task=20)
    assert [(r["begin"], r["until"]) for r in spans.collect()] == [(0, 40)]
    dealt = next(rows for a, rows in seen if a == ("shard", "salt"))
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 60


def test_tables_of_an_operator_go_when_it_ends(spark, workspace):
    import os

    docs = spark.createDataFrame([(i, prose(i % 3, 80)) for i in range(9)], "doc_id long, text string")
    out = remove_repeats(docs, workspace)
    held = [d for d, _, files in os.walk(workspace.root.removeprefix("file://")) if any(f.endswith(".parquet") for f in files)]
    assert len(held) == 1 and held[0].endswith("gathered")
    assert out.count() == 9


def test_no_silent_local_folder(spark, monkeypatch):
    import auditlake.llm.common as common

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far)
