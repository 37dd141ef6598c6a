import random
import re
from collections import defaultdict

import numpy as np
import pytest

from echometer.llm import jaccard
from echometer.llm.components import components
from echometer.llm.shingles import shingle_set


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """(size, component) of each (id, text), ids distinct."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    parents = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parents[x] != x:
            x = parents[x]
        return x

    lists = defaultdict(list)
    for doc_id, own in sets.items():
        counts = defaultdict(int)
        for s in own:
            for other in lists[s]:
                counts[other] += 1
            lists[s].append(doc_id)
        for other, both in counts.items():
            if 100 * both >= 75 * (len(own) + len(sets[other]) - both):
                a, b = root(doc_id), root(other)
                parents[max(a, b)] = min(a, b)
    return {doc_id: (len(own), root(doc_id)) for doc_id, own in sets.items()}


def grouped(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()}


def copies(rng, bases, count, edits):
    rows = []
    for doc_id in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((doc_id, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [3, 64])
def test_equals_brute_force(spark, monkeypatch, frequent):
    # Small limits lead through split blocks, frequent shingles and keys of both kinds.
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(frequent)
    bases = [[f"b{k}x{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 200]))] for k in range(6)]
    rows = copies(rng, bases, 160, [0, 1, 1, 2, 3, 5, 8])
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_keys_meet():
    rng = np.random.default_rng(3)
    flags = np.zeros(jaccard.BUCKETS, bool)
    for n in (1, 2, 3, 4, 7, 20, 61, 400):
        for _ in range(20):
            union = rng.integers(0, 2**63, n, np.uint64)
            common = -(-75 * n // 100)
            cut = rng.integers(common, n + 1)
            one, other = np.unique(union[:cut]), np.unique(np.concatenate((union[:common], union[cut:])))
            for frequent in (flags, ~flags, rng.random(jaccard.BUCKETS) < 0.8):
                keys = [set(jaccard.signature_keys(s, frequent)[0].tolist()) for s in (one, other)]
                assert keys[0] & keys[1], n


def test_block_search_equals_brute_force():
    rng = random.Random(9)
    rows = copies(rng, [[f"a{i}" for i in range(50)], [f"c{i % 9}" for i in range(40)]], 60, [0, 1, 2, 3, 4])
    sets = [shingle_set(text.encode()) for _, text in sorted(rows)]
    roots = list(range(len(sets)))
    for _ in sets:
        for a, b in jaccard.search_block(sets):
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert {k: (len(sets[k]), roots[k]) for k in range(len(sets))} == brute(sorted(rows))


def test_edges(edges, nothing):
    out = grouped(edges)
    assert out[0] == (0, 0) and out[1] == (0, 1) and out[2] == (1, 2)
    assert out[6][1] == 6 and out[7][1] == 6
    assert jaccard.similar_groups(edges).count() == edges.count()
    assert jaccard.similar_groups(nothing).count() == 0


def test_frequency_counts_all_tasks(spark):
    # A few documents with the shingle in each task, many in all.
    rows = [(i, f"one two three four five w{i}") for i in range(80)]
    marks = jaccard.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), "doc_id", "text")
    (shingle,) = shingle_set(b"one two three four five")
    assert jaccard.frequent_buckets(marks).tolist() == [int(shingle) % jaccard.BUCKETS]


@pytest.fixture
def few_rounds(monkeypatch):
    calls, pairs = [], jaccard._first_pairs

    def counted(postings):
        calls.append(1)
        assert len(calls) < 5, "rounds of first documents without an end"
        return pairs(postings)

    monkeypatch.setattr(jaccard, "_first_pairs", counted)


def test_ends_without_candidates(spark, nothing, few_rounds):
    assert jaccard.similar_groups(nothing).count() == 0
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20))) for i in range(4)]
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_only_later_documents_of_a_list_link(spark, few_rounds):
    words = [f"w{k}" for k in range(60)]
    least = shingle_set(" ".join(words).encode())[0]
    changed = ([*words[:k], "new", *words[k + 1 :]] for k in range(60))
    other = next(w for w in changed if shingle_set(" ".join(w).encode())[0] != least)
    # Every shingle that the two have in common is first in a text of its own, far too short to link with them.
    rows = [(k, " ".join(words[k : k + 5])) for k in range(56)] + [(100, " ".join(words)), (101, " ".join(other))]
    expected = brute(rows)
    assert expected[101][1] == 100
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (5, 5)]
    labels = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100}


def test_query(spark, tables, texts):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op3_ngram_jaccard(spark, tables).collect()}
    assert rows == brute(texts)


def test_keys_are_made_once(spark, monkeypatch):
    plans, several = [], jaccard._several

    def seen(postings):
        plans.append(postings._jdf.queryExecution().toString())
        return several(postings)

    monkeypatch.setattr(jaccard, "_several", seen)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20))) for i in range(4)]
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert plans and not any("MapInArrow" in plan for plan in plans)


def test_near_copies_make_no_pairs(spark, monkeypatch):
    # One large group of near copies, many of them too far from the others to link.
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    rows = copies(rng, [base], 240, [1, 2, 4, 6, 8, 9, 10])
    lengths, pairs = [], jaccard._all_pairs_across

    def seen(postings):
        lengths.extend(row["count"] for row in postings.groupBy("key").count().collect())
        return pairs(postings)

    monkeypatch.setattr(jaccard, "_all_pairs_across", seen)
    expected = brute(rows)
    assert len({component for _, component in expected.values()}) > 20
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected
    assert max(lengths, default=0) <= jaccard.FAMILY


def test_short_long_lists_are_merged(monkeypatch):
    rng = random.Random(4)
    sets = [shingle_set(text.encode()) for _, text in sorted(copies(rng, [[f"a{i}" for i in range(80)]], 50, [0, 2, 4, 5, 7]))]
    merged = jaccard.search_block(sets)
    monkeypatch.setattr(jaccard, "PER_LOOKUP", 0)
    assert merged == jaccard.search_block(sets)
    leads = [1, 7, 30]
    assert {x for x, _ in jaccard.search_block(sets, leads)} <= set(leads)
