import hashlib
import random

from echometer.llm import fingerprints
from echometer.llm.fingerprints import Prefixes


def test_spans_and_extensions():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab\U0001f680") for _ in range(rng.randrange(40))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + b
        x, y = Prefixes.of(a), Prefixes.of(b)
        prefix = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        suffix = next((i for i, (p, q) in enumerate(zip(a[::-1], b[::-1])) if p != q), min(len(a), len(b)))
        assert (fingerprints.common_prefix(x, y), fingerprints.common_suffix(x, y)) == (prefix, suffix)
        i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        for k in range(len(b) - (j - i) + 1):
            assert (x.span(i, j) == y.span(k, k + j - i)) == (a[i:j] == b[k : k + j - i])
        joined = x.joined(len(a) // 3, y, len(b) // 2)
        whole = Prefixes.of(a[: len(a) // 3] + b[: len(b) // 2])
        assert all((p == q).all() for p, q in zip(joined.arrays, whole.arrays))


def test_likeness():
    rng = random.Random(6)
    words = [str(rng.random()) for _ in range(400)]
    texts = [" ".join(words), " ".join(words[:390]), " ".join(words[:200]), " ".join(str(rng.random()) for _ in range(400)), "", "x"]
    prints = [fingerprints.fingerprint(p := Prefixes.of(t), fingerprints.sketch(p)) for t in texts]
    near = [fingerprints.likeness(prints[0], p) for p in prints]
    assert near[0] == 1 and near[1] > 0.85 and 0.3 < near[2] < 0.7 and near[3] < 0.05 and near[4] == 0
    assert fingerprints.likeness(prints[4], prints[4]) == 1 and fingerprints.likeness(prints[4], prints[5]) == 0


def check(rows, texts):
    """``texts``: (id, text) in order."""
    by_id = {r.doc_id: r for r in rows}
    for (doc_id, text), (_, other) in zip(texts, texts[1:] + texts[:1]):
        half, r = len(text) // 2, by_id[doc_id]
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        p, q = Prefixes.of(text), Prefixes.of(edited)
        assert r.fingerprint == fingerprints.fingerprint(p, fingerprints.sketch(p))
        assert r.edited_fingerprint == fingerprints.fingerprint(q, fingerprints.sketch(q))
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.edited_prefix == fingerprints.common_prefix(p, q)


def test_edges(spark, edges, nothing):
    rows = fingerprints.neighbours(edges).collect()
    assert len(rows) == edges.count()
    equal = [r for r in rows if r.doc_id == 3]
    assert len(equal) == 2 and len({r.fingerprint for r in equal}) == 1
    assert sorted(r.near_next for r in equal)[-1] == 1
    assert fingerprints.neighbours(nothing).count() == 0
    alone = fingerprints.neighbours(edges.filter("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fingerprints.fingerprints(edges).count() == edges.count()


def test_buckets_without_rows(spark):
    texts = [(i * i, f"text {i} " * (i % 7)) for i in range(50)]
    df = spark.createDataFrame(random.Random(1).sample(texts, 50), "doc_id long, text string").repartition(6)
    check(fingerprints.neighbours(df).collect(), texts)


def test_query(spark, tables, texts):
    rows = fingerprints.op1_fingerprints(spark, tables).collect()
    check(rows, texts)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(dict(texts)[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
