import hashlib
import re
import zlib

import numpy as np
import pytest

from echometer.llm import periodic_runs
from tests.llm.conftest import EDGES


def brute_runs(words):
    """Every maximal stretch of smallest period q and length >= max(6, 4q), by testing each q."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    s = np.array([ids[w] for w in words], np.int64)
    n, out = len(s), []
    for q in range(1, n // 4 + 1):
        eq = np.concatenate([[False], s[:-q] == s[q:], [False]])
        edges = np.flatnonzero(np.diff(eq.astype(np.int8)))
        for x, y in zip(edges[::2], edges[1::2]):
            length = y - x + q
            if length < max(6, 4 * q):
                continue
            if any(q % d == 0 and (s[x:x + length - d] == s[x + d:x + length]).all() for d in range(1, q)):
                continue
            out.append((int(x), int(length), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = set()
    for s, length, q in runs:
        dropped.update(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id,
        len(words),
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


@pytest.mark.parametrize(
    "words",
    [
        "a a a a a a".split(),
        "a b a b a b a b x".split(),
        "x a b a b a b a b a b a b a y a a a a a a a a".split(),
        list("abcabcabcabcabcabcabcabc") + list("zzzzzz"),
        list("aabaabaabaabaabaab") + list("aab"),
        [],
        ["one"],
    ],
)
def test_runs_equal_brute_force(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    items = np.array([ids[w] for w in words], np.int64)
    assert [tuple(r) for r in periodic_runs.runs_of(items).tolist()] == brute_runs(words)


def test_random_sequences():
    rng = np.random.default_rng(7)
    for size, alphabet in [(40, 2), (200, 3), (500, 2), (300, 5)]:
        for _ in range(20):
            words = [str(x) for x in rng.integers(0, alphabet, size)]
            ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
            items = np.array([ids[w] for w in words], np.int64)
            assert [tuple(r) for r in periodic_runs.runs_of(items).tolist()] == brute_runs(words)


def test_query_equals_brute_force(spark, tables, texts):
    got = sorted(tuple(r) for r in periodic_runs.op13_periodic_runs(spark, tables).collect())
    assert got == sorted(brute(i, t) for i, t in texts)
    assert any(r[2] > 0 for r in got)


def test_edges(spark, edges, nothing):
    got = sorted((tuple(r) for r in periodic_runs.find_runs(edges).collect()), key=repr)
    assert got == sorted((brute(r[0], r[1]) for r in EDGES), key=repr)
    assert periodic_runs.find_runs(nothing).count() == 0


def test_long_run():
    words = ["w"] * 200_000 + [f"x{i}" for i in range(50_000)] + ["a", "b"] * 30_000
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    items = np.array([ids[w] for w in words], np.int64)
    assert [tuple(r) for r in periodic_runs.runs_of(items).tolist()] == [(0, 200_000, 1), (250_000, 60_000, 2)]
