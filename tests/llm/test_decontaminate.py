import hashlib
import random
import re

from echometer.llm import decontaminate
from tests.llm.conftest import EDGES


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10):
    own, hit, ids = words(text), set(), set()
    for item, other in items:
        pattern = words(other)
        length = min(window, len(pattern))
        windows = {tuple(pattern[i : i + length]) for i in range(len(pattern) - length + 1)} if length else ()
        for i in range(len(own) - length + 1 if length else 0):
            if tuple(own[i : i + length]) in windows:
                hit.update(range(i, i + length))
                ids.add(item)
    return len(own), len(hit), sorted(ids - {None})


def test_search_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        items = [
            (str(k), " ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 15])))) for k in range(3)
        ]
        patterns = decontaminate.Patterns(items)
        text = " ".join(rng.choice("abc") for _ in range(80))
        found, ids = set(), set()
        for start, end, owners in patterns.search(decontaminate.words_of(text.encode())):
            found.update(range(start, end))
            ids |= owners
        assert (80, len(found), sorted(ids)) == brute(text, items)


def test_edges(spark, edges, monkeypatch):
    items = [(1, "Another LINE stays"), (None, "here twice"), (2, None), (3, ""), (10, "word5 word6 word7"), (10, "quite a few")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(str(brute(row[1], [(i and str(i), t) for i, t in items])) for row in EDGES)
    for size in (1 << 20, 1):  # one chunk of patterns, and one for each item
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        rows = decontaminate.find_passages(edges, bench).collect()
        assert sorted(str((r.n_words, r.n_hit, r["items"])) for r in rows) == expected
        assert all(r.document["n_words"] == "n_words" for r in rows)


def test_empty(edges, nothing, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(nothing, none).count() == 0
    assert {r.n_hit for r in decontaminate.find_passages(edges, none).collect()} == {0}


def test_query(spark, tables, texts):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in decontaminate.op6_decontamination(spark, tables).collect()}
    assert any(r.contaminated for r in rows.values())
    for doc_id, text in texts:
        n, hit, ids = brute(text, items)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        r = rows[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), digest, hit > 0)
