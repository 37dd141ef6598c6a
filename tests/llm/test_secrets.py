import hashlib
import re

from pyspark.sql import functions as F

from echometer.llm import secrets

RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", r"[0-9a-f]+", 0, 24, 0),
)


def brute(text):
    found = []
    for rank, (kind, pattern, group, least, flags) in enumerate(RULES):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def found(df):
    return secrets.judged(secrets.find_candidates(df, F.col("source"), F.col("doc_id"), ["doc_id"]))


KEY = "AKIA" + "Q" * 16
LIVE = "0123456789abcdef01234567"
ROWS = [
    (1, f"é password = '{LIVE}' and token: abc", "a"),
    (2, KEY, "a"),
    (3, f"x {KEY}", "b"),
    (4, f"{KEY} {KEY}", "c"),
    (5, None, "a"),
    (6, "", None),
    (7, "API_KEY=ſecret PaſſWord=1234567 Token=1234567", None),
    (8, "deadbeef" * 4 + "g" + "AKIA123", "b"),
]


def test_verdicts(spark):
    df = spark.createDataFrame(ROWS * 2, "doc_id long, text string, source string")
    rows = {r.document.doc_id: r for r in found(df).collect()}
    assert len(rows) == 8 and found(df).count() == 16
    assert [v.kind for v in rows[1].verdicts] == ["live"]
    assert [v.kind for v in rows[4].verdicts] == ["example", "example"]
    assert rows[2].verdicts[0].owners == 3 and rows[2].verdicts[0].repositories == 3
    assert rows[5].candidates == [] and rows[5].verdicts is None


def test_base_spans_equal_rules():
    for _, text, _ in ROWS:
        names = secrets.KINDS
        assert [f"{names[s[1]]}:{s[0]}:{s[2]}" for s in secrets.base_spans(text or "")] == brute(text)


def test_edges(edges, nothing):
    assert found(edges).count() == edges.count()
    assert found(nothing).count() == 0


def test_query(spark, tables, texts):
    rows = {r.doc_id: r for r in secrets.op9_secrets(spark, tables).collect()}
    for doc_id, text in texts:
        spans, r = brute(text), rows[doc_id]
        kinds = [s.split(":")[0] for s in spans]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in secrets.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_counts_by_kind_wherever_the_candidate_stands(spark, tmp_path):
    texts = [f"{LIVE} {LIVE} token={LIVE}", f"{KEY} {LIVE} secret: {KEY} {KEY}", f"api_key={LIVE}", None]
    rows = [(i, text, "a") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in secrets.op9_secrets(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 0, 3), 1: (1, 3, 1), 2: (1, 0, 1), 3: (0, 0, 0)}
