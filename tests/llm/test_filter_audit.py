from itertools import permutations

from echometer.llm import filter_audit
from tests.compare import difference
from tests.llm.conftest import EDGES

COLUMNS = "doc_id long, text string, lang string"


def brute(docs, labels):
    """Rows of the audit by testing every filter on every document for every order."""
    import re

    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            key = text or ""
            first[key] = min(first.get(key, doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = len(re.findall("[A-Z]", t))
        f = {
            "A": len(words) < 100,
            "B": len(set(words)) * 100 < len(words) * 80,
            "C": upper * 100 > len(t) * 10,
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": doc_id is not None and doc_id > first[t],
        }
        fails.append((lang or "", f, doc_id in good, doc_id in toxic))
    rows = []
    for part in sorted({p for p, *_ in fails}):
        own = [x for x in fails if x[0] == part]
        removed_by = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                out = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                removed_by[order, letter] = out
                rows.append([part, order, step, letter, len(left), len(out),
                             sum(x[1][letter] for x in own) - len(out),
                             sum(x[1][letter] and sum(x[1].values()) == 1 for x in own),
                             sum(x[2] for x in out), sum(x[3] for x in out)])
        for row in rows:
            if row[0] == part and len(row) == 10:
                row.append(sum(len(v) for (o, l), v in removed_by.items() if l == row[3]))
    return sorted(map(tuple, rows))


def result(df):
    return sorted(tuple(r) for r in df.select(*[f.split()[0] for f in filter_audit.RESULT.split(", ")]).collect())


def test_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = result(filter_audit.op11_filter_audit(spark, tables))
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({(lang or "") for _, _, lang in docs})


def test_equals_sql(spark, tables):
    assert difference(filter_audit.op11_filter_audit(spark, tables), tables, filter_audit.OP11_SQL) is None


def test_edges(spark, edges):
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = result(filter_audit.filter_audit(edges, labels))
    docs = [(r[0], r[1], r[2]) for r in EDGES]
    assert got == brute(docs, [(3, 1, 1), (3, 0, 0), (4, None, 1)])
    # Nulls and empty text are one text; the repeated row of id 3 passes E twice.
    assert {r[0] for r in got} == {"", "en", "fr", "es", "de"}


def test_empty_and_ties(spark, nothing):
    assert filter_audit.filter_audit(nothing).count() == 0
    same = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(5, same, "x"), (5, same, "x"), (2, same, "y"), (None, same, "x")], COLUMNS)
    got = result(filter_audit.filter_audit(docs))
    assert got == brute([tuple(r) for r in docs.collect()], [])
    # Only E removes anything: both rows of id 5 in part x; the row without id stays.
    first = [r for r in got if r[0] == "x" and r[1] == "EABCD" and r[2] == 1][0]
    assert first[4:7] == (1, 2, 0) and first[7] == 2 and first[10] == 2 * 120
