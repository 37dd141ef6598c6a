import random

from pyspark.sql import functions as F

from echometer.llm import lines
from tests.compare import difference


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    cut = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[cut + (len(a) == len(b)) :] == b[cut + 1 :]


def brute(rows, least=lines.MIN_CHARS):
    """Dropped line numbers of each (id, text), ids distinct."""
    order = sorted((row for row in rows if row[1] is not None), key=lambda r: (r[0] is not None, r[0]))
    first, out = {}, {}
    for doc_id, text in order:
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (len(first), doc_id, k))
    for doc_id, text in order:
        for k, line in enumerate(text.split("\n")):
            if not line.strip():
                continue
            at = first[line]
            again = at[1:] != (doc_id, k)
            close = len(line) >= least and any(f < at and near(line, other) for other, f in first.items() if len(other) >= least)
            if again or close:
                out.setdefault(doc_id, []).append(k)
    return out


def dropped(df):
    return {r.doc_id: [d.number for d in r.dropped] for r in lines.dropped_lines(df).collect()}


def test_equals_brute_force(spark):
    rng, rows = random.Random(7), []
    for doc_id in range(40):
        text = []
        for _ in range(6):
            line = list(rng.choice(["the quick brown fox jumps", "añejo ñandú über straße 12", "aaaaaaaaaaaaaaaaaaaa", "x" * 15]))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "q", "é"])
            text.append("".join(line))
        rows.append((doc_id, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert dropped(df) == brute(rows)


def test_long_lines(spark):
    base = "".join(random.Random(1).choice("abcdef ") for _ in range(5000))
    rows = [(1, base), (2, base[:2500] + base[2501:]), (3, base[:4999] + "Z"), (4, "Y" + base), (5, base[:100] + "ZZ" + base[102:])]
    assert dropped(spark.createDataFrame(rows, "doc_id long, text string")) == {2: [0], 3: [0], 4: [0]}


def test_edges(edges, nothing):
    found = lines.with_dropped(edges)
    rows = found.select("document.doc_id", "document.text", "dropped", lines.without_lines(F.col("document.text"), F.col("dropped")).alias("left")).collect()
    assert len(rows) == edges.count()
    left = {r.doc_id: r.left for r in rows if r.doc_id is not None}
    # Equal rows under one id are judged alike.
    assert left[3] == "One line that is here twice.\nAnother line stays\n"
    # Document 4: one edit from a line of 3, an equal line, a blank one, and one edit again.
    assert left[4] == ""
    assert left[0] is None and left[1] == "" and left[2] == "short"
    assert left[6] is not None and left[7] == left[6] + "tail"
    assert lines.dropped_lines(nothing).count() == 0 and lines.with_dropped(nothing).count() == 0


def test_short_copies_go_and_blank_lines_stay(spark):
    rows = [(1, "a\na\n\n\nshort\n\u3000\n\t"), (2, "a\nshort\nshirt\n\u3000\n\x1c "), (3, "短い行\n短い行")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dropped(df) == {1: [1], 2: [0, 1], 3: [1]} == brute(rows)


def test_query(spark, tables):
    assert difference(lines.op10_line_dedup(spark, tables), tables, lines.OP10_SQL) is None
