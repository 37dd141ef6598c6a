import hashlib
import shutil

import pytest

import corpus_pipeline
from echometer.llm import common
from tests.llm import test_decontaminate, test_jaccard, test_lines


def staged(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], sf_dir), name))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_brute_force(spark, tables):
    start, language, lines, groups, clean, tokens = staged(spark, common.documents(spark, tables), tables)
    assert all(df.columns == list(common.DOCUMENT_COLUMNS) for df in (language, lines, groups, clean))
    assert pairs(language) == pairs(start)  # every document of the table is in one of its languages

    lost, expected = test_lines.brute(pairs(language)), []
    for doc_id, text in pairs(language):
        kept = [line for k, line in enumerate(text.split("\n")) if k not in lost.get(doc_id, ())]
        if doc_id not in lost or "\n".join(kept).strip():
            expected.append((doc_id, "\n".join(kept)))
    assert pairs(lines) == expected

    component = test_jaccard.brute(expected)
    expected = [(i, t) for i, t in expected if component[i][1] == i]
    assert pairs(groups) == expected

    items = [(str(r.item_id), r.text) for r in common.table(spark, tables, "benchmark").collect()]
    expected = [(i, t) for i, t in expected if test_decontaminate.brute(t, items)[1] == 0]
    assert pairs(clean) == expected

    digests = {r.doc_id: r.decoded_sha256 for r in tokens.collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected}
    rows = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, tokens.collect()))


def test_copies_with_blank_lines_go(spark):
    text = "The first paragraph of a text.\n\nThe second paragraph of it.\n\t\n\u3000\nThe third and last paragraph.\n"
    rows = [(1, text), (2, text), (3, text + "new"), (4, "\n\n"), (5, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = pairs(corpus_pipeline.drop_repeated_lines(spark, docs, ""))
    # Blank lines are never dropped, so blank documents lose no line.
    assert left == [(1, text), (3, "\n\t\n\u3000\nnew"), (4, "\n\n"), (5, "\n\n")]


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, edges, nothing, tables, tmp_path, empty):
    shutil.copy(f"{tables}/benchmark.parquet", tmp_path / "benchmark.parquet")
    out = staged(spark, nothing if empty else edges, str(tmp_path))
    assert out[-1].count() == (0 if empty else out[-2].count())
    if not empty:
        ids = [r.doc_id for r in out[-1].collect()]
        # Without a letter, copied in whole, or nearly a copy: gone.
        assert not {0, 1, 8, 7} & set(ids) and {2, 3, 6} <= set(ids)
