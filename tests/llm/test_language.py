import numpy as np
import base64
import random
import string

import pytest

from echometer.llm import language

LANGS = {"en": "the cat and the dog were there with thin thread ", "fr": "le chien est à côté de la forêt élevée ", "xx": "zzk qqj wwx "}


def trained(spark, rows=300):
    docs = [(i, lang, LANGS[lang] * (1 + i % 5), "z") for i in range(rows) for lang in [list(LANGS)[i % 3]]]
    return language.fit(language.training_sample(spark.createDataFrame(docs, "doc_id long, lang string, text string, score string")))


def test_predicts_and_rejects(spark):
    model = trained(spark)
    rows = [(0, "the thread and the dog"), (1, "la forêt"), (2, "東京都 東京都"), (3, None), (4, "12 ... \n"), (5, ""), (6, "ÉLEVÉE FORÊT")]
    out = {r.document.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[k].lang_pred for k in (0, 1, 6)] == ["en", "fr", "fr"]
    assert [out[k].rejected for k in range(7)] == [False, False, True, True, True, True, False]
    assert [out[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in out.values()) and out[2].lang_pred in LANGS


def test_sample_is_bounded_and_never_held_out(spark, edges, nothing):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, lang string")
    sample = language.training_sample(docs, rows=100).collect()
    assert 60 <= len(sample) <= 100
    held = {r.doc_id for r in docs.filter(language.held_out(docs.doc_id)).collect()}
    assert not held & {int(r.text.split()[1]) for r in sample}
    assert language.training_sample(edges).count() <= 9
    assert language.fit(language.training_sample(nothing)).languages == ()


def test_edges(spark, edges, nothing):
    model = trained(spark)
    rows = language.predict(edges, model).collect()
    assert len(rows) == edges.count() and all(r.document["score"] == "score" for r in rows)
    assert language.predict(nothing, model).count() == 0
    empty = language.fit(language.training_sample(nothing))
    assert {r.lang_pred for r in language.predict(edges, empty).collect()} == {"und"}


def test_query_on_held_out_rows(spark, tables):
    rows = language.op8_language_id(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang")
    held = rows.filter("held_out").join(docs, "doc_id").collect()
    assert rows.count() == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert not any(r.rejected for r in held)


ITALIAN = (
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza "
    "e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e "
    "tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di "
    "colore, di sesso, di lingua, di religione, di opinione politica o di altro genere."
)
FINNISH = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
    "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä "
    "julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin tai sukupuoleen perustuvaa erotusta."
)


def test_rejects_noise_and_other_languages_of_the_script(spark, tables):
    docs = spark.read.parquet(f"{tables.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang", "text")
    model = language.fit(language.training_sample(docs))
    rng = random.Random(5)
    bad = [ITALIAN, FINNISH, rng.randbytes(400).hex()]
    bad += ["".join(rng.choice(string.ascii_lowercase + " ") for _ in range(n)) for n in (200, 400, 4000)]
    bad += [base64.b64encode(rng.randbytes(n)).decode() for n in (200, 400, 4000)]
    rows = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    kept = [(r.document.text[:30], r.score) for r in language.predict(rows, model).filter("NOT rejected").collect()]
    assert not kept
    held = language.predict(docs.filter(language.held_out(docs.doc_id)), model).collect()
    assert len(held) > 200 and sum(r.rejected for r in held) <= 0.01 * len(held)


@pytest.mark.parametrize("rows", [[], [("a", [])], [("a", [0.5] * 3)] * 7])
def test_few_rows_bound_nothing(rows):
    model = language.Model(None, None, ("a",) if rows else ())
    assert not language._bounds(model, rows).any()


def test_a_matrix_holds_one_language_only(spark, monkeypatch):
    shapes, centroids = [], language._centroids
    monkeypatch.setattr(language, "_centroids", lambda rows, k: shapes.append(len(rows)) or centroids(rows, k))
    docs = spark.range(8000).selectExpr("id doc_id", "concat('text ', id) text", "concat('l', id % 4) lang")
    sample = language.training_sample(docs)
    assert sample.count() == 2000
    assert language.fit(sample).languages == tuple(f"l{k // 3}" for k in range(12)) and shapes == [500] * 4


def test_fit_without_arrow(spark, tables):
    """The model must not depend on session settings: toPandas without Arrow gives lists."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        model = language.fit(language.training_sample(docs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert len(model.languages) > 0


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 20])
def test_gram_parts_are_the_grams(chunk):
    rng = random.Random(chunk)
    for size in (0, 1, 2, 3, 5, 50, 1000):
        text = "".join(rng.choice("ab cdé  \nXY1東") for _ in range(size))
        whole = language.grams(text)
        parts = list(language.gram_parts(text, chunk))
        assert np.array_equal(np.concatenate([np.empty(0, np.int64), *parts]), whole)
        counts, total = language.gram_counts(text)
        assert total == len(whole) and np.array_equal(counts, np.bincount(whole, minlength=language.DIMENSIONS))
