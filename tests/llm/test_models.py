"""Language and toxicity models: held-out accuracy on the given tables, odd rows, empty tables."""

import pytest

from tallyfield.llm import language_id, toxicity
from tallyfield.llm.catalog import op2_toxicity, op7_language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, 5), (2, "", "en", 5), (3, "12 34 !!", "en", 5), (4, "é", None, 5), (4, "é", None, 5), (None, "the thing was here", "en", 5), (6, "word " * 200_000, "fr", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r.doc_id, r.lang_pred == "und", r.score > 0) for r in language_id.predict_languages(odd, model).collect()}
    assert {(1, True, False), (2, True, False), (3, True, False), (4, False, True), (None, False, True), (6, False, True)} == got
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 6]
    assert {r.lang_pred for r in language_id.predict_languages(odd, None).collect()} == {"und"}
    assert language_id.train(odd.limit(0)) is None
    assert language_id.predict_languages(odd.limit(0), model).count() == 0


def test_repeated_rows_are_learnt_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300).cache()
    again = docs.unionByName(docs.where("doc_id % 7 = 1").limit(1).crossJoin(spark.range(1000)).select(docs.columns))
    models = [language_id.train(d.withColumn("doc_id", d.doc_id.cast("int")), per_lang=20) for d in (docs, again)]
    assert models[0].languages == models[1].languages and all(m.weights.shape[0] == language_id.DIMS for m in models)


@pytest.fixture
def learnt(monkeypatch):
    """The languages of the rows that a model is fitted to."""
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda features, labels: seen.append(list(labels)))
    return seen


@pytest.mark.parametrize("single", [3, 17, 1_000_005])
def test_a_language_of_one_document_in_many_rows_is_learnt(spark, learnt, single):
    docs = spark.range(30_000 - 59).selectExpr(f"{single}L AS doc_id", "'hola que tal' AS text", "'es' AS lang")
    docs = docs.unionByName(spark.range(59).selectExpr("id * 1000 + 100 AS doc_id", "concat('the thing ', id) AS text", "'en' AS lang"))
    language_id.train(docs)
    assert set(learnt[0]) == {"en", "es"} and learnt[0].count("es") == 1


def test_repeated_documents_leave_room_for_others(spark, learnt):
    docs = spark.range(400_000).selectExpr("id % 2000 AS doc_id", "concat('le mot ', id % 2000) AS text", "'fr' AS lang")
    language_id.train(docs)
    assert learnt[0] == ["fr"] * language_id.PER_LANG


def test_codewords_stay_apart():
    codes = language_id.codewords(20, 15)
    assert min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= 3


@pytest.mark.parametrize("per_lang", [1, 2])
def test_all_of_many_languages_are_learnt(spark, per_lang):
    names = [f"l{k:02}" for k in range(80)]
    rows = [(k * 8 + i, chr(0x4E00 + 100 * k) * 4, name) for k, name in enumerate(names) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, per_lang=per_lang)
    assert model.languages == names
    got = language_id.predict_languages(docs, model).join(docs, "doc_id").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


@pytest.mark.parametrize(("sf", "recall", "precision", "auc"), [("0.01", 0.75, 0.75, 0.9), ("0.1", 0.9, 0.85, 0.95)])
def test_toxicity_on_held_out_documents(spark, sf, recall, precision, auc):
    folder = f"/root/testdata/sf{sf}"
    rows = op2_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    caught = [r.toxic for r in rows if r.predicted]
    assert above > auc and sum(caught) / len(toxic) >= recall and sum(caught) / len(caught) >= precision


def test_toxicity_of_ten_toxic_documents():
    plain = ["bakola", "demiru", "fongat", "hujelo", "kipsan", "lortev", "muzwin", "qebdra", "sylphex", "vornack"]
    toxic = ["idiotic", "clownish", "vermin", "stupid", "moronic", "scum", "filthy", "pathetic", "loser", "garbage"]
    clean_text = lambda k: " ".join(plain[(k * 7 + i * (k % 3 + 1)) % 10] for i in range(20))
    said = lambda k: " ".join(toxic[(k + i) % 10] for i in (0, 3, 7))
    texts = [clean_text(k) for k in range(58)] + [f"{clean_text(k)} {said(k)}" for k in range(10)]
    model = toxicity.fit(zip(texts, [0] * 58 + [1] * 10, strict=True))
    assert min(model.scores([f"{clean_text(k)} {said(k)}" for k in range(100, 110)])) > 0.5 > max(model.scores([clean_text(k) for k in range(100, 160)]))


def test_toxicity_learns_repeated_rows_once_and_within_bounds(spark):
    rows = [(k, f"{'vile' if k % 2 else 'kind'} {'xyz'[k % 3]}aa") for k in range(40)]
    docs = spark.createDataFrame(rows + [rows[2]] * 300 + [(98, "kind " * 9000), (99, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(98, 1), (99, 1)], "doc_id int, toxic int")
    once = docs.dropDuplicates()
    a, b = toxicity.train(docs, labels, max_chars=2000), toxicity.train(once, labels, max_chars=2000)
    assert (a.direction == b.direction).all() and a.scores(["vile"])[0] > 0.5 > a.scores(["kind"])[0]


def test_toxicity_of_odd_rows(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows) and all(r.score < 0.5 for r in rows if r.doc_id in (1, 2, 3))
    assert min(model.scores(["what an idiottt", "you stupiid clownn"])) > 0.5 > max(model.scores([None, "", "of the thing"]))
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
