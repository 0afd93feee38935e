"""The pipeline's stages, one after the other, against plain versions."""

import random

import corpus_pipeline
from loomline.llm import langid, queries

from . import plain


def test_stages_and_run(spark, tmp_path):
    r = random.Random(8)
    parts = {"en": "the of and th ing er on at".split(), "de": "der die und ung sch ein ver ge".split()}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4)))
    rows = []
    for k in range(120):
        lang = r.choice(["en", "de"])
        rows.append((k, " ".join(word(lang) for _ in range(r.randint(8, 90))), lang, f"s{k % 4}", 1))
    for k in range(120, 160):
        text = rows[r.randrange(100)][1].split(" ")
        if k % 2 and len(text) > 60:
            text[3] = "changed"
        rows.append((k, ("  " if k % 3 else " ").join(text), "en", "s1", 1))
    rows += [(200, None, "en", "s0", None), (201, "12 34", None, None, 3), (202, "", "de", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    columns, seen, numbers = docs.columns, {}, []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        step(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        numbers.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert numbers[0] == len(rows) - 3
    pairs = lambda name: [(x.doc_id, x.text) for x in seen[name]]
    assert {x.doc_id for x in seen["exact_dedup"]} == {x[0] for x in plain.exact(pairs("language_id")) if x[3]}
    assert {x.doc_id for x in seen["near_dedup"]} == {x[0] for x in plain.near(pairs("exact_dedup")) if x[3]}
    assert {x.doc_id for x in seen["mixing"]} <= {x.doc_id for x in seen["near_dedup"]}
    size = lambda name: sum(len(x.text.split()) for x in seen[name])
    assert abs(size("mixing") - size("near_dedup")) < 4 * 90
    assert sorted(x.doc_id for x in seen["mixing"]) == sorted(x.doc_id for x in seen["sentencepiece"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen["sentencepiece"]))
    empty = queries.table(spark, str(tmp_path), "documents").limit(0)
    assert [step(spark, empty, str(tmp_path)).count() for _, step in corpus_pipeline.STAGES] == [0] * 5


def test_mixed_languages_stay(spark):
    """A text in three languages, none of which has half of its letters."""
    r = random.Random(5)
    parts = {"en": "the of and th ing er on at".split(), "de": "der die und ung sch ein ver ge".split(), "fr": "que les ou eau oi aux ette qui".split()}
    words = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(k, words(lang, 60), lang, "s", 1) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, " ".join((words("en", 45), words("de", 30), words("fr", 30))), None, "s", 1), (501, "12 34", None, "s", 1), (502, None, "en", "s", 1), (503, "", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.predict(docs.where("doc_id = 500"), langid.fit(docs)).first()
    assert found.lang_pred == "en" and found.score < 0.5
    assert sorted(x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()) == [*range(120), 500]
