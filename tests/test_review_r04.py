"""What the review of round 4 found: each case failed before."""

import random

from feedweave.operators import enrich
from feedweave.plans import catalog, context_queries  # noqa: F401


def documents(spark, folder, *rows):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return lambda name, column: {r["post_id"]: r[column] for r in catalog.QUERIES[name](spark, str(folder)).collect()}


def test_a_text_is_read_once_for_all_seeds(spark, monkeypatch):
    monkeypatch.setattr(enrich, "PART", 16, raising=False)  # texts come in parts
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.choice((0, 7, 8, 20, 90)))) for _ in range(40)]
    seeds = sorted({t[i : i + n] for t in texts for i in (0, 3) for n in (8, 9, 15, 31, 32) if i + n <= len(t)} | {"ab" * 4, "x" * 32, "é" * 33})
    found = enrich.containing(spark.createDataFrame(list(enumerate(texts)), "text_id long, t string"), spark.createDataFrame(list(enumerate(seeds)), "seed_id long, s string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, k) for i, t in enumerate(texts) for k, s in enumerate(seeds) if s in t and len(s) <= 32)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # a row for each place of a text before


def test_a_note_of_the_source_may_be_all_there_is(spark, tmp_path):
    found = documents(spark, tmp_path, (7, ""), (15, "Words."))
    assert found("authored_clean", "text") == {7: "", 15: "Words."}


def test_comments_are_shown_as_in_the_sql(spark, tmp_path):
    # the first holds no word of five letters, though five letters stand in a row without its spaces
    found = documents(spark, tmp_path, (7, "Resh 4238171331158001 a orat. By."), (1, "Abcde 1."))
    assert found("structured_context", "sharer_comment") == {7: "Resh 4238171331158001 a orat. By.", 1: ""}
