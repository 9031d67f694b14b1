"""The registered queries of the training-data operators on the smallest tables, and the pipeline against a plain version of it."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedweave.llm import language_id, license_scan, minhash_dedup, ppm_score, registry, toxicity
from tests.llm.test_near_duplicates import expected_documents
from tests.llm.test_text_models import plain_scan, slow_ppm

SF = "/root/testdata/sf0.001"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def compared(spark, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compared(spark, name)


def test_op1_by_contract(spark, documents):
    rows = {r["doc_id"]: r for r in ppm_score.op1_ppm_score(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    words = {i: (d["text"] or "").encode().lower().split() for i, d in documents.items()}
    train = [i for i in documents if crc(i, 5) != 1]
    c = Counter(w for i in train for w in words[i])
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    for i, r in rows.items():
        assert r["held_out"] == (crc(i, 5) == 1) and r["train_tokens"] == n and r["n_tokens"] == len(words[i]) + 1
        assert r["n_known"] == sum(c[w] > 0 for w in words[i]) + 1
        assert r["base_score"] == pytest.approx(sum(log(c[w]) for w in words[i]) + log(ends))
    some = sorted(documents, key=lambda i: len(documents[i]["text"] or ""))[:25]
    want = slow_ppm([(documents[i]["text"] or "").encode() for i in train], [(documents[i]["text"] or "").encode() for i in some])
    assert [rows[i]["score"] for i in some] == pytest.approx(want, rel=1e-9)


def test_op1_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "a b"), (2, "zz")], "doc_id long, text string")
    rows = ppm_score.ppm_scores(df, F.coalesce(F.col("doc_id") == 1, F.lit(False))).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and {r["train_tokens"] for r in rows} == {10}


def test_op4_held_out_accuracy(spark, documents):
    """On documents whose labels weren't learned: toxic ones rank first (some are labelled so by chance alone), clean ones aren't predicted."""
    rows = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    assert all(r["held_out"] == (crc(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    larger = {r["doc_id"]: r["score"] for r in toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(larger[i], y) for i, y in marks.items() if crc(i, 3) == 1 and i in larger and y is not None]
    toxic, clean = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert toxic and clean and np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.85 and np.mean([s >= 0.7 for s in toxic]) > 0.7 and np.mean([s >= 0.7 for s in clean]) < 0.02


def test_op4_edge_rows(spark):
    docs = spark.createDataFrame([(None, "text"), (1, None), (1, None), (2, "word " * 200_000)], "doc_id long, text string")
    model = (toxicity.Lexicon({"word": 1.0}), 0.001, toxicity.PRIOR)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    carried = toxicity.score(docs.withColumn("score", F.lit("mine")), model, carry=True).select("row.*").collect()
    assert {r["score"] for r in carried} == {"mine"}


def test_op6_query_equals_plain_scan(spark, documents):
    rows = {r["doc_id"]: r for r in license_scan.op6_license_scan(spark, SF).collect()}
    for i, d in documents.items():
        want = plain_scan(d["text"])
        r = rows[i]
        assert (r["n_paragraphs"], r["n_candidates"], r["n_licences"], r["family"], r["confirmed"]) == (*want[:4], want[5]) and r["score"] == pytest.approx(want[4])


def test_op10_held_out_accuracy(spark, documents):
    rows = {r["doc_id"]: r for r in language_id.op10_language_id(spark, SF).collect()}
    assert rows.keys() == documents.keys() and all(r["held_out"] == (crc(i, 4) == 2) for i, r in rows.items())
    held = [i for i in documents if crc(i, 4) == 2 and documents[i]["lang"] and documents[i]["text"]]
    assert np.mean([rows[i]["lang_pred"] == documents[i]["lang"] for i in held]) >= 0.95


def test_pipeline_equals_plain_version(spark, documents):
    """Stage by stage on what the stage before kept: decisions by the operators' models row by row, near-duplicates by brute force, ids by the library."""
    from tokenizers import Tokenizer

    texts = {i: d["text"] for i, d in documents.items()}
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(df.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    kept = {}
    for i, text in texts.items():
        words = language_id.label_words(text, model)
        letters = {w: len(language_id.core(w.encode())) for w, _, _ in words}
        if words and sum(letters[w] for w, _, _ in words):
            p = model.marginals(model.emissions([language_id.core(w.encode()) for w, _, _ in words]), np.array([len(words)]))
            weight = np.array([letters[w] for w, _, _ in words], float)
            if (weight @ p / weight.sum()).max() >= corpus_pipeline.LEAST_SCORE:
                kept[i] = text
    first = corpus_pipeline.identify_language(spark, df, SF)
    assert first.columns == df.columns and {r["doc_id"] for r in first.select("doc_id").collect()} == kept.keys()

    lexicon, noise, w = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text in list(kept.items()):
        x = toxicity.design(toxicity.document_features([(text or "").encode()], lexicon), noise)[0]
        if 1 / (1 + math.exp(-(x @ w[:-1] + w[-1]))) >= 0.7:
            del kept[i]
    ids = sorted(kept)
    kept = {ids[i]: kept[ids[i]] for i, _, c in expected_documents([kept[i] for i in ids], 80) if i == c}

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == kept.keys()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = np.array(library.encode(kept[r["doc_id"]] or "", add_special_tokens=False).ids + [2], np.uint32)
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == len(own)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))  # the same pieces in each run


def test_pipeline_stages_on_edge_rows(spark):
    """Empty tables, null texts and ids, repeated rows and clashing columns pass every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, "the and of in that was for with", "en", "s", 1), (10**6, None, None, None, None), (10**6 + 1, "the and of in that was for with on this", "en", "s", 1), (10**6 + 1, "the and of in that was for with on this", "en", "s", 1)], base.schema)
    docs = base.limit(60).union(more).withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("predicted", F.lit("y"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r["score"] for r in rows} == {"x"} and sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 10**6 + 1 for r in rows) == 2
    assert not any(r["doc_id"] == 10**6 for r in rows)
    packed = corpus_pipeline.pack(spark, kept, SF)
    assert packed.where("doc_id is null").count() >= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF) if stage is corpus_pipeline.pack else stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        empty = docs.limit(0)


def test_revisits_with_headers_that_differ_in_case(spark):
    from feedweave.llm import warc_revisits

    rows = [(1, "http://a.org/x", 10, 200, {"ETag": "b", "etag": "a", "X": "1"}), (2, "http://a.org/x", 20, 304, {"etag": "a", "ETAG": "b"}), (2, "http://a.org/x", 20, 304, {"etag": "a"}), (None, "http://a.org/x", 30, 304, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    found = warc_revisits.resolve_revisits(df).collect()
    assert len(found) == 4 and sorted(r["outcome"] for r in found if r["record_id"] == 2) == ["resolved", "validator_mismatch"]


def test_shape_of_tables_grows_with_the_vectors():
    from feedweave.llm import embedding_dedup

    assert embedding_dedup.shape_for(50_000) == (18, 12)
    for n in (10**6, 10**9):
        tables, bits = embedding_dedup.shape_for(n)
        assert bits > 12 and (1 - embedding_dedup.agreement(0.98) ** bits) ** tables <= embedding_dedup.MISSES


def test_near_duplicates_default_is_the_contract(spark):
    assert minhash_dedup.bands_for(85) == 24
