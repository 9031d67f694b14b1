"""Token counts, centroid clustering and ranked lexical search against brute force, on edge cases and with limits set low."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedweave.llm import centroid_clusters, lexical_search, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n", "It's 3.14... ÄÖ ß İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "x\x1cy\x85z\xa0w é ́", "l'été d'll I'LL 'S 123abc", "</w> a</w>",
    "日本語 テキスト ﷺ ﬁ", "🙂🙂 👨‍👩‍👧", "a" * 5000, "1" * 3000, "!" * 3000, "<|endoftext|><|endoftext|>", "|<|endoftext|", "\x00a\x00", "ſ K Å ﻿abc", "word " * 3000,
]


# Token counts ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_tokens_are_proven(model):
    whole = token_counts.whole_tokens(model)
    some = random.Random(1).sample([s for s in whole if s.isascii() and s.isalpha()], 500)
    assert len(whole) > 10_000 and all(len(model.encode(s, add_special_tokens=False).ids) == 1 for s in some)
    # merges that make a shorter token first leave this string in two
    merges = [("b", "c</w>"), ("a", "b"), ("ab", "c</w>")]
    from tokenizers import models

    small = Tokenizer(models.BPE({"a": 0, "b": 1, "c</w>": 2, "bc</w>": 3, "ab": 4, "abc</w>": 5}, merges, end_of_word_suffix="</w>"))
    assert token_counts.whole_tokens(small) == ["bc", "c"]


def test_counts_equal_library(spark, model):
    texts = [*ODD, *ODD[:4]]
    df = spark.createDataFrame([(None if i == 7 else i % len(ODD), t, -1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, whole string")
    rows = token_counts.count_tokens(df).collect()
    want = [(None if i == 7 else i % len(ODD), len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in enumerate(texts)]
    assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted(want, key=str)
    assert all(r["n_whole"] <= r["n_pre_tokens"] <= r["n_tokens"] for r in rows)
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_op11_equals_library(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in token_counts.op11_token_counts(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        n = len(model.encode(t, add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len(t.encode()), n, n > 2048)
    assert sum(r["n_whole"] for r in rows.values()) > 0


# Centroid clustering -----------------------------------------------------------------------------------------------------


def plain_clusters(vectors, k=8, rounds=10, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(q) for _, q in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda q: min((apart(q, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last]


def clustered(spark, vectors, extra=(), **more):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in [*vectors, *extra]], "vec_id long, embedding array<float>, distance int, cluster string")
    rows = centroid_clusters.clusters(df, **more).collect()
    return rows, sorted((tuple(r)[:6] for r in rows), key=str)


def test_clusters_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64)) * 3
    v = (centres[rng.integers(0, 5, 150)] + rng.normal(size=(150, 64)) * 0.05).astype(np.float32)
    vectors = [(i if i != 20 else None, x.tolist()) for i, x in enumerate(v)]
    vectors += [(200 + i, vectors[3][1]) for i in range(60)] + [(5, vectors[9][1]), (5, vectors[9][1])]  # copies, repeated ids
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] * 64), (905, [math.inf] + [0.0] * 63), (906, [1e30] * 64)]
    rows, found = clustered(spark, vectors, bad)
    assert found == sorted(plain_clusters(vectors), key=str)
    assert np.mean([r["n_verified"] for r in rows]) < 5


def test_clusters_ties_few_rows_and_empty(spark):
    few = [(1, [0.0] * 64), (2, [2.0] + [0.0] * 63), (3, [1.0] + [0.0] * 63)]
    assert clustered(spark, few)[1] == sorted(plain_clusters(few), key=str)
    for k in (1, 2):  # the third lies in the middle
        assert clustered(spark, few, k=k)[1] == sorted(plain_clusters(few, k), key=str)
    same = [(i, [0.25] * 64) for i in range(30)]
    assert clustered(spark, same)[1] == sorted(plain_clusters(same), key=str)
    assert clustered(spark, [], [(1, None)])[0] == []


def test_assign_equals_brute_force():
    rng = np.random.default_rng(2)
    for explained in (0.1, 0.6, 1.0):
        q = rng.integers(-3, 4, (500, 6))
        c = rng.integers(-3, 4, (9, 6))
        rotation = centroid_clusters.Rotation.of_moments(len(q), q.sum(axis=0).astype(float), (q.T @ q).astype(float), explained)
        d = ((q[:, None] - c) ** 2).sum(axis=2)
        cluster, distance, tried = centroid_clusters.assign(q, *rotation(q), c, rotation)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all() and (tried <= 9).all()


# Ranked lexical search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranking(docs, items, best=50):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // terms
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return out


def ranking(spark, docs, items, best=50):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, n string")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical_search.top_documents(d, q, best).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n):
    words = ["Alpha", "beta", "GAMMA", "delta", "ÄÖ", "äö", "x1", "42", "naïve", "日本", *(f"w{i}" for i in range(80))]
    text = lambda k: rng.choice(" ,.-_\x00\n").join(rng.choice(words[: rng.choice((12, 40, 90))]) for _ in range(k))
    return text, [(i, text(rng.randint(0, 40))) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"ITEMS": 3, "TERMS": 12, "CELLS": 200, "LEAF": 2, "FAN": 2}])
def test_ranking_equals_plain_version(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(8)
    text, docs = corpus(rng, 260)
    docs += [(300, None), (301, ""), (302, " .,"), (None, docs[5][1]), (None, "w1 w2 w3"), (7, docs[5][1]), (7, docs[5][1])]
    docs += [(400 + i, docs[9][1]) for i in range(130)] + [(900, "w1 " * 5000)]  # a third are copies, one is very long
    items = [(i, text(rng.randint(1, 9))) for i in range(9)] + [(20, None), (21, ""), (22, "absent nowhere"), (None, "alpha w1"), (3, "beta"), (3, "beta"), (23, text(60))]
    for best in (5, 50):
        assert ranking(spark, docs, items, best) == sorted(plain_ranking(docs, items, best), key=str)


def test_ranking_of_empty_tables(spark):
    assert ranking(spark, [], [(1, "a")]) == [] and ranking(spark, [(1, "a")], []) == [] and ranking(spark, [(1, None)], [(1, "a")]) == []
    assert ranking(spark, [(1, "a")], [(1, "a")]) == plain_ranking([(1, "a")], [(1, "a")])


def test_node_pairs_prune_whole_batches(monkeypatch):
    rng = np.random.default_rng(3)
    topics, terms, n = 8, 160, 2048
    docs = [np.unique(rng.integers(0, 20, 6) + 20 * (i % topics)) for i in range(n)]
    sizes = np.array([len(d) for d in docs])
    postings = lexical_search.Postings(np.arange(n), sizes, np.concatenate(docs), rng.integers(1, 900_000, sizes.sum()))
    codes = [np.unique(rng.integers(0, 20, 5) + 20 * (i % topics)) for i in range(40)]
    items = lexical_search.Items(list(range(40)), codes, rng.integers(1, 9000, terms), 5, {})
    scored, pairs = 0, 0
    for at in range(0, n, 256):
        own = lexical_search.search(items, postings.take(np.arange(at, at + 256)))
        scored, pairs = scored + own[0], pairs + own[1]
    assert pairs == 40 * n and scored < pairs / 8
    for k, row in enumerate(items.rows.tolist()):
        scores = postings.scores(np.arange(n), items.weights[k])
        want = np.lexsort((np.arange(n), -scores))[:5]
        assert items.held[k][0].tolist() == want.tolist() and items.held[k][1].tolist() == scores[want].tolist()
        assert set(np.flatnonzero(items.weights[k])) == set(codes[row])
