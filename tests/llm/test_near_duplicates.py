"""Near-duplicate operators against brute force, with nulls, ties, copies, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedweave.llm import embedding_dedup, minhash_dedup, topk_search
from feedweave.llm.components import connected_components


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3), (70, 71), (71, 72), (70, 72)]
    found = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {k: v for k, v in found.items() if k <= 40} == {i: 0 for i in range(41)}
    assert found[51] == 50 and found[72] == 70 and 60 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    return (text or "").encode().lower().split()


def expected_documents(texts, percent=85):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, union_find(len(sets), links)))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(120)] for _ in range(6)]
    texts = [None, "", " \t ", "Two words", "two  WORDS", "a\x1fb c", "ä Ö"]
    for b in bases:
        texts.append(" ".join(b))
        for _ in range(rng.randint(2, 14)):
            v = list(b)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    # copies of copies: links that only a chain makes, and a passage that many share
    v = list(bases[0])
    for _ in range(12):
        v[rng.randrange(len(v))] = word()
        texts.append(" ".join(v))
    texts += [" ".join([word() for _ in range(60)] + bases[1][:60]) for _ in range(20)]
    texts += [texts[8]] * 30
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(t, "x", i, i) for i, t in enumerate(texts)], "text string, rep string, n long, doc_id long")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert found == expected_documents(texts)


def test_pipeline_stage_drops_near_copies_at_80(spark):
    """Copies with a Jaccard similarity of 0.80 to 0.85 go in the pipeline's stage, which equals brute force at 0.8; op8 keeps them."""
    base = [f"w{i}" for i in range(204)]  # 200 shingles
    near, far = list(base), list(base)
    for i in (20, 60, 100, 140):
        near[i] = "x"  # 180 shared of 220
    for i in (20, 60, 100, 140, 180):
        far[i] = "y"  # 175 shared of 225
    texts = [" ".join(w) for w in (base, near, far)] + corpus(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == [i for i, _, c in expected_documents(texts, 80) if i == c] and kept[:2] == [0, 2]
    at85 = {r["doc_id"] for r in minhash_dedup.near_duplicates(df, percent=85).where("kept").collect()}
    assert {0, 1, 2} <= at85


@pytest.mark.parametrize("percent, bands", [(85, 24), (80, 35)])
def test_bands_miss_a_pair_at_the_limit_once_in_a_million(percent, bands):
    assert minhash_dedup.bands_for(percent) == bands
    assert (1 - (percent / 100) ** minhash_dedup.ROWS) ** bands <= 1e-6


def test_documents_empty_and_null_ids(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in rows) == [("5", 5, True), ("5", 5, True), ("None", None, True)]


def test_tiles_confirm_what_hubs_leave_open(spark):
    """Two families that share each bucket with a stranger still link within themselves."""
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = []
    for k in range(40):  # copies of one base, far enough from each other that hubs alone can't link all
        v = list(base)
        for i in rng.sample(range(300), 4):
            v[i] = f"x{k}{i}"
        texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert found == expected_documents(texts)


def test_common_agrees_with_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.int64)) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, y = np.triu_indices(30, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(x, y)]
    assert minhash_dedup.common(np.concatenate(sets), at, x, y).tolist() == want
    assert minhash_dedup.common(np.concatenate(sets), at, x[:5], y[:5]).tolist() == want[:5]


def vectors(seed, n=200, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 and rows and rows[i - 1][1] is not None:
            v = np.array(rows[i - 1][1], np.float32) + rng.normal(0, rng.choice([0.0, 0.03, 0.3]), dim).astype(np.float32)
            label = rows[i - 1][2]
        else:
            v, label = rng.normal(0, 1, dim).astype(np.float32), int(rng.integers(0, 2))
        rows.append((i, [float(x) for x in v], label))
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * dim, 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("inf")] + [0.0] * (dim - 1), 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1], rows[0][2]), (n + 7, rows[0][1][:4], rows[0][2]), (n + 8, [None] + rows[0][1][1:], rows[0][2])]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vectors(1)
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep int")
    ok = [b is not None and len(b) > 0 and c is not None and all(x is not None and np.isfinite(x) for x in b) and any(b) for _, b, c in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links.append((i, j))
    comp = union_find(len(rows), links)
    want = [(i, sum(i in x for x in links), comp[i]) for i in range(len(rows))]
    assert len(links) > 50
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert found == want
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_doubles_keep_their_precision_and_range(spark):
    """Large doubles link as their cosines say; two vectors that floats would tell apart from nothing don't become copies."""
    far = [1e200, 1e200, 0.0]
    rows = [(1, far, 1), (2, [x * 1.001 for x in far], 1), (3, [1e-200, 1e-200, 0.0], 1), (4, [0.0, 0.0, 1e300], 1), (5, [1.0, 1.0, 1e-60], 1), (6, [0.0, 0.0, 1e-60], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (1, 4), 5: (3, 1), 6: (1, 4)}


def test_vectors_in_several_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 8)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.01, 8)], 1) for i in range(1300)]
    found = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    u = m / np.sqrt((m * m).sum(1))[:, None]
    want = (u @ u.T >= 0.98).sum() - len(rows)
    assert found.agg(F.sum("n_links")).first()[0] == want
    assert {r[0] for r in found.select("component_id").distinct().collect()} == {0}


def test_top_k_equals_brute_force(spark):
    rows = vectors(2, 400, 12)
    df = spark.createDataFrame([(a, b, 1, "z") for a, b, _ in rows], "vec_id long, embedding array<float>, score int, cb string")
    ok = [(a, np.floor(np.array(b, np.float32).astype(float) * 256).astype(int)) for a, b, _ in rows if b and all(x is not None and np.isfinite(x) for x in b)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for c, w in ok if c != q and len(w) == len(v))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk_search.top_k(df).collect())) == sorted(want)
    assert topk_search.top_k(df.limit(0)).count() == 0
    again = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (51, [1.0]), (51, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(again).collect())) == sorted([(50, 1, 50, 131072), (50, 1, 50, 131072), (50, 2, 51, 65536), (50, 3, 51, 65536), (50, 2, 51, 131072), (50, 3, 51, 131072)])
    few = spark.createDataFrame([(50, [1.0]), (51, [1.0]), (52, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(few).collect())) == [(50, 1, 51, 65536), (50, 2, 52, 65536)]


def test_index_stops_early_and_keeps_ties():
    rng = np.random.default_rng(3)
    v = rng.integers(-60, 60, (3000, 32))
    v[100:140] = v[7]
    index = topk_search.BlockIndex(v)
    queries, skip = v[:40], [slice(k, k + 1) for k in range(40)]
    for q, own, (rows, scores) in zip(queries, skip, index.search(queries, 5, skip)):
        want = v @ q
        kept = np.delete(np.arange(len(v)), own)
        least = np.sort(want[kept])[-5]
        assert sorted(rows.tolist()) == kept[want[kept] >= least].tolist() and (want[rows] == scores).all()
    filled = int((index.size > 0).sum())
    processed = [index.best(q, 5, own)[2] for q, own in zip(queries, skip)]
    assert min(processed) > 0 and max(processed) < filled and np.mean(processed) < 0.9 * filled  # stops before the last segment, on proof alone
    known = [index.best(q, 5, own, bar=float(np.sort(np.delete(v @ q, own))[-5])) for q, own in zip(queries, skip)]
    assert np.mean([x[2] for x in known]) <= np.mean(processed)  # a bar known from other blocks stops earlier
    gain, d, level, _ = index.plan(queries[0])
    assert (np.diff(gain[d, level]) <= 0).all()  # descending impact
    huge = topk_search.BlockIndex(v * (1 << 20))
    assert all(sorted(x.tolist()) == sorted(y.tolist()) for (x, _), (y, _) in zip(huge.search(queries, 5, skip), index.search(queries, 5, skip)))


def test_screen_never_drops_a_link():
    """Sets of all sizes at the very threshold pass the sketch screen."""
    rng = np.random.default_rng(9)
    for n in (10, 100, 550, 1000, 1100, 5000, 20000):
        for nested in (True, False):
            for _ in range(10):
                common_ = int(np.ceil(0.85 * n)) if nested else n
                extra = n - common_ if nested else int(0.15 / 0.85 * n)
                pool = np.unique(rng.integers(0, 2**63, 3 * n + 20, np.uint64))
                rng.shuffle(pool)
                a = np.sort(pool[: common_ + (extra if nested else extra // 2)])
                b = np.sort(np.concatenate([pool[:common_], pool[2 * n : 2 * n + (0 if nested else extra - extra // 2)]]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 85 * (len(a) + len(b) - both):
                    continue
                bits = np.bitwise_count((minhash_dedup.odd_sketch(a) ^ minhash_dedup.odd_sketch(b)).view(np.uint64)).sum()
                small = max(len(a), len(b)) <= minhash_dedup.SAMPLE
                assert bits <= ((len(a) + len(b)) * 15 // 185 if small else minhash_dedup.most_long(85))
