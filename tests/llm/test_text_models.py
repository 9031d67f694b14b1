"""Text operators: scores, packing, pieces, licences, languages, toxicity, revisits."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedweave.llm import language_id, license_scan, packing, piece_encoding, ppm_score, toxicity, warc_revisits

SF = "/root/testdata/sf0.001"


# Language-model scores ---------------------------------------------------------------------------------------------------


def slow_ppm(train, texts, order=ppm_score.ORDER):
    """Partial matching with method D and exclusion, symbol by symbol."""
    count = defaultdict(Counter)
    for t in train:
        raw = bytes([10]) * order + ppm_score.document_bytes(t)
        for p in range(order, len(raw)):
            for k in range(order + 1):
                count[raw[p - k : p]][raw[p]] += 1
    out = []
    for t in texts:
        raw, total = bytes([10]) * order + ppm_score.document_bytes(t), 0.0
        for p in range(order, len(raw)):
            off = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in count.get(raw[p - k : p], {}).items() if s not in off}
                n = sum(seen.values())
                if raw[p] in seen:
                    total += math.log10((seen[raw[p]] - 0.5) / n)
                    break
                if seen:
                    total += math.log10(len(seen) / (2 * n))
                off |= set(seen)
            else:
                total -= math.log10(256 - len(off))
        out.append(total)
    return out


def test_ppm_equals_slow_version(spark):
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "mats", "Öl", "x1", "THE"]
    texts = [None, "", " \t\n", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)), "zz qq unseen bytes ~~", "word " * 500]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    found = {r["doc_id"]: r for r in ppm_score.ppm_scores(df, F.col("doc_id") % 3 != 0).collect()}
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if i % 3]
    want = slow_ppm(train, raw)
    c = Counter(w for t in train for w in t.lower().split())
    c["<end>"] = len(train)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(raw):
        tokens = [*t.lower().split(), "<end>"]
        assert found[i]["score"] == pytest.approx(want[i], rel=1e-5)
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)


def test_ppm_without_training_and_empty(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = ppm_score.ppm_scores(df, F.lit(False)).first()
    assert row["score"] == pytest.approx(-4 * math.log10(256)) and row["train_tokens"] == 0
    assert ppm_score.ppm_scores(df.limit(0), F.lit(True)).count() == 0


# Packing -----------------------------------------------------------------------------------------------------------------


def test_best_cuts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        pos = np.array(sorted({0, *(rng.randrange(1, 60) for _ in range(rng.randint(1, 14)))}))
        length = 16
        pos = np.unique(np.concatenate([pos, np.arange(0, pos[-1], 15)]))
        penalty = np.array([rng.choice([0, 3, 9]) for _ in pos], float)
        cost = [0.0] + [math.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = int(pos[j] - pos[i])
                if n <= length:
                    cost[j] = min(cost[j], cost[i] + (0 if n & (n - 1) == 0 else length - n) + penalty[j] + packing.NEW_SEQUENCE)
        chain = packing.best_cuts(pos, penalty, length)
        got = sum((0 if n & (n - 1) == 0 else length - n) + penalty[j] + packing.NEW_SEQUENCE for i, j in zip(chain, chain[1:]) for n in [int(pos[j] - pos[i])])
        assert chain[0] == 0 and chain[-1] == len(pos) - 1 and got == cost[-1]
        assert all(pos[j] - pos[i] <= length for i, j in zip(chain, chain[1:]))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "It's 3.14... ÄÖ ß İstanbul", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w é ́", "no end " * 6000, *(f"Sentence {i}. " * (i % 90) for i in range(300))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    ids = [np.array(model.encode(t or "", add_special_tokens=False).ids + [2], np.uint32) for t in texts]
    rows = packing.pack(df).collect()
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(at[i] == len(own) for i, own in enumerate(ids))
    padding = total = 0
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 4096
        total += end
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding < 0.05 * total
    assert packing.pack(df.limit(0)).count() == 0


# Pieces ------------------------------------------------------------------------------------------------------------------


def slow_segmentation(pieces, text):
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            if best[start] is None:
                continue
            s, i = pieces.score.get(text[start:end], (None, -1))
            if s is None and end - start == 1:
                s = pieces.unknown
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                own = [i] if i >= 0 else [pieces.bytes[b] for b in text[start:end].encode()]
                best[end] = best[start][0] + s, best[start][1] + own
    return best[-1]


def test_streaming_viterbi(spark):
    pieces = piece_encoding._loaded(None)
    score = {i: s for s, i in pieces.score.values()}
    rng = random.Random(1)
    for text in ["Hello world", "a", "  two  spaces ", "naïve\ncafé 日本語 😀", "x" * 300, "".join(rng.choice("abcdeé \n") for _ in range(400))]:
        whole = piece_encoding.SPACE + text.replace(" ", piece_encoding.SPACE)
        want = slow_segmentation(pieces, whole)
        cost = lambda ids: sum(score.get(i, 0.0) for i in ids)
        commits = pieces.stream(whole)
        streamed = [i for c in commits for i in c]
        assert cost(streamed) == pytest.approx(cost(want[1])) and cost(pieces.encode(text)) == pytest.approx(cost(want[1]))
        assert pieces.decode(streamed) == text and pieces.decode(pieces.encode(text)) == text
    assert len(pieces.stream("▁the▁cat▁sat")) > 1


def test_pieces_agree_with_the_library():
    """The vocabulary read as a unigram model by the library itself gives segmentations of the same score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = piece_encoding._loaded(None)
    for text in ("The quick brown fox", "streaming windows commit ids", "Der Hund schläft"):
        cost = lambda ids: sum(library.get_score(i) for i in ids)
        assert cost(pieces.encode(text)) == pytest.approx(cost(library.encode(text)))


def test_encode_and_decode_frames(spark):
    texts = [None, "", "plain text", "mark ▁ inside", "tabs\tand\nlines  ", "long " * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    found = piece_encoding.encode(df)
    assert {r["doc_id"]: r["exact"] for r in found.select("doc_id", "exact").collect()} == {i: "▁" not in (t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in piece_encoding.decode(found).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    assert piece_encoding.encode(df.limit(0)).count() == 0


# Licences ----------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    texts = [
        None, "", "\n \n", "prose only", "Intro\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "all rights reserved.", "The driver lost a licence after the hearing.", "licensed under the apache license version 2.0 today", "x\n" * 3000 + "Released under the MIT License.",
    ]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, family string, pos int")
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [rows[i]["family"] for i in range(13)] == ["none"] * 4 + ["mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0", "unknown", "none", "apache-2.0", "mit", "mit"]
    assert all(rows[i]["confirmed"] for i in (4, 5, 6, 7, 11)) and not rows[8]["confirmed"]
    assert rows[0]["n_paragraphs"] == 0 and rows[4]["n_paragraphs"] == 3 and rows[4]["n_licences"] == 1
    assert license_scan.scan(df.limit(0)).count() == 0
    sample = "Released under the MIT License, v2.0. CC-BY!"
    assert spark.range(1).select(license_scan.words_column(F.lit(sample))).first()[0] == license_scan.words(sample)


def plain_scan(text):
    """The scan of one text, step by step."""
    import re

    (classes, weights, bias), least, marks = license_scan.trained()
    joined = re.sub(license_scan.WRAPPED.replace("(?md)", "(?m)"), r"\1 ", text or "")
    parts = [p for p in joined.split("\n") if p.strip(" ")]
    found, candidates = [], 0
    for pos, p in enumerate(parts):
        own = license_scan.words(p)
        if not license_scan.grams(own) & set(marks) and not re.search(license_scan.SPEAKS_OF_RIGHTS, " ".join(own)):
            continue
        candidates += 1
        probability = license_scan.probabilities((classes, weights, bias), own)
        best = max(range(len(classes)), key=lambda k: (probability[k], -sorted(classes).index(classes[k])))
        family = classes[best]
        if family == "none":
            continue
        threes = lambda w: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        mine, sure, share, allowed = threes(own), 0.0, 0.0, set()
        for t in license_scan.CONFIRMING.get(family, ()):
            other = license_scan.words(t)
            allowed |= license_scan.keys(other)
            same = len(mine & threes(other)) / min(len(mine), len(threes(other)))
            share = max(share, same)
            sure = max(sure, same) if license_scan.keys(other) == license_scan.keys(own) else sure
        if family != "unknown" and (license_scan.keys(own) - allowed or share < license_scan.AGREE or sure < license_scan.CONFIRM and probability[best] < least):
            family = "unknown"
        found.append((float(probability[best]), -pos, family, family != "unknown" and sure >= license_scan.CONFIRM))
    best = max(found, default=(0.0, 0, "none", False))
    return len(parts), candidates, len(found), best[2], best[0], best[3]


LICENCE_LINES = {
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "Released under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0", "Released under the BSD 2-Clause License.": "bsd-2-clause",
    "Licensed under the Eclipse Public License 2.0.": "epl-2.0", "Released under the ISC License.": "isc", "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0", "Released under Apache 2.0": "apache-2.0",
    "Distributed under the GPLv3": "gpl-3.0", "MIT-style terms": "mit", "You may use this under BSD 3-Clause": "bsd-3-clause", "Licensed under the Artistic License 2.0.": "unknown", "Released under the European Union Public Licence 1.2.": "unknown",
}


def test_licence_families_and_wrapped_notices(spark):
    wrapped = "\n".join(
        ["Permission is hereby granted, free of charge, to any person obtaining a", "copy of this software and associated documentation files (the Software),", "to deal in the Software without restriction, including without limitation", "the rights to use, copy, modify, merge, publish, distribute, sublicense."]
    )
    df = spark.createDataFrame([*enumerate(LICENCE_LINES), (100, f"Title\n\n{wrapped}\n\nEnd")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [rows[i]["family"] for i in range(len(LICENCE_LINES))] == list(LICENCE_LINES.values())
    assert not any(rows[i]["confirmed"] for i, f in enumerate(LICENCE_LINES.values()) if f == "unknown")
    assert all(rows[i]["confirmed"] for i in range(9))
    assert (rows[100]["n_paragraphs"], rows[100]["family"], rows[100]["confirmed"]) == (3, "mit", True)


def test_licences_of_other_families_and_shared_paragraphs_are_unknown(spark):
    """No family is named by what several families' texts share, by a version that it doesn't have, or by another licence beside it."""
    other = [
        *license_scan.SHARED, "Python Software Foundation License Version 2", "Mozilla Public License 1.1", "CC BY-SA 3.0", "Licensed under Apache-2.0 OR MIT", "Business Source License 1.1", "European Union Public Licence 1.2", "zlib License",
    ]
    ordinary = ["He keeps a licensed pub near the river.", "He lost his driving licence in 2019 after the trial.", "A copyright dispute between two film studios ended."]
    rows = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([*enumerate(other + ordinary)], "doc_id long, text string")).collect()}
    assert [rows[i]["family"] for i in range(len(rows))] == ["unknown"] * len(other) + ["none"] * len(ordinary)
    assert not any(r["confirmed"] for r in rows.values())


def test_licence_query_equals_plain_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [*LICENCE_LINES, None, "", " \n\t\n ", "GNU General Public License version 3, or GPL 2", "Ties: All rights reserved.\nAll rights reserved."]
    both = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*more, *more])] + [(None, more[0])], "doc_id long, text string"))
    texts = sorted(both.collect(), key=str)
    found = sorted(license_scan.scan(both).collect(), key=str)
    want = sorted(((r["doc_id"], *plain_scan(r["text"])) for r in texts), key=str)
    assert sorted((r[0] or 0, *r[1:5], round(r[5], 6), r[6]) for r in found) == sorted((w[0] or 0, *w[1:5], round(w[5], 6), w[6]) for w in want)


def test_licence_variants_left_out():
    classes, weights, bias = license_scan.train()
    right = total = 0
    for own, label in license_scan.training_rows(99):
        z = list(bias)
        for g in license_scan.grams(own):
            for k, w in enumerate(weights.get(g, ())):
                z[k] += w
        right += classes[int(np.argmax(z))] == label
        total += 1
    assert right > 0.93 * total


# Languages ---------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 ... !!", "en"), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd).withColumn("score", F.lit("x"))
    rows = {r["doc_id"]: r for r in language_id.identify(both).join(both.select("doc_id", "lang"), "doc_id").collect()}
    assert [rows[10**6 + k]["lang_pred"] for k in range(3)] == ["und"] * 3
    held = [r for i, r in rows.items() if i < 10**6 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language_id.identify(both.limit(0)).collect()} == set()


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    model = language_id.Crf(["a", "b", "c"], {}, np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    counts = np.array([3, 1, 4])
    scores = rng.normal(0, 2, (8, 3))
    got = model.marginals(scores.copy(), counts)
    at = 0
    for n in counts:
        want, z = np.zeros((n, 3)), 0.0
        for path in product(range(3), repeat=int(n)):
            w = math.exp(model.start[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:])))
            z += w
            for t, y in enumerate(path):
                want[t, y] += w
        assert np.allclose(got[at : at + n], want / z)
        at += n


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    model = language_id.Crf(["a", "b", "c"], {}, np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    counts, gold, scores = np.array([6, 1, 3]), rng.integers(0, 3, 10), rng.normal(0, 2, (10, 3))
    by_score, by_move, by_start = model.gradient(scores.copy(), counts, gold)
    for value, slope in ((scores, by_score), (model.move, by_move), (model.start, by_start)):
        for at in np.ndindex(value.shape):
            kept = value[at]
            ends = []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                ends.append(model.log_likelihood(scores, counts, gold))
            value[at] = kept
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5)


def test_spans_of_code_switched_text(spark):
    model = language_id.train([("the cat and the dog were here with that thing " * 20, "en"), ("der hund und die katze sind nicht schön gewesen " * 20, "de")])
    df = spark.createDataFrame([(1, "the cat and the dog, 12 und die katze sind schön"), (2, None), (3, "12 ..")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["words"], s["lang"]) for s in r["spans"]] for r in language_id.label_spans(df, model).collect()}
    assert found == {1: [(0, 5, "en"), (6, 5, "de")], 2: [], 3: []}


def test_code_switching():
    model = language_id.train([("the cat and the dog were here with that thing " * 20, "en"), ("der hund und die katze sind nicht schön gewesen " * 20, "de")])
    labels = [lang for _, lang, _ in language_id.label_words("the cat and the dog und die katze sind schön", model)]
    assert labels == ["en"] * 5 + ["de"] * 5


# Toxicity ----------------------------------------------------------------------------------------------------------------


def test_lexicon_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    terms = ["idiot", "scum", "worthless", "abc"]
    lexicon = toxicity.Lexicon({t: 1.0 for t in [*terms, "lowe*"]})
    words = ["".join(rng.choice("idotscumwrhle") for _ in range(rng.randint(2, 10))) for _ in range(500)] + ["idiot", "idi0t", "idoit", "scumm", "worthles", "abcd", "lowen", "lowe", "worthlesss"]
    ok = set(lexicon.plausible(words))
    for i, w in enumerate(words):
        plausible = i in ok
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.allowed_edits(t)]
        found = lexicon.match(w)
        if w.startswith("lowe") and len(w) > 4:
            assert found == ("lowe*", 0) and plausible
        elif near:
            assert found and found[1] == min(near)[0] and plausible
        else:
            assert found is None


def test_toxicity(spark):
    rng = random.Random(6)
    clean = lambda: " ".join("".join(rng.choice(["hou", "tre", "riv", "wal", "sto", "gre", "na"]) for _ in range(4)) for _ in range(40))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = clean().split()
        for _ in range(3 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(["moronic", "dirtbag", "scumface"]))
        rows.append((i, " ".join(t), i % 2, 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0, 0.1), (1001, "", 0, 0.1), (1002, f"{clean()} you moroníc dirtbga, scumfase and moronik {clean()}", 0, 0.1), (1003, clean(), 0, 0.1), (1004, f'{clean()} he said "dirtbag" to me {clean()}', 0, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["predicted"] == (i % 4 == 0) for i in held)
    assert found[1002]["predicted"] == 1 and found[1000]["predicted"] == found[1001]["predicted"] == found[1003]["predicted"] == 0
    assert found[1004]["score"] < found[1002]["score"]
    none = toxicity.score(docs, toxicity.fit(docs, marks.limit(0)))
    assert none.where("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0


def labelled(n_toxic, n_clean, extra, common, seed=7):
    """Documents and labels, none held out: all hold the ``common`` words in an order of their own, toxic document k those of ``extra(k)`` too."""
    rng = random.Random(seed)
    ids = [i for i in range(4 * (n_toxic + n_clean)) if zlib.crc32(str(i).encode()) % 3 != 1][: n_toxic + n_clean]
    docs = []
    for k, i in enumerate(ids):
        own = list(common) + (extra(k) if k < n_toxic else [])
        rng.shuffle(own)
        docs.append((i, " ".join(own)))
    return docs, [(i, int(k < n_toxic)) for k, i in enumerate(ids)]


def test_common_words_take_no_places_from_toxic_terms(spark):
    """More than 4,000 words that all documents hold, and a term of half the toxic ones."""
    common = ["".join((a, b, c)) for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop"]
    docs, labels = labelled(60, 90, lambda k: ["moronic"] * (k % 2), common)
    lexicon, _, _ = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(common) > 4000 and set(lexicon.weights) == {"moronic"}


def test_terms_by_columns_equal_terms_by_lexicon(spark):
    rng = random.Random(8)
    toxic = Counter({f"w{k}": rng.choice([1, 3, 20, 40, rng.randint(1, 60)]) for k in range(600)})
    clean = Counter({w: rng.choice([0, 0, 1, rng.randint(0, 90)]) for w in toxic})
    want = toxicity.learn_lexicon(toxic, clean, 60, 90, most=10**6)
    counts = spark.createDataFrame([(w, t, clean[w]) for w, t in toxic.items()], "term string, t long, c long")
    assert {r["term"] for r in toxicity.clear_terms(counts, 60, 90, len(toxic)).collect()} == set(want) and want


def test_long_terms_match_with_two_edits():
    term = "".join(chr(97 + k * 7 % 26) for k in range(90))
    lexicon = toxicity.Lexicon({term: 1.0}, {})
    words = [term, term[:40] + term[41:], "x" + term + "y", term[:60], term + "abc", "q" * 70000]
    assert sorted(lexicon.plausible(words)) == [0, 1, 2]
    assert [lexicon.match(w) is not None for w in words[:5]] == [True, True, True, False, False]


def test_near_copies_teach_once_and_strangers_that_share_a_phrase_each(spark):
    """What the lexicon counts: documents, near copies as one, whatever phrase other texts have in common with them."""
    shared = "in the end of the day "
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    toxic = [shared + filler(k) + " grumblefink" for k in range(40)]
    clean = [shared + filler(100 + k) for k in range(60)]
    copies = [shared + filler(99) + f" clatterpot c{k}" for k in range(40)]
    docs, labels, i = [], [], 0
    for texts, y in ((toxic, 1), (clean, 0), (copies, 1)):
        for text in texts:
            while zlib.crc32(str(i).encode()) % 3 == 1:
                i += 1
            docs.append((i, text))
            labels.append((i, y))
            i += 1
    lexicon, _, _ = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grumblefink" in lexicon.weights and "clatterpot" not in lexicon.weights


def test_misspellings_of_inflected_terms(spark):
    """A term that also occurs inflected is learned as a stem; its whole words stay targets of the automata."""
    docs, labels = labelled(60, 90, lambda k: [("idiot", "idiots", "scum", "scumbag")[k % 4]], [f"w{k}" for k in range(40)])
    lexicon, _, _ = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.startswith("idio") and t.endswith("*") for t in lexicon.weights) and "idiot" not in lexicon.weights
    words = ["idiot", "idiots", "idiotic", "ldiot", "iddiot", "idots", "idi0t"]
    assert set(lexicon.plausible(words)) == set(range(len(words)))
    assert [lexicon.match(w) for w in words] == [("idio*", n) for n in (0, 0, 0, 1, 1, 1, 1)]
    assert lexicon.match("radio") is None and toxicity.Lexicon(lexicon.weights).match("ldiot") is None
    stem = toxicity.Lexicon({"scum*": 1.0}, {"scum": "scum*"})
    assert stem.match("scum") == ("scum*", 0) and stem.match("scvm") == ("scum*", 1) and stem.match("scvmbag") is None


# Revisits ----------------------------------------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "http://www.A.org/x?utm_source=f#t", 100, 200, {"ETag": "v1", "Content-Length": "5", "Cache-Control": "a"}),
        (2, "https://a.org/x/", 200, 304, {"etag": 'W/v1', "Cache-Control": "b", "X-Own": "no"}),
        (3, "https://a.org/x", 300, 304, {"etag": "v2"}),
        (4, "https://a.org/x", 50, 304, {"etag": "v1"}),
        (5, "https://a.org/x", 250, 200, None),
        (6, "https://a.org/x", 400, 304, {"etag": "v1"}),
        (7, None, 10, 304, None),
        (8, "https://a.org/x", 250, 200, {"Last-Modified": "m"}),
        (9, "https://a.org/x", 500_000, 304, {"last-modified": "m", "etag": "v9"}),
        (10, "https://a.org/x", 100, 304, {"etag": "v1"}),
        (11, "https://b.org", 1, 404, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, ts long, status int, headers map<string,string>, base_id string")
    found = {r["record_id"]: (r["outcome"], r["base_id"]) for r in warc_revisits.resolve_revisits(df).collect()}
    assert found == {
        1: ("response", None), 2: ("resolved", 1), 3: ("no_validator", 8), 4: ("no_earlier_response", None), 5: ("response", None), 6: ("no_validator", 8), 7: ("no_earlier_response", None),
        8: ("response", None), 9: ("resolved", 8), 10: ("no_earlier_response", None), 11: ("other", None),
    }
    merged = warc_revisits.resolve_revisits(df).where("record_id = 2").first()["headers"]
    assert merged == {"etag": "W/v1", "content-length": "5", "cache-control": "b"}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0
