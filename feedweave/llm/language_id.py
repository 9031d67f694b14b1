"""Languages of words and documents by a linear-chain conditional random field.

Features of a word: affixes, character n-grams and, for training words seen more than twice, the word itself.  Transitions between
the labels of neighbouring words and the weights of first labels are learned with them.  Training sequences join runs of words of
different languages, so the model meets code-switching.  Forward-backward gives every word a distribution over the languages; a document's is their mean,
weighted by letters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import carried, crc_mod, flat_words, id_and_text, mix64, row_texts, shared, slices, table, tidy

BUCKETS = 1 << 16
SLICE = 1_500_000  # bytes of text whose features are in memory at once
DOCS_PER_LANGUAGE = 300  # the bound of the training sample: whole documents of each language, about


def core(word: bytes) -> str:
    """A word's letters in lower case; digits, signs and marks fall away."""
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def feature_ids(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of core words and, for each, the word's position; a word without letters has none.

    Every run of 1 to 4 characters of the word between its marks ^ and $ is hashed (so affixes are the runs that touch a
    mark); a lexicon word also has an id of its own behind the buckets.
    """
    text = "".join(f"^{w}$" if w else "" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 if w else 0 for w in words])
    ids, at = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        same = owner[:m] == owner[n - 1 :]
        ids.append((mix64(h[same]) % np.uint64(BUCKETS)).astype(np.int64))
        at.append(owner[:m][same])
    known = [(lexicon[w] + BUCKETS, i) for i, w in enumerate(words) if w in lexicon]
    ids.append(np.array([k for k, _ in known], np.int64))
    at.append(np.array([i for _, i in known], np.int64))
    return np.concatenate(ids), np.concatenate(at)


class Crf:
    """Weights of features by label and of transitions; scores by forward-backward over many sequences at once."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.labels, self.lexicon, self.emit, self.move, self.start = labels, lexicon, emit, move, start

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words by label."""
        return self.weighed(*feature_ids(words, self.lexicon), len(words))

    def weighed(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, self.emit[ids, k], n) for k in range(len(self.labels))], axis=1)

    def marginals(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each word's distribution over the labels; ``scores`` holds the words of all sequences, ``counts`` the sequences' lengths."""
        return self.expectations(scores, counts)[0]

    def expectations(self, scores: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each word's distribution over the labels and, if asked, the expected number of each pair of neighbouring labels.

        Sequences run side by side, longest first, so step t of all of them is one array operation.
        """
        out = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf)) if len(scores) else scores.copy()
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        begin, n = first[order], counts[order]
        live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), side="right")
        move, both = np.exp(self.move), np.zeros_like(self.move)
        ahead = np.empty_like(out)
        a = None
        for t, k in enumerate(live.tolist()):
            a = np.exp(self.start) * out[begin[:k]] if t == 0 else (a[:k] @ move) * out[begin[:k] + t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[begin[:k] + t] = a
        b = np.ones((0, out.shape[1]))
        for t in range(len(live) - 1, -1, -1):
            k = int(live[t])
            if len(b) < k:
                b = np.concatenate([b, np.ones((k - len(b), out.shape[1]))])
            rows = begin[:k] + t
            own = ahead[rows] * b
            own /= own.sum(axis=1, keepdims=True)
            behind = b * out[rows]
            if pairs and t:
                # a pair's probability: what leads to its first label, the transition, the second label's emission, what follows
                before = ahead[rows - 1]
                both += (before / ((before @ move) * behind).sum(axis=1, keepdims=True)).T @ behind * move
            b = behind @ move.T
            b /= b.sum(axis=1, keepdims=True)
            out[rows] = own
        return out, both

    def log_likelihood(self, scores: np.ndarray, counts: np.ndarray, gold: np.ndarray) -> float:
        """Of the gold labels, all sequences together."""
        total, at = 0.0, 0
        for n in counts.tolist():
            own, y = scores[at : at + n], gold[at : at + n]
            total += self.start[y[0]] + own[np.arange(n), y].sum() + self.move[y[:-1], y[1:]].sum()
            a = self.start + own[0]
            for t in range(1, n):
                a = np.logaddexp.reduce(a[:, None] + self.move, axis=0) + own[t]
            total -= np.logaddexp.reduce(a)
            at += n
        return float(total)

    def gradient(self, scores: np.ndarray, counts: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``log_likelihood``, by the words' scores, the transitions and the first labels' weights."""
        p, both = self.expectations(scores, counts, pairs=True)
        by_score = -p
        by_score[np.arange(len(gold)), gold] += 1
        first = np.cumsum(counts) - counts
        inner = np.ones(len(gold), bool)
        inner[first + counts - 1] = False
        i = np.flatnonzero(inner)
        by_move = -both
        np.add.at(by_move, (gold[i], gold[i + 1]), 1)
        return by_score, by_move, by_score[first].sum(axis=0)


def training_sequences(texts: list[tuple[str, str]], seed: int = 10, length: int = 48) -> list[tuple[list[str], list[str]]]:
    """Sequences of (words, labels): runs of 4 to 24 words from one document after another, in mixed order."""
    rng = np.random.default_rng(seed)
    runs = []
    for text, lang in texts:
        words = [w for w in map(core, text.encode().split()) if w]
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 25))
            runs.append((words[at : at + n], lang))
            at += n
    sequences, words, labels = [], [], []
    for i in rng.permutation(len(runs)):
        own, lang = runs[i]
        words, labels = words + own, labels + [lang] * len(own)
        if len(words) >= length:
            sequences.append((words[:length], labels[:length]))
            words, labels = [], []
    if words:
        sequences.append((words, labels))
    return sequences


def train(texts: list[tuple[str, str]], epochs: int = 3, batch: int = 32, rate: float = 0.2, decay: float = 1e-6) -> Crf:
    """A CRF from (text, language) pairs by minibatch AdaGrad on the conditional likelihood."""
    labels = sorted({lang for _, lang in texts})
    seen = Counter(w for text, _ in texts for w in {core(x) for x in text.encode().split()} if w)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 2))}
    size, features = max(1, len(labels)), BUCKETS + len(lexicon)
    model = Crf(labels, lexicon, np.zeros((features, size), np.float32), np.zeros((size, size)), np.zeros(size))
    sequences = training_sequences(texts)
    index = {lang: i for i, lang in enumerate(labels)}
    g_emit, g_move, g_start = np.full((features, size), 1e-3, np.float32), np.full((size, size), 1e-3), np.full(size, 1e-3)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            chosen = [sequences[i] for i in order[at : at + batch]]
            flat = [w for words, _ in chosen for w in words]
            gold = np.array([index[x] for _, own in chosen for x in own])
            counts = np.array([len(words) for words, _ in chosen])
            idx, rep = feature_ids(flat, lexicon)
            by_score, by_move, by_start = model.gradient(model.weighed(idx, rep, len(flat)), counts, gold)
            used, slot = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(slot, by_score[rep, k], len(used)) for k in range(size)], axis=1) - decay * model.emit[used]
            g_emit[used] += grad**2
            model.emit[used] += rate * grad / np.sqrt(g_emit[used])
            g_move += by_move**2
            model.move += rate * by_move / np.sqrt(g_move)
            g_start += by_start**2
            model.start += rate * by_start / np.sqrt(g_start)
    return model


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Crf | None:
    """A model from ``docs(doc_id, text, lang)`` with text and language, for every language there is.

    The sample is bounded by ``docs_per_language``: about so many whole documents of each language, chosen by a hash of id and
    language, the same in each run.  None if nothing is labelled.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang")).where("text is not null and lang is not null and text rlike '[a-zA-Z\\\\x{80}-\\\\x{10FFFF}]'")
    mark = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    chosen = rows.join(F.broadcast(sizes), "lang").where(mark < F.lit((docs_per_language + 20) * 2.0**30) / F.col("n"))
    texts = sorted(map(tuple, chosen.select("lang", F.coalesce("doc_id", F.lit(0)), "text").collect()))
    model = train([(text, lang) for lang, _, text in texts])
    return model if model.labels else None


def _words(texts: list[bytes], model: Crf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with letters of all texts: the text's position, the word's place in it, its letters and its distribution; and each text's word count."""
    words, counts = flat_words(texts)
    cores = [core(w) for w in words.dictionary.to_pylist()]
    codes = words.indices.to_numpy()
    letters = np.array([len(x) for x in cores], np.float64)[codes] if len(codes) else np.zeros(0)
    has = letters > 0
    owner = np.repeat(np.arange(len(texts)), counts)[has]
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts))[has]
    own = np.bincount(owner, minlength=len(texts))
    p = model.marginals(model.emissions(cores)[codes][has] if len(codes) else np.zeros((0, len(model.labels))), own[own > 0])
    return owner, place, letters[has], p, own


def predict(docs: DataFrame, model: Crf | None, carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``; with ``carry``, the whole row as a struct ``row`` instead of ``doc_id``.

    ``und`` with score 0 if the text is null or has no letter (and for every text without a model).  Ties go to the
    language that sorts first.  Whole texts count, however long.  Repeated rows and rows without a doc_id come back each; an
    empty table gives an empty result; other columns, whatever their names, change nothing.
    """
    get = shared(docs.sparkSession, model)

    def run(batches):
        model = get()
        for batch in batches:
            texts = row_texts(batch)
            out_lang, out_score = ["und"] * len(texts), [0.0] * len(texts)
            if model is not None:
                for i, j in slices(texts, SLICE):
                    owner, _, letters, p, own = _words(texts[i:j], model)
                    total = np.bincount(owner, letters, j - i)
                    sums = np.stack([np.bincount(owner, letters * p[:, k], j - i) for k in range(len(model.labels))], axis=1)
                    best = sums.argmax(axis=1)
                    for k in np.flatnonzero(own > 0).tolist():
                        out_lang[i + k] = model.labels[best[k]]
                        out_score[i + k] = min(1.0, max(0.0, float(sums[k, best[k]] / total[k])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())], names=[batch.schema.names[0], "lang_pred", "score"])

    rows, schema = carried(docs, carry, "lang_pred string, score double")
    return rows.mapInArrow(tidy(run), schema)


def label_spans(docs: DataFrame, model: Crf) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: the runs of words of one language, in order.

    A span holds ``start`` (the words before it), ``words``, ``lang`` (each word's most probable label) and ``probability``
    (the mean of its words').  Words without letters belong to the span before them; a text without letters has no spans.
    """
    get = shared(docs.sparkSession, model)

    def run(batches):
        model = get()
        for batch in batches:
            texts = row_texts(batch)
            for i, j in slices(texts, SLICE):
                owner, place, _, p, _ = _words(texts[i:j], model)
                label, most = p.argmax(axis=1), p.max(axis=1, initial=0)
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])) if len(owner) else np.zeros(0, np.int64)
                ends = np.append(new[1:], len(owner))
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                for a, b in zip(new.tolist(), ends.tolist()):
                    spans[owner[a]].append({"start": int(place[a]), "words": int(place[b - 1] - place[a] + 1), "lang": model.labels[label[a]], "probability": float(most[a:b].mean())})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(spans, kind)], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<start: int, words: int, lang: string, probability: double>>")


def label_words(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """The words of one text that have letters, with label and probability."""
    words = [w for w in (text or "").split() if core(w.encode())]
    p = model.marginals(model.emissions([core(w.encode()) for w in words]), np.array([len(words)])) if words else np.zeros((0, 1))
    return [(w, model.labels[int(x.argmax())], float(x.max())) for w, x in zip(words, p)]


def identify(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Predictions for all documents by a model learned from those whose crc32(doc_id) mod 4 isn't 2."""
    model = fit(docs.where(crc_mod(docs["doc_id"], 4) != 2))
    return predict(docs, model, carry)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
