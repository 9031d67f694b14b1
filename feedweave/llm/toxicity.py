"""Toxic documents: a learned lexicon, matched with misspellings by Levenshtein automata, scored in context.

The lexicon's terms (whole words, and stems written ``stem*``) are those whose documents are labelled toxic far more often
than chance; all that pass the bound count, however many.  A trie of the terms is walked together with each distinct word's
Levenshtein automaton; a stem takes every word that it begins, and misspellings of the whole words that it stands for.  Hits
inside quotation marks or behind a verb of saying count apart from open abuse.  A logistic regression over the counts gives the
score; it learns what misspelled hits weigh from copies of the toxic training texts whose terms are misspelled on purpose.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import byte_texts, carried, crc_mod, discard, id_and_text, row_texts, shared, slices, split_words, stored, table, tidy
from feedweave.llm.minhash_dedup import near_duplicates

TOXIC_DOCS, CLEAN_DOCS = 4000, 6000  # the bounds of the training sample, by label
SAME_PERCENT = 80  # Jaccard similarity from which documents teach as one
STEMS = range(4, 9)
WINDOW = 6  # words on either side that tell quotation from abuse
THRESHOLD = 0.7
# Digits and signs that stand for letters, and words that announce a quotation.
LOOKS_LIKE = str.maketrans("013457@$!", "oieastasi")
DISGUISE, LETTER = re.compile("[013457@$!]"), re.compile("[^\\W\\d_]")
SAYING = frozenset(b"said says called calls quoted quote wrote writes word term insult slur named dit disait mot sagte nannte wort dijo palabra".split())
MARKS = "\"'`.,;:!?()[]{}<>|*_~-…«»“”„‘’¿¡"
QUOTES = re.compile("[\"\u201c\u201d\u201e\u00ab\u00bb]")


def plain(word: bytes) -> str:
    """A word without the marks around it, in lower case."""
    text = word.decode("utf-8", "replace").lower().strip(MARKS)
    return text.rstrip("#$%&").rstrip(MARKS) if text[-2:] in ("##", "$$", "%%", "&&") else text  # a lone $ may stand for a letter


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word: how often it has each character, by code point modulo 61."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 61
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(owner * 61 + points, minlength=61 * len(words)).reshape(-1, 61).astype(np.int32)


class Lexicon:
    """Terms with weights in a trie; ``match`` intersects it with a word's Levenshtein automaton.

    ``forms`` are whole words that stand for a stem among the terms: the automata reach them, and they count as the stem.
    """

    def __init__(self, weights: dict[str, float], forms: dict[str, str] | None = None):
        self.weights = dict(weights)
        self.forms = {w: stem for w, stem in (forms or {}).items() if w not in self.weights}
        self.trie: dict = {}
        for term in sorted([*weights, *self.forms]):
            node = self.trie
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node.setdefault("", []).append(term)
        self.whole = [t for t in sorted([*weights, *self.forms]) if not t.endswith("*")]
        self.stems = [t[:-1] for t in sorted(weights) if t.endswith("*")]
        self.letters = letter_counts(self.whole)
        # A word within k edits of a term holds one of the term's k + 1 pieces unchanged: the first where it begins, the last where
        # it ends, or the one between, an edit before it and one behind, at most a letter from its place.
        pieces: dict[tuple[int, int], set[str]] = {}
        for term in self.whole:
            n, k = len(term), allowed_edits(term)
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            parts = list(zip(cuts, cuts[1:]))
            pieces.setdefault((0, parts[0][1]), set()).add(term[: parts[0][1]])
            if k:
                pieces.setdefault((parts[-1][0] - n, n - parts[-1][0]), set()).add(term[parts[-1][0] :])
            for a, b in parts[1:-1]:
                for at in (a - 1, a, a + 1):
                    pieces.setdefault((at, b - a), set()).add(term[a:b])
        self.pieces = {place: sorted(texts) for place, texts in pieces.items()}
        self.heads = {n: sorted(s for s in self.stems if len(s) == n) for n in {len(s) for s in self.stems}}

    @staticmethod
    def holding(words: pa.Array, at: int, size: int, texts: list[str]) -> np.ndarray:
        """Which words hold one of the texts of ``size`` characters at a place, counted from the end if negative."""
        part = pc.utf8_slice_codeunits(words, at, at + size if at >= 0 or at + size < 0 else 1 << 30)
        return pc.is_in(part, value_set=pa.array(texts, pa.string())).to_numpy(zero_copy_only=False)

    def plausible(self, words: list[str]) -> list[int]:
        """Positions of the words that can match at all: they hold a piece of a term, and an edit changes their length by one at most, their letters' counts by two."""
        column = pa.array(words, pa.string())
        some = np.zeros(len(words), bool)
        for (at, size), texts in self.pieces.items():
            some |= self.holding(column, at, size, texts)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.flatnonzero(some & (lengths <= max(map(len, self.whole), default=0) + 2))
        sizes = lengths[rows]
        counts = letter_counts([words[i] for i in rows.tolist()])
        found = [np.zeros(0, np.int64)]
        for term, own in zip(self.whole, self.letters):
            k = allowed_edits(term)
            near = np.flatnonzero(np.abs(sizes - len(term)) <= k)
            found.append(rows[near[np.abs(counts[near] - own).sum(axis=1) <= 2 * k]])
        for size, texts in self.heads.items():
            found.append(np.flatnonzero(self.holding(column, 0, size, texts)))
        return np.unique(np.concatenate(found)).tolist()

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that ``word`` writes and the edits needed; fewest edits first, then the longest term, then by name."""
        if word in self.weights:
            return word, 0
        if stems := [s for s in self.stems if word.startswith(s) and len(word) > len(s)]:
            return max(stems, key=len) + "*", 0
        best: tuple[int, int, str] | None = None
        state = list(range(len(word) + 1))
        limit = 2
        stack = [(self.trie, state, 0)]
        while stack:
            node, state, depth = stack.pop()
            for term in node.get("", ()):
                if not term.endswith("*") and state[-1] <= allowed_edits(term):
                    found = (state[-1], -depth, term)
                    best = min(best, found) if best else found
            for c, child in node.items():
                if c:
                    row = [state[0] + 1]
                    for i, x in enumerate(word):
                        row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (x != c)))
                    if min(row) <= limit:
                        stack.append((child, row, depth + 1))
        return (self.forms.get(best[2], best[2]), best[0]) if best else None


#: What document_features counts: weights of open, misspelled and quoted hits, distinct terms written as they are, misspelled forms, words.
RAW = ("open", "misspelled", "quoted", "kinds", "slips", "words")
FEATURES = 5


def design(raw: np.ndarray, noise: float) -> np.ndarray:
    """Features of a document: logarithms of the hits' weights by kind, of the distinct terms and of the weight per word.

    ``noise`` is how often a word of clean text happens to be near a term; misspelled hits count as far as they exceed what
    that explains, four standard deviations included, so that long texts gather none by chance.
    """
    open_, slipped, quoted, kinds, slips, words = raw.T
    chance = noise * words
    excess = np.maximum(0, slips - chance - 4 * np.sqrt(chance)) / np.maximum(slips, 1)
    return np.stack([np.log1p(open_), np.log1p(slipped * excess), np.log1p(quoted), np.log1p(kinds), np.log1p(100 * (open_ + quoted) / np.maximum(words, 1))], axis=1)


def document_features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """A row per text: see RAW."""
    words, counts = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    bare = [plain(w) for w in distinct]
    hit_of: dict[int, tuple[float, int, str]] = {}
    for i in lexicon.plausible(bare):
        if bare[i] and (found := lexicon.match(bare[i])):
            hit_of[i] = lexicon.weights[found[0]], found[1], found[0]
    signs = [i for i, w in enumerate(bare) if i not in hit_of and DISGUISE.search(w) and LETTER.search(w)]
    other = [bare[i].translate(LOOKS_LIKE) for i in signs]
    for k in lexicon.plausible(other):
        if found := lexicon.match(other[k]):
            hit_of[signs[k]] = lexicon.weights[found[0]], found[1] + 1, found[0]
    out = np.zeros((len(texts), len(RAW)))
    out[:, 5] = counts
    codes = coded.indices.to_numpy()
    places = np.flatnonzero(np.isin(codes, np.fromiter(hit_of, np.int64, len(hit_of)))) if hit_of else np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    owners = np.searchsorted(begin + counts, places, side="right")
    kinds: dict[int, set[str]] = {}
    forms: set[tuple[int, int]] = set()
    for p, d in zip(places.tolist(), owners.tolist()):
        weight, edits, term = hit_of[int(codes[p])]
        a, b = max(int(begin[d]), p - WINDOW), min(int(begin[d] + counts[d]), p + WINDOW + 1)
        around = words.slice(a, b - a).to_pylist()
        before, after = b" ".join(around[: p - a]).decode("utf-8", "replace"), b" ".join(around[p + 1 - a :]).decode("utf-8", "replace")
        own = around[p - a].decode("utf-8", "replace")
        opened = len(QUOTES.findall(before)) % 2 == 1 or bool(QUOTES.match(own))
        closed = bool(QUOTES.search(after)) or bool(QUOTES.search(own[1:]))
        quoted = opened and closed or any(w.lower().strip(b".,:;\"'") in SAYING for w in around[max(0, p - 3 - a) : p - a])
        if not edits:
            out[d, 2 if quoted else 0] += weight
            kinds.setdefault(d, set()).add(term)
        elif (form := (d, int(codes[p]))) not in forms:  # a misspelled form counts once in a text
            forms.add(form)
            out[d, 1] += weight
            out[d, 4] += 1
    for d, k in kinds.items():
        out[d, 3] = len(k)
    return out


def _terms(text: bytes) -> set[str]:
    whole = {w for w in map(plain, set(text.split())) if len(w) > 2 and w.isalpha()}
    return whole | {w[:n] + "*" for w in whole for n in STEMS if len(w) > n}


def doubt_of(tried: int) -> float:
    """What a term's evidence must exceed if so many terms are tried."""
    return math.log(max(1, tried)) + math.log(1000)


def clear_terms(counts: DataFrame, n_toxic: int, n_clean: int, tried: int) -> DataFrame:
    """The rows of ``counts(term, t, c)`` that learn_lexicon would find, by the same bound, odds and direction."""
    t, c, rate = F.col("t"), F.col("c"), n_toxic / (n_toxic + n_clean)
    share = t / (t + c)
    far = (t + c) * (share * F.log(share / rate) + F.when(c > 0, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    return counts.where((t >= 3) & (share > rate) & (far > doubt_of(tried) - 1e-6) & ((t + 0.5) / (n_toxic + 1) > 3 * (c + 0.5) / (n_clean + 1)))


def learn_lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, most: int | None = None, tried: int | None = None) -> dict[str, float]:
    """Terms whose share of the toxic documents clearly exceeds their share of the clean ones, with log ratios as weights.

    ``tried`` is the number of terms that ``toxic`` was picked from, if these are not all.
    """
    found = []
    rate = n_toxic / max(1, n_toxic + n_clean)
    doubt = doubt_of(len(toxic) if tried is None else tried)
    for term, t in toxic.items():
        c = clean.get(term, 0)
        share = t / (t + c)
        if t < 3 or share <= rate or not 0 < rate < 1:
            continue
        # Chernoff's bound on seeing so many toxic documents among the term's by chance, over all terms tried
        far = (t + c) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))
        p, q = (t + 0.5) / (n_toxic + 1), (c + 0.5) / (n_clean + 1)
        if far > doubt and p > 3 * q:
            found.append((far, term, math.log(p / q)))
    chosen: dict[str, float] = {}
    evidence = {term: far for far, term, _ in found}
    for far, term, weight in sorted(found, key=lambda x: (-x[0], x[1].endswith("*"), -len(x[1]), x[1])):
        stem = term.rstrip("*")
        covered = [s for s in chosen if s.endswith("*") and stem.startswith(s[:-1])]
        longer = [s for s in chosen if term.endswith("*") and s.rstrip("*").startswith(stem)]
        # what a chosen stem begins says nothing new; a stem must add much to the chosen terms that begin with it
        if covered or longer and far < 1.3 * max(evidence[s] for s in longer):
            continue
        chosen[term] = weight
        if len(chosen) == most:
            break
    return chosen


def stem_forms(weights: dict[str, float], counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, str]:
    """The whole words of ``counts(term, t, c)`` that a stem among the terms takes or equals, and that lean to toxic documents; the longest stem of each."""
    stems = [s[:-1] for s in weights if s.endswith("*")]
    if not stems:
        return {}
    taken = F.lit(False)
    for n in sorted({len(s) for s in stems}):
        taken = taken | F.substring("term", 1, n).isin([s for s in stems if len(s) == n])
    leaning = counts.where((F.col("t") >= 3) & (F.col("t") * n_clean > F.col("c") * n_toxic) & ~F.endswith("term", F.lit("*")) & taken)
    return {r["term"]: max((s for s in stems if r["term"].startswith(s)), key=len) + "*" for r in leaning.select("term").collect()}


def misspelled(text: bytes, lexicon: Lexicon) -> bytes:
    """The text with each word that writes a term of four letters or more changed by one edit, which a hash of word and place chooses."""
    words = text.split()
    for k, word in enumerate(words):
        bare = plain(word)
        if len(bare) < 4 or not ((found := lexicon.match(bare)) and not found[1]):
            continue
        h = zlib.crc32(b"%d %s" % (k, word))
        at, kind, letter = 1 + h % (len(bare) - 2), (h >> 8) % 4, "abcdefghijklmnopqrstuvwxyz"[(h >> 12) % 26]
        changed = (
            bare[:at] + letter + bare[at + 1 :] if kind == 0 else bare[:at] + bare[at + 1 :] if kind == 1 else bare[:at] + letter + bare[at:] if kind == 2 else bare[:at] + bare[at] + bare[at:]
        )
        words[k] = changed.encode()
    return b" ".join(words)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, share: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (the intercept last) by Newton's method, drawn towards ``prior``; row i counts ``share[i]`` times."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.ones(len(x)) if share is None else share
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hessian = (x1 * (share * p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x1.T @ (share * (y - p)) - ridge * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Where few labels say otherwise: open abuse weighs fully, misspelled abuse nearly so, quoted words half.
PRIOR = np.array([1.5, 1.3, 0.6, 1.0, 0.2, -4.0])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, float, np.ndarray]:
    """Lexicon, rate of chance hits and weights from ``docs(doc_id, text)`` joined with ``labels(doc_id, toxic)``.

    Bounded: at most TOXIC_DOCS toxic and CLEAN_DOCS clean documents, chosen by a hash of their ids; term counts are summed
    per batch before they are shuffled, and only terms that pass the significance bound reach the driver.  Null texts or labels teach nothing;
    of documents that near_duplicates links (80 per cent of their word 5-grams in common) the one with the smallest id teaches alone, and
    of rows that repeat an id the one whose text sorts last.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(crc_mod(F.col("doc_id"), 3) != 1)
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(TOXIC_DOCS / max(1, sizes.get(1, 0)))).otherwise(CLEAN_DOCS / max(1, sizes.get(0, 0)))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # the bounded sample's ids

    # copies and near copies teach once, each group by its document with the smallest id
    sample = stored(sample.select("doc_id", "text", "toxic"))
    texts = sample.groupBy("doc_id").agg(F.max("text").alias("text"))
    firsts = stored(near_duplicates(texts, percent=SAME_PERCENT).where("kept").select("doc_id"))
    single = sample.join(firsts, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("m"))
    first = sample
    sample = stored(single.select("m.text", "m.toxic"))

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(byte_texts(batch["text"]), batch["toxic"].to_pylist()):
                (toxic if y else clean).update(_terms(text))
                n[y] += 1
        toxic[""], clean[""] = n[1], n[0]
        terms = sorted(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "t", "c"])

    counts = sample.select("text", "toxic").mapInArrow(tidy(count), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = stored(counts.where("term = '' or t >= 3"))
    n_toxic, n_clean, tried = counts.agg(F.sum(F.expr("if(term = '', t, 0)")), F.sum(F.expr("if(term = '', c, 0)")), F.sum(F.expr("if(term = '', 0, 1)"))).first()
    terms = counts.where("term <> ''")
    rows = clear_terms(terms, n_toxic, n_clean, tried).collect() if n_toxic and n_clean else []
    weights = learn_lexicon(Counter({r["term"]: r["t"] for r in rows}), Counter({r["term"]: r["c"] for r in rows}), n_toxic, n_clean, tried=tried) if rows else {}
    lexicon = Lexicon(weights, stem_forms(weights, terms, n_toxic, n_clean) if weights else {})
    get_lexicon = shared(docs.sparkSession, lexicon)

    def measure(batches):
        lexicon = get_lexicon()
        for batch in batches:
            texts = byte_texts(batch["text"])
            for i, j in slices(texts):
                toxic = batch["toxic"].slice(i, j - i).to_numpy()
                changed = [misspelled(texts[i + k], lexicon) for k in np.flatnonzero(toxic == 1).tolist()]
                x = np.concatenate([document_features(texts[i:j], lexicon), document_features(changed, lexicon)])
                kind = np.concatenate([toxic, np.full(len(changed), 2)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(len(RAW))), pa.array(kind)], names=[*RAW, "kind"])

    fields = ", ".join(f"{k} double" for k in RAW)
    found = np.array(sorted(map(tuple, sample.select("text", "toxic").mapInArrow(tidy(measure), f"{fields}, kind int").collect())), np.float64).reshape(-1, len(RAW) + 1)
    discard(first, firsts, sample, counts)
    raw, kind = found[:, :-1], found[:, -1]
    clean = raw[kind == 0]
    noise = float((clean[:, 4].sum() + 1) / (clean[:, 5].sum() + 1000))
    # a toxic text and its misspelled copy count half each
    w = logistic(design(raw, noise), (kind > 0).astype(float), PRIOR, np.where(kind > 0, 0.5, 1.0)) if len(set(kind.tolist())) == 3 else PRIOR.copy()
    return lexicon, noise, w


def score(docs: DataFrame, model: tuple[Lexicon, float, np.ndarray], carry: bool = False) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``; with ``carry``, the whole row as a struct ``row`` instead of ``doc_id``.

    Null and empty texts get the score of a text without hits.  Repeated rows and rows without a doc_id come back each, whole
    texts count; an empty table gives an empty result; other columns, whatever their names, change nothing.
    """
    get = shared(docs.sparkSession, model)

    def run(batches):
        lexicon, noise, w = get()
        for batch in batches:
            texts, parts = row_texts(batch), []
            for i, j in slices(texts, 3_000_000):
                x = design(document_features(texts[i:j], lexicon), noise)
                parts.append(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500))))
            p = np.concatenate([*parts, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[batch.schema.names[0], "score", "predicted"])

    rows, schema = carried(docs, carry, "score double, predicted int")
    return rows.mapInArrow(tidy(run), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
