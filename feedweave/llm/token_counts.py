"""Token counts of whole texts, where most pre-tokens are never merged.

A vocabulary string is whole if the merges bring it back to its own single token.  This is proven once for every string of the
vocabulary, before any text is read; a pre-token that equals a whole string counts as one token without more ado, and only the
rest go through the merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from feedweave.llm.common import byte_texts, id_and_text, shared, slices, split_words, table, tidy
from feedweave.llm.packing import Tokens

LIMIT = 2048
WORD_END = "</w>"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_pre_tokens long, n_whole long"


def whole_tokens(model) -> list[str]:
    """The vocabulary strings, as the pre-tokenizer writes them, that the merges encode as one token each."""
    strings = [s.removesuffix(WORD_END) for s in model.get_vocab(with_added_tokens=False) if s.endswith(WORD_END) and s != WORD_END]
    return sorted(s for s in strings if len(model.model.tokenize(s)) == 1)


class TokenCounter:
    """Counts for distinct words of a batch; words never share a token, as the vocabulary's pre-tokens don't span white space."""

    def __init__(self, path: str, whole: list[str]):
        self.tokens = Tokens(path)
        self.model = self.tokens.model
        self.whole = set(whole)
        raw = {c: b for b, c in self.tokens.merges.symbols().items()}
        self.whole_bytes = pa.array([bytes(raw[c] for c in s) for s in whole], pa.binary())
        self.specials = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]

    def odd(self, word: bytes) -> tuple[int, int, int]:
        """Tokens, pre-tokens and whole pre-tokens of any word."""
        text = word.decode("utf-8", "replace")
        if any(s in word for s in self.specials):  # these are cut out before anything else happens
            n = len(self.model.encode(text, add_special_tokens=False).ids)
            return n, n, 0
        parts = [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(text))]
        rest = [p for p in parts if p not in self.whole]
        return len(parts) - len(rest) + sum(len(self.model.model.tokenize(p)) for p in rest), len(parts), len(parts) - len(rest)

    def units(self, distinct: pa.Array) -> np.ndarray:
        """Tokens, pre-tokens and whole pre-tokens of each distinct word, as three rows."""
        core, other = (x.dictionary_encode() for x in self.tokens.cut(distinct))
        letters = core.dictionary
        whole = pc.is_in(letters, self.whole_bytes).to_numpy(zero_copy_only=False)
        some = pc.binary_length(letters).to_numpy(zero_copy_only=False) > 0
        sizes = whole.astype(np.int64)
        rest = some & ~whole
        sizes[rest] = self.tokens.merges(letters.filter(pa.array(rest)))[2]
        of_core = np.stack([sizes, some.astype(np.int64), whole.astype(np.int64)])
        of_other = np.array([self.odd(w) if w else (0, 0, 0) for w in other.dictionary.to_pylist()], np.int64).reshape(-1, 3).T
        return of_core[:, core.indices.to_numpy()] + of_other[:, other.indices.to_numpy()]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """The three counts of each text."""
        words, counts = split_words(texts, lower=False)
        coded = words.dictionary_encode()
        of_word = self.units(coded.dictionary)[:, coded.indices.to_numpy()]
        upto = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(of_word, axis=1)], axis=1)
        ends = np.cumsum(counts)
        return upto[:, ends] - upto[:, ends - counts]


def _counted(path: str | None, limit: int, whole):
    def run(batches):
        import public_tokenizers

        counter = TokenCounter(path or public_tokenizers.path("word_bpe_49k.json"), whole())
        for batch in batches:
            texts = byte_texts(batch["text"])
            found = [counter(texts[i:j]) for i, j in slices(texts)]
            n, pre, direct = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            sizes = pc.binary_length(batch["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, pa.array(n), pa.array(n > limit), pa.array(pre), pa.array(direct)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: its bytes, its tokens, whether these exceed ``limit``, its pre-tokens and how many of them were whole.

    ``tokenizer_path`` names a word-end BPE vocabulary in JSON, by default the one of the packing operator.  Tokens are those of the
    library for the whole text, without begin, end or truncation; special strings inside a text are one token each, as the library has
    it, and count as pre-tokens that aren't whole.  Null and empty texts have 0 bytes and 0 tokens.  Rows that repeat an id, or have none,
    each get a row; an empty table gives an empty result; other columns are ignored.  No row is shuffled; the broadcast is at most the
    vocabulary.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    whole = shared(docs.sparkSession, whole_tokens(model))
    return id_and_text(docs).mapInArrow(tidy(_counted(tokenizer_path, limit, whole)), SCHEMA)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
