"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text into pieces maximises the sum of their scores.  The encoder reads characters one by one and
keeps scores for the boundaries that a piece can still start or end at, no more than the longest piece is long.  As soon as
the back-pointer paths of all these meet in one boundary, the ids before it are committed, and characters and back-pointers
up to it are dropped; this is tested again after each longest piece's length at the latest.  (What waits for a commit has no
bound of its own: a text whose paths stayed apart would be held, as a cut before they meet could be wrong.)  Characters
without a piece cost UNKNOWN and become byte pieces.  Ties go to the longer last piece.

Every segmentation has a boundary between words, so words are committed one by one; the short ones of a batch run side by
side, a step of the programme for all of equal length at once.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import id_and_text, spread, table

SPACE = "▁"
CACHE = 200_000  # distinct words whose ids a task keeps
SHORT = 40  # characters of a word that runs beside others
ROOM = 2_500_000  # characters of a batch that are encoded at once
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a vocabulary file with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.score = {self.text[i]: (model.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.score), default=1)
        self.starts = {p[:k] for p in self.score for k in range(1, len(p))}  # what a longer piece begins with
        finite = [s for s, _ in self.score.values() if s > -1e8]
        self.unknown = min(finite, default=0.0) - 10
        # Cuts that every segmentation must make: before a space mark that follows something else, if no piece spans it;
        # around a line feed, if no piece holds one.
        self.mark_cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.line_cuts = not any("\n" in p for p in self.score)

    def stream(self, chars) -> "list[list[int]]":
        """Commits of ids for an iterable of characters; joined, they are the best segmentation's ids."""
        window: list[str] = []  # characters since the last commit
        best = deque([0.0])  # scores of the boundaries from `tried` on: the longest piece's length and one, at most
        back = [(-1, -1)]  # by boundary since the last commit: boundary before, and id
        furthest = 0  # the furthest boundary that a piece tried so far reaches
        commits, tried, test_at, ended = [], 0, self.longest, False
        source = iter(chars)
        while True:
            # enough characters to try all pieces that start at boundary `tried`
            while not ended and len(window) < tried + self.longest:
                c = next(source, None)
                if c is None:
                    ended = True
                else:
                    window.append(c)
            if tried == len(window):
                break
            piece = ""
            for end in range(tried, min(len(window), tried + self.longest)):
                piece += window[end]
                s, i = self.score.get(piece, (None, -1))
                if s is None and len(piece) == 1:
                    s = self.unknown
                if s is not None:
                    to = end + 1
                    while tried + len(best) <= to:
                        best.append(-float("inf"))
                        back.append((-1, -1))
                    if best[0] + s > best[to - tried]:
                        best[to - tried], back[to] = best[0] + s, (tried, i)
                    furthest = max(furthest, to)
                if piece not in self.starts:
                    break
            tried += 1
            best.popleft()
            meet = 0
            if furthest == tried:
                meet = tried
            elif tried >= test_at:
                meet, test_at = self._meeting(back, tried, furthest), tried + self.longest
            if meet:
                commits.append(self._path(back, window, meet))
                window, back = window[meet:], [(a - meet, i) for a, i in back[meet:]]
                back[0] = (-1, -1)
                tried, furthest, test_at = tried - meet, furthest - meet, max(1, test_at - meet)
        return commits

    @staticmethod
    def _meeting(back: list[tuple[int, int]], tried: int, furthest: int) -> int:
        """The last boundary that the paths of all open boundaries share; 0 if that's only the first."""
        open_ = {p for p in range(tried, furthest + 1) if back[p][0] >= 0}
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(back[last][0])
        return open_.pop() if open_ else 0

    def _path(self, back, window, end: int) -> list[int]:
        ids = []
        while end:
            start, i = back[end]
            ids += [i] if i >= 0 else [self.bytes.get(b, 0) for b in reversed(window[start].encode())]
            end = start
        return ids[::-1]

    def _lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all pieces and of what pieces begin with, sorted; each one's id (-1: no piece), score, and whether a longer piece begins so."""
        if not hasattr(self, "_table"):
            texts = sorted(self.score.keys() | self.starts)
            hashes = np.zeros(len(texts), np.uint64)
            for k, t in enumerate(texts):
                h = 0
                for c in t:
                    h = (h * int(FACTOR) + ord(c) + 1) & (1 << 64) - 1
                hashes[k] = h
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two pieces share a hash")
            order = np.argsort(hashes)
            ids = np.array([self.score.get(t, (0, -1))[1] for t in texts])
            scores = np.array([self.score.get(t, (-np.inf, -1))[0] for t in texts])
            self._table = hashes[order], ids[order], scores[order], np.array([t in self.starts for t in texts])[order]
        return self._table

    def together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many segments in a row and how many are each one's; ``stream`` for all of equal length side by side."""
        hashes, ids, scores, longer = self._lookup()
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        at = np.cumsum(lengths) - lengths
        owners, found = [], []
        alone = np.flatnonzero(lengths > SHORT).tolist()
        for n in np.unique(lengths[lengths <= SHORT]).tolist():
            rows = np.flatnonzero(lengths == n)
            own = chars[at[rows][:, None] + np.arange(n)]
            best = np.full((len(rows), n + 1), -np.inf)
            best[:, 0] = 0
            size, piece = np.zeros((len(rows), n + 1), np.int8), np.full((len(rows), n + 1), -1, np.int32)
            score_of = np.full((min(n, self.longest), len(rows), n), -np.inf)
            id_of = np.full(score_of.shape, -1, np.int32)
            r, c = np.divmod(np.arange(own.size), n)
            h = np.zeros(len(r), np.uint64)
            for k in range(len(score_of)):
                h = h * FACTOR + own[r, c + k] + np.uint64(1)
                slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[slot] == h
                score_of[k, r, c] = np.where(known, scores[slot], -np.inf)
                id_of[k, r, c] = np.where(known, ids[slot], -1)
                on = known & longer[slot] & (c + k + 1 < n)
                r, c, h = r[on], c[on], h[on]
            unknown = id_of[0] < 0
            score_of[0][unknown] = self.unknown
            for start in range(n):
                for k in range(min(len(score_of), n - start)):
                    to = start + k + 1
                    value = best[:, start] + score_of[k, :, start]
                    better = value > best[:, to]
                    best[better, to] = value[better]
                    size[better, to] = k + 1
                    piece[better, to] = id_of[k, better, start]
            out = np.full((len(rows), n), -2, np.int32)
            end, every = np.full(len(rows), n), np.arange(len(rows))
            for k in range(n - 1, -1, -1):
                open_ = end > 0
                out[open_, k] = piece[open_, end[open_]]
                end = end - np.where(open_, size[every, end], 0)
            bad = (out == -1).any(axis=1)  # characters that become bytes
            alone += rows[bad].tolist()
            keep = (out > -2) & ~bad[:, None]
            owners.append(np.repeat(rows, keep.sum(axis=1)))
            found.append(out[keep])
        for k in alone:
            own = [i for c in self.stream(segments[k]) for i in c]
            owners.append(np.full(len(own), k))
            found.append(np.array(own, np.int32))
        owner, pool = np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.int32), *found])
        return pool[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(segments))

    def exact(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which segments their ids decode to."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        want = [s.replace(SPACE, " ").encode() for s in segments]
        got = b"".join(map(self._raw.__getitem__, ids.tolist()))
        ends = np.cumsum(np.fromiter(map(len, self._raw), np.int64, len(self._raw))[ids])
        last = np.cumsum(sizes)
        size = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[last]]))
        if got == b"".join(want) and (size == np.fromiter(map(len, want), np.int64, len(want))).all():
            return np.ones(len(segments), bool)
        begin = np.cumsum(size) - size
        return np.array([got[a : a + n] == w for a, n, w in zip(begin.tolist(), size.tolist(), want)], bool)

    def segments(self, text: str) -> list[str]:
        """A text, marks for spaces and one put in front, cut where every segmentation has a boundary."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.mark_cuts:
            return [marked]
        return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.line_cuts else f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for ids in self.stream(s) for i in ids] if text else []

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined, space marks turned back, the one in front taken off."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


class Known:
    """Ids of segments, each distinct one encoded once; up to CACHE short ones are kept for the next batch."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.sizes, self.fine = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all segments in a row, how many are each one's, and whether they decode to it."""
        coded = pa.array(segments, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.index) > CACHE:
            self.clear()
        at = np.fromiter((self.index.get(s, -1) for s in distinct), np.int64, len(distinct))
        fresh = np.flatnonzero(at < 0)
        new = [distinct[k] for k in fresh.tolist()]
        ids, n = self.pieces.together(new)
        pool, sizes, fine = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, n]), np.concatenate([self.fine, self.pieces.exact(new, ids, n)])
        at[fresh] = len(self.sizes) + np.arange(len(new))
        first = np.cumsum(sizes) - sizes
        place = at[coded.indices.to_numpy()]
        out = pool[spread(first[place], sizes[place])], sizes[place], fine[place]
        if sum(map(len, new)) < 2 * ROOM:
            self.index |= {s: len(self.sizes) + k for k, s in enumerate(new)}
            self.pool, self.sizes, self.fine = pool, sizes, fine
        return out


def _loaded(path: str | None) -> Pieces:
    import public_tokenizers

    return Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, exact`` for every row of ``docs(doc_id, text)``; ``exact``: decoding gives the text back.

    Null and empty texts have no ids.  A text that holds the space mark itself decodes to a space there: not exact.  Texts
    of any length are encoded whole.  Repeated rows come back each; an empty table gives an empty result; other columns are
    ignored.
    """

    def run(batches):
        pieces = _loaded(model_path)
        known = Known(pieces)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            a = 0
            while a < len(texts):
                b, room = a, ROOM
                while b < len(texts) and (b == a or len(texts[b]) <= room):
                    room -= len(texts[b])
                    b += 1
                segments: list[str] = []
                counts = np.zeros(b - a, np.int64)
                for k in range(a, b):
                    own = pieces.segments(texts[k]) if texts[k] else ()
                    counts[k - a] = len(own)
                    segments += own
                ids, sizes, fine = known(segments)
                at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                exact = (np.bincount(np.repeat(np.arange(b - a), counts)[~fine], minlength=b - a) == 0) & np.fromiter((SPACE not in t for t in texts[a:b]), bool, b - a)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(exact)], names=["doc_id", "ids", "exact"])
                a = b

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, exact boolean")


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` for every row of ``rows(doc_id, ids)``; null ids give a null text."""

    def run(batches):
        pieces = _loaded(model_path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))

    def digest(batches):
        for batch in batches:
            ids, at = batch["ids"].values.to_numpy(), batch["ids"].offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].astype(np.uint32).tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), batch["exact"]], names=["doc_id", "n_ids", "ids_crc32", "exact"])

    return found.mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, exact boolean")
