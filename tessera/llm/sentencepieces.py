"""SentencePiece encoding and decoding on numpy arrays.

Texts are cut before white space into words; words not seen before advance together with all
others of their length. Hashes of all substrings up to the longest piece are looked up in the
sorted hashes of the pieces, once. From this table

* ``viterbi`` takes, position by position, the best sum of scores over the pieces that end there;
  the maxima's lengths are the backpointers (what a unigram model asks for);
* ``merges`` joins, in every word at once, the pair of neighbours whose piece has the best
  score, leftmost first (what a BPE model asks for; sums of its scores, which are ranks, give
  other ids, so Viterbi alone can't be right for it).

Characters that no piece has become the ids of their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAVING, POWERS, U64, mix, partition, ship, slices

SPACE = "▁"
#: Words in each of the two generations that a worker remembers while it has a partition (some 30 MB each), the longest
#: of them, words in one batch, longest word done by array rounds.
CACHE, CACHE_CHARS, BATCH, ROUNDS = 100_000, 40, 4096, 128
UNKNOWN = 10.0
TOP = U64(44)


class Pieces:
    """A model's pieces by hash, and both ways to encode with them."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], algorithm: str) -> None:
        """``kinds``: normal, byte, unknown, control or unused. ``algorithm``: merges or viterbi."""
        self.algorithm = algorithm
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.ids = {pieces[i]: i for i in normal}
        self.score = np.array(scores, np.float64)
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        key = np.array([self.hash_one(pieces[i]) for i in normal], U64)
        order = np.argsort(key)
        self.key, self.id = key[order], np.array(normal, np.int64)[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two pieces have one hash")
        # whether any key has a top: most substrings are told from pieces by it
        self.held = np.zeros(1 << 20, bool)
        self.held[(self.key >> TOP).astype(np.int64)] = True
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.low = float(self.score[normal].min()) - UNKNOWN if normal else -UNKNOWN
        text = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.size = np.array([len(t) for t in text])
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        lone = "\n" if not any("\n" in p for p in self.ids) else ""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.cut = re.compile(".+", re.S)
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{lone or SPACE + '+'}|{SPACE}+", re.S)
        self.forget()

    def forget(self) -> None:
        self.now: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.before = self.now

    @staticmethod
    def hash_one(s: str) -> np.uint64:
        return Pieces.prefix(np.frombuffer(s.encode("utf-32-le"), np.uint32)[None, :])[2][0, 0, len(s) - 1]

    @staticmethod
    def prefix(code: np.ndarray, longest: int = 0) -> tuple[int, int, np.ndarray]:
        """Hashes of code[:, s : s + n + 1] at [:, s, n]; past the end they are of no use."""
        w, n = code.shape
        longest = min(n, longest or n)
        up, down = POWERS.get(n + 1)
        sums = np.zeros((w, n + 1 + longest), U64)
        np.cumsum((code.astype(U64) + U64(1)) * up[:n], axis=1, out=sums[:, 1 : n + 1])
        out = np.empty((w, n, longest), U64)
        for size in range(1, longest + 1):
            out[:, :, size - 1] = mix((sums[:, size : size + n] - sums[:, :n]) * down[:n] + U64(size))
        return w, n, out

    def table(self, code: np.ndarray) -> np.ndarray:
        """Ids of the pieces at [:, start, characters - 1], or -1."""
        w, n, key = self.prefix(code, self.longest)
        key = key.ravel()
        may = np.flatnonzero(self.held[(key >> TOP).view(np.int64)])
        at = np.minimum(np.searchsorted(self.key, key[may]), len(self.key) - 1)
        hit = self.key[at] == key[may]
        found = np.full(len(key), -1, np.int64)
        found[may[hit]] = self.id[at[hit]]
        found = found.reshape(w, n, -1)
        for size in range(2, found.shape[2] + 1):
            found[:, n - size + 1 :, size - 1] = -1
        return found

    def viterbi(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the spans of each word's best path. On ties the longest last piece is taken."""
        w, n, longest = table.shape
        best = np.full((w, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((w, n + 1), np.int64)
        worth = np.where(table >= 0, self.score[np.maximum(table, 0)], -np.inf)
        worth[:, :, 0] = np.where(table[:, :, 0] >= 0, worth[:, :, 0], self.low)
        for end in range(1, n + 1):
            sizes = np.arange(min(longest, end), 0, -1)
            total = np.stack([best[:, end - s] + worth[:, end - s, s - 1] for s in sizes], 1)
            pick = total.argmax(1)
            best[:, end], back[:, end] = total[np.arange(w), pick], sizes[pick]
        ends, at, rows = np.zeros((w, n + 1), bool), np.full(w, n), np.arange(w)
        while len(rows):
            ends[rows, at[rows]] = True
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        row, end = np.nonzero(ends)
        return row, end - back[row, end], end

    def merges(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the symbols that are left when no two neighbours make a piece."""
        w, n, longest = table.shape
        start = np.tile(np.minimum(np.arange(n + 2), n), (w, 1))
        rank = np.where(table >= 0, self.score[np.maximum(table, 0)], -np.inf)
        live, row = np.arange(w), np.arange(w)[:, None]
        while len(live) and n > 1:
            s = start[live]
            a, b, c = s[:, :-2], s[:, 1:-1], s[:, 2:]
            size = c - a
            fits = (b < c) & (size <= longest)
            value = np.where(fits, rank[live[:, None], np.minimum(a, n - 1), np.minimum(size, longest) - 1], -np.inf)
            pick = value.argmax(1)
            on = value[np.arange(len(live)), pick] > -np.inf
            live, pick, s = live[on], pick[on], s[on]
            col = np.arange(n + 2)
            shifted = np.concatenate([s[:, 1:], np.full((len(s), 1), n)], 1)
            start[live] = np.where(col <= pick[:, None], s, shifted)
        row, col = np.nonzero(start[:, :-1] < start[:, 1:])
        return row, start[row, col], start[row, col + 1]

    def merge_long(self, word: str) -> list[tuple[int, int]]:
        """:meth:`merges` of one long word with a heap."""
        n = len(word)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        gone = [False] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and end[b] - a <= self.longest and (i := self.ids.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if gone[a] or end[a] != mid or right[a] >= n or end[right[a]] != stop:
                continue
            b = right[a]
            gone[b], end[a], right[a] = True, stop, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [(a, end[a]) for a in range(n) if not gone[a]]

    def spell(self, words: list[str], table: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
        """Ids of each word's spans as little-endian unsigned 32-bit integers."""
        row, start, end = spans
        ids = np.full(len(row), -1, np.int64)
        short = end - start <= table.shape[2]
        ids[short] = table[row[short], start[short], end[short] - start[short] - 1]
        cut = np.searchsorted(row, np.arange(len(words) + 1))
        raw, cut4 = ids.astype("<u4").tobytes(), (4 * cut).tolist()
        out = [raw[a:b] for a, b in zip(cut4[:-1], cut4[1:], strict=True)]
        for i in np.unique(row[ids < 0]).tolist():
            one: list[int] = []
            for k in range(cut[i], cut[i + 1]):
                if ids[k] >= 0:
                    one.append(int(ids[k]))
                else:
                    one += [self.byte[x] for x in words[i][start[k] : end[k]].encode()] if self.byte else [self.unknown]
            out[i] = np.array(one, "<u4").tobytes()
        return out

    def words(self, new: list[str]) -> Iterator[tuple[str, bytes, bytes]]:
        """(word, its ids, ids of its best sum of scores); they differ only for models that merge."""
        by_size: dict[int, list[str]] = {}
        for w in new:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            step = max(1, min(BATCH, 400_000 // (size * min(size, self.longest))))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                table = self.table(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), size))
                summed = self.spell(part, table, self.viterbi(table))
                if self.algorithm == "viterbi":
                    own = summed
                elif size <= ROUNDS:
                    own = self.spell(part, table, self.merges(table))
                else:
                    own = [self.spell([w], t[None], tuple(np.array([(0, *x) for x in self.merge_long(w)]).T))[0] for w, t in zip(part, table, strict=True)]
                yield from zip(part, own, summed, strict=True)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, and those of the best sums of scores."""
        if len(self.now[0]) > CACHE:
            self.before, self.now = self.now, ({}, {})
        own, summed = self.now
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*cut).difference(own)
        for w in new.intersection(self.before[0]):
            own[w], summed[w] = self.before[0][w], self.before[1][w]
        long: list[str] = []
        for w, a, b in self.words([w for w in new if w not in own]):
            own[w], summed[w] = a, b
            if len(w) > CACHE_CHARS:
                long.append(w)
        out = [(b"".join(map(own.__getitem__, words)), b"".join(map(summed.__getitem__, words))) for words in cut]
        for w in long:
            del own[w], summed[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; the space put before the text goes."""
        size = self.size[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.bytes[np.repeat(self.at[ids], size) + step].tobytes().removeprefix(b" ")


@lru_cache(2)
def load(path: str, algorithm: str) -> Pieces:
    """The pieces of a model file; a bare name is looked up among the installed public tokenizers."""
    import sentencepiece

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(sp.get_piece_size())
    kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in n]
    out = Pieces([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], kinds, algorithm)
    LEAVING.append(out.forget)
    return out


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", algorithm: str = "merges") -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit), best_sum_ids and decoded of every row.

    Models with identity normalisation and a space put before each text. ``ids`` are those of the model's own
    ``algorithm``; ``best_sum_ids`` the Viterbi path of the highest sum of scores. Null and empty texts have no ids.
    Rows with null or repeated doc_id are texts like others; of equally good merges the leftmost comes first, of equal
    sums the one with the longest last piece is taken; an empty table gives an empty result; whole texts
    are encoded; columns other than doc_id and text are not read, so their names can't clash.
    """
    ship(docs.sparkSession)

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = load(model, algorithm)
            for part in slices(batch, "text"):
                pairs = pieces.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = [pieces.decode(np.frombuffer(a, "<u4")).decode(errors="replace") for a, _ in pairs]
                arrays = [part.column("doc_id"), part.column("text"), pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "ids", "best_sum_ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, ids binary, best_sum_ids binary, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of ids and their CRC-32, the same of the best sum of scores, and whether decoding gives the text back."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda c: (F.octet_length(c) / 4).cast("long")
    return rows.select(
        "doc_id", n("ids").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), n("best_sum_ids").alias("n_best_sum"), F.crc32("best_sum_ids").alias("best_sum_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
