"""Best-fit packing of token sequences by linear grouping.

Only a histogram of piece lengths (at most ``capacity`` rows, however large the
corpus) reaches the driver, where the packing is planned:

1. large pieces, sorted by length, are cut by rank into groups of equal cardinality and
   rounded up to the longest of their group;
2. the few sizes are packed by configurations: a linear program by column generation,
   its prices' best configuration found by a knapsack over the capacity;
3. whole multiples of the configurations are filled with actual pieces, longest first;
4. what is left and all small pieces go best-fit into the room that remains;
5. of a few such plans and plain best-fit decreasing the one of fewest sequences is taken.

Bins that look alike are one run, so a plan is a list of intervals: of the pieces of a
length, ranks ``first`` to ``first + n`` go to sequences ``base`` ... at an offset. Ranks
are counted in three steps (in a bucket, over the buckets of a stretch, over stretches), so no length is one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partition, slices
from .tokens import encoder

CAPACITY = 2048
#: Groups of large lengths, and the shares of the capacity above which a length may be large; each is tried.
GROUPS, SHARES = 48, (1 / 6, 1 / 4, 1 / 3)
#: Rows of a bucket in which ranks are counted, and buckets of a stretch.
BUCKET_ROWS, STRETCH = 4096, 1024
END = 0


def best_configuration(size: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worth of the dearest set of pieces that fits, and how many it has of each size; level by level of the number of pieces."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):
        value = np.full((len(size), capacity + 1), -np.inf)
        for i, s in enumerate(size.tolist()):
            value[i, s:] = best[: capacity + 1 - s] + price[i]
        pick = value.argmax(0)
        top = value[pick, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    count, c = np.zeros(len(size)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            count[pick[c]] += 1
            c -= int(size[pick[c]])
    return float(best[capacity]), count


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], float]]:
    """[(pieces of each size, how often)] of a fractional packing with fewest bins; sizes distinct, demands positive."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    b, size = np.array(demand, float), np.array(sizes)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth, column = best_configuration(size, inverse.sum(0), capacity)
        if worth <= 1 + 1e-9:
            break
        x, step = inverse @ b, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.inv(basis) @ b
    return [([int(round(a)) for a in basis[:, j]], float(x[j])) for j in range(k)]


def groups_by_rank(histogram: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Pieces as [length, count], longest first, in ``groups`` groups of equal cardinality; a length may be in several."""
    quota = max(1, -(-sum(c for _, c in histogram) // groups))
    out, free = [], 0
    for length, count in histogram:
        while count:
            if not free:
                out.append([])
                free = quota
            n = min(count, free)
            out[-1].append([length, n])
            count, free = count - n, free - n
    return out


class Plan:
    """``slots[length]``: rows (first rank, count, first sequence, offset) of the packing of fewest ``sequences``.

    Pieces count as large from each of ``shares`` of the capacity in turn, and from none, which is plain best-fit decreasing.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[float, ...] = SHARES) -> None:
        tried = [Attempt(histogram, capacity, groups, share) for share in (*shares, 1.0)]
        best = min(tried, key=lambda one: one.sequences)
        self.sequences, self.slots = best.sequences, best.slots


class Attempt:
    """One packing, where pieces of more than ``large`` of the capacity are grouped."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, large: float) -> None:
        self.capacity, self.sequences = capacity, 0
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.next = dict.fromkeys(histogram, 0)
        self.left = {n: c for n, c in histogram.items() if c}
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.full(capacity)
        self.grouped([n for n in sorted(self.left, reverse=True) if n > large * capacity], groups)
        for n in sorted(self.left, reverse=True):
            self.best_fit(n)

    def put(self, length: int, count: int, base: int, used: int) -> None:
        self.slots.setdefault(length, []).append((self.next[length], count, base, used))
        self.next[length] += count
        self.left[length] -= count

    def full(self, length: int) -> None:
        if count := self.left.get(length, 0):
            self.put(length, count, self.sequences, 0)
            self.sequences += count

    def grouped(self, lengths: list[int], groups: int) -> None:
        members = groups_by_rank([(n, self.left[n]) for n in lengths if self.left[n]], groups)
        if not members:
            return
        # groups of one length are one size to the program
        same: dict[int, list[int]] = {}
        for g, m in enumerate(members):
            same.setdefault(m[0][0], []).append(g)
        pooled = [[piece for g in own for piece in members[g]] for own in same.values()]
        sizes, demand = list(same), [sum(c for _, c in m) for m in pooled]
        for counts, times in configurations(sizes, demand, self.capacity):
            bins = int(times + 1e-6)
            if bins <= 0:
                continue
            runs = [(self.sequences, bins, 0)]
            self.sequences += bins
            for g, count in enumerate(counts):
                for _ in range(count):
                    runs = self.substitute(runs, pooled[g])
            for base, n, used in runs:
                self.room[self.capacity - used].append((base, n))

    def substitute(self, runs: list[tuple[int, int, int]], pieces: list[list[int]]) -> list[tuple[int, int, int]]:
        """One actual piece of a group into each bin, longest pieces first; a run is cut where the length changes."""
        out = []
        for base, n, used in runs:
            for piece in pieces:
                if n and (m := min(n, piece[1])):
                    self.put(piece[0], m, base, used)
                    piece[1] -= m
                    out.append((base, m, used + piece[0]))
                    base, n = base + m, n - m
            if n:
                out.append((base, n, used))
        return out

    def best_fit(self, length: int) -> None:
        while count := self.left[length]:
            room = next((r for r in range(length, self.capacity + 1) if self.room[r]), 0)
            if not room:
                room, bins = self.capacity, -(-count // (self.capacity // length))
                self.room[room].append((self.sequences, bins))
                self.sequences += bins
            base, n = self.room[room].pop()
            each = room // length
            bins = min(n, count // each)
            used = self.capacity - room
            if bins:
                for j in range(each):
                    self.put(length, bins, base, used + j * length)
                self.room[room - each * length].append((base, bins))
            elif count:
                for j in range(count):
                    self.put(length, 1, base, used + j * length)
                self.room[room - count * length].append((base, 1))
                bins = 1
            if n > bins:
                self.room[room].append((base + bins, n - bins))


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the closing id, cut where it is longer."""

    @partition
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of ``docs`` placed.

    Null and empty texts are the closing id alone; longer texts than ``capacity`` ids are cut,
    nothing else is. A special token that a text spells out is its one id, as plain ``tokenizers`` have it.
    Rows with null or repeated doc_id are packed like others; which of equal pieces (doc_id, piece and CRC) goes
    where is open, as they are interchangeable; an empty table gives an empty result; columns other than doc_id
    and text are not read, so their names can't clash.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    plan = Plan(histogram, capacity)
    table = np.array(sorted((n << 40 | first, base - first, offset) for n, rows in plan.slots.items() for first, _, base, offset in rows), np.int64).reshape(-1, 3)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    of = max(1, -(-sum(histogram.values()) // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(of)))
    counts = cut.groupBy("bucket", "length").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("stretch", "length").agg(F.sum("n").alias("n")).select("stretch", "length", earlier(Window.partitionBy("length").orderBy("stretch")).alias("base"))
    counts = counts.withColumn("inside", earlier(Window.partitionBy("length", "stretch").orderBy("bucket")))
    before = counts.join(stretches, ["stretch", "length"]).select("bucket", "length", (F.col("base") + F.col("inside")).alias("before"))
    ranked = cut.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("row") - 1).drop("bucket", "before", "row")

    @partition
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rank = pdf["rank"].to_numpy()
            slot = shared.value[np.searchsorted(shared.value[:, 0], (pdf["length"].to_numpy() << 40) + rank, "right") - 1]
            pdf["sequence_id"], pdf["offset"] = slot[:, 1] + rank, slot[:, 2]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
