"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

1. A character language model (trigrams of letters) is counted over all documents.
2. Words that look disguised - digits or signs between letters, letters spaced out, letters
   repeated - become lattices of what each character may stand for. The Viterbi path under
   the language model, less the channel's costs, is the restored word; texts are scored with
   their restored words beside the written ones.
3. A classifier is fitted on a bounded sample of labelled rows: evidence of a word is the
   log-odds of its best feature (the word, or its first 3 to 7 bytes), a text's evidence is its
   strongest word and how many strong words it has; a logistic curve, fitted on rows whose counts
   were left out, makes it a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FINE_BYTES, POWERS, U64, mix, partition, prefix_hashes, ship, slices, text_bytes
from .shingles import LOWER, word_spans

#: Labelled rows that a classifier is fitted on at most: those of the least hashes of doc_id.
SAMPLE = 40_000
#: Feature bins; bytes of the word beginnings; documents with label 1 that a feature needs.
BINS, BEGINNINGS, SUPPORT = 1 << 20, (3, 4, 5, 6, 7), 4
#: Evidence from which a word counts as strong, and the score from which a text is predicted toxic.
STRONG, THRESHOLD = 2.5, 0.3
#: Letters of the language model: 0 is a word's edge, 1-26 are a-z, 27 any other letter.
LETTERS = 28

# What signs and digits are written for, and the channel's costs in nats.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "%": "", "#": "", "&": "",
    "*": "", ".": "", "-": "", "_": "", " ": "", ",": "", "'": "", "~": "", "^": "", "/": "", "\\": "",
}
SUBSTITUTE, LEAVE_OUT, REPEAT, DROP = 0.7, 0.4, 0.2, 6.0

SIGNS = "".join(re.escape(c) for c in STANDS_FOR if not c.isdigit() and c != " ")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_][ .\-_*]{{1,2}}){{2,}}[^\W_](?![^\W_])")
DISGUISED = re.compile(
    rf"(?<![^\W_])(?:(?=[{SIGNS}\d]{{0,64}}[^\W\d_])[^\W_]{{0,64}}?(?:[^\W\d_][{SIGNS}\d]|[\d@$!|+€£¡(])(?:[^\W_]|[{SIGNS}]){{0,64}}|[^\W_]{{0,64}}?([^\W\d_])\1\1[^\W_]{{0,64}})"
)
#: A run of letters, digits and signs; the signs within it that stand for no letter; the longest run that is one word to DISGUISED.
CHUNK = re.compile(rf"(?:[^\W_]|[{SIGNS}])+")
JOINING = re.compile("[" + "".join(re.escape(c) for c, s in STANDS_FOR.items() if not s and c != " ") + "]+")
WORD = 64
TRIPLE = re.compile(r"([^\W\d_])\1\1")
DOUBLED = re.compile(r"(.)\1", re.I)
#: Bytes of signs that stand for a letter, of signs that stand for none, of separators in SPACED, of ASCII letters and digits.
STANDS, JOINS, APART, PLAIN = np.zeros((4, 256), bool)
STANDS[[ord(c) for c, s in STANDS_FOR.items() if s and c.isascii()]] = True
JOINS[[ord(c) for c, s in STANDS_FOR.items() if not s and c != " "]] = True
APART[[ord(c) for c in " .-_*"]] = True
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True
#: First bytes of characters of two bytes that are letters or no part of words: Latin, Greek and Cyrillic. All others may be signs or digits.
TWO, OTHER = np.zeros((2, 256), bool)
TWO[0xC3:0xCA] = TWO[0xCE:0xD4] = True
OTHER[0xC2:] = ~TWO[0xC2:]
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = ALPHA[128:] = True
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27


@lru_cache(10_000)
def letter_class(c: str) -> int:
    c = unicodedata.normalize("NFD", c)[0].lower()
    return ord(c) - 96 if "a" <= c <= "z" else 27


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, as LETTERS x LETTERS x LETTERS. At most that many rows are collected."""

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text", FINE_BYTES):
                data, at = text_bytes(part.column("text"))
                code = CLASS[data]
                code[at[(at < len(data))]] = 0
                if len(code) > 2:
                    key = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
                    total += np.bincount(key, minlength=LETTERS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3)
    for r in rows:
        out[r.gram] = r.n
    return out.reshape(LETTERS, LETTERS, LETTERS)


class Channel:
    """Restores words by the Viterbi path through their lattice."""

    def __init__(self, counts: np.ndarray) -> None:
        smooth = counts + 0.05
        two = smooth.sum(2, keepdims=True)
        self.log = np.log(0.9 * smooth / two + 0.1 * smooth.sum((0, 1)) / smooth.sum()).tolist()
        self.seen: dict[str, str] = {}

    def restore(self, word: str) -> str:
        if (out := self.seen.get(word)) is None:
            if len(self.seen) > 200_000:
                self.seen = {}
            out = self.seen[word] = self.viterbi(word)
        return out

    def viterbi(self, word: str) -> str:
        """States are the last two letters; each character is kept, replaced, left out or taken as a repetition."""
        log = self.log
        best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c in word.lower():
            step: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            stands = STANDS_FOR.get(c)
            for (x, y, last), (score, text) in best.items():
                options = []
                if c.isalpha():
                    if c != last:
                        options.append((c, 0.0))
                    else:
                        options += [(c, 0.0), ("", -REPEAT)]
                elif stands is not None:
                    options += [(s, -SUBSTITUTE) for s in stands]
                    options.append(("", -LEAVE_OUT if not stands else -DROP))
                else:
                    options.append(("", -DROP))
                for s, cost in options:
                    if s:
                        k = letter_class(s)
                        to, value = (y, k, s), score + cost + log[x][y][k]
                        found = (text, s)
                    else:
                        to, value, found = (x, y, last), score + cost, text
                    if to not in step or value > step[to][0]:
                        step[to] = (value, found)
            best = step
        # letters are linked from the last to the first, so long words take linear time
        at, out = max(((v + log[x][y][0], t) for (x, y, _), (v, t) in best.items()), key=lambda found: found[0])[1], []
        while at is not None:
            at, s = at
            out.append(s)
        return "".join(reversed(out))

    def restored(self, text: str) -> str:
        """The text's disguised words, restored, between spaces."""
        out = []
        for m in SPACED.finditer(text):
            out.append(self.viterbi(m[0]) if len(m[0]) > WORD else self.restore(m[0]))
        for chunk in CHUNK.finditer(text):
            if len(chunk[0]) > WORD:
                found = self.long(chunk[0])
            else:
                found = (m[0].strip(".,-_'*%#&~^/\\ ") for m in DISGUISED.finditer(chunk[0]))
                # letters alone without a doubled one are the written word
                found = (w for w in found if len(w) > 2 and (not w.isalpha() or len(set(w)) < len(w) - 1 and DOUBLED.search(w)))
            for w in found:
                w = self.viterbi(w) if len(w) > WORD else self.restore(w)
                out.append(w)
                squeezed = re.sub(r"(.)\1+", r"\1", w)
                if squeezed != w:
                    out.append(squeezed)
        return " ".join(out)

    def long(self, chunk: str) -> Iterator[str]:
        """The words of a chunk of more than WORD characters: what lies between joining signs, as it is, each two
        neighbours together, and runs of pieces of up to three characters ('tr-a-sh'). Repetitions are cut to two first."""
        if chunk.isalpha() and not TRIPLE.search(chunk):
            return
        pieces = [p for p in JOINING.split(re.sub(r"(.)\1{2,}", r"\1\1", chunk)) if p]
        run: list[str] = []
        for k, piece in enumerate(pieces):
            yield from self.worth(piece)
            if k:
                yield from self.worth(pieces[k - 1] + piece)
            if len(piece) <= 3:
                run.append(piece)
            if len(piece) > 3 or k == len(pieces) - 1:
                if len(run) > 2:
                    yield from self.worth("".join(run))
                run = []

    @staticmethod
    def worth(word: str) -> Iterator[str]:
        if len(word) > 2 and any(c.isalpha() for c in word):
            yield word


def apart(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of letters or digits that may be inner ones of a match of SPACED: separators around them, then characters that may be on their own."""
    d = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(8, np.uint8)])
    gap = APART[d]
    where = np.flatnonzero(PLAIN[d[1:-1]] & gap[:-2] & gap[2:]) + 1
    size = np.ones(len(where), np.int64)
    high = np.flatnonzero(gap[:-1] & (d[1:] >= 0xC2)) + 1
    if len(high):
        long = 2 + (d[high] >= 0xE0) + (d[high] >= 0xF0)
        fits = gap[high + long]
        where, size = np.r_[where, high[fits]], np.r_[size, long[fits]]
    before, after = where - 2 - gap[where - 2], where + size + 1 + gap[where + size + 1]
    edge = np.zeros(len(d) + 1, bool)
    edge[at + 4] = True
    own = (PLAIN[d[before]] & (~PLAIN[d[before - 1]] | edge[before])) | (d[before] >= 128)
    own &= (PLAIN[d[after]] & (~PLAIN[d[after + 1]] | edge[after + 1])) | (d[after] >= 128)
    return np.sort(where[own]) - 4


def suspects(data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All words in which DISGUISED may find something, and runs of words in which SPACED may; the text of each.

    Such words have letters and a sign or digit that stands for one, a sign before a letter, a doubled letter and
    a sign, three equal letters, or characters that these bytes can't tell.
    """
    start, end, text = word_spans(data, at)
    if len(data) < 3 or not len(start):
        return [], np.zeros(0, np.int64)

    def having(hit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        out[np.maximum(start.searchsorted(np.flatnonzero(hit), "right") - 1, 0)] = True
        return out

    alpha, joins, low = ALPHA[data], JOINS[data], LOWER[data]
    letters = np.r_[0, np.cumsum(alpha, dtype=np.int64)]
    equal = alpha[1:] & (low[1:] == low[:-1])
    odd = having(STANDS[data]) & (letters[end] > letters[start])
    odd |= having((joins[:-1] & alpha[1:]) | np.r_[equal[1:] & equal[:-1], False])
    twice = having(equal)
    if (data >= 128).any():
        odd |= having(OTHER[data])
        lead = np.flatnonzero(TWO[data[:-3]] & TWO[data[2:-1]])
        twice[start.searchsorted(lead, "right") - 1] = True
        lead = lead[lead < len(data) - 5]
        same = (data[lead] == data[lead + 2]) & (data[lead] == data[lead + 4]) & (data[lead + 1] == data[lead + 3]) & (data[lead + 1] == data[lead + 5])
        odd[start.searchsorted(lead[same], "right") - 1] = True
    odd |= twice & having(joins)
    # a run has the words of inner letters and those beside them
    inner = np.unique(start.searchsorted(apart(data, at), "right") - 1)
    run = np.zeros(len(start) + 2, bool)
    run[inner] = run[inner + 1] = run[inner + 2] = True
    run = run[1:-1]
    odd &= ~run
    first = np.flatnonzero(run & np.r_[True, ~run[:-1] | (text[1:] != text[:-1])])
    last = np.flatnonzero(run & np.r_[~run[1:] | (text[1:] != text[:-1]), True])
    a, b = np.r_[np.flatnonzero(odd), first], np.r_[np.flatnonzero(odd), last]
    raw = data.tobytes()
    return [raw[s:e].decode(errors="ignore") for s, e in zip(start[a].tolist(), end[b].tolist(), strict=True)], text[a]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, text): a row of bins for each word (itself, its beginnings; -1 where it is shorter) and the word's text."""
    low = LOWER[data]
    start, end, text = word_spans(data, at)
    letter = ALPHA[data] | (data >= 48) & (data < 58)
    # words without the signs before and after them
    run = np.cumsum(np.r_[0, letter.astype(np.int64)])
    has = run[end] > run[start]
    start, end, text = start[has], end[has], text[has]
    at_letter = np.flatnonzero(letter)
    if len(at_letter):
        start = at_letter[run[start]]
        end = at_letter[run[end] - 1] + 1
    sums, down = prefix_hashes(low), POWERS.get(len(data) + 1)[1]
    out = np.full((len(start), 1 + len(BEGINNINGS)), -1, np.int64)
    for k, size in enumerate((None, *BEGINNINGS)):
        stop = end if size is None else start + size
        fits = np.ones(len(start), bool) if size is None else stop < end
        s, e = start[fits], stop[fits]
        key = mix((sums[e] - sums[s]) * down[s] + U64(0 if size is None else size * 0x9E37))
        out[fits, k] = (key >> U64(44)).astype(np.int64)
    return out, text


def worded(part: pa.RecordBatch, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """:func:`features` of the texts of a batch with their restored words after them."""
    data, at = text_bytes(part.column("text"))
    bins, text = features(data, at)
    words, owner = suspects(data, at)
    if not words:
        return bins, text
    bins2, text2 = features(*text_bytes(pa.array([channel.restored(w) for w in words], pa.string())))
    order = np.argsort(np.r_[text, owner[text2]], kind="stable")
    return np.concatenate([bins, bins2])[order], np.r_[text, owner[text2]][order]


def evidence(bins: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each text: its strongest word, and the logarithm of one more than its strong words."""
    word = np.where(bins >= 0, weight[bins], 0).max(1, initial=0)
    out = np.zeros((n, 2))
    np.maximum.at(out[:, 0], text, word)
    out[:, 1] = np.log1p(np.bincount(text[word > STRONG], minlength=n))
    return out


def sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic): labelled rows outside the held-out quarter, ``most`` of them at most, by the hash of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter trigram counts, weight of each bin, the curve's constant and two slopes)."""
    spark = docs.sparkSession
    ship(spark)
    counts = letter_counts(docs)
    chosen = spark.createDataFrame(sample(labels, most).toPandas(), "doc_id long, toxic int")  # bounded by ``most``
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)))
    counted, curve_rows = rows.where("fold > 0"), rows.where("fold = 0")

    def count(which: np.ndarray | None):
        """Documents that have a bin, by bin; with ``which`` only of these bins."""

        @partition
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            channel, total, docs_seen = Channel(counts), np.zeros(BINS, np.int64), 0
            for batch in batches:
                for part in slices(batch, "text", FINE_BYTES):
                    bins, text = worded(part, channel)
                    keep = bins >= 0
                    if which is not None:
                        keep &= which[bins]
                    key = np.unique(np.broadcast_to(text[:, None], bins.shape)[keep] * BINS + bins[keep])
                    total += np.bincount(key % BINS, minlength=BINS)
                    docs_seen += part.num_rows
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int32()), pa.array(np.r_[total[some], docs_seen], pa.int64())], ["bin", "n"])

        return run

    sums = lambda df, which: df.select("text").mapInArrow(count(which), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    pos, total_pos = _dense(sums(counted.where("toxic = 1"), None).where(f"bin < 0 OR n >= {SUPPORT}"))
    neg, total_neg = _dense(sums(counted.where("toxic = 0"), pos > 0))
    weight = np.log((pos + 0.2) / (total_pos + 1)) - np.log((neg + 0.5) / (total_neg + 1))
    weight = np.where(pos > 0, np.maximum(weight, 0) * pos / (pos + 2), 0).astype(np.float32)

    @partition
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(counts)
        for batch in batches:
            for part in slices(batch, "text", FINE_BYTES):
                e = evidence(*worded(part, channel), weight, part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), part.column("toxic")], ["a", "b", "toxic"])

    seen = curve_rows.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic int").toPandas()  # bounded by ``most``
    return counts, weight, logistic(seen[["a", "b"]].to_numpy(), seen["toxic"].to_numpy().astype(float))


def _dense(df: DataFrame) -> tuple[np.ndarray, int]:
    out, n = np.zeros(BINS), 0
    for r in df.collect():  # one row for each bin at most
        if r.bin < 0:
            n = r.n
        else:
            out[r.bin] = r.n
    return out, n


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Constant and slopes by Newton's method with a ridge on the slopes; a step is halved until the loss falls, so classes that a line parts do no harm."""
    if not len(x):
        return np.array([-3.0, 0.5, 0.5])
    x = np.column_stack([np.ones(len(x)), x])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    beta = np.r_[np.log(rate / (1 - rate)), np.zeros(x.shape[1] - 1)]
    penalty = ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + b @ penalty @ b / 2)

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        beta = beta + size * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * max(1, abs(now)):
            break
    return beta


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, and the columns ``carry``.

    Only texts are scored; labels are learned from at most ``most`` rows outside the held-out quarter (crc32 of
    doc_id as text, modulo 4, is 2). Null and empty texts get the score of no evidence; a null doc_id isn't held
    out; rows of a repeated doc_id are scored each by its own text; without labels scores stay low; an empty
    table gives an empty result. Whole texts are read; other columns are not.
    """
    counts, weight, beta = fit(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast((counts, weight, beta))  # bounded by BINS and LETTERS
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id_"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"{c}_carried") for c in carry if c != "text"])
    fields = [f for f in source.schema.fields if f.name.endswith("_carried") or (f.name == "text" and "text" in carry)]

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weight, beta = shared.value
        channel = Channel(counts)
        for batch in batches:
            for part in slices(batch, "text", FINE_BYTES):
                e = evidence(*worded(part, channel), weight, part.num_rows)
                z = beta[0] + e @ beta[1:]
                yield pa.RecordBatch.from_arrays([part.column("doc_id_"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), *(part.column(f.name) for f in fields)], ["doc_id", "score", *(f.name.removesuffix("_carried") for f in fields)])

    ddl = "doc_id long, score double" + "".join(f", `{f.name.removesuffix('_carried')}` {f.dataType.simpleString()}" for f in fields)
    rows = source.mapInArrow(run, ddl)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *carry)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_toxicity": op5_toxicity}
