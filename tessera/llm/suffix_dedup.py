"""Removal of passages that repeat: every byte covered by a string of ``length`` bytes found anywhere else.

Equal strings must meet in one suffix array although texts are many and apart:

1. The gram of least hash (the leftmost of equal ones) among the 48-byte grams of a ``length``-byte
   window is its anchor. Equal windows have equal anchors, neighbouring windows mostly the same
   one; windows in a row with one anchor are a run. An anchor met in one place only can't belong to a repeat: its runs are done with.
2. The bytes of the other runs go to the shard of their anchor, equal ones once with their
   number. A shard's suffix array (induced sorting) and permuted common prefixes show which windows
   also start elsewhere in the shard; a run that came twice repeats as a whole.
3. An anchor in very many places would make one shard; its windows are told apart by 128-bit
   fingerprints instead, dealt out one by one and combined before the shuffle.
4. Windows come back to their texts; covered bytes are joined to spans.

Equal texts are found by their SHA-256 and searched once: each of them repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FINE_BYTES, LEAVING, POWERS, U64, Powers, Scratch, buckets, grouped, mix, partition, prefix_hashes, slices, text_bytes
from .suffix_array import repeated_starts

LENGTH, GRAM = 200, 48
#: Places above which an anchor is told apart by fingerprints; bytes of a shard.
HOT, SHARD_BYTES = 256, 400_000
#: The part of a gram's hash that ranks it; the leftmost of equal ones is the anchor.
HIGH = U64(0xFFFFFFFF00000000)
SECOND = Powers(0xD1342543DE82EF95)
LEAVING.append(SECOND.shrink)
MOST = np.iinfo(np.int64).min


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    sums = prefix_hashes(data)
    return mix((sums[GRAM:] - sums[:-GRAM]) * POWERS.get(len(data) + 1)[1][: max(0, len(sums) - GRAM)])


def anchor_runs(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run, in order; windows lie within one text. ``length`` is 48 to 256."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(U64), none, none
    grams = gram_hashes(data)
    least = window_minima((grams & HIGH) | np.arange(len(grams), dtype=U64), length - GRAM + 1)
    valid = np.zeros(len(least) + 1, np.int8)
    size = np.diff(at)
    for a, b in zip(at[:-1][size >= length].tolist(), (at[1:][size >= length] - length + 1).tolist(), strict=True):
        valid[a:b] = 1
    ok = valid[:-1].astype(bool)
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    new[at[:-1][(at[:-1] < len(least))]] |= ok[at[:-1][(at[:-1] < len(least))]]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.r_[~ok[1:] | new[1:], True]) + 1
    return grams[(least[first] & ~HIGH).astype(np.int64)], first, stop - first


def keyed(docs: DataFrame) -> DataFrame:
    """(key, sha, id, text): what a text is known by; null ids and texts get values of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    return docs.select(F.xxhash64(sha).alias("key"), sha.alias("sha"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(MOST))).alias("id"), text.alias("text"))


def _run_rows(piece: pa.RecordBatch, length: int) -> np.ndarray:
    """(anchor, key, first window << 8 | windows - 1) of each run of the texts."""
    data, at = text_bytes(piece.column("text"))
    key = piece.column("key").to_numpy(zero_copy_only=False)
    anchor, first, n = anchor_runs(data, at, length)
    text = np.searchsorted(at, first, "right") - 1
    return np.stack([anchor, key[text].view(U64), ((first - at[text]) << 8 | (n - 1)).astype(U64)], 1)


def _anchors(parts: int, length: int):
    """Step 1: for each part of the anchors a blob of (anchor, key, first window << 8 | windows - 1)."""

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [_run_rows(part, length) for part in slices(piece, "text", FINE_BYTES)]
                rows = np.concatenate(found)
                key = piece.column("key").to_numpy(zero_copy_only=False)
                if len(np.unique(key)) < len(key):  # equal texts of a slice have equal rows
                    rows = np.unique(rows, axis=0)
                anchor = rows[:, 0]
                part = ((anchor >> U64(40)) % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[order[cut[p] : cut[p + 1]]].tobytes() for p in used], pa.binary())], ["part", "rows"])

    return run


def _shared(pdf: pd.DataFrame, hot_places: int) -> pd.DataFrame:
    """The runs whose anchor is in two places, by text: those of usual anchors and those of hot ones."""
    rows = np.unique(np.concatenate([np.frombuffer(b, U64).reshape(-1, 3) for b in pdf["rows"]]), axis=0) if len(pdf) else np.zeros((0, 3), U64)
    edge = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    size = np.diff(np.r_[edge, len(rows)])
    places = np.repeat(size, size)
    rows, hot = rows[places > 1], (places > hot_places)[places > 1]
    if not len(rows):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "hot": np.zeros(0, bool), "runs": []})
    order = np.lexsort((rows[:, 2], hot, rows[:, 1]))
    rows, hot = rows[order], hot[order]
    cut = np.flatnonzero(np.r_[True, (rows[1:, 1] != rows[:-1, 1]) | (hot[1:] != hot[:-1])])
    stop = np.r_[cut[1:], len(rows)]
    return pd.DataFrame({"key": rows[cut, 1].view(np.int64), "hot": hot[cut], "runs": [rows[a:b, 2].tobytes() for a, b in zip(cut, stop, strict=True)]})


def _fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """128 bits for each window, two columns."""
    out = []
    for powers, sums in ((POWERS, prefix_hashes(data)), (SECOND, None)):
        up, down = powers.get(len(data) + 1)
        if sums is None:
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum((data.astype(U64) + U64(7)) * up[: len(data)], out=sums[1:])
        out.append(mix((sums[length:] - sums[:-length]) * down[: len(sums) - length]))
    return np.stack(out, 1)


def _occurrences(parts: int, length: int):
    """Steps 2 and 3: runs with their bytes; blobs of the fingerprints of hot windows."""
    names = ["kind", "part", "key", "first", "anchor", "content", "bytes"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                rows: list[tuple] = []
                hot: list[np.ndarray] = []
                for key, text, runs, very in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "runs", "hot")), strict=True):
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    code = np.unique(np.concatenate([np.frombuffer(b, U64) for b in runs])).astype(np.int64) if runs else np.zeros(0, np.int64)
                    grams = gram_hashes(data) if len(code) else None
                    for a, n in zip((code >> 8).tolist(), ((code & 255) + 1).tolist(), strict=True):
                        part = raw[a : a + n - 1 + length]
                        anchor = grams[a + int((grams[a : a + length - GRAM + 1] & HIGH).argmin())]
                        rows.append((0, 0, key, a, int(anchor.view(np.int64)), hashlib.blake2b(part, digest_size=16).digest(), part))
                    if very:
                        code = np.unique(np.concatenate([np.frombuffer(b, U64) for b in very])).astype(np.int64)
                        start, n = code >> 8, (code & 255) + 1
                        window = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        prints = _fingerprints(data, length)[window]
                        hot.append(np.column_stack([prints, np.full(len(window), key).astype(np.int64).view(U64), window.astype(U64)]))
                if hot:
                    rows += [(1, p, None, None, None, None, b) for p, b in _deal(np.concatenate(hot), parts)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), types, strict=True)], names)

    return run


def _deal(rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows (fingerprint, fingerprint, key, window) by part. Where a slice has a print twice, its windows are known to repeat:
    they are marked, and one of them stands for all in the shuffle (part -1 keeps the others)."""
    order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]
    first = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
    size = np.diff(np.r_[np.flatnonzero(first), len(rows)])
    twice = np.repeat(size > 1, size)
    if twice.any():
        yield -1, rows[twice][:, 2:].tobytes()
    sent = np.column_stack([rows[first], twice[first].astype(U64)])
    part = ((sent[:, 0] >> U64(40)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, sent[order[cut[p] : cut[p + 1]]].tobytes()


def _windows(key: np.ndarray, window: np.ndarray) -> pd.DataFrame:
    """(key, windows): windows of a text as ascending runs (first, number)."""
    order = np.lexsort((window, key))
    key, window = key[order], window[order].astype(np.int64)
    if not len(key):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "windows": []})
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (window[1:] > window[:-1] + 1)])
    stop = np.r_[cut[1:], len(key)] - 1
    pairs, owner = np.column_stack([window[cut], window[stop] - window[cut] + 1]), key[cut]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return pd.DataFrame({"key": owner[edge].view(np.int64), "windows": [pairs[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(owner)], strict=True)]})


def _repeated_prints(parts: int):
    """Step 3 for one part of the fingerprints: (to, places), the places that repeat by the part of their text's key."""

    @grouped
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(b, U64).reshape(-1, 5) for b in pdf["bytes"]])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        edge = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        size = np.diff(np.r_[edge, len(rows)])
        rows = rows[np.repeat(size > 1, size) | (rows[:, 4] > 0)][:, 2:4]
        to = ((rows[:, 0] >> U64(20)) % U64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        return pd.DataFrame({"to": some.astype(np.int32), "places": [rows[order[cut[p] : cut[p + 1]]].tobytes() for p in some]})

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = np.concatenate([np.frombuffer(b, U64).reshape(-1, 2) for b in pdf["places"]])
    return _windows(rows[:, 0], rows[:, 1])


def _marked(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for b in pdf["bytes"]:
            rows = np.frombuffer(b, U64).reshape(-1, 2)
            yield _windows(rows[:, 0], rows[:, 1])


def _shard(length: int):
    """Step 2 for one shard: the repeated windows of each distinct run, as (first, number) pairs."""

    @grouped
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contents = pdf["bytes"].to_list()
        joined = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
        again = repeated_starts(joined, length)
        out, at = [], 0
        for one, times in zip(contents, pdf["times"], strict=True):
            n = len(one) - length + 1
            hit = np.ones(n, bool) if times > 1 else again[at : at + n]
            at += len(one) + 1
            edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            out.append(np.column_stack([edge[::2], edge[1::2] - edge[::2]]).astype(np.int64).tobytes())
        pdf = pd.DataFrame({"anchor": pdf["anchor"], "content": pdf["content"], "hits": out})
        return pdf[pdf["hits"].str.len() > 0]

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot_places: int = HOT) -> tuple[DataFrame, Scratch]:
    """(key, copies, windows): for each text that has any, its repeated windows as a list of blobs of (first, number) pairs."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), buckets(spark)
    base = keyed(docs)
    copies = scratch.save(base.groupBy("key", "sha").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "copies")
    blobs = base.select("key", "text").mapInArrow(_anchors(parts, length), "part int, rows binary")
    runs = blobs.groupBy("part").applyInPandas(grouped(lambda pdf: _shared(pdf, hot_places)), "key long, hot boolean, runs binary")
    blob = lambda hot: F.collect_list(F.when(F.col("hot") == hot, F.col("runs")))
    runs = scratch.save(runs.groupBy("key").agg(blob(False).alias("runs"), blob(True).alias("hot")).join(copies, "key"), "runs")

    texts = base.join(runs.drop("copies"), ["key", "sha", "id"]).select("key", "text", "runs", "hot")
    found = scratch.save(texts.mapInArrow(_occurrences(parts, length), "kind int, part int, key long, first long, anchor long, content binary, bytes binary"), "found")
    scratch.drop("runs")
    places = found.where("kind = 0")
    distinct = scratch.save(places.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.first("bytes").alias("bytes")), "distinct")
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("bytes") + 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // SHARD_BYTES))))
    hits = distinct.groupBy(shard.alias("shard")).applyInPandas(_shard(length), "anchor long, content binary, hits binary")
    back = places.select("key", "first", "anchor", "content").join(hits, ["anchor", "content"]).select("key", "first", "hits")

    @partition
    def shift(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"key": pdf["key"], "windows": [(np.frombuffer(h, np.int64).reshape(-1, 2) + [a, 0]).astype(np.int64).tobytes() for a, h in zip(pdf["first"], pdf["hits"], strict=True)]})

    hot = found.where("kind = 1").select("part", "bytes")
    windows = back.mapInPandas(shift, "key long, windows binary")
    windows = windows.unionByName(hot.where("part >= 0").groupBy("part").applyInPandas(_repeated_prints(parts), "to int, places binary").groupBy("to").applyInPandas(grouped(_gathered), "key long, windows binary"))
    windows = windows.unionByName(hot.where("part < 0").select("bytes").mapInPandas(partition(_marked), "key long, windows binary"))
    gathered = windows.groupBy("key").agg(F.collect_list("windows").alias("windows"))
    out = scratch.save(copies.join(gathered, "key", "left").where("copies > 1 OR windows IS NOT NULL").select("key", "copies", "windows"), "windows")
    scratch.drop("found", "distinct", "copies")
    return out, scratch


def spans(n: int, copies: int | None, windows: list[bytes] | None, length: int) -> np.ndarray:
    """Removed spans (start, end) of a text of ``n`` bytes, apart from each other and ascending."""
    if (copies or 0) > 1 and n >= length:
        return np.array([[0, n]])
    pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in (windows if windows is not None else ())]
    if not pairs:
        return np.zeros((0, 2), np.int64)
    pair = np.concatenate(pairs)
    pair = pair[np.argsort(pair[:, 0], kind="stable")]
    start, end = pair[:, 0], np.maximum.accumulate(pair[:, 0] + pair[:, 1] - 1 + length)
    new = np.r_[True, start[1:] > end[:-1]]
    return np.column_stack([start[new], end[np.r_[new[1:], True]]])


def cut_repeats(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), hot: int = HOT, as_text: bool = False) -> DataFrame:
    """Each row's doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and the columns ``carry``.

    With ``as_text`` also text: what stays without parts of characters at the cuts, null for a null text.

    A text is its UTF-8 bytes, null as empty. A byte goes if a string of ``length`` bytes covers it that
    also starts anywhere else, in the same text too; strings are judged on the input and never cross texts.
    Rows with null or repeated doc_id are texts like others, so equal rows of ``length`` bytes or more lose all;
    an empty table gives an empty result. Other columns are not read.
    """
    table, _ = repeated_windows(docs, length, hot)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in carry], *([F.col("text").isNull().alias("missing_")] if as_text else []), text.alias("text_"), F.xxhash64(F.unhex(F.sha2(text, 256))).alias("key"))
    rows = rows.join(table, "key", "left").drop("key")
    fields = [f for f in rows.schema.fields if f.name in carry]

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text_"):
                out: list[tuple] = []
                texts: list[str] = []
                for t, c, w in zip(*(piece.column(x).to_pylist() for x in ("text_", "copies", "windows")), strict=True):
                    raw = t.encode()
                    gone = spans(len(raw), c, w, length)
                    edge = [0, *gone.ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                    if as_text:
                        texts.append("".join(raw[a:b].decode(errors="ignore") for a, b in zip(edge[::2], edge[1::2], strict=True)) if len(gone) else t)
                    out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
                new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                if as_text:
                    new.append(pa.array([None if gone else t for t, gone in zip(texts, piece.column("missing_").to_pylist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *new, *(piece.column(f.name) for f in fields)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *["text"] * as_text, *(f.name for f in fields)])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + ", text string" * as_text + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, ddl)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
