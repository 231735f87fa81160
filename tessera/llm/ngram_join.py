"""Near duplicates: an exact Jaccard join on word shingles by T-occurrence search.

1. Texts with the same set are one class; a class is searched once.
2. An inverted index over each set's smallest hashes (its prefix). Two sets that link
   share at least ``m`` prefix shingles, so a class with fewer that occur twice is out.
   The least class of a posting list leads a block; a class joins the blocks of its
   lists, but may leave out lists that hold fewer than ``m / 2`` of its shingles: both
   ends of a link leave out fewer than ``m``, so some block still holds the two.
3. In a block, cut into chunks of a bounded number of classes, every search is a
   T-occurrence problem solved by DivideSkip: the L longest inverted lists are set aside,
   the short ones merged by a heap, and members with T - L occurrences are probed for
   in the long lists by binary search. The leader is in every chunk and is searched first;
   then every class that isn't in its component yet.
4. A block of several chunks is cut by the sizes of its sets first: two sets that link are of
   one level of sizes or of neighbouring ones. Classes outside the block's largest component
   are searched in the other chunks of these levels.

No step lists the pairs of a group, and a search leaves out what is already linked
with it, so copies cost one link each. All links that components need are found.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FINE_BYTES, U64, Scratch, buckets, components, grouped, partition, slices, text_bytes
from .shingles import set_key, shingle_sets

WORDS, PERCENT = 5, 80
#: Classes of a chunk, and the weight of list lengths in DivideSkip's choice of L.
CHUNK, MU = 256, 0.0085
#: By how much more than linked sets' sizes can differ a level of sizes is wider, so that rounding moves no link two levels off.
WIDER = 1.008
#: Numbers that a level's chunks may have.
LEVEL = 1 << 32


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of ``n`` shares with any set it links with."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + spare(n))


def spare(n: int) -> int:
    """How many prefix shingles two linked sets share at least, ``n`` being the smaller."""
    return max(1, -(-n // 10))


class Merger:
    """Which nodes are in one component."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self.up = np.unique(labels, return_inverse=True)
        self.up = self.up.astype(np.int64)

    def same(self, i: int) -> np.ndarray:
        return self.up == self.up[i]

    def join(self, i: int, j: int) -> None:
        a, b = self.up[i], self.up[j]
        if a != b:
            self.up[self.up == max(a, b)] = min(a, b)


def heap_merge(lists: list[np.ndarray]) -> np.ndarray:
    """Ascending lists as one, the two shortest first, from a heap by length."""
    heap = [(len(x), i, x) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) > 1:
        n, i, x = heapq.heappop(heap)
        m, _, y = heap[0]
        z = np.concatenate([x, y])
        z.sort(kind="stable")
        heapq.heapreplace(heap, (n + m, i, z))
    return heap[0][2] if heap else np.zeros(0, np.int64)


def divide_skip(member: np.ndarray, length: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that occur in ``threshold`` lists at least, and in how many.

    ``member`` has the ascending lists end to end, ``length`` their lengths.
    """
    none = np.zeros(0, np.int64)
    filled = int((length > 0).sum())
    if filled < threshold or threshold < 1:
        return none, none
    order = np.argsort(length, kind="stable")[len(length) - filled :]
    stop = np.cumsum(length)
    aside = min(threshold - 1, int(threshold / (MU * np.log2(length.max() + 1) + 1)))
    short, long = order[: filled - aside], order[filled - aside :]
    found, seen = runs(heap_merge([member[stop[i] - length[i] : stop[i]] for i in short.tolist()]))
    may = seen >= threshold - aside
    found, seen = found[may], seen[may]
    if len(long) and len(found):
        # binary search of every possible member in every long list at once
        span = int(member.max()) + 1
        place = np.repeat(np.arange(len(length)) * span, length) + member
        want = np.sort(long)[:, None] * span + found
        at = np.minimum(np.searchsorted(place, want), len(place) - 1)
        seen = seen + (place[at] == want).sum(0)
    may = seen >= threshold
    return found[may], seen[may]


class Index:
    """Inverted lists over whole sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        token = np.concatenate(sets) if sets else np.zeros(0, U64)
        member = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        token, self.member = token[order], member[order]
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        self.token, self.start, self.count = token[edge], edge, np.diff(np.r_[edge, len(token)])

    def search(self, query: np.ndarray, skip: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with ``query``, but for those in ``skip``."""
        none = np.zeros(0, np.int64)
        threshold = int(least_overlap(len(query), percent))
        at = np.minimum(np.searchsorted(self.token, query), max(0, len(self.token) - 1))
        hit = at[self.token[at] == query] if len(self.token) else none
        if len(hit) < threshold:
            return none
        count = self.count[hit]
        which = np.repeat(np.arange(len(hit)), count)
        member = self.member[np.arange(len(which)) - (np.cumsum(count) - count)[which] + self.start[hit][which]]
        open_ = ~skip[member]
        found, both = divide_skip(member[open_], np.bincount(which[open_], minlength=len(hit)), threshold)
        return found[100 * both >= percent * (len(query) + self.size[found] - both)]


def link(index: Index, sets: list[np.ndarray], merged: Merger, queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Searches each query among the members not yet linked with it; the links found."""
    links = []
    for q in queries:
        skip = merged.same(q)
        if skip.all():
            continue
        for m in index.search(sets[q], skip[: len(index.size)], percent).tolist():
            links.append((q, m))
            merged.join(q, m)
    return links


def signatures(docs: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """Rows of two kinds: a document with its set's size and key; or a part of the index with prefix shingles."""

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "text_key", "n", "key", "tokens"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = [s for part in slices(piece, "text", FINE_BYTES) for s in shingle_sets(*text_bytes(part.column("text")), words)]
                keys = [set_key(s) for s in sets]
                ids = piece.column("doc_id").to_pylist()
                rows: list[tuple] = [(-1, d, t, len(s), k, None) for d, t, s, k in zip(ids, piece.column("text_key").to_pylist(), sets, keys, strict=True)]
                once = {k: s for d, s, k in zip(ids, sets, keys, strict=True) if len(s) and d is not None}
                prefix = [s[: prefix_length(len(s), percent)] for s in once.values()]
                if prefix:
                    token = np.concatenate(prefix)
                    owner = np.repeat(np.array([int.from_bytes(k[:8], "little") for k in once], U64), [len(p) for p in prefix])
                    part = (token >> U64(40)) % U64(parts)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64))
                    for p in range(parts):
                        if cut[p] < cut[p + 1]:
                            own = order[cut[p] : cut[p + 1]]
                            rows.append((p, None, None, len(own), *packed(token[own], owner[own])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key")).mapInArrow(run, "part int, doc_id long, text_key long, n long, key binary, tokens binary")


def text_key(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def packed(token: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes]:
    """Owners with their numbers of tokens (10 bytes each), and 48 bits of each token: one more token in common only adds a candidate."""
    who, count = runs(owner)
    more = -(-count // 0xFFFF)
    who, last = np.repeat(who, more), np.cumsum(more) - 1
    n = np.full(len(who), 0xFFFF, np.uint16)
    n[last] = count - (more - 1) * 0xFFFF
    return who.tobytes() + n.tobytes(), shortened(token)


def shortened(token: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return np.ascontiguousarray(token, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widened(tokens: bytes) -> np.ndarray:
    wide = np.zeros((len(tokens) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def unpacked(key: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(key) // 10
    return widened(tokens), np.repeat(np.frombuffer(key, U64, n), np.frombuffer(key, np.uint16, n, 8 * n).astype(np.int64))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal neighbours."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[edge], np.diff(np.r_[edge, len(x)])


def lead(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the index: how many of a class's prefix shingles are in lists that a leader leads."""
    pairs = [unpacked(k, t) for k, t in zip(pdf["key"], pdf["tokens"], strict=True)]
    token, owner = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
    token, owner = token[keep], owner[keep]
    first = np.r_[True, token[1:] != token[:-1]]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, len(token)])
    leader, many = np.repeat(owner[start], size), np.repeat(size > 1, size)
    leader, owner = leader[many], owner[many]
    order = np.lexsort((owner, leader))
    leader, owner = leader[order], owner[order]
    start = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (owner[1:] != owner[:-1])]) if len(leader) else np.zeros(0, np.int64)
    return pd.DataFrame({"class": owner[start].view(np.int64), "block": leader[start].view(np.int64), "n_tokens": np.diff(np.r_[start, len(leader)])})


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, key, shingles) of each row; 48 bits of a shingle's hash tell it from the few others of a chunk."""

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", FINE_BYTES):
                sets = shingle_sets(*text_bytes(piece.column("text")), words)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([shortened(s) for s in sets], pa.binary())], ["rep", "key", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, key binary, shingles binary")


def found_links(name: np.ndarray, links: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series([name[i] for i, _ in links], dtype=object), "b": pd.Series([name[j] for _, j in links], dtype=object)})


def search_chunk(percent: int):
    """Step 3 for one chunk: links between its classes."""

    @grouped
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name").sort_values(["leads", "name"], ascending=[False, True])
        sets = [widened(b) for b in pdf["shingles"]]
        merged = Merger(np.arange(len(sets)))
        return found_links(pdf["name"].to_numpy(), link(Index(sets), sets, merged, list(range(len(sets))), percent))

    return run


def search_between(percent: int):
    """Step 4 for one chunk: links of classes from outside with its own."""

    @grouped
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name").sort_values(["asks", "name"], ascending=[True, True])
        sets = [widened(b) for b in pdf["shingles"]]
        own = int((~pdf["asks"]).sum())
        merged = Merger(pdf["component"].to_numpy())
        return found_links(pdf["name"].to_numpy(), link(Index(sets[:own]), sets, merged, list(range(own, len(sets))), percent))

    return run


def ngram_jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; sets hold the distinct
    ``words``-word shingles, or the whole sequence where there are fewer words. Documents link when
    ``100 * intersection >= percent * union``. A null, empty or wordless text has 0 shingles, links with
    nothing and is its own component. Rows with a null doc_id keep their count, have a null
    component and link with nothing. Equal texts are one class; a doc_id that comes twice
    gives two rows, each with its own text's component. An empty table gives an empty result.
    Columns other than doc_id and text are not read, so their names can't clash.

    Shingles are compared by 64-bit hashes in the index and by 48 bits of them when a chunk counts an overlap.
    With ``keys`` also text_key, key (the text's set) and keeper (whether the component is named by this set, so
    that of a component's texts one set, that of its smallest doc_id, is kept).
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), buckets(spark)
    signed = scratch.save(signatures(docs, parts, words, percent), "signed")
    members = scratch.save(signed.where("part = -1").select("doc_id", "n", "key", *(["text_key"] if keys else [])), "documents")
    # a class is named by its smallest doc_id, then its key, so the least name of a component has the least doc_id
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = scratch.save(classes.withColumn("name", F.concat(big_endian(F.col("rep")), "key")), "classes")

    shared = signed.where("part >= 0").groupBy("part").applyInPandas(grouped(lead), "class long, block long, n_tokens long")
    shared = shared.groupBy("class", "block").agg(F.sum("n_tokens").alias("n_tokens"))
    named = classes.withColumn("class", little_endian("key"))
    shared = shared.join(named, "class")
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) / 10))
    one = Window.partitionBy("key")
    shared = shared.withColumn("all", F.sum("n_tokens").over(one)).where(F.col("all") >= least)
    below = F.sum("n_tokens").over(one.orderBy("n_tokens", "block").rowsBetween(Window.unboundedPreceding, 0))
    shared = shared.withColumn("below", below).where(F.col("below") * 2 >= least).select("block", "rep", "key", F.floor(F.log("n") / math.log(100 / percent * WIDER)).cast("long").alias("level"))
    joined = scratch.save(shared, "blocks")
    levels = joined.groupBy("block", "level").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("first"))
    whole = levels.groupBy("block").agg(F.sum("m").alias("m"), F.min("first").alias("first")).where("m > 1")
    whole = whole.select("block", (F.col("m") > chunk).alias("large"), F.col("first.key").alias("leader"))
    joined = joined.join(whole, "block").withColumn("leads", F.col("key") == F.col("leader")).drop("leader")
    # chunks of large blocks: of each level as many as its classes fill, numbered level by level
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / chunk) - 1), lambda k: F.col("level") * LEVEL + k)
    cut = scratch.save(levels.join(whole.where("large").select("block"), "block").select("block", "level", numbers.alias("numbers")), "levels")
    near = cut.select("block", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"), "numbers").groupBy("block", "level").agg(F.flatten(F.collect_list("numbers")).alias("near"))
    joined = scratch.save(joined, "members")
    scratch.drop("blocks", "signed")

    wanted = joined.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    sets = whole_sets(texts, words).join(joined, ["rep", "key"])
    sets = sets.join(cut, ["block", "level"], "left")
    own = F.when(F.col("large"), F.element_at("numbers", (F.pmod(F.xxhash64(F.lit(7), "key"), F.size("numbers")) + 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    sets = scratch.save(sets.select("block", "large", "level", "leads", own.alias("own"), F.concat(big_endian(F.col("rep")), "key").alias("name"), "shingles"), "sets")
    every = cut.groupBy("block").agg(F.flatten(F.collect_list("numbers")).alias("every"))
    leaders = sets.where("leads AND large").join(every, "block").withColumn("chunk", F.explode("every")).where("chunk <> own").drop("every")
    dealt = sets.withColumn("chunk", F.col("own")).unionByName(leaders)
    edges = scratch.save(dealt.select("block", "chunk", "leads", "name", "shingles").groupBy("block", "chunk").applyInPandas(search_chunk(percent), "a binary, b binary").distinct(), "edges")

    linked = components(scratch, edges, "first")
    large = sets.where("large").join(linked.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    large = large.select("block", "level", "own", "name", "component", "shingles")
    main = large.groupBy("block", "component").agg(F.count("*").alias("m")).groupBy("block").agg(F.max(F.struct("m", "component")).alias("top"))
    asking = large.join(main.select("block", F.col("top.component").alias("main")), "block").where("component <> main").drop("main")
    asking = asking.join(near, ["block", "level"]).withColumn("chunk", F.explode("near")).drop("near").where("chunk <> own").withColumn("asks", F.lit(True))
    between = large.withColumn("chunk", F.col("own")).withColumn("asks", F.lit(False)).unionByName(asking)
    between = between.select("block", "chunk", "name", "component", "shingles", "asks").groupBy("block", "chunk").applyInPandas(search_between(percent), "a binary, b binary")
    found = scratch.save(between.distinct(), "between")
    if found.limit(1).count():
        linked = components(scratch, linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), "second")
    final = classes.join(linked.withColumnRenamed("node", "name"), "name", "left").select("key", F.coalesce("component", "name").alias("component"), (F.coalesce("component", "name") == F.col("name")).alias("keeper"))
    scratch.drop("sets", "members")
    out = members.join(final, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), from_big_endian(F.substring("component", 1, 8)))).otherwise(F.col("doc_id")).alias("component_id"),
        *(["text_key", "key", "keeper"] if keys else []),
    )
    out = scratch.save(out, "result")
    scratch.drop("documents", "classes", "edges", "between", "levels")
    return out


def big_endian(x: Column) -> Column:
    """Eight bytes that sort as the long does."""
    return F.unhex(F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def from_big_endian(x: Column) -> Column:
    return (F.conv(F.hex(x), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def little_endian(column: str):
    """The first eight bytes of a binary column as a signed integer, least byte first."""
    parts = [F.shiftleft(F.conv(F.hex(F.substring(column, i + 1, 1)), 16, 10).cast("long"), 8 * i) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLE_SQL = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
t AS (SELECT doc_id, shingle FROM u WHERE shingle IN (SELECT shingle FROM u GROUP BY 1 HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
c(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reach)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(reach) AS component_id FROM c JOIN n USING (doc_id) GROUP BY doc_id
"""
}
