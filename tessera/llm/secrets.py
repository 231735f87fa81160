"""Secret scans by a trigram inverted index, in DataFrame expressions only.

Each rule's regex is read into a Boolean trigram query that every match must satisfy: an OR of
clauses, each an AND of trigrams. The index holds a posting (trigram, text) for each
trigram that some rule asks for; a rule's candidates are the texts that have all trigrams
of one of its clauses (postings intersected by counting), and only they are verified with the
regex. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most strings that one part of a regex may stand for before it counts as "anything".
SPREAD = 64


@dataclass(frozen=True)
class Rule:
    """``regex`` is matched leftmost and non-overlapping; a match stays if its ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    #: A cheaper regex that finds a place in every text with a match that stays, for rules that scan fully.
    probe: str = ""


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _clauses(strings: set[str]) -> list[frozenset[str]] | None:
    """What texts that hold one of the strings have; None: nothing is sure."""
    out = []
    for s in strings:
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        if not grams:
            return None
        out.append(grams)
    return out


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return [x | y for x in a for y in b] if len(a) * len(b) <= SPREAD else min(a, b, key=len)


def _read(parsed) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """(the strings it stands for, None if too many; the clauses of a text with a match)."""
    known: set[str] | None = {""}
    run, query = {""}, None
    for op, value in parsed:
        strings: set[str] | None = None
        inner = None
        if op is sre.LITERAL:
            strings = {chr(value).lower()}
        elif op is sre.AT:
            strings = {""}
        elif op is sre.IN:
            strings = set()
            for kind, x in value:
                if kind is sre.LITERAL:
                    strings.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    strings |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    strings = None
                    break
            if strings is not None and len(strings) > 8:
                strings = None
        elif op is sre.SUBPATTERN:
            strings, inner = _read(value[3])
        elif op is sre.BRANCH:
            parts = [_read(x) for x in value[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            elif all(p[1] is not None for p in parts):
                inner = list(itertools.chain.from_iterable(p[1] for p in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            strings, inner = _read(body)
            if (low, high) == (0, 1):
                strings, inner = (strings | {""} if strings is not None else None), None
            elif (low, high) != (1, 1):
                inner = inner if low else None
                if low and strings is not None:
                    run = {a + b for a in run for b in strings} if len(run) * len(strings) <= SPREAD else run
                strings = None
        if strings is not None and len(run) * len(strings) <= SPREAD:
            run = {a + b for a in run for b in strings}
            known = None if known is None else run
            continue
        query = _both(query, _clauses(run))
        query = _both(query, inner if strings is None else _clauses(strings))
        known, run = None, {""}
    if known is not None:
        return run, _clauses(run)
    return None, _both(query, _clauses(run))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The clauses of a regex in lower case; None if it has no mandatory trigrams."""
    query = _read(sre_parse.parse(regex))[1]
    if query is None:
        return None
    return [c for c in set(query) if not any(o < c for o in query)]


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): for each text those of ``trigrams`` that its lower-cased characters hold, once."""
    if not trigrams:
        return texts.select(F.lit("").alias("trigram"), "key").where(F.lit(False))
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return texts.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules with a clause of which a text has all trigrams, by intersecting postings."""
    spark = texts.sparkSession
    asked = [(t, r.kind, n, len(c)) for r in rules for n, c in enumerate(trigram_query(r.regex) or ()) for t in sorted(c)]
    index = trigram_index(texts, sorted({a[0] for a in asked}))
    clauses = spark.createDataFrame(asked or [("", "", 0, 0)], "trigram string, kind string, clause int, size int")  # fixed by the rules
    whole = index.join(F.broadcast(clauses), "trigram").groupBy("key", "kind", "clause", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


#: Elements whose running values are built one after the other; longer arrays go in pieces of so many, so the work is
#: n ** 1.5 array copies at most where one aggregate over all takes n ** 2.
PIECE = 64
#: Characters of a part of a text: a place is looked up within its part.
PART = 4096


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step) -> Column:
    """What ``step(before, element)`` gives from ``start`` on, for each element in turn."""

    def grown(p: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(p, begin, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(step(a["at"], x))).alias("out")))["out"]

    def over(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / PIECE).cast("int")
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.slice(all_, k * PIECE + 1, F.lit(PIECE)))

    def joined_up(pieces: Column) -> Column:
        # a piece starts at what the pieces before it come to
        starts = F.concat(F.array(start), grown(F.transform(pieces, lambda p: F.aggregate(p, start, step)), start))
        return F.flatten(F.zip_with(pieces, F.slice(starts, 1, F.size(pieces)), lambda p, first: grown(p, first)))

    return bound(bound(values, over), joined_up)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, kind, end>> of the matches that stay, in code points."""
    regex = F.lit(rule.regex)
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")
    kept = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda g: F.char_length(g) >= rule.least)
    gaps = F.transform(F.split(text, rule.regex, -1), F.char_length)

    def spans(sizes: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda gap, size: gap + size), F.lit(0), lambda at, n: at + n)
        every = F.zip_with(ends, F.arrays_zip(sizes.alias("size"), kept.alias("kept")), lambda end, m: F.struct((end - m["size"]).alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"), m["kept"].alias("kept")))
        return F.transform(F.filter(every, lambda x: x["kept"]), lambda x: F.struct(x["start"], x["kind_order"], x["kind"], x["end"]))

    return F.coalesce(bound(F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.char_length), lambda sizes: F.when(F.size(sizes) > 0, spans(sizes)).otherwise(none)), none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, n_chars and all other columns) with ``secret_spans_``: their spans by start, then rule.

    Null texts count as empty and stay null. Rows with null or repeated doc_id are scanned like others;
    an empty table gives an empty result. Whole texts are scanned; a column named ``secret_spans_`` is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    found = candidates(texts, rules)  # a hash that two texts share only adds a candidate
    rows = docs.drop("secret_spans_").withColumn("secret_key_", F.xxhash64(text)).join(found.select(F.col("key").alias("secret_key_"), F.col("kinds").alias("secret_kinds_")), "secret_key_", "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        if trigram_query(rule.regex) is None:
            chosen = F.regexp_like(text, F.lit(rule.probe or rule.regex))
            rule = Rule(rule.kind, rule.regex.replace("]+", f"]{{{rule.least},}}"), rule.group, rule.least) if rule.probe else rule
        else:
            chosen = F.array_contains("secret_kinds_", rule.kind)
        parts.append(F.when(chosen, matches(text, rule, order)).otherwise(none))
    return rows.withColumn("secret_spans_", F.array_sort(F.concat(*parts))).drop("secret_key_", "secret_kinds_")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base rules, base_sha256 and spans of every row."""
    rows = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = F.col("secret_spans_")
    base = F.filter(spans, lambda s: s["kind_order"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; rows and columns stay, null texts too. A span that begins within an earlier one goes with it."""
    rows = secret_spans(docs, rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / PART).cast("int")), lambda k: F.substring(text, k * PART + 1, F.lit(PART)))
    reached = running(F.transform("secret_spans_", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

    def piece(parts: Column, first: Column, stop: Column) -> Column:
        one, last = F.floor(first / PART).cast("int"), F.floor(F.greatest(stop - 1, first) / PART).cast("int")
        return F.substring(F.array_join(F.slice(parts, one + 1, last - one + 1), ""), F.pmod(first, F.lit(PART)) + 1, stop - first)

    def masked(parts: Column, reached: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reached, 1, F.size(reached) - 1))
        # a span that begins before the furthest end so far is within what is masked
        own = F.filter(F.zip_with("secret_spans_", before, lambda s, b: F.struct(b.alias("before"), s["start"].alias("start"))), lambda x: x["start"] >= x["before"])
        begun = F.array_join(F.transform(own, lambda x: F.concat(piece(parts, x["before"], x["start"]), F.lit(mark))), "")
        return F.concat(begun, piece(parts, F.element_at(reached, -1), F.char_length(text)))

    clean = bound(parts, lambda p: bound(reached, lambda r: masked(p, r)))
    return rows.withColumn("text", F.when(F.size("secret_spans_") > 0, clean).otherwise(F.col("text"))).drop("secret_spans_")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
