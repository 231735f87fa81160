"""Operators on documents against brute-force versions, on awkward rows."""

import array
import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, secrets, suffix_array, suffix_dedup, token_counts, tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, rep long, component string, n int, kinds string, bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "c", 2, "x", "b") for i, t in rows], SCHEMA)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice([a + b for a in "kamotire" for b in "aeioun"], n))


def documents():
    base = prose(1, 200)
    words = base.split()
    rows = [(i, prose(i, 80)) for i in range(10, 30)]
    for k in range(40):  # near copies, some near enough
        changed = list(words)
        r = np.random.default_rng(100 + k)
        for j in r.choice(200, k % 9, replace=False):
            changed[j] = "other" + str(k)
        rows.append((100 + k, " ".join(changed)))
    rows += [(200, base), (201, base), (202, base.upper()), (203, "  " + base.replace(" ", "\n"))]
    passage = prose(77, 60)
    rows += [(300 + k, f"{prose(300 + k, 30)} {passage} {prose(900 + k, 30)}") for k in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "one two"), (405, "One  Two"), (406, "é ü x y z ñ"), (407, "nd, " * 500), (408, prose(5, 30_000))]
    rows += [(None, base), (None, None), (500, "a b c d e f"), (500, "a b c d e f"), (501, "\x00\x01 x")]
    return rows


def sets(rows):
    out = []
    for _, t in rows:
        w = [bytes(x).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall((t or "").encode())]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    s = sets(rows)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(s[i]), None if d is None else min(x for x in least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("chunk", [256, 5])
def test_join_finds_every_link(spark, chunk):
    got = ngram_join.ngram_jaccard_join(frame(spark, documents()), chunk=chunk).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(documents())


def test_large_blocks_are_cut_by_size(spark):
    # one shared passage, sets of many sizes, chains of copies that link only step by step across levels of size
    passage = prose(50, 60)
    rows = [(k, f"{passage} {prose(51, 10 + 3 * k)}") for k in range(60)] + [(100 + k, f"{passage} {prose(200 + k, 8 + k % 40)}") for k in range(60)]
    rows += [(300 + k, t + " end") for k, t in rows[::4]]
    got = ngram_join.ngram_jaccard_join(frame(spark, rows), chunk=6).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).count() == 0
    assert ngram_join.ngram_jaccard_join(frame(spark, [(1, None), (2, "")])).count() == 2


@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_divide_skip_counts(lists, threshold):
    lists = [np.unique(x) for x in lists]
    found, seen = ngram_join.divide_skip(np.concatenate(lists), np.array([len(x) for x in lists]), threshold)
    want = collections.Counter(x for one in lists for x in one.tolist())
    assert dict(zip(found.tolist(), seen.tolist(), strict=True)) == {m: c for m, c in want.items() if c >= threshold}


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raws, strict=True):
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = True
        edges = np.diff(np.r_[0, cut.astype(int), 0])
        kept = bytes(np.frombuffer(b, np.uint8)[~cut])
        out.append((d, len(b), int(cut.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats_are_cut_exactly(spark, monkeypatch, hot):
    rows = [r for r in documents() if r[0] != 408]
    got = suffix_dedup.cut_repeats(frame(spark, rows), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 200)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.cut_repeats(frame(spark, [])).count() == 0


@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_suffix_arrays(b, length):
    data = np.frombuffer(b, np.uint8)
    order = suffix_array.suffix_array(np.r_[data.astype(np.int64) + 1, 0])
    assert order.tolist() == sorted(range(len(b) + 1), key=lambda i: b[i:])
    got = suffix_array.repeated_starts(data, length)
    assert got.tolist() == [i + length <= len(b) and any(b[i : i + length] == b[j : j + length] for j in range(len(b)) if j != i) for i in range(len(b))]


def secret_rows():
    key = "AKIA" + "A1B2" * 5
    return [
        (1, f"password = hunter22! {key} token:abc secret=deadbeefdeadbeefdeadbeef"), (2, "api_key: \"abcdef\" APIKEY='zz/+=9' é😀 passwd=é password:=x1y2z3"),
        (3, "token=token:abcdefg"), (4, "0123456789abcdef" * 3 + "G" + "a" * 23), (5, None), (6, ""), (7, "AKIAshort AKIAAKIA" + "Z" * 14), (None, "secret: 123456"), (3, "secret: 123456"),
        (8, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20), (9, "token = x " * 400 + "token=abcdef"), (10, "TOKEN\x20\x20=\x20'ABCDEF'"),
    ]


def brute_secrets(rows):
    rules = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    out = []
    for d, t in rows:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m))
        joined = ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
        out.append((d, *(sum(s[2] == n for s in spans) for n, _, _ in rules), hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def test_secrets(spark):
    got = secrets.digest(frame(spark, secret_rows())).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == brute_secrets(secret_rows())
    assert any("private_key:0:31" in r.spans and "hub_token" in r.spans for r in got)
    assert secrets.digest(frame(spark, [])).count() == 0


def test_redaction_keeps_the_rest(spark):
    rows = {(r.doc_id, r.text) for r in secrets.redact(frame(spark, secret_rows())).collect()}
    assert (5, None) in rows and (6, "") in rows and (3, "token=token:abcdefg") in rows and (None, "[SECRET]") in rows
    assert any(t and t.startswith("[SECRET]! [SECRET] token:abc [SECRET]") for _, t in rows)


def test_texts_of_many_secrets(spark):
    # 64 and 4096 are the sizes of pieces; é counts as one
    rows = [(n, "é token=abcdef1 " * n) for n in (1, 63, 64, 65, 4096, 30_000)] + [(7, "x" * 4090 + " secret=abcdefgh secret=" + "0a" * 5000 + " é")]
    began = time.time()
    got = secrets.digest(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == brute_secrets(rows)
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert all(clean[n] == "é [SECRET] " * n for n, _ in rows[:-1]) and clean[7] == "x" * 4090 + " [SECRET] [SECRET] é"
    assert time.time() - began < 120


def test_running_values(spark):
    rows = [([int(x) for x in np.random.default_rng(n).integers(-5, 9, n)],) for n in (0, 1, 63, 64, 65, 200, 4097)]
    df = spark.createDataFrame(rows, "a array<int>")
    for name, step, fold in (("sum", lambda a, x: a + x, lambda a, x: a + x), ("most", lambda a, x: F.greatest(a, x), max)):
        for r in df.select("a", secrets.running(F.col("a"), F.lit(0), step).alias(name)).collect():
            assert r[name] == list(itertools.accumulate(r.a, fold, initial=0))[1:]


def test_a_repeated_doc_id_loses_no_link(spark):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (-5, prose(3, 50)), (-5, None), (2**60, prose(3, 50) + " y")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect())
    assert got == sorted([(1, 96, 1), (1, 96, 1), (2, 97, 1), (3, 97, 1), (-5, 46, -5), (-5, 0, -5), (2**60, 47, -5)])


def test_trigram_queries_are_necessary():
    for rule in secrets.BASE + secrets.ADDED:
        query = secrets.trigram_query(rule.regex)
        assert (query is None) == (rule.kind == "hex")
        for _, text in secret_rows():
            for m in re.finditer(rule.regex, text or "", 0):
                assert query is None or any(all(g in m[0].lower() for g in c) for c in query)


def token_rows():
    return [(1, "Hello, world. It's 3.14..."), (2, None), (3, ""), (4, prose(3, 3000)), (4, "a‖b ‖ H̱a"), (None, "日本語。 テスト. x² ½"), (5, "word " * 1023), (6, "x" * 9000), (7, "<|endoftext|> a"), (8, "Some<|startoftext|>glued. <|ENDOFTEXT|>"), (9, "word " * 40_000)]


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_places_every_piece(spark):
    got = packing.pack(frame(spark, token_rows()), capacity=512, bucket_rows=2).collect()
    want = []
    for (d, _), ids in zip(token_rows(), encoded([t for _, t in token_rows()]), strict=True):
        ids = [*ids, 0]
        want += [(d, k, s, len(ids[s : s + 512]), zlib.crc32(array.array("I", ids[s : s + 512]).tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(frame(spark, [])).count() == 0


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_plans_hold_all_and_waste_little(histogram):
    plan = packing.Plan(histogram, 100, groups=8)
    used = collections.Counter()
    for n, slots in plan.slots.items():
        ranks = sorted((first, count) for first, count, _, _ in slots)
        assert [f for f, _ in ranks] == [sum(c for _, c in ranks[:i]) for i in range(len(ranks))]
        assert sum(c for _, c in ranks) == histogram[n]
        for _, count, base, offset in slots:
            for k in range(count):
                used[base + k] += n
    assert len(used) == plan.sequences and max(used.values()) <= 100
    # first-fit decreasing is the yardstick
    bins = []
    for n in sorted((x for n, c in histogram.items() for x in [n] * c), reverse=True):
        i = next((i for i, b in enumerate(bins) if b + n <= 100), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    assert plan.sequences <= len(bins) + 8
    assert plan.sequences <= len(bins)


@pytest.mark.parametrize(("histogram", "most"), [({1100: 1, 400: 500}, 101), ({1500: 1, 350: 1000, 10: 5}, 201), ({2048: 3, 1: 5}, 4), ({}, 0)])
def test_groups_are_cut_by_rank(histogram, most):
    assert packing.Plan(histogram).sequences == most
    groups = packing.groups_by_rank(sorted(histogram.items(), reverse=True), 8)
    sizes = [sum(c for _, c in g) for g in groups]
    assert len(set(sizes[:-1])) <= 1 and sum(sizes) == sum(histogram.values())


def test_ids_are_the_library_s():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    got = tokens.encoder("word_bpe_49k.json").encode([(t or "").encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == encoded(texts)


def test_token_counts(spark):
    got = {r.length: r for r in token_counts.token_counts(frame(spark, token_rows())).collect()}
    lengths = [len(x) for x in encoded([t for _, t in token_rows()])]
    assert {n: r.n_docs for n, r in got.items()} == collections.Counter(lengths)
    for limit, r in got.items():
        assert r.truncated_total == sum(min(n, limit) for n in lengths)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(n >= limit for n in lengths), sum(n for n in lengths if n >= limit))
    sums = token_counts.token_counts(frame(spark, token_rows()))
    found = {(r.kind, r.parameter): r.value for r in token_counts.answer(sums, [10, 1000], [0.5]).collect()}
    assert found == {("truncated_total", 10.0): sum(min(n, 10) for n in lengths), ("truncated_total", 1000.0): sum(min(n, 1000) for n in lengths), ("quantile", 0.5): sorted(lengths)[-(-len(lengths) // 2) - 1]}
    limits, quantiles = [0, 1, *sorted(set(lengths)), 7, 10**6], [0.01, 0.25, 0.9, 1.0]
    again = {(r.kind, r.parameter): r.value for r in token_counts.answer(sums, limits, quantiles).collect()}
    assert again == {("truncated_total", float(n)): sum(min(x, n) for x in lengths) for n in limits} | {("quantile", q): sorted(lengths)[math.ceil(q * len(lengths)) - 1] for q in quantiles}
    assert token_counts.token_counts(frame(spark, [])).count() == 0
