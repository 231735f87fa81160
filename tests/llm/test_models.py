"""Pages, pieces, toxicity and the pipeline."""

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import html_text, sentencepieces, toxicity

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use the cookies of this site.</p></div>
<main><article><h1>The title &amp; more</h1><p><b>First paragraph of the article, with  some&nbsp;space.<br>same block<p>Second one.</p>
<div class="ad">Buy the things of the shop now</div><ul><li>a point in a list</li></ul><aside>See also the other</aside><form><input><p>Subscribe to the letter</p></form>
<p>Last one, after &lt;markup&gt;.</p></article><section id="comments"><article class="comment"><p>I am a reader and this is what I think of it.</p></article></section></main>
<div class="sidebar">Popular</div><footer>&copy; 2024</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE).split("\n") == ["The title & more", "First paragraph of the article, with some space. same block", "Second one.", "a point in a list", "Last one, after <markup>."]


def test_pages_without_article_markup():
    body = "<p>" + "It is the story of a town that was on the river and of the people in it. " * 5 + "</p>"
    page = f"<div><a href=x>one</a> <a href=y>two</a></div>{body}<p>Short one.</p>{body}<div><a href=z>next page of the list</a></div>"
    assert len(html_text.main_text(page).split("\n")) == 3
    for odd in (None, "", "   ", "<", "<p", "<div class=\"", "plain", "<!-- x", "<script>", "&#0;&bogus;", "</p></div>", "<p>" * 3000):
        assert isinstance(html_text.main_text(odd), str)


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "v", "", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars == len(r.text)) for r in got] == [(1, "u", True), (1, None, True), (None, "v", True)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = "It is the story of a town that was on the river and of the people in it."


@pytest.mark.parametrize("markup", ['<section id="discussion"><p>{}</p></section>', '<div class="warning"><p>{}</p></div>', '<h2 id="social-impact">{}</h2>', '<h2 id="related-work">{}</h2>', '<p class="popular">{}</p>', '<p id="comments">{}</p>', '<section id="navigation"><p>{}</p></section>', '<div class="ad-hoc"><p>{}</p></div>', '<div class="header">{}</div>'])
def test_names_within_articles(markup):
    found = html_text.main_text(f"<nav><a href=x>one</a></nav><article><p>{PROSE}</p>{markup.format('What they said of it in the end')}<p>{PROSE}</p></article>")
    assert found.split("\n") == [PROSE, "What they said of it in the end", PROSE]


def test_doubtful_names_outside_articles():
    assert html_text.main_text(f'<div class="notice"><p>{PROSE}</p></div>') == PROSE
    assert html_text.main_text(f'<div class="header">A tagline without any meaning</div><p>{PROSE}</p>') == PROSE


@pytest.mark.parametrize(
    "text",
    ["Это рассказ о городе у реки и о людях, которые жили там много лет назад и ничего не забыли. ", "Jest to opowieść o mieście nad rzeką i ludziach, którzy tam mieszkali przez wiele lat. ", "这是一个关于河边小镇和那里居民的故事，他们在那里生活了很多年，什么都没有忘记。", "これは川のほとりの町とそこに住む人々の物語であり、彼らは長年そこに暮らしていた。"],
)
@pytest.mark.parametrize("times", [1, 6])
def test_languages_without_stop_words(text, times):
    text = text.strip() if times == 1 else (text * times).strip()
    menu = "<div><a href=x>one</a> <a href=y>two</a></div>"
    assert html_text.main_text(f"{menu}<p>{text}</p><p>{text}</p>{menu}").split("\n") == [text, text]


@pytest.mark.parametrize("markup", ['<svg class="icon"/>', "<math/>", "<svg><path d='M0'/>", "<object>", "<video src=x>", "<canvas/>", "<svg><title>no</title><text>no</text></svg>", "<iframe src=x>no</iframe>", "<svg>" * 2000])
def test_skipped_elements_end(markup):
    assert html_text.main_text(f"<article><p>First</p>{markup}<p>Second</p></article>").split("\n") == ["First", "Second"]


def test_formulas_stay():
    page = "<article><p>Here <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds</p></article>"
    assert html_text.main_text(page) == "Here x=2 holds"


def naive(html):
    """The given pages' one article without its advert, cut at block tags."""
    body = re.sub(r'<!--.*?-->|<(script|style)>.*?</\1>|<div class="ad">.*?</div>', "", re.search(r"<article>(.*?)</article>", html, re.S)[1], flags=re.S)
    blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|section|blockquote|table|tr)\b[^>]*>", body)
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in blocks]
    return "\n".join(x for x in lines if x)


def test_pages_of_a_table_are_read_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        assert got[row.page_id].text == naive(row.html) and got[row.page_id].n_chars == len(naive(row.html))


def test_a_very_long_page():
    body = "".join(f"<p>{PROSE} {k}</p><div class='share'><a href=x>share</a></div>" for k in range(5000))
    assert html_text.main_text(f"<nav>menu</nav><article>{body}</article>").split("\n") == [f"{PROSE} {k}" for k in range(5000)]


TEXTS = ["", " ", "  a  b ", "\n\n x", "日本語 text 😀 é", "a" * 300, "hello" * 60 + "  x", "tab\there", "don't 12345 -- !!!! ok", " z \x00", "the quick brown fox " * 50]


def test_pieces_equal_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = sentencepieces.load("piece_bpe_32k.model", "merges")
    for text, (ids, _) in zip(TEXTS, pieces.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)
        assert pieces.decode(np.frombuffer(ids, "<u4")).decode() == text


def test_ids_are_the_library_s_on_a_table():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    pieces = sentencepieces.load("piece_bpe_32k.model", "merges")
    for text, (ids, summed) in zip(texts, pieces.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)
        assert pieces.decode(np.frombuffer(summed, "<u4")).decode() == text


def test_viterbi_is_a_unigram_model_s_own(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    r = np.random.default_rng(5)
    names = sorted({"▁", *"abcd", *("".join(r.choice(list("▁abcd"), int(n))) for n in r.integers(2, 6, 60))})
    names = [n for n in names if "▁" not in n[1:]]
    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = proto.TrainerSpec.UNIGRAM, True
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((n, float(np.float32(-r.uniform(1, 9))), 1) for n in names)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["", "a", "é b", *("".join(r.choice(list("abcd  é"), int(n))) for n in r.integers(1, 60, 300))]
    rows = [(k, t, 0, b"x") for k, t in enumerate(texts)]
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded binary"), str(path), "viterbi")
    for row in got.collect():
        own, theirs = np.frombuffer(row.ids, "<u4").tolist(), sp.encode(row.text)
        # equal but for paths of equal worth, which the library's single precision orders as it rounds
        assert own == theirs or sum(map(sp.get_score, own)) == pytest.approx(sum(map(sp.get_score, theirs)), rel=1e-6), row.text
        assert row.ids == row.best_sum_ids and row.decoded == row.text


def test_viterbi_is_the_best_sum():
    r = np.random.default_rng(3)
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bca"]
    pieces = sentencepieces.Pieces(names, [0.0, *(-r.uniform(1, 9, len(names) - 1)).tolist()], ["unknown", *["normal"] * (len(names) - 1)], "viterbi")

    def best(w):
        top = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                i = pieces.ids.get(w[s:e])
                worth = pieces.score[i] if i is not None else pieces.low if e - s == 1 else -1e18
                top[e] = max(top[e], top[s] + worth)
        return top[-1]

    words = {"▁" * int(r.integers(0, 2)) + "".join(r.choice(list("abcd"), int(r.integers(1, 12)))) for _ in range(300)}
    for w, ids, _ in pieces.words(sorted(words)):
        total = sum(pieces.low if i == 0 else pieces.score[i] for i in np.frombuffer(ids, "<u4").tolist())
        assert total == pytest.approx(best(w))


def test_pieces_table(spark):
    rows = [(1, "a b"), (1, None), (None, ""), (2, "x" * 5000)]
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.decoded, len(r.ids) > 0) for r in got] == [("a b", True), ("", False), ("", False), ("x" * 5000, True)]
    assert sentencepieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("word", ["m0r0n", "i d i o t", "l.o.s.e.r", "idiooooot", "tr-a-sh", "p@thet1c", "c l o w n", "LOOOSER", "1d10t"])
def test_disguises_are_undone(word):
    counts = np.zeros((28, 28, 28))
    for w in ("moron idiot loser trash pathetic clown " * 50 + "the and of tion nd er on dit hat " * 40).split():
        codes = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    plain = {"m0r0n": "moron", "i d i o t": "idiot", "l.o.s.e.r": "loser", "idiooooot": "idiot", "tr-a-sh": "trash", "p@thet1c": "pathetic", "c l o w n": "clown", "LOOOSER": "loser", "1d10t": "idiot"}
    assert plain[word] in toxicity.Channel(counts).restored(f"so {word} there").split()


def readings(channel, word):
    """Every path through a word's lattice: (score, letters)."""
    paths = [(0.0, "", (0, 0))]
    for c in word.lower():
        step = []
        for score, text, (x, y) in paths:
            if c.isalpha():
                options = [(c, 0.0)] + ([("", -toxicity.REPEAT)] if text[-1:] == c else [])
            else:
                stands = toxicity.STANDS_FOR.get(c)
                options = [(s, -toxicity.SUBSTITUTE) for s in stands or ""] + [("", -toxicity.DROP if stands or stands is None else -toxicity.LEAVE_OUT)]
            for s, cost in options:
                if s:
                    k = toxicity.letter_class(s)
                    step.append((score + cost + channel.log[x][y][k], text + s, (y, k)))
                else:
                    step.append((score + cost, text, (x, y)))
        paths = step
    return [(score + channel.log[x][y][0], text) for score, text, (x, y) in paths]


@pytest.mark.parametrize("word", ["1d10t", "sh1|t", "a$$", "iiidiooot", "m.0-r_0n", "€£¡(x", "l00ser!", "aab11bb", "é1é", "7r4sh", "9^9"])
def test_viterbi_takes_the_best_path(channel, word):
    every = readings(channel, word)
    best = max(score for score, _ in every)
    assert channel.viterbi(word) in {text for score, text in every if score > best - 1e-9}


@pytest.fixture(scope="module")
def channel():
    counts = np.zeros((28, 28, 28))
    for w in ("moron idiot loser trash shit sunde pathetic clown ass " * 50 + "the and of tion nd er on dit hat " * 40).split():
        codes = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    return toxicity.Channel(counts)


def sought(channel, texts):
    """Restored words of each text by way of the words that bytes point out."""
    out = [[] for _ in texts]
    for w, i in zip(*toxicity.suspects(*toxicity.text_bytes(pa.array(texts, pa.string()))), strict=True):
        out[i] += channel.restored(w).split()
    return out


DISGUISES = {"idio7": "idiot", "shi7": "shit", "as5": "ass", "a$$": "ass", "id€ot": "ideot", "£oser": "loser", "¡diot": "idiot", "(lown": "clown", "1 d 1 0 t": "idiot", "i d 1 0 t": "idiot", "s ü n d e": "sünde", "д у р а к": "дурак", "“i d i o t”": "idiot", "i. d. i. o. t": "idiot", "дууурак": "дурак"}


def test_bytes_point_out_every_disguise(channel):
    texts = [f"so {w} there" for w in DISGUISES] + list(DISGUISES)
    for want, got in zip([*DISGUISES.values()] * 2, sought(channel, texts), strict=True):
        assert want in got


@given(st.lists(st.text(st.sampled_from("aAiIto15$!€£¡(.,-_*'/éÉдуД²٣“— \n\t"), max_size=24), min_size=1, max_size=4))
@settings(max_examples=1500, deadline=None)
def test_bytes_lose_nothing(channel, texts):
    assert [sorted(x) for x in sought(channel, texts)] == [sorted(channel.restored(t).split()) for t in texts]


@pytest.mark.parametrize(
    "chunk",
    ["id" + "i" * 100 + "ot", "nice,words," * 6 + "1d10t", "1d10t" + "/nice/words" * 6, "nice-words." * 6 + "id-i-ot" + "-nice" * 6, "nice," * 20 + "i,d,i,o,t" + ",nice" * 20, "nice," * 20 + "1d" + "i" * 80 + "0t", "i." + "." * 90 + "diot"],
)
def test_long_chunks_are_read(channel, chunk):
    assert len(chunk) > 64 and "idiot" in sought(channel, [f"so {chunk} there"])[0]


def test_long_words_are_decoded_whole(channel):
    for n in (20, 20_000):
        assert channel.restored("p4thetic" * n) == "pathetic" * n


def test_disguises_are_scored(spark):
    plain = [(k, f"{'of the and tion ' * 3}{'idiot' if k % 3 == 0 else 'sunny'} here", int(k % 3 == 0)) for k in range(600)]
    odd = [(1000 + k, f"the tion of {w} here") for k, w in enumerate(w for w, p in DISGUISES.items() if p == "idiot")]
    docs = spark.createDataFrame([r[:2] for r in plain] + odd, "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame([r[::2] for r in plain], "doc_id long, toxic int")).where("doc_id >= 1000").collect()
    assert len(got) == len(odd) and all(r.predicted for r in got)


def test_texts_without_evidence(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, " \n"), (3, "q" * 100_000), (4, "fine")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, score int, held_out string")
    got = toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1
    assert all(0 <= r.score < toxicity.THRESHOLD and r.predicted == 0 for r in got)
    assert {r.doc_id: r.held_out for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}


def test_held_out_scores(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    words = ["vile", "rotten"]
    rows = [(10_000 + k, f"{'of the and tion ' * (k % 7 + 3)}{words[k % 2] if k % 5 == 0 else 'fine'} here and there", "en", "s", 1) for k in range(1500)]
    more = docs.unionByName(spark.createDataFrame([*rows, (None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema)).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(0))
    told = labels.where("toxic = 0").unionByName(spark.createDataFrame([(r[0], 1, int("fine" not in r[1])) for r in rows] + [(None, None, None), (5, None, None)], labels.schema))
    got = toxicity.score(more, told).join(spark.createDataFrame([(r[0], int("fine" not in r[1])) for r in rows], "doc_id long, y int"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.predicted != r.y for r in got) <= 0.02 * len(got)
    assert toxicity.score(more, told).count() == more.count()
    assert toxicity.score(more.limit(0), told).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(90_001, None, "en", "s", None), (90_002, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (90_003, "token=abcdef12 x y", None, None, 18), (90_004, "same row here", "en", "s", 13), (90_004, "same row here", "en", "s", 13)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("key", F.lit("extra"))
    n = docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)
        assert tuple(docs.columns) == c.COLUMNS
        assert (left := docs.count()) <= n
        n = left
    assert {"[SECRET] x y"} <= {r.text for r in docs.collect()}
    assert docs.where("doc_id = 90004").count() == 1 and docs.where("doc_id IS NULL").count() == 1
    assert c.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == n


def test_uncut_texts_stay(spark, sf_dir):
    import corpus_pipeline as c

    passage = "é" * 150
    rows = [(1, "a \ufffd b"), (2, None), (3, ""), (4, f"\ufffd one {passage} x"), (5, f"two {passage} \ufffdy")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in c.without_repeats(spark, docs, sf_dir).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["a \ufffd b", None, ""]
    assert got[4].startswith("\ufffd one") and got[5].endswith("\ufffdy") and passage not in got[4] + got[5]


def test_registered_queries():
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in e.queries()
