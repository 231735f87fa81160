"""Main text of web pages by two passes of block rules.

The first pass looks at each block alone: stop-word density, length and link density make it good,
bad or, where it is too short to tell, open; where a page or block has no stop words of the languages
known (English, German, French, Spanish), length and link density decide alone. The second gives open blocks the label of their
nearest decided neighbours. What markup itself names as no article (menus, footers, forms, scripts,
boxes whose class says advert or comments) is bad from the start; within an article only whole
names of containers count. Names that articles use too (notice, discussion) leave it to the text.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partition, ship, slices

#: Link density above which a block is bad; stop-word densities; lengths in characters.
LINKS, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.33, 0.05, 0.25, 25, 200
#: Where no stop words are known: width from which a block is good. Characters of scripts without spaces are three wide.
PLAIN = 70
WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u109f\u1780-\u17ff]")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that keep a place on the stack, as what they hold depends on them.
HOLDERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 dt dd li td th tr option".split())
NEVER = frozenset("nav footer aside form fieldset menu dialog search head button label legend".split())
WORDS = (
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr login masthead menu menubar modal nav "
    "navbar navigation newsletter overlay paywall popup promoted rail share sharing sidebar signup skyscraper sponsor sponsored subscribe subscription toolbar topbar widget widgets"
)
NAMED = frozenset(WORDS.split())
#: Names that articles have too: they say nothing within one, and elsewhere the text of their blocks decides.
DOUBTFUL = frozenset(
    "alert byline copyright disclaimer discussion feedback header notice notices notification popular promo promotion reactions recommended related replies reply respond responses social tags warning".split()
)
#: Names that count within an article as an id too; other ids there name sections.
IDS = frozenset("ad ads comment comments disqus footer sidebar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
STOPS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up into than them only other its about after where what here
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ihre
    le la les de des et un une du en est que dans qui pour pas au sur plus par il ne se ce sont avec son mais comme ou si leur elle cette ces aux nous vous ils on être fait sans deux même tout
    el los las que y en un una por con no su para es al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos""".split()
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
#: Elements that are skipped up to their closing tag, or only their tag where it is missing; of these, those that "/>" ends.
EMPTY = frozenset("svg iframe object canvas video audio".split())
SKIPPED = EMPTY | frozenset("noscript template textarea select button title annotation annotation-xml".split())
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
MARK = re.compile(r"""\b(?:class|(id)|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)


class Block:
    __slots__ = ("bad", "chars", "doubt", "heading", "inside", "linked", "parts")

    def __init__(self, bad: bool, inside: bool, heading: bool, doubt: bool) -> None:
        self.parts: list[str] = []
        self.chars = self.linked = 0
        self.bad, self.inside, self.heading, self.doubt = bad, inside, heading, doubt


def named_bad(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name, class, id or role says that it holds no article."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if "=" not in attributes:
        return False
    role = ROLE.search(attributes)
    if role and role[1].lower() in ROLES:
        return True
    marks = [(bool(m[1]), m[2] or m[3] or m[4] or "") for m in MARK.finditer(attributes)]
    if name == "article":
        return any(w.lower() in ("comment", "comments", "reply") for _, value in marks for w in SPLIT.split(value))
    if name in ("html", "body", "main"):
        return False
    if inside:
        return name in HOLDERS and any(w in (IDS if is_id else NAMED) for is_id, value in marks for w in value.lower().split())
    return any(w.lower() in NAMED for is_id, value in marks if name in HOLDERS or not is_id for w in SPLIT.split(value))


def doubtful(name: str, attributes: str) -> bool:
    """Whether the name of an element outside an article may say that it holds none."""
    return name not in ("html", "body", "article", "main") and any(w in DOUBTFUL for m in MARK.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split())


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with what the markup around them says."""
    stack: list[tuple[str, bool, bool, bool]] = []
    bad = inside = doubt = False
    links, heading = 0, False
    out: list[Block] = []
    now = Block(False, False, False, False)
    breaks = 0

    def add(text: str) -> None:
        nonlocal breaks
        if text:
            if "&" in text:
                text = unescape(text)
            now.parts.append(text)
            n = len(text) - text.count(" ")
            if n and not text.isspace():
                breaks = 0
                now.chars += n
                if links:
                    now.linked += n

    def fresh() -> None:
        nonlocal now, breaks
        if now.chars:
            out.append(now)
        now, breaks = Block(bad, inside, heading, doubt and not inside), 0

    at = 0
    unclosed: set[str] = set()
    while m := TAG.search(html, at):
        if at < m.start():
            add(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        if name in SKIPPED and not closing and name not in unclosed and not (name in EMPTY and m[0].endswith("/>")):
            if close := CLOSING[name].search(html, at):
                at = close.end()
                continue
            unclosed.add(name)
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            now.parts.append(" ")
            breaks += 1
            if breaks > 1:
                fresh()
        elif name in ("td", "th", "img", "input"):
            now.parts.append(" ")
        if name not in BLOCKS or name in ("td", "th"):
            continue
        if name[0] == "h" and name[1:].isdigit():
            heading = not closing
        links = 0
        if name in HOLDERS:
            if closing:
                if any(s[0] == name for s in stack):
                    while stack:
                        top, bad, inside, doubt = stack.pop()
                        if top == name:
                            break
            elif not m[0].endswith("/>"):
                stack.append((name, bad, inside, doubt))
                own = named_bad(name, m[4] or m[7] or "", inside)
                bad = bad or own
                doubt = doubt or doubtful(name, m[4] or m[7] or "")
                inside = inside or (name in ("article", "main") and not own)
        elif not closing and not bad and "=" in (m[4] or m[7] or "") and named_bad(name, m[4] or m[7], inside):
            fresh()
            now.bad = True
            continue
        fresh()
    add(html[at:])
    fresh()
    return out


def stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOPS for w in words), len(words)


def foreign(text: str) -> bool:
    """Whether most letters are of scripts that no known language is written in."""
    return not text.isascii() and 2 * sum(c > "\u024f" for c in text if c.isalpha()) > sum(map(str.isalpha, text))


def labels(found: list[Block], texts: list[str]) -> list[bool]:
    """Whether each block belongs to the article."""
    structured = any(b.inside and not b.bad for b in found)
    out_of_it = [b.bad or b.linked > LINKS * b.chars or (structured and not b.inside) for b in found]
    counts = [(0, 0) if gone else stops(text) for gone, text in zip(out_of_it, texts, strict=True)]
    # pages in a language without known stop words, but for chance hits: length and links decide alone
    letter = sum(w in ("a", "y", "o") for gone, text in zip(out_of_it, texts, strict=True) if not gone for w in text.lower().split())
    unknown = sum(n for n, _ in counts) - letter < STOP_HIGH / 2 * sum(n for _, n in counts)
    width = [len(text) + 2 * len(WIDE.findall(text)) if not text.isascii() else len(text) for text in texts]
    alone = [not gone and (unknown or foreign(text)) for gone, text in zip(out_of_it, texts, strict=True)]
    least = PLAIN if any(a and w >= PLAIN and not b.heading for a, w, b in zip(alone, width, found, strict=True)) else SHORT
    first: list[str] = []
    for k, (b, text) in enumerate(zip(found, texts, strict=True)):
        if out_of_it[k]:
            first.append("bad")
            continue
        density = counts[k][0] / counts[k][1] if counts[k][1] else 0.0
        if (width[k] if alone[k] else len(text)) < SHORT or b.heading:
            first.append("open")
        elif density >= STOP_HIGH or (density >= STOP_LOW and len(text) >= LONG) or b.inside:
            first.append("good")
        elif alone[k]:
            first.append("good" if width[k] >= least else "open")
        elif density >= STOP_LOW:
            first.append("open")
        else:
            first.append("open" if len(text) >= LONG or density else "bad")
    decided = [i for i, x in enumerate(first) if x != "open"]
    # a notice or an advert within the article says nothing about the blocks beside it
    within = [i for i in decided if found[i].inside and not found[i].bad]
    out = [x == "good" for x in first]
    if not decided:
        return [structured or sum(map(len, texts)) >= LONG] * len(first)
    for i, x in enumerate(first):
        if x != "open":
            continue
        near = within if found[i].inside else decided
        k = bisect(near, i)
        before = first[near[k - 1]] if k else None
        after = first[near[k]] if k < len(near) else None
        if found[i].inside:
            out[i] = not near or "good" in (before, after)
        elif found[i].heading:
            out[i] = after == "good"
        else:
            out[i] = before == "good" and after == "good" if None not in (before, after) or found[i].doubt else "good" in (before, after) and len(texts[i]) >= SHORT
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for a null or empty page."""
    found = blocks(html or "")
    texts = [" ".join("".join(b.parts).split()) for b in found]
    return "\n".join(t for t, good in zip(texts, labels(found, texts), strict=True) if good and t)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row, then text and n_chars.

    Null and empty pages give an empty text. Whole pages are read; rows with null or repeated ids are pages like
    others; an empty table gives an empty result; columns not named are not read, so their names can't clash.
    """
    ship(pages.sparkSession)
    source = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(column).cast("string"), F.lit("")).alias("html_"))

    @partition
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html_"):
                texts = [main_text(h) for h in piece.column("html_").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_text": op8_html_text}
