"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides from where a block
stands (menus, page footers and asides are boilerplate; forms, page headers and what class,
id or role name as boilerplate are so too unless they hold the page's text) and from its
length, link density and stop-word density; an article element that holds much of the page's
text is a prior for these. On a page in a language without known stop words, length and link
density decide. Short blocks and middling ones stay open; in the second pass they take the
label of their nearest decided neighbours. If that leaves nothing, paragraphs and sentences
that nothing speaks against are the text.

A page is read once from start to end, in time proportional to its length however broken it
is: a tag whose quotes never close ends the reading of quotes on that page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that end a block, tags whose content is no text, tags of boilerplate.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split())
NO_TEXT = frozenset(
    "applet audio button canvas datalist embed head iframe map math noembed noframes noscript object script select "
    "style svg template textarea title video".split())
BOILERPLATE = frozenset("aside footer menu nav".split())
# Tags of boilerplate that some pages put around everything, so that what they hold decides.
WRAPPERS = frozenset("dialog fieldset form".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion recommended related replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags toc toolbar warning widget complementary replylist discussion responses".split())
# Those of them that name reader comments, which can be longer than the page's own text, and
# first words of a class that tells how a wrapper is laid out.
TALK = frozenset("comment comments commentlist discussion disqus replies replylist respond responses".split())
LAYOUT = frozenset("has layout no non not with without".split())
# Frequent words of the languages that pages are expected in.
STOP = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "aber als am an auf aus bei das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une "
    "así con como del el en es la las lo los no o para por que se su una y".split())

REMARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OPENED = re.compile(r"</?[a-zA-Z]")
UNFINISHED = re.compile(r"<(?:/?[a-zA-Z][^<>]*|/|!-{0,2})?\Z")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CONCEALED = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
# Scripts that write a word in one or two characters; ends of sentences.
DENSE_SCRIPT = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
SENTENCE = re.compile("[.!?\u2026\u0964\u061f\u3002\uff01\uff1f][\"'\u00bb\u201c\u201d\u2019)\\]]*$")
CAMEL = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("parts", "linked", "inside", "away", "heading", "paragraph", "text", "label", "named", "against")

    def __init__(self, inside: int, away: bool, heading: bool, paragraph: bool, named: int):
        self.parts: list[str] = []
        self.linked = 0
        self.inside, self.away, self.heading, self.named = inside, away, heading, named
        self.paragraph = paragraph
        self.text, self.label, self.against = "", "", False


class Named:
    """An element whose tag is one of WRAPPERS, or whose class, id or role has a word of NAMES."""

    __slots__ = ("above", "vote", "talk", "article", "own", "held", "against", "away")

    def __init__(self, above: int, vote: int, talk: bool):
        self.above, self.vote, self.talk = above, vote, talk
        self.article = self.against = self.away = False
        self.own = self.held = 0


class Page(list):
    """The blocks of a page; for each article or main element, from 1, the one around it or 0."""

    above: list[int]


def named(attributes: str) -> tuple[int, bool]:
    """How far class, id or role name boilerplate, and whether as reader comments: 2 by a whole name, 1 by a part of one."""
    vote, talk = 0, False
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in CAMEL.split(name) if w]
            if parts and parts[0] not in LAYOUT and not NAMES.isdisjoint(parts):
                vote = max(vote, 2 if len(parts) == 1 else 1)
                talk = talk or not TALK.isdisjoint(parts)
    return vote, talk


def weigh_names(found: list[Block], names: list[Named], short: int = 70, long: int = 200, links: float = 0.5) -> None:
    """Settles what the names of elements mean for the blocks inside.

    A name is no reason against an element that holds most of the page's text outside of
    links, or the article; reader comments count as that only where there is next to nothing
    else. Otherwise a whole name, and any name of comments, takes the element away, unless it
    holds an article; then, as for a part of a name, it is a vote against its blocks.
    """
    free = total = 0
    for b in found:
        if not b.away and b.linked <= links * len(b.text):
            total += len(b.text)
            if b.named:
                names[b.named].own += len(b.text)
            else:
                free += len(b.text)
    for e in reversed(names[1:]):
        e.held += e.own
        names[e.above].held += e.held
        names[e.above].article |= e.article
    for e in names[1:]:
        over = names[e.above]
        most = e.held > free and (e.article or e.held >= long and 2 * e.held > total) and not (e.talk and free >= short)
        e.away = over.away or not most and (e.talk or e.vote == 2 and not e.article)
        e.against = over.against or not most
        if not e.against:
            free += e.own
    for b in found:
        if b.named:
            b.away = b.away or names[b.named].away
            b.against = names[b.named].against


def blocks(page: str) -> Page:
    """The blocks of a page that hold text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, boilerplate, article, named element
    articles = [0]
    names = [Named(0, 0, False)]
    places: dict[str, list[int]] = {}  # where each tag is open on the stack
    walls: list[int] = []  # where block-level tags are
    links = 0
    current: Block | None = None
    at = 0
    quoted, last = TAG, page.rfind(">")

    def add(raw: str) -> None:
        nonlocal current
        if not raw or stack and stack[-1][1] and stack[-1][0] in NO_TEXT:
            return
        if current is None:
            if raw.isspace():
                return
            away = bool(stack) and stack[-1][1]
            inside, name = stack[-1][2:] if stack else (0, 0)
            near = [s[0] for s in stack[-3:]]
            current = Block(inside, away, not HEADINGS.isdisjoint(near), "p" in near, name)
            out.append(current)
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    def cut(i: int) -> None:
        nonlocal links
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BLOCK:
                walls.pop()
            links -= tag == "a"

    def close(tag: str) -> None:
        open_at = places.get(tag)
        if open_at and (tag in BLOCK or not walls or walls[-1] < open_at[-1]):
            cut(open_at[-1])

    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = REMARK.match(page, start)
        if m is None and start < last and OPENED.match(page, start):
            m = quoted.match(page, start)
            if m is None:
                quoted = LOOSE
                m = quoted.match(page, start)
        if m is None:
            if UNFINISHED.match(page, start):
                add(page[at:start])
                break
            add(page[at:start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        if m.re is REMARK:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            current = None
        if m[1]:
            close(tag)
            continue
        if tag == "br":
            add(" ") if current is not None else None
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK and stack and stack[-1][0] not in BLOCK or tag == "p":
            # an open paragraph ends here, and with it what was left open inside
            if walls and stack[walls[-1]][0] == "p":
                cut(walls[-1])
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
            cut(len(stack) - 1)
        above = stack[-1] if stack else ("", False, 0, 0)
        inside, name = above[2:]
        if tag in ("article", "main"):
            articles.append(inside)
            inside = len(articles) - 1
            names[name].article = True
        away = above[1] or tag in BOILERPLATE or tag in NO_TEXT
        if tag not in ("html", "body", "article", "main") and tag not in HEADINGS:
            away = away or bool(CONCEALED.search(m[3]))
            vote, talk = named(m[3])
            if tag in WRAPPERS or tag == "header" and not inside:
                vote = 2
            if vote:
                names.append(Named(name, vote, talk))
                name = len(names) - 1
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            walls.append(len(stack))
        stack.append((tag, away, inside, name))
        links += tag == "a"
    for b in out:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
    full = Page(b for b in out if b.text)
    full.above = articles
    weigh_names(full, names)
    return full


def decide(found: Page, short: int = 70, long: int = 200, links: float = 0.5, low: float = 0.15,
           high: float = 0.3, foreign: float = 0.03) -> None:
    """Labels each block text or none, in two passes.

    An article or main element that holds at least half as much as what is largest on the
    page is a prior: inside of it blocks are text at a lower density, and short ones if no
    decided neighbour speaks against it; outside of it only long and dense ones are.
    """
    above = found.above
    density, linked, sizes = [], [], []
    stops = total = 0
    own, top = [0] * len(above), list(range(len(above)))
    for b in found:
        words = WORD.findall(b.text.lower())
        known = sum(w in STOP for w in words)
        density.append(known / max(1, len(words)))
        linked.append(b.linked > links * len(b.text))
        sizes.append(len(b.text) + (0 if b.text.isascii() else 2 * len(DENSE_SCRIPT.findall(b.text))))
        if not b.away and not linked[-1] and sizes[-1] >= short:
            stops, total = stops + known, total + len(words)
    if stops < foreign * total:
        # no language whose stop words are known: what length says stands for the density
        density = [max(d, high if size >= long else low if size >= short else 0) for d, size in zip(density, sizes)]
    for i, b in enumerate(found):
        if not b.away and not linked[i] and (b.inside or density[i] >= low and sizes[i] >= short):
            own[b.inside] += len(b.text)
    held = list(own)
    for c in range(len(above) - 1, 0, -1):
        held[above[c]] += held[c] if above[c] else 0
    for c in range(1, len(above)):
        top[c] = top[above[c]] or c
    prior = [c > 0 and 2 * held[c] >= max(own) > 0 for c in range(len(above))]
    some = any(prior)
    for i, b in enumerate(found):
        size, dense = sizes[i], density[i]
        if b.away or linked[i]:
            b.label = "none"
        elif b.against or some and not b.inside:
            b.label = "text" if dense >= high and size >= long else "none" if b.against and not b.heading else "short"
        elif size < short:
            b.label = "short"
        elif prior[b.inside]:
            b.label = "text" if dense >= low or size >= long else "open"
        elif dense >= high or dense >= low and size >= long:
            b.label = "text"
        else:
            b.label = "open" if dense >= low else "none"
    first = [b.label for b in found]
    behind, ahead = _nearest(found, first, top), _nearest(found[::-1], first[::-1], top)[::-1]
    for i, b in enumerate(found):
        if first[i] not in ("short", "open"):
            continue
        if prior[b.inside] and not b.against:
            b.label = "none" if behind[i][1] == ahead[i][1] == "none" else "text"
            continue
        before, after = behind[i][0], ahead[i][0]
        b.label = before if before == after else "text" if first[i] == "open" or b.heading and after == "text" else "none"
    if not any(b.label == "text" for b in found):
        for i, b in enumerate(found):
            if first[i] in ("short", "open") and not b.against and (b.paragraph or SENTENCE.search(b.text)):
                b.label = "text"


def _nearest(found: list[Block], first: list[str], top: list[int]) -> list[tuple[str, str]]:
    """For each block the label of the nearest decided one before it: on the page, and in its outermost article."""
    page, of, out = "none", {}, []
    for b, label in zip(found, first):
        out.append((page, of.get(top[b.inside], "text")))
        if label in ("text", "none"):
            page = label
            if not b.away:
                of[top[b.inside]] = label
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: its text blocks in page order, two line ends between them."""
    if not page:
        return ""
    found = blocks(page)
    decide(found)
    return "\n\n".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A missing or empty page, and one without main text, gives an empty text. Broken markup
    is read as far as it goes; an unfinished tag at the end is no text. Other columns are
    not read; repeated rows give repeated results.
    """
    schema = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, schema[0].type),
                 pa.array([len(t) for t in texts], schema[1].type)], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
