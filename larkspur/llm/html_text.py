"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides the clear blocks by link density, by length and by the
density of stop words; where they stand counts too: navigation, forms, adverts, comments and the like never count, and
an article or main element that holds most of the readable text is taken for the whole. Pass two gives ambiguous short
blocks the label of their nearest decided neighbours.

Names in class and id tell furniture from text. Words that mean nothing else drop an element wherever they stand in a
name; ambiguous ones only where the whole name is made of such words (``notice-of-death`` is a subject, ``legal-notice``
a notice); and those that also head an article's sections (``discussion``) only where the element does not read like
prose or bears the marks of reader comments.

Cases: null or empty html gives an empty text, as does a page without text. Broken markup is read as browsers do as
far as it matters: an end tag closes what is open inside its element, an unmatched one is ignored, a ``<`` that opens
no tag is text, a quoted value that does not close ends with its tag. Pages of any length are read whole, in time that
grows with their length whatever their markup. Repeated rows are each read. Extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import map_batches, sliced

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title head button noembed noframes xmp audio video map datalist".split())
TEXT_ONLY = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
DROP = frozenset("nav aside footer form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())

#: Words in class or id that mark what is not the article, wherever they stand in a name.
UNWANTED = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot dfp sponsor sponsored sponsors promo promoted
    cookie cookies consent gdpr popup modal overlay paywall subscribe subscription newsletter signup login
    nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead
    sidebar widget widgets teaser teasers footer copyright comment comments commentlist disqus""".split()
)
#: Those that mark it where a name has no words but these, the ones above and PLAIN ones.
AMBIGUOUS = frozenset("aside alert alerts banner notice notices promotion related recommended recommendations share sharing reply replies".split())
#: Those that an article's own section may bear.
SECTIONS = frozenset("discussion feedback response responses respond legal disclaimer search foot social popular trending".split())
PLAIN = frozenset(
    """area bar block body bottom box btn button buttons col column container content div entry field form global group head heading icon icons inner item items
    left link links list main message messages module outer page panel post posts primary region right row secondary section site small text title top wrap wrapper zone""".split()
)
#: Words that make a name a phrase, as in an id that was made from a heading.
PHRASE = frozenset("a an and as at by for from in is it of on or the to was were with".split())
#: Marks of reader comments inside a section.
MARKS = frozenset("author avatar comment comments commenter permalink replies reply timestamp user username vote votes".split())

#: Frequent words of the supported languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for as was with be by on not this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    le la les de des du un une et à est que qui dans en pour pas par sur plus au avec ce se ne il elle sont mais ou son
    el los las y una por con para del como más su al lo pero sus le ya este sí porque esta entre cuando muy sin""".split()
)

_OPEN = re.compile(r"<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_QUOTE, _QUOTE_OR_END = re.compile("[\"']"), re.compile("[\"'>]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in TEXT_ONLY}
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LETTERS = re.compile(r"[^\W\d_]+")

KEEP, SUSPECT, DROP_IT = 0, 1, 2


class Block:
    __slots__ = ("chars", "inside", "label", "linked", "links", "region", "tag", "text")

    def __init__(self, text, linked, links, inside, tag, region):
        self.text, self.linked, self.links, self.inside, self.tag, self.region, self.label = text, linked, links, inside, tag, region, None
        self.chars = len(text)


class Region:
    """An element that may be a section of the article or reader comments."""

    __slots__ = ("height", "marks")

    def __init__(self, height):
        self.height, self.marks = height, 0


def _judge(name: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """What an element's tag says of its content, and whether it marks reader comments."""
    marks = name in ("form", "textarea")
    if name in DROP or name == "header" and not in_article:
        return DROP_IT, marks
    if not attrs or attrs.isspace():
        return KEEP, marks
    verdict = KEEP
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return DROP_IT, marks
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return DROP_IT, marks
        if key == "role" and value.lower() in ROLES:
            return DROP_IT, marks
        if key == "class" or key == "id" and name not in HEADINGS:
            for token in value.split():
                words = {w.lower() for w in _PARTS.findall(token)}
                marks = marks or not words.isdisjoint(MARKS)
                if name in ("html", "body", "main") or not words.isdisjoint(PHRASE):
                    continue
                if not words.isdisjoint(UNWANTED) or "header" in words and not in_article and name not in HEADINGS:
                    verdict = DROP_IT
                elif words <= SECTIONS | AMBIGUOUS | PLAIN and not words.isdisjoint(AMBIGUOUS):
                    verdict = DROP_IT
                elif words <= SECTIONS | PLAIN and not words.isdisjoint(SECTIONS):
                    verdict = max(verdict, SUSPECT if in_article and "form" not in words else DROP_IT)
    return verdict, marks


def blocks(html: str) -> list[Block]:
    """All text blocks outside dropped elements, in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked = links = 0
    stack: list[str] = []  # open elements; an empty name is one that was closed early
    places: dict[str, list[int]] = {}  # where each name stands in it
    block_at: list[int] = []  # and where block elements do
    regions: list[Region] = []
    drop_at = 0  # height of the stack at which the dropped element stands, 0 for none
    article = link = 0
    last_tag = ""
    loose = 0  # up to here tags end at the next >, as a quote before it does not close

    def close_block():
        nonlocal linked, links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, linked, links, article > 0, last_tag, regions[-1] if regions else None))
            text.clear()
        linked = links = 0

    def add(raw):
        nonlocal linked
        if raw:
            t = unescape(raw) if "&" in raw else raw
            text.append(t)
            if link:
                linked += len(t.strip())

    def push(name):
        nonlocal article, link
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            block_at.append(len(stack))
        stack.append(name)
        if name in ("article", "main"):
            article += 1
        elif name == "a":
            link += 1

    def pop():
        nonlocal article, link, drop_at
        name = stack.pop()
        if name:
            places[name].pop()
            if name in BLOCK:
                block_at.pop()
            if name in ("article", "main"):
                article -= 1
            elif name == "a":
                link -= 1
        if drop_at and len(stack) < drop_at:
            drop_at = 0
        if regions and len(stack) < regions[-1].height:
            regions.pop()
        return name

    def tag_end(at):
        """Where the tag ends whose name ends at `at`. Only a quote that follows an equals sign opens a value."""
        nonlocal loose
        end = html.find(">", at)
        if end < 0:
            return size
        m = None if at < loose else _QUOTE.search(html, at, end)
        while m is not None and m[0] != ">":
            i = m.start()
            back = i - 1
            while html[back].isspace():
                back -= 1
            if html[back] == "=" and back >= at:
                i = html.find(m[0], i + 1)
                if i < 0:
                    loose = m.start() + 1
                    return end
            m = _QUOTE_OR_END.search(html, i + 1)
            if m is None:
                return size
            end = m.start()
        return end

    at, size = 0, len(html)
    while at < size:
        m = _OPEN.search(html, at)
        if m is None:
            if not drop_at:
                add(html[at:])
            break
        if not drop_at and m.start() > at:
            add(html[at : m.start()])
        name = m["name"]
        if name is None:
            if m[0] == "<!--":
                end, skip = html.find("-->", m.end() - 2), 3
            elif m[0] == "<![CDATA[":
                end, skip = html.find("]]>", m.end()), 3
                if not drop_at:
                    add(html[m.end() : end if end >= 0 else size])
            else:
                end, skip = html.find(">", m.end()), 1
            at = end + skip if end >= 0 else size
            continue
        name = name.lower()
        end = tag_end(m.end())
        attrs, at = html[m.end() : end], end + 1
        block = name in BLOCK
        if m["end"]:
            if name == "br" and not drop_at:
                text.append(" ")
            if block and not drop_at:
                close_block()
            if places.get(name):
                while pop() != name:
                    pass
            continue
        if name == "br":
            if not drop_at:
                text.append(" ")
            continue
        if block and not drop_at:
            close_block()
            last_tag = name
        if name in TEXT_ONLY:
            if regions and name == "textarea":
                regions[-1].marks += 1
            stop = _CLOSE[name].search(html, at)
            at = size if stop is None else html.find(">", stop.end()) + 1 or size
            continue
        if name in VOID or attrs.endswith("/") and not block:
            continue
        if name == "p" and places.get("p") and places["p"][-1] == block_at[-1]:
            while pop() != "p":  # an open paragraph ends here, with the inline tags in it
                pass
        elif name == "a" and places.get("a") and (not block_at or places["a"][-1] > block_at[-1]):
            stack[places["a"].pop()] = ""
            link -= 1
        verdict, marks = _judge(name, attrs, article + (name in ("article", "main")) > (name == "article"))
        if drop_at and verdict == KEEP and name in ("article", "main") and stack[drop_at - 1] in ("nav", "header", "form", "menu"):
            height = drop_at  # a navigation that nobody closed
            while len(stack) >= height:
                pop()
        push(name)
        if name == "a":
            links += 1
        if regions and marks:
            regions[-1].marks += 1
        if not drop_at:
            if verdict == DROP_IT or name in RAW:
                drop_at = len(stack)
            elif verdict == SUSPECT:
                regions.append(Region(len(stack)))
    close_block()
    return out


def _prose(own: list[Block]) -> bool:
    """Whether blocks read like a section of an article: enough text, in sentences, few links."""
    chars = sum(b.chars for b in own)
    return chars >= 70 and sum(b.linked for b in own) <= 0.2 * chars and _stop_density(" ".join(b.text for b in own)) >= 0.15


def classify(found: list[Block]) -> None:
    """Set every block's label: good or bad."""
    suspects: dict[Region, list[Block]] = {}
    for b in found:
        if b.region is not None:
            suspects.setdefault(b.region, []).append(b)
    for region, own in suspects.items():
        if region.marks or not _prose(own):
            for b in own:
                b.label = "bad"
    rest = [b for b in found if b.label is None]
    stop = {id(b): _stop_density(b.text) for b in rest if b.chars >= 70}
    inside = sum(b.chars - b.linked for b in rest if b.inside)
    outside = sum(b.chars for b in rest if not b.inside and b.chars > 140 and b.linked <= 0.33 * b.chars and stop[id(b)] >= 0.3)
    framed = inside > 0 and inside >= outside  # else the articles are teasers beside the text
    for b in rest:
        density = b.linked / b.chars
        if framed:
            if not b.inside or density > 0.8 and b.links > 1:
                b.label = "bad"
            elif b.chars >= 70 or not b.links and _stop_density(b.text) >= 0.2:
                b.label = "good"
            continue
        if density > 0.33 or "©" in b.text and b.chars < 200:
            b.label = "bad"
        elif b.chars < 70:
            b.label = "bad" if b.linked else None
        elif stop[id(b)] >= 0.3:
            b.label = "good" if b.chars > 140 else None
        elif stop[id(b)] < 0.15:
            b.label = "bad"
    decided = [(i, b.label) for i, b in enumerate(found) if b.label]
    k = 0
    for i, b in enumerate(found):
        while k < len(decided) and decided[k][0] < i:
            k += 1
        if b.label:
            continue
        left, right = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        near = [x for x in (left, right) if x]
        if not near:
            b.label = "good" if framed or b.tag not in HEADINGS else "bad"
        elif len({x[1] for x in near}) == 1:
            b.label = near[0][1]
        elif framed or b.tag in HEADINGS and right and right[1] == "good" or b.chars >= 70:
            b.label = "good"
        else:
            b.label = min(near, key=lambda x: (abs(x[0] - i), x[1] == "good"))[1]


def _stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    classify(found)
    return " ".join(b.text for b in found if b.label == "good")


_HTML = re.compile(r"<html(?=[\s/>])", re.I)


def declared_language(html: str | None) -> str | None:
    """What the first html element's lang attribute says."""
    m = _HTML.search(html or "")
    if m is None:
        return None
    end = html.find(">", m.end())
    for a in _ATTR.finditer(html, m.end(), end if end >= 0 else len(html)):
        if a[1].lower() == "lang":
            return (a[2] or a[3] or a[4] or "").strip() or None
    return None


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, declared_lang (of the html element, or null): one row per page row, by a map over the scan."""

    def run(batches):
        import pyarrow as pa

        from larkspur.llm.html_text import declared_language, main_text

        for b in sliced(batches, "html"):
            html = b.column(2).to_pylist()
            texts = [main_text(h) for h in html]
            said = [declared_language(h) for h in html]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(said, pa.string())], names=["page_id", "url", "text", "n_chars", "declared_lang"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long, declared_lang string")
