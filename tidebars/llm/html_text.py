"""Main text of HTML pages by two passes over their blocks.

Pass one gives each block of text a label from where it stands (containers for menus, headers, footers,
sidebars, notices, adverts, forms, comments; an article or main element if the page has one), its length, its
share of stop words and its share of link text. Blocks too short, or otherwise undecided, get the label of their
nearest decided neighbour in pass two; inside the page's article a good neighbour on either side is enough. Where no
block is good, or none is decided near by, undecided text stays: it has nothing against it.

A container that is bad by its names alone is let off if it holds the page's main element, or most of the page's text
while the hint is only part of a name, or most of the text or the first article while no block outside is good. A hint
beside other words of content ("social-history") never stands against a block that reads as prose.

A page is scanned once from left to right; what is known to be missing ahead (a closing quote, a closing tag, a ">") is
remembered, so the time grows with the page's length alone.

Defined results: null or empty html has an empty text and 0 characters; rows that repeat a page_id, or have
none, are extracted row by row; an empty table gives no rows; columns other than page_id, url and html are ignored;
a page of any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.store import small_batches

#: Elements whose content is never text of the page; of the first ones a missing end means the rest of the page.
_RAW_TO_END = frozenset(("script", "style"))
_RAW = _RAW_TO_END | frozenset("noscript template textarea svg math iframe object title select".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN_REST = re.compile(r"[^>\"']*>")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)(\s*=\s*)?")
_BARE_VALUE = re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BAD_NAME = re.compile(
    r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|complementary|footer|contentinfo|masthead|toolbar|pagination|pager|share|social|related|recommended|newsletter|subscribe|signup|login|search|comments?|disqus|replies|respond|widget|form)\d*",
    re.I,
)
#: Parts of a name that say what a container has, or how it is set, not what it is.
_STATE = frozenset("has have no not with without is open opened closed enabled disabled on off active count".split())
#: Parts of a name that say where or how a container stands; beside them a hint keeps its weight.
_PLACES = frozenset(
    "area bar block body bottom box btn button buttons cell center col column container content desktop div element fixed float footer global grid group header holder icons inner item items left links list main mini mobile module outer overlay page panel post posts primary right row secondary section site slot small stack sticky text top unit view wide wrap wrapper zone".split()
)
_BAD_TAGS = frozenset("nav footer aside button dialog menu head".split())
_MAIN_TAGS = frozenset(("article", "main"))
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Function words of the languages expected; fixed values.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can do for from had has have he her his i if in into is it its more not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und vom von vor war wie wir zu zum zur
    al como con del el ella en entre era es esta este fue ha hay la las lo los más muy no o para pero por que se ser si sin sobre su sus un una y ya""".split()
)
_WORD = re.compile(r"[^\W\d_]+")

#: Scripts written without spaces between words; a character counts as several.
_DENSE_SCRIPT = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[.!?…]['\"’”»)\]]*(?:\s|$)|[。！？]|[।۔؟]")

SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.12, 0.2, 0.33
#: Characters that one character of a dense script counts as, and characters a sentence of prose has at most on average.
DENSE_WEIGHT, SENTENCE = 3, 400


class Named:
    """A container that is bad by its names, within others of the kind."""

    __slots__ = ("article", "bad", "hint", "main", "outer", "strict", "weight")

    def __init__(self, hint: str, outer: Named | None):
        self.hint, self.outer, self.article, self.main, self.weight = hint, outer, False, False, 0.0


class Block:
    """Text between two block boundaries: pieces, link characters, context."""

    __slots__ = ("dense", "heading", "label", "links", "main", "named", "text")

    def __init__(self, text: str, links: int, bad: bool, main: int, heading: bool, named: Named | None):
        self.text, self.main, self.heading, self.named = text, main, heading, named
        self.links = links / max(1, len(text))
        self.label = "bad" if bad else ""
        self.dense = not bad and reads_as_prose(text)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def hides(attrs: dict[str, str]) -> bool:
    return attrs.get("hidden", "until-found").lower() != "until-found" or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDES.search(attrs.get("style", "")))


def hint(attrs: dict[str, str]) -> str:
    """"whole" if a class, id or role is a hint word, "part" if one has a hint word between - or _ beside words of place
    alone, "weak" if beside others, else ""."""
    found = ""
    for name in " ".join(attrs.get(n, "") for n in ("class", "id", "role")).split():
        if name.lower() == "hidden" or _BAD_NAME.fullmatch(name):
            return "whole"
        parts = [x.lower() for x in re.split("[-_]", name.split("--")[0]) if x]
        hits = [x for x in parts if _BAD_NAME.fullmatch(x)]
        if hits and not any(x in _STATE for x in parts):
            firm = all(x in _PLACES or x.isdigit() or len(x) < 3 or _BAD_NAME.fullmatch(x) for x in parts)
            found = "part" if firm or found == "part" else "weak"
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("open", tag, attributes) and ("close", tag, "") from left to right, in linear time."""
    n, at, text = len(page), 0, 0
    last_end = page.rfind(">")
    gone: set[str] = set()  # quotes and end tags that don't come any more
    plain = False  # no quoted value closes its tag from here on: a tag ends at the next ">"
    while True:
        at = page.find("<", at)
        if at < 0 or at > last_end:
            break
        following = page[at + 1 : at + 2]
        if following in "!?" and following:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2) + 3
                end = n if end < 3 else end
            else:
                end = page.find(">", at) + 1
            if at > text:
                yield "text", page[text:at], ""
            at = text = end
            continue
        closing = following == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            at += 1
            continue
        tag, pos = m.group().lower(), m.end()
        rest = _PLAIN_REST.match(page, pos)
        if rest:
            end = rest.end()
        elif plain:
            end = page.find(">", pos) + 1
        else:
            end = 0
            while pos < n:
                if page[pos] == ">":
                    end = pos + 1
                    break
                a = _ATTR_NAME.match(page, pos)
                if a.end() == pos:
                    pos += 1
                    continue
                pos = a.end()
                if a.group(2) and pos < n:
                    quote = page[pos]
                    close = page.find(quote, pos + 1) if quote in "\"'" and quote not in gone else -1
                    if close >= 0:
                        pos = close + 1
                    else:
                        if quote in "\"'":
                            gone.add(quote)
                        pos = _BARE_VALUE.match(page, pos).end()
            if not end:
                plain = True
                end = page.find(">", m.end()) + 1
        if at > text:
            yield "text", page[text:at], ""
        attrs = page[m.end() : end - 1]
        at = text = end
        if closing:
            yield "close", tag, ""
        elif tag in _RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, end) if tag not in gone else None
            if stop:
                at = text = stop.end()
            elif tag in _RAW_TO_END:
                return
            else:
                gone.add(tag)
        else:
            yield "open", tag, attrs
    if text < n:
        yield "text", page[text:], ""


def blocks(page: str) -> tuple[list[Block], list[Named]]:
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, Named | None]] = []
    depth: dict[str, int] = {}
    inner: Named | None = None
    containers: list[Named] = []
    bad = main = n_main = mute = 0
    muted = ""
    in_link = heading = False

    def flush() -> None:
        nonlocal pieces, mute
        if pieces:
            text = " ".join(html.unescape("".join(x for x, _ in pieces)).split())
            if text:
                links = sum(len(" ".join(html.unescape(x).split())) for x, linked in pieces if linked)
                out.append(Block(text, links, bad > 0, n_main if main else 0, heading, inner))
            pieces = []
        mute = 0

    def pop() -> str:
        nonlocal bad, main, inner
        t, was_bad, was_main, was_named = stack.pop()
        bad, main = bad - was_bad, main - was_main
        depth[t] -= 1
        if was_named:
            inner = was_named.outer
        return t

    for kind, value, raw in tokens(page):
        if kind == "text":
            if not mute:
                pieces.append((value, in_link))
            continue
        tag, close = value, kind == "close"
        if tag == "a":
            in_link = not close
        if tag in ("br", "img", "wbr"):
            pieces.append((" ", False))
        if tag not in _BLOCKS:
            if mute and tag == muted:
                mute += -1 if close else 1
            elif not mute and not close and raw and tag not in _VOID and _hidden_inline(raw):
                muted, mute = tag, 1
            continue
        flush()
        if close:
            if depth.get(tag):
                while pop() != tag:
                    pass
            in_link = heading = False
            continue
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag in _VOID:
            continue
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        attrs = attributes(raw) if raw else {}
        is_bad = tag in _BAD_TAGS or tag == "header" and not main or tag not in ("html", "body") and hides(attrs)
        hinted = "whole" if tag == "form" else hint(attrs) if attrs and not is_bad and tag not in _MAIN_TAGS and tag not in ("html", "body") else ""
        is_main = tag in _MAIN_TAGS or attrs.get("role", "").lower() == "main"
        if is_main and not main:
            n_main += 1
        own = Named(hinted, inner) if hinted else None
        if own:
            inner = own
            containers.append(own)
        if is_main and not bad and inner:
            # handed on to the containers around when names are judged
            inner.main |= tag != "article"
            inner.article |= n_main == 1
        stack.append((tag, is_bad, is_main, own))
        depth[tag] = depth.get(tag, 0) + 1
        bad, main = bad + is_bad, main + is_main
    flush()
    return out, containers


def _hidden_inline(raw: str) -> bool:
    attrs = attributes(raw)
    return attrs.get("hidden", "until-found").lower() != "until-found" or bool(_HIDES.search(attrs.get("style", "")))


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def length(text: str) -> int:
    """Characters, those of scripts without spaces counted several times."""
    return len(text) + (DENSE_WEIGHT - 1) * len(_DENSE_SCRIPT.findall(text))


def reads_as_prose(text: str) -> bool:
    """Long enough and with stop words, or long and in sentences, whatever the language."""
    size = length(text)
    if size < SHORT:
        return False
    stops = stop_share(text)
    return stops >= STOP_HIGH or size >= LONG and (stops >= STOP_LOW or len(_SENTENCE.findall(text)) * SENTENCE >= size)


def judge_names(found: list[Block], containers: list[Named]) -> None:
    """Blocks in a container with a bad name are bad, unless the container is let off."""
    if not containers:
        return
    total = 0.0
    for b in found:
        if not b.label:
            weight = len(b.text) * (1 - min(1.0, b.links))
            total += weight
            if b.named:
                b.named.weight += weight
    for x in reversed(containers):  # inner ones come later
        if x.outer:
            x.outer.weight += x.weight
            x.outer.main |= x.main
            x.outer.article |= x.article
    good = any(not b.label and not b.named and b.links <= LINKS and b.dense for b in found)
    for x in containers:
        most = 2 * x.weight > total
        off = x.main or most and x.hint != "whole" or not good and (most or x.article)
        x.strict = (x.outer.strict if x.outer else False) or not off and x.hint != "weak"
        x.bad = (x.outer.bad if x.outer else False) or not off
    for b in found:
        if b.named and (b.named.strict or b.named.bad and not b.dense):
            b.label = "bad"


def classify(found: list[Block], containers: list[Named]) -> None:
    """Both passes; every block ends as good or bad."""
    judge_names(found, containers)
    left = [b for b in found if not b.label and (b.links <= LINKS or b.heading)]
    inside = sum(len(b.text) for b in left if b.main)
    outside = sum(len(b.text) for b in left if not b.main and b.dense)
    has_main = inside > 0 and 2 * inside >= outside
    for b in found:
        if b.label:
            continue
        if has_main and not b.main or b.links > LINKS and not b.heading:
            b.label = "bad"
        elif b.dense:
            b.label = "good"
        elif length(b.text) >= LONG and not b.main and stop_share(b.text) < STOP_LOW / 2:
            b.label = "bad"
    n = len(found)
    before: list[int] = [-1] * n
    after: list[int] = [n] * n
    last = -1
    for i in range(n):
        before[i] = last
        last = i if found[i].label else last
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if found[i].label else last
    decided = [b.label or inherited(found, i, before[i], after[i]) for i, b in enumerate(found)]
    if "good" not in decided:
        # nothing reads as prose: what no rule is against stays
        decided = [b.label or "good" for b in found]
    for b, label in zip(found, decided, strict=True):
        b.label = label


def inherited(found: list[Block], i: int, left: int, right: int) -> str:
    """The label of an undecided block from its nearest decided neighbours."""
    b = found[i]
    sides = [(abs(i - j), found[j].label) for j in (left, right) if 0 <= j < len(found) and (not b.main or found[j].main == b.main)]
    labels = {label for _, label in sides}
    if len(labels) < 2:
        return labels.pop() if labels else "good"
    if b.main:
        return "good"
    if b.heading:
        return found[right].label
    nearest = min(d for d, _ in sides)
    labels = {label for d, label in sides if d == nearest}
    if len(labels) == 1:
        return labels.pop()
    return "good" if _SENTENCE.search(b.text) else "bad"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, containers = blocks(page)
    classify(found, containers)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; stays in its partition, row by row."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
