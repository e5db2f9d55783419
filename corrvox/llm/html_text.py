"""Main text of web pages by line-block distribution.

1. **Lines.** Markup is stripped: each block element is a line, inline markup is dropped, character
   references are decoded, white space inside a line is one space.
2. **What is not text of the page.** Elements that may hold menus, headers, footers, asides, forms, adverts or
   notices are suspects: by element name, or by a class, id or role all of whose parts are furniture
   words (``cookie-notice``, ``cookieBanner``, not ``has-sidebar``; in an article a header is none). A suspect's lines are left out,
   unless the page would be empty without it: it holds ten times the text that no suspect holds, most
   of it running text (an unclosed advert, a form around the page). If only some part of a name is a
   furniture word, a block is left out only where its own text says so: most of it links, or no heading,
   no running text and less than a line of it. Reader comments are left out whatever they hold.
3. **Distribution.** What is left, in page order, is one series of line weights. A line weighs its length without links, a
   quarter of it where it isn't running text (no sentence mark, under ``SOLID`` characters), nothing where it is mostly links.
   Article and main elements only change weights: a paragraph, heading, list item or cell inside, and any running text, weighs
   its whole length and ``BONUS`` more; where a page has such elements, lines outside weigh ``OUTSIDE`` times less. Weights are summed over blocks of ``window`` lines: text surges where a
   block's sum reaches ``SURGE`` (the highest sum, if that is less) and dives where it falls under it. All text between
   surges and dives stays, without the lines at both ends that weigh nothing or are neither headings nor
   running text (in articles: nor paragraphs, items or cells); a heading right before a surge comes along. What was left out before does not part a stretch, so closing
   words after an advert stay with their text.

Null html and pages without text give an empty string. Unclosed elements end where their parent
ends, paragraphs and list items where the next begins. An unclosed comment, script or quoted
attribute goes to the end of the page or to the next quote. Time is linear in the page's length.
Rows with null identifiers and repeated rows give a row each; an empty table gives none; extra
columns are not read. Nothing is dropped or capped inside the kept stretches.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("aside audio button dialog fieldset footer form menu nav select video".split())
RAW = frozenset("canvas iframe math noscript object script style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, and those of them that may hold it in a div.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
HOLDERS = frozenset("blockquote dd li td".split())
#: Elements whose end tag may be left out: they are only followed where they are suspects.
LOOSE = frozenset("a b dd dt em i li option p span strong td th tr".split())
INLINE = frozenset("a b em i span strong".split())
#: What ends an open suspect of this name that is innermost.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs complementary consent contentinfo "
    "cookie cookies dialog disclaimer footer gdpr header login menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall "
    "popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets".split()
)
#: Words for what readers wrote.
COMMENTS = frozenset("comment commentary commenter commentlist comments discussion discussions disqus replies reply respond responses".split())
#: Words that say nothing beside a furniture word: ``main-menu``, ``page-footer``.
PLAIN = frozenset("area bar block bottom box container content global inner left list main page primary right secondary section site top wrap wrapper".split())

SOLID, SURGE, BONUS, OUTSIDE = 40, 80, 40, 4
_MARK = re.compile(r"[.!?…。！？؟।]")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_STOP = re.compile("[>\"']")


def tags_of(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, name, attributes) of all markup, in order; a name begins with / in an end tag and is empty in comments and raw text.

    Each place is looked at a bounded number of times: what was searched to the end of the page and isn't there is not searched again.
    """
    at, n = 0, len(page)
    missing: set[str] = set()

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        k = page.find(what, begin)
        if k < 0:
            missing.add(what)
        return k

    while True:
        a = page.find("<", at)
        if a < 0:
            return
        if page.startswith("<!--", a):
            z = find("-->", a + 4)
            at = n if z < 0 else z + 3
            yield a, at, "", ""
            continue
        if page.startswith("<![CDATA[", a):
            z = find("]]>", a + 9)
            at = n if z < 0 else z + 3
            yield a, at, "", ""
            continue
        if page.startswith(("<!", "<?"), a):
            z = find(">", a + 2)
            at = n if z < 0 else z + 1
            yield a, at, "", ""
            continue
        m = _NAME.match(page, a + 1)
        if m is None:
            at = a + 1
            continue
        z = m.end()
        while (stop := _STOP.search(page, z) if ">" not in missing else None) is not None:
            if stop[0] == ">":
                break
            closed = find(stop[0], stop.end())
            z = stop.end() if closed < 0 else closed + 1
        if stop is None:
            missing.add(">")  # nothing ends a tag any more: what is left is text
            return
        name, attrs, at = m[0].lower(), page[m.end() : stop.start()], stop.end()
        if name in RAW and not attrs.endswith("/"):
            close = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at) if "</" + name not in missing else None
            if close is None:
                missing.add("</" + name)
            yield a, n if close is None else close.end(), "", ""
            at = n if close is None else close.end()
            continue
        yield a, at, name, attrs


def suspicion(tag: str, attrs: str, inside: bool) -> int:
    """3: hidden for certain, 2: furniture by its name, 1: perhaps, 0: no. ``inside``: in an article or main element."""
    if tag in FURNITURE or tag == "header" and not inside:
        return 2
    if tag in ("body", "html", "main") or not attrs:
        return 0
    level, weak = 0, tag in INLINE or tag == "article"
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _UNSEEN.search(value.lower()):
            return 3
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            parts = [p.lower() for p in _PART.split(token) if p]
            said = sum(p in COMMENTS for p in parts)
            bad = said + sum(p in WORDS and not (inside and p == "header") for p in parts)
            if bad:
                whole = bad + sum(p in PLAIN for p in parts) == len(parts)
                level = max(level, 3 if said and whole else 2 if whole else 1)
    return 0 if weak and level == 1 else level


@dataclass(slots=True)
class Line:
    text: str
    links: int = 0
    heading: bool = False
    suspect: int = 0  # the innermost one it is in; 0: none
    container: int = 0  # the article or main element it is in; 0: none
    prose: bool = False  # in an element of PROSE

    @property
    def solid(self) -> bool:
        return len(self.text) >= SOLID or bool(_MARK.search(self.text))


@dataclass(slots=True)
class Suspect:
    level: int
    parent: int
    chars: int = 0
    links: int = 0
    running: int = 0
    headings: int = 0
    hidden: bool = False


def lines_of(page: str) -> tuple[list[Line], list[Suspect]]:
    """All lines in page order, and the suspects (number 0 stands for none); an empty line is where a suspect begins or ends."""
    lines: list[Line] = []
    suspects = [Suspect(0, 0)]
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, suspect and container before
    open_: Counter[str] = Counter()
    links = in_link = suspect = container = made = 0
    heading, prose = False, ""

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            lines.append(Line(text, min(links, len(text)), heading, suspect, container, prose != ""))
        held.clear()
        links = 0

    def text(s: str) -> None:
        nonlocal links
        if s:
            held.append(s)
            if in_link:
                links += len(_SPACE.sub(" ", html.unescape(s)).strip())

    def close() -> str:
        nonlocal suspect, container
        name, was, had = stack.pop()
        open_[name] -= 1
        if was != suspect or had != container:
            flush()
        if was != suspect:
            lines.append(Line("", suspect=was, container=had))
        suspect, container = was, had
        return name

    at = 0
    for begin, end, tag, attrs in tags_of(page):
        text(page[at:begin])
        at = end
        if not tag:
            continue
        if tag[0] != "/":
            if tag in BLOCKS:
                flush()
                heading = tag in HEADINGS
                if tag in PROSE:
                    prose = tag
                elif not (tag == "div" and prose in HOLDERS):
                    prose = ""
            if tag == "br":
                text(" ")
            if tag in ("a", "label"):  # neither is running text
                in_link = 1
            if tag in VOID or attrs.endswith("/"):
                continue
            while stack and tag in ENDED_BY.get(stack[-1][0], ()):
                close()
            level = suspicion(tag, attrs, container > 0)
            if tag in LOOSE and not level:
                continue
            stack.append((tag, suspect, container))
            open_[tag] += 1
            if level:
                flush()
                suspects.append(Suspect(level, suspect))
                suspect = len(suspects) - 1
                lines.append(Line("", suspect=suspect, container=container))
            elif tag in ("article", "main") and not container:
                made += 1
                container = made
        else:
            tag = tag[1:]
            if tag in ("a", "label"):
                in_link = 0
            if tag in BLOCKS:
                flush()
                heading = False
                if tag in PROSE:
                    prose = ""
            if open_[tag]:
                while close() != tag:
                    pass
    text(page[at:])
    flush()
    return lines, suspects


def judge(lines: list[Line], suspects: list[Suspect]) -> None:
    """Decide which suspects are hidden (see the module's text)."""
    free = 0  # characters that no suspect of level 2 or 3 holds
    for x in lines:
        s = suspects[x.suspect]
        s.chars += len(x.text)
        s.links += x.links
        s.running += len(x.text) - x.links if x.solid else 0
        s.headings += x.heading
    sure = [False] * len(suspects)
    for k, s in enumerate(suspects):
        sure[k] = k > 0 and (s.level >= 2 or sure[s.parent])
        free += 0 if sure[k] else s.chars
    for s in reversed(suspects[1:]):  # inner ones have higher numbers than those around them
        around = suspects[s.parent]
        if s.parent:
            around.chars += s.chars
            around.links += s.links
            around.running += s.running
            around.headings += s.headings
    for s in suspects[1:]:
        if suspects[s.parent].hidden or s.level == 3:
            s.hidden = True
        elif s.level == 2:
            s.hidden = free * 10 >= s.chars or s.running * 2 < s.chars
        else:
            s.hidden = s.links * 2 > s.chars or not s.running and not s.headings and s.chars < SOLID


def stretches_of(weights: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """Where the sums over blocks of ``window`` lines surge to the threshold and dive under it: (first line, line after the last) of
    maximal runs of lines that are in such a block, without the lines of no weight at their ends."""
    n, upto = len(weights), [0]
    for w in weights:
        upto.append(upto[-1] + w)
    out: list[tuple[int, int]] = []
    for i in range(n):  # block i: lines i to i + window - 1
        z = min(n, i + window)
        if upto[z] - upto[i] >= threshold:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], z)
            else:
                out.append((i, z))
    trimmed = []
    for a, z in out:
        while not weights[a]:
            a += 1
        while not weights[z - 1]:
            z -= 1
        trimmed.append((a, z))
    return trimmed


def weigh(lines: list[Line], link_share: float = 0.5) -> list[int]:
    """What each line adds to the distribution."""
    out, any_inside = [], any(x.container for x in lines)
    for x in lines:
        free = len(x.text) - x.links
        if x.links > link_share * len(x.text):
            out.append(0)
        elif x.container and (x.prose or x.solid):
            out.append(free + BONUS)
        else:
            out.append(-(-free // ((1 if x.solid else 4) * (OUTSIDE if any_inside and not x.container else 1))))
    return out


def main_stretches(lines: list[Line], weights: list[int], window: int) -> list[tuple[int, int]]:
    """Stretches between surges and dives, (first line, line after the last), without loose ends, with the headings before them."""
    highest = max(sum(weights[i : i + window]) for i in range(len(lines)))
    firm = [w > 0 and (x.solid or x.prose and x.container > 0) for x, w in zip(lines, weights, strict=True)]
    out: list[tuple[int, int]] = []
    for a, z in stretches_of(weights, window, min(SURGE, highest)):
        b, y = a, z
        while b < y and not (firm[b] or lines[b].heading):
            b += 1
        while y > b and not firm[y - 1]:
            y -= 1
        b, y = (b, y) if b < y else (a, z)
        least = out[-1][1] if out else 0
        while b > least and lines[b - 1].heading:
            b -= 1
        out.append((b, y))
    return out


def main_text(page: str | None, window: int = 3) -> str:
    if not page:
        return ""
    lines, suspects = lines_of(page)
    judge(lines, suspects)
    left = [x for x in lines if x.text and not suspects[x.suspect].hidden]
    weights = weigh(left)
    if not any(weights):
        return ""
    return "\n".join(x.text for a, z in main_stretches(left, weights, window) for x in left[a:z])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
