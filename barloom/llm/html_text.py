"""HTML extraction by block rules in two passes.

A page is cut into blocks at block-level tags. Pass one labels each block by
stop-word density, length and link density: good, bad, or undecided if it is too
short, or has too few stop words, to tell. What the page itself names as a menu,
header, footer, sidebar, notice, advert, form or reader comments (by element, role,
class or id) is bad beforehand, since a notice's prose reads like any other.
Pass two lets an undecided block inherit from its nearest decided neighbours: those
in the innermost element round it that has any, one before and one after. If they
differ, the closer one counts; if both are as close, it is good only inside an
<article> or <main>. These elements have no other part in it, but that their blocks
look for neighbours inside them, and that they are good where nothing there is decided.

A null html is the empty text; pages without a good block give the empty text.
Broken markup never fails: an unclosed tag at the end is dropped, unknown
references stay as they are. Repeated rows stay; each page is read whole, however
long, and alone, without a shuffle; time goes with its length. Only page_id, url and
html are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS = 0.4

#: Fixed sets of element names.
RAW = "script|style|textarea|title|iframe"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = set("nav aside footer header form menu button dialog fieldset head noscript template svg math object select canvas video audio".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id attributes that mark what isn't the article.
MARKS = set(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar header"
    " comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations pagination pager toolbar skip".split()
)
#: Frequent words of the languages that extraction knows (fixed values).
STOP_WORDS = {
    "en": "the of and to a in is that it was for on are with as be by at this from or an have not but they his her you all which one we there been has when who will more no if out so what up its about into than them can only other new some could time these two may then do any my now such like our over me even most also did many must before through where much your well should those people how just because good each too see very make still work being".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux cette ses mais comme on tout nous sa fait été aussi leur bien peut ces deux même elle si ont sans être entre après où ils dont lui".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso".split(),
    "it": "di e il la che in un a per è una non del si con i da le della dei al come più anche nel ma alla sono ha lo gli delle questo nella essere".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das seu sua ou quando muito nos já eu também só pelo pela até isso".split(),
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "link", "bad", "scope", "heading", "inside", "label")

    def __init__(self, text, link, bad, scope, heading, inside):
        self.text, self.link, self.bad, self.scope, self.heading, self.inside, self.label = text, link, bad, scope, heading, inside, None


class Element:
    """A block-level element: the one round it, and the blocks in it, from `start` to `end`."""

    __slots__ = ("parent", "start", "end", "scope")

    def __init__(self, parent, start, scope):
        self.parent, self.start, self.end, self.scope = parent, start, None, scope


def _left_out(name: str, rest: str) -> bool:
    if name in LEFT_OUT:
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and not MARKS.isdisjoint(_WORDS.findall(value)) and name not in ("html", "body"):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks with text, in order, and its block-level elements, outer ones first."""
    found: list[Block] = []
    elements = [Element(0, 0, 0)]  # the page
    stack: list[tuple[str, bool, int, int]] = []  # name, left out, scope, element
    open_: Counter = Counter()  # names on the stack, so that a stray end tag needs no search
    bad, scope, inside, scopes, links, heading = False, 0, 0, 0, 0, False
    texts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(texts)).split())
        if text:
            found.append(Block(text, min(1.0, linked / len(text)), bad, scope, heading, inside))
        texts.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            texts.append(piece)
            if links:
                linked += len(piece.strip())

    def pop() -> str:
        name, _, _, element = stack.pop()
        open_[name] -= 1
        if element != (stack[-1][3] if stack else 0):
            flush()  # an inline end tag may close it too
            elements[element].end = len(found)
        return name

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m["end"]:
            while open_[name]:
                closed = pop()
                links -= closed == "a"
                if closed == name:
                    break
        elif name not in VOID and not (m["rest"] or "").endswith("/"):
            if name == "a":
                links += 1
            elif name in ("p", "li", "tr", "td", "option", "dt", "dd") and stack and stack[-1][0] == name:
                pop()  # closed by its next sibling
            outer, own, element = (stack[-1][1], *stack[-1][2:]) if stack else (False, 0, 0)
            if name in SCOPES:
                scopes += 1
                own, outer = scopes, outer and any(open_[x] for x in SCOPES)
            if name in BLOCK:
                elements.append(Element(element, len(found), own))
                element = len(elements) - 1
            stack.append((name, outer or _left_out(name, m["rest"]), own, element))
            open_[name] += 1
        elif name not in BLOCK:
            continue
        state = stack[-1][1:] if stack else (False, 0, 0)
        if state != (bad, scope, inside):
            flush()  # an element, or what is left out, begins or ends, be it by an inline tag
        bad, scope, inside = state
        heading = any(open_[x] for x in HEADINGS)
    add(page[at:])
    flush()
    for e in elements:
        e.end = len(found) if e.end is None else e.end
    return found, elements


def first_pass(b: Block, stops: frozenset = STOPS) -> bool | None:
    """A block's label by itself; None if it can't be told."""
    if b.bad or b.link > LINKS:
        return False
    if b.heading or len(b.text) < SHORT:
        return None
    words = _LETTERS.findall(b.text.lower())
    density = sum(map(stops.__contains__, words)) / len(words) if words else 0.0
    if not b.scope and "©" in b.text and len(b.text) < LONG:
        return False
    return True if density >= (STOP_LOW if len(b.text) >= LONG else STOP_HIGH) else None


def classify(own: list[Block], elements: list[Element], stops: frozenset = STOPS) -> None:
    """Sets label of every block: True for good."""
    first = [first_pass(b, stops) for b in own]
    # what is left out for its name only says nothing of what stands beside it
    decided = [i for i, b in enumerate(own) if first[i] is not None and (b.link > LINKS or not b.bad)]
    round_ = []  # for each element the innermost one round it, or itself, that has decided blocks
    for k, e in enumerate(elements):
        has = bisect_left(decided, e.end) > bisect_left(decided, e.start)
        # a scope doesn't look outside itself
        round_.append(k if has or k == 0 or e.scope != elements[e.parent].scope else round_[e.parent])
    for i, b in enumerate(own):
        b.label = first[i]
        if b.label is not None:
            continue
        e = elements[round_[b.inside]]
        k = bisect_left(decided, i)
        before = decided[k - 1] if k and decided[k - 1] >= e.start else None
        after = decided[k] if k < len(decided) and decided[k] < e.end else None
        if before is None and after is None:
            b.label = b.scope > 0
        elif before is None or after is None:
            b.label = first[after if before is None else before]
        elif b.heading and first[after]:
            b.label = True  # a heading goes with the text below it
        elif first[before] == first[after]:
            b.label = first[before]
        elif i - before == after - i:
            b.label = b.scope > 0
        else:
            b.label = first[before if i - before < after - i else after]


def main_text(page: str) -> str:
    own, elements = blocks(page)
    classify(own, elements)
    return " ".join(b.text for b in own if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def make():
        def batch(rows):
            texts = [main_text(p) for p in rows.column("html").to_pylist()]
            return {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return batch

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return map_batches(own, make, "page_id long, url string, text string, n_chars long", barrier_rows=128)
