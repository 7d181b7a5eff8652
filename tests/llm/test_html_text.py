import random
import re

from barloom.llm import html_text as h

LONG = "This is the story of a town that was by the sea and it had a lot of people who were there for the work of the day. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p>";</script></head><body class="page header">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for all of the things that you do.</div>
<div class="ad">Buy the best of it now.</div><article><h1>Title &amp; more</h1><p>{LONG}<b>bold</b>er<br>next&nbsp;line &lt;tag&gt; &unknown; R&ampD</p><p>Short.</p>
<aside>{LONG}</aside><p>See <a href="x">this</a> and {LONG}</p><form><p>{LONG}</p><input></form><section id="comments"><p>{LONG}</p></section></article>
<footer>&copy; {LONG}</footer><!-- {LONG} --></body></html>"""


def test_page():
    want = f"Title & more {LONG}bolder next line <tag> &unknown; R&D Short. See this and {LONG.strip()}"
    assert h.main_text(PAGE) == want


def test_short_blocks_inherit():
    page = f"<body><div>{LONG * 2}</div><div>Yes, he said.</div><div>{LONG * 2}</div><div><a>one</a> <a>two</a> <a>three</a></div><div>All rights reserved</div><div><a>x</a></div></body>"
    assert h.main_text(page) == f"{LONG * 2}Yes, he said. {(LONG * 2).strip()}"


def test_short_article_and_broken_markup():
    assert h.main_text("<nav><a>x</a></nav><div class=ad>Buy it</div><article><h1>Hm</h1><p>Hm. So</article><footer>f</footer>") == "Hm Hm. So"
    for cut in range(0, len(PAGE), 7):
        h.main_text(PAGE[:cut])
    assert h.main_text("<article><p>" + "w " * 200_000 + "</p><a href=\"unclosed>") == ("w " * 200_000).strip()
    assert h.main_text("<article><p>tail &am") == "tail &am"
    assert h.main_text("<article>" + "<b>" * 3000 + "x" + "<p><" * 3000).startswith("x")


def test_hard_markup_is_linear():
    for page in ("<b>" * 200_000 + "</i>" * 200_000 + "x", "<article>" * 50_000 + "x", "<div><p" * 50_000, "<script>" * 50_000, '<a title="' * 50_000, "<!--" * 100_000):
        h.main_text(page)
    assert h.main_text("<svg><article><p>" + LONG) == LONG.strip()
    assert h.main_text("<article><p>" + LONG + "<span class=advert>Buy</span> it</p>" + LONG * 2) == f"{LONG}it {(LONG * 2).strip()}"
    assert h.main_text("<article><p>" + LONG + "<select><option>one<option>two</select><script x='>var a = 1;</script></article>") == LONG.strip()


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "c", "c"), (2, None, "", "c", "c"), (3, "u", PAGE, "c", "c"), (3, "u", PAGE, "c", "c"), (None, "v", "<p>x", "c", "c")]
    got = sorted(map(tuple, h.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert len(got) == 5 and (1, "u", "", 0) in got and (2, None, "", 0) in got
    assert sum(r[2] == h.main_text(PAGE) and r[3] == len(r[2]) for r in got) == 2
    assert h.extract(spark.createDataFrame([], schema)).count() == 0


def test_without_telling_names():
    """Density, length and link density find the text of pages that name nothing."""
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>Part {i} of it</a></li>" for i in range(5)) + "</ul></div>"
    text = f"<h2>Hm</h2><p>{LONG * 2}</p><p>So it was.</p><table><tr><td>{LONG}</td><td>12</td></tr></table><p>zzq qqz xxk vvw</p><p>{LONG}</p>"
    want = f"Hm {(LONG * 2).strip()} So it was. {LONG.strip()} 12 zzq qqz xxk vvw {LONG.strip()}"
    page = f"<body>{menu}<div>Buy now</div><div>{text}</div><div>{menu}<p>All rights</p></div><div>&copy; the owner of this</div></body>"
    assert h.main_text(page) == want
    assert h.main_text(page.replace("<body>", "<body><article>").replace("</body>", "</article></body>")) != ""
    own, elements = h.blocks(page)
    h.classify(own, elements, frozenset())
    assert not any(b.label for b in own)  # it is the stop words that tell
    own, elements = h.blocks(f"<div><p>{LONG}</p><p><a>{LONG}</a></p></div>")
    h.classify(own, elements)
    assert [b.label for b in own] == [True, False]


def brute(own, elements):
    """Both passes by the letter, looking at every block for every block."""
    first = []
    for b in own:
        words = ["".join(g) for g in re.findall(r"([^\W\d_]+)", b.text.lower())]
        share = sum(w in h.STOPS for w in words) / max(1, len(words))
        if b.bad or b.link > 0.4:
            first.append(False)
        elif b.heading or len(b.text) < 70:
            first.append(None)
        elif not b.scope and "©" in b.text and len(b.text) < 200:
            first.append(False)
        else:
            first.append(True if share >= (0.15 if len(b.text) >= 200 else 0.3) else None)
    out = []
    for i, b in enumerate(own):
        if first[i] is not None:
            out.append(first[i])
            continue
        at, near = b.inside, []
        while True:
            e = elements[at]
            near = [j for j in range(e.start, e.end) if first[j] is not None and not (own[j].bad and own[j].link <= 0.4)]
            if near or at == 0 or e.scope != elements[e.parent].scope:
                break
            at = e.parent
        left, right = [j for j in near if j < i][-1:], [j for j in near if j > i][:1]
        sides = [first[j] for j in left + right]
        if not sides:
            out.append(b.scope > 0)
        elif len(sides) == 1 or sides[0] == sides[1]:
            out.append(sides[0])
        elif b.heading and sides[1]:
            out.append(True)
        elif i - left[0] == right[0] - i:
            out.append(b.scope > 0)
        else:
            out.append(sides[0] if i - left[0] < right[0] - i else sides[1])
    return out


def test_passes_against_brute_force():
    rng = random.Random(7)
    bits = [LONG, "short one", "qxz " * 60, "qxz vbn " * 12, "the of and", f"<a>{LONG}</a>", "<a>x</a>", "© " + LONG]
    names = ["div", "p", "section", "article", "main", "nav", "aside", "h2", "ul", "li", "span", "b", "a", "table", "td"]
    for _ in range(400):
        page = ""
        for _ in range(rng.randrange(1, 40)):
            name = rng.choice(names)
            page += rng.choice([f"<{name}>", f"</{name}>", f"<{name} class=comments>", rng.choice(bits), rng.choice(bits), rng.choice(bits)])
        own, elements = h.blocks(page)
        h.classify(own, elements)
        assert [b.label for b in own] == brute(own, elements), page
        assert all(elements[b.inside].start <= i < elements[b.inside].end for i, b in enumerate(own)), page
