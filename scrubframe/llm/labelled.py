"""The labelled table of the block classifier: small hand-written pages with the blocks that belong to the article."""

from __future__ import annotations

import re

LONG = "The river rose through the night and by morning the lower fields were under water, so the farmers moved their animals up the hill."
MORE = "Nobody in the village could remember a spring as wet as this one, although the older people spoke of a flood in their childhood."
SHORT = "It rained."

LABELLED_PAGES = [
    (f"""<html><head><title>Flood</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News and weather</a></li></ul></nav>
    <div class="ad">Buy new boots now and save money on every pair this week only.</div><article><h1>Flood in the valley</h1><p>{LONG}</p><p>{SHORT}</p>
    <p>{MORE}</p></article><footer>&copy; The Valley Paper. All rights reserved by the owners of this page.</footer></body></html>""",
     ["Flood in the valley", LONG, SHORT, MORE]),
    (f"""<body><header><h1>Valley Paper</h1><a href=/>Front page</a></header><div class="cookie-banner">We use cookies to make this page work and to learn
    how people read it. <button>Accept</button></div><main><h2>{SHORT}</h2><p>{MORE}</p><ul><li>first point</li><li>a second and longer point of the list</li></ul>
    <aside><p>Related: <a href=/x>Ten storms that changed the coast of the country</a></p></aside><p>{LONG}</p></main>
    <div id="comments"><h3>Comments</h3><p>I was there and saw the whole thing, it was much worse than this article says.</p></div></body>""",
     [SHORT, MORE, "first point", "a second and longer point of the list", LONG]),
    (f"""<div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="content"><h1>{SHORT}</h1><p>{LONG}</p><p>{SHORT} Again.</p><p>{MORE}</p></div>
    <div class="sidebar"><p>{MORE} Read more in our paper.</p><a href=3>Archive</a></div><div class="footer">Contact us by mail or phone.</div>""",
     [SHORT, LONG, f"{SHORT} Again.", MORE]),
    (f"""<body><p>{LONG}</p><p>{MORE}</p><p><a href=1>Next page</a> <a href=2>Previous page</a></p><p><a href=3>Terms</a></p></body>""", [LONG, MORE]),
    (f"""<body><article><header><h1>Dry summer</h1></header><p><a href=/s>See the map of all rivers in the country</a></p><p>{SHORT}</p>
    <form><label>Your name</label><input><p>Write to us about the weather in your town today.</p></form><blockquote>{MORE}</blockquote>
    <section class="comments"><p>{LONG} says a reader.</p><p>Yes.</p></section><footer>Filed under weather and people.</footer></article></body>""",
     ["Dry summer", "See the map of all rivers in the country", SHORT, MORE]),
    ("""<body><article><h1>Ice.</h1><p>Ice.</p></article><footer>&copy; page</footer></body>""", ["Ice."]),
    ("""<body><nav><a href=/>Home</a></nav><div class="ad">New.</div><article></article><footer>Imprint and further words about the owner</footer></body>""", []),
    (f"""<body><article><p>A.</p></article><aside>{LONG}</aside><footer>{MORE}</footer></body>""", ["A."]),
    (f"""<body><div class="notice">{LONG}</div><div class="newsletter"><p>{MORE}</p></div><article><p>One.</p><p>{LONG} Two.</p></article></body>""",
     ["One.", f"{LONG} Two."]),
    ("""<body><p>Short page without an article element.</p></body>""", ["Short page without an article element."]),
    ("""<body><p>Hi.</p></body>""", ["Hi."]),
    ("""<body><header>Site</header><p>Hi all.</p><footer>End</footer></body>""", ["Hi all."]),
    (f"""<body><div class=ad>{LONG}</div><h1>Head line</h1><p>{MORE}</p><p>{SHORT}</p></body>""", ["Head line", MORE, SHORT]),
    (f"""<body><article><p>{LONG}</p></article><p>Outside of the article but plain, with many words that look like text of their own.</p>
    <p>More.</p></body>""", [LONG]),
    (f"""<body><nav><a href=1>Start</a></nav><article><h1>{SHORT}</h1><p>{LONG}</p><p>No.</p><p>{MORE}</p><p>Les.</p></article></body>""",
     [SHORT, LONG, "No.", MORE, "Les."]),
    (f"""<body><article><p>{LONG}</p><p><a href=1>{MORE}</a></p><ul><li><a href=2>map</a></li><li><a href=3>The old map of the valley</a></li></ul></article>
    <p>{MORE} Outside.</p><p><a href=9>{LONG} Out.</a></p></body>""", [LONG, MORE, "map", "The old map of the valley"]),
    (f"""<body><main><p>{MORE}</p><p>End.</p></main><p>{SHORT} Outside.</p></body>""", [MORE, "End."]),
    (f"""<body><article><p><a href=1>{SHORT}</a></p><p>{LONG}</p><p>Go <a href=2>on</a>.</p></article><p>Out.</p><p>{LONG} Out.</p></body>""",
     [SHORT, LONG, "Go on."]),
    (f"""<body><div class=text><p>{LONG}</p><p>End.</p></div></body>""", [LONG, "End."]),
    (f"""<body><div class=text><p>{LONG}</p><p>{MORE}</p><p>Les.</p><ul><li><a href=1>Home</a></li><li><a href=2>All of the other pages here</a></li></ul></div></body>""",
     [LONG, MORE, "Les."]),
]

#: Sentences of different lengths that fill the layouts.
TEXTS = [
    "The old bridge was closed for repairs in the autumn, and since then every cart has had to go round by the mill, which takes an hour longer.",
    "She had kept the letters in a wooden box under the stairs, together with a ring, two photographs and a key that fitted none of the doors.",
    "Most of the bread was baked before dawn.",
    "A glass of water weighs more than the glass itself, and so the shelf has to be built for what it holds and not only for what it looks like, the joiner says.",
    "In the first year they planted beans between the young trees, in the second year clover, and only in the third did they let the grass come back by itself.",
    "He did not answer at once.",
    "When the snow melts early the birds return before there is anything for them to eat, and the people of the coast put out grain until the end of March.",
    "The council will meet again in June to decide whether the money is spent on the school roof or on the road that leads to it.",
]
HEADINGS = ["Bridge closed until spring", "What the box held", "Bread before dawn", "How strong is a shelf", "Three years of trees", "Early birds"]
NOTICES = ["We use cookies to make this site better for you.", "Get our best stories by mail every week.", "This week only: boots at half the price.",
           "Your browser is out of date and may not show this page well."]
FOOTERS = ["Copyright 2021 The Mill Press. All rights reserved.", "Imprint and contact", "Made by the people of the mill", "Page 3 of 9"]

#: Layouts: text between double square brackets belongs to the article. {a} to {d} are sentences, {h} and {g} headings, {n} a notice, {f} a footer.
LAYOUTS = [
    """<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>All news of the region</a></li></ul></nav><article><h1>[[{h}]]</h1><p>[[{a}]]</p><p>[[{b}]]</p>
    <p>[[{c}]]</p></article><footer><div>{f}</div></footer></body>""",
    """<body><div class="cookie-banner"><div>{n}</div><a href=1>Accept</a></div><header><div><a href=/>The Mill Press</a></div></header><main><h2>[[{h}]]</h2>
    <p>[[{a}]]</p><h3>[[{h} again]]</h3><p>[[{c}]]</p><p>[[{d}]]</p></main><div class="footer">{f}</div></body>""",
    """<div id="menu"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id="content"><h1>[[{h}]]</h1><p>[[{b}]]</p><p>[[{d}]]</p></div>
    <aside><div><a href=4>{g} and what came of it</a></div><div><a href=5>More of the same kind</a></div></aside><div class="site-footer">{f}</div>""",
    """<body><div class="topbar"><a href=1>Sign in</a></div><div class="advert">{n}</div><div class="text"><h1>[[{h}]]</h1><p>[[{a}]]</p><p>[[{b}]]</p><p>[[{d}]]</p></div>
    <div class="related"><div><a href=2>{g}</a></div><div><a href=3>Ten more pages</a></div></div><div class="copyright">{f}</div></body>""",
    """<table><tr><td class="nav"><a href=1>Start</a><br><a href=2>Archive of all years</a></td><td><h2>[[{h}]]</h2><p>[[{a}]]</p><p>[[{c}]]</p><p>[[{b}]]</p></td></tr></table>
    <div class="footer"><a href=3>Contact</a> {f}</div>""",
    """<body class="with-sidebar"><article><h1>[[{h}]]</h1><p>[[{c}]]</p><p>[[{b}]]</p><div class="newsletter"><div>{n}</div></div></article>
    <nav><div><a href=1>Older page</a></div><div><a href=2>Newer page</a></div></nav></body>""",
    """<body><header><a href=/>Front page</a><span>{f}</span></header><div class="post"><h1>[[{h}]]</h1><p>[[{d}]]</p><p>[[{a}]]</p></div>
    <div class="share"><a href=1>Send</a> <a href=2>Print</a></div><div class="promo">{n}</div></body>""",
    """<body><ul class="menu"><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div class="story"><h1>[[{h}]]</h1><div>[[{a}]]</div><div>[[{b}]]</div>
    <blockquote>[[{d}]]</blockquote><div>[[{c}]]</div><ul><li>[[{b} First.]]</li><li>[[{a} Second.]]</li></ul><div>[[{d} So it goes.]]</div></div>
    <div class="search"><a href=3>Find a page</a></div><div class="footer">{f}</div></body>""",
    """<body><div class="navbar"><a href=1>Start</a> <a href=2>Archive</a></div><div class="lead">[[{a} {b}]]</div><h2>[[{h}]]</h2><p>[[{c}]]</p><p>[[{d}]]</p>
    <div class="tabs"><a href=3>More</a></div><div class="footer">{f}</div></body>""",
]
#: Layouts that only make sense with their names: what stands inside the article belongs to it, however short it is and whatever is next to it.
NAMED_LAYOUTS = [
    """<body><nav><a href=1>Home</a></nav><article><ul><li class="comment">Me too.</li><li>[[Nine.]]</li></ul></article></body>""",
    """<article><table><tr><td class="sidebar">Old pages.</td><td>[[{c}]]</td><td>[[Nine.]]</td></tr></table></article>""",
    """<article><div>[[{c}]]</div><div class="ad">{n}</div><div>[[{h}.]]</div></article><div class="related"><a href=1>{g}</a></div>""",
    """<main><ul><li>[[Nine.]]</li><li><a href=1>[[Ten of them]]</a></li><li>[[{c}]]</li></ul><div>[[{a}]]</div><div>[[End of it.]]</div></main><footer>{f}</footer>""",
    """<article><h1>[[{h}]]</h1><div><a href=1>[[{c}]]</a></div><form>Your name</form><div>[[{a}]]</div><div><a href=2>[[Map.]]</a></div></article><div>{f}</div>""",
    """<article><div><a href=2>[[The map of it.]]</a></div></article><aside>{a}</aside><div class="comments"><p>{b}</p><div>{c}</div></div><p>{d}</p>""",
    """<main><div class="breadcrumbs"><a href=1>Home</a> <a href=2>Mill</a></div><div>[[{h}]]</div><div>[[{f}]]</div><div>[[{n}]]</div></main><h3>{g}</h3>""",
    """<body><article><div>[[Nine.]]</div></article></body>""", """<article><p class="advert">{n}</p><p>[[{c}]]</p></article><p>Nine.</p>""",
    """<main><table><tr><th>[[Year]]</th><th>[[Rain]]</th></tr><tr><td>[[Nine.]]</td><td>[[{b}]]</td></tr></table><div class="share"><a href=1>Send</a></div></main>""",
]
#: Names and elements that tell what a part of a page is; without them only words and links of a block and its neighbours do.
NAMED = re.compile(r"\s(?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)")
SECTION = re.compile(r"(</?)(?:nav|header|footer|aside|article|main)\b")


def fill(layout: str, turn: int, bare: bool) -> tuple[str, list[str]]:
    """One page of a layout with the blocks of its article; ``bare`` takes all names off and turns sections into plain containers."""
    a, b, c, d = (TEXTS[(turn + k) % len(TEXTS)] for k in (0, 1, 2, 3))
    page = layout.format(a=a, b=b, c=c, d=d, h=HEADINGS[turn % len(HEADINGS)], g=HEADINGS[(turn + 1) % len(HEADINGS)],
                         n=NOTICES[turn % len(NOTICES)], f=FOOTERS[turn % len(FOOTERS)])
    if bare:
        page = SECTION.sub(r"\1div", NAMED.sub("", page))
    return page.replace("[[", "").replace("]]", ""), re.findall(r"\[\[(.*?)\]\]", page, re.S)


def layout_pages(layouts: list[str]) -> list[tuple[str, list[str]]]:
    """Every layout with every turn of the sentences, with its names and without them."""
    return [fill(layout, turn, bare) for layout in layouts for turn in range(len(TEXTS)) for bare in (False, True)]


def wrapped_pages() -> list[tuple[str, bool]]:
    """Unnamed pages inside of one element that decides about all of their blocks, with that decision."""
    bodies = [re.sub("</?body>", "", fill(layout, turn, True)[0]) for layout in LAYOUTS for turn in range(len(TEXTS))]
    around = [("<article>{}</article>", True), ("<main><section>{}</section></main>", True), ("<article><header>{}</header></article>", True),
              ("<aside>{}</aside>", False)]
    return [(wrap.format(body), kept) for body in bodies for wrap, kept in around]
