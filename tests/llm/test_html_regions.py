import math
import random
import time

import numpy as np
import pytest

from lexiloom.llm import html_text as H

LONG = "A sentence of the article that is long enough to be content, as it goes on for a while."
MENU = "<a href='/'>Home</a>", "<a href='/n'>News</a>", "<a href='/s'>Sport</a>"

#: Pages without a marked article, or with odd names, and their text.
PAGES = [
    (f"<body>{''.join(f'<p>{a}</p>' for a in MENU)}<h1>T</h1><p>{LONG}</p><p>{LONG}</p></body>", f"T {LONG} {LONG}"),
    (f"<body>{'<br>'.join(MENU)}<br><h1>T</h1><p>{LONG}</p><p>end</p><div>{' | '.join(MENU)}</div><div>(c) 2024</div></body>", f"T {LONG} end"),
    (f"<body><div>{' '.join(MENU)}</div><h2><a href='#t'>T</a></h2><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p></body>", f"T {LONG} one two {LONG}"),
    (f"<div id=wrap><ul><li>{MENU[0]}<li>{MENU[1]}</ul><div id=c><h1>T</h1><p>lead</p>{f'<p>{LONG * 3}</p>' * 6}<p>closing</p></div><div>Copyright 2024 by us</div></div>", " ".join(["T lead", *[LONG * 3] * 6, "closing"])),
    (f"<article><p class='promo-free'>real text</p><p>{LONG}</p><div class='promo'>buy</div></article>", f"real text {LONG}"),
    (f"<body class='with-sidebar'><div class='no-ads has-comments'><h1>T</h1><p>{LONG}</p><div class='related-posts'>More</div><div class='cookie-notice'>{LONG}</div></div></body>", f"T {LONG}"),
    (f"<body><form id=aspnetForm><h1>T</h1><p>{LONG}</p></form></body>", f"T {LONG}"),
    (f"<body><h1>T</h1><p>{LONG}</p><pre><code>x = 1 <span class='token comment'># hi</span></code></pre><form>Name <input></form></body>", f"T {LONG} x = 1 # hi"),
    (f"<body><div class=entry-header><h1>T</h1></div><p>{LONG}</p><section id=comments><h2>Comments</h2>{f'<p>{LONG} me too</p>' * 9}</section></body>", f"T {LONG}"),
    (f"<body><p>{LONG} <span class=ad>buy</span> more <span style='display: none'>hidden</span></p></body>", f"{LONG} more"),
    (f"<ul>{''.join(f'<li>{a}' for a in MENU)}</ul>", ""),
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_unmarked_pages(page):
    assert H.main_text(PAGES[page][0]) == PAGES[page][1]


def test_the_ratios_decide(monkeypatch, spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    unmarked = [PAGES[i][0] for i in (1, 3)]
    plain = [H.main_text(p) for p in pages + unmarked]
    smoothed = H.smoothed
    monkeypatch.setattr(H, "smoothed", lambda r: 0 * r)
    assert all(H.main_text(p) == "" != t for p, t in zip(pages + unmarked, plain, strict=True))
    monkeypatch.setattr(H, "smoothed", lambda r: smoothed(r).max() - smoothed(r))  # the other lines
    assert all(H.main_text(p) != t for p, t in zip(unmarked, plain[len(pages) :], strict=True))


def plain_choice(page):
    """chosen_lines line by line, with sets of lines instead of running sums."""
    n = len(page.lines)
    ratio = [0.0 if page.off[i] else len(page.lines[i]) / max(page.tag_counts[i], 1) for i in range(n)]
    kernel = {d: math.exp(-0.5 * (d / H.RADIUS) ** 2) for d in range(-H.RADIUS, H.RADIUS + 1)}
    smooth = [sum(kernel[d] * ratio[i + d] for d in kernel if 0 <= i + d < n) / sum(kernel.values()) for i in range(n)]
    chars = [0 if page.off[i] else len(page.lines[i]) for i in range(n)]
    if not sum(chars):
        return []
    mean = sum(smooth) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / n)
    median = next(smooth[i] for i in sorted(range(n), key=lambda i: smooth[i]) if sum(c for j, c in enumerate(chars) if (smooth[j], j) <= (smooth[i], i)) >= sum(chars) / 2)
    limit = min(spread, median / 3)
    linked = [page.linked[i] and not page.off[i] for i in range(n)]
    menu = {i for i in range(n) if linked[i] and (page.link_counts[i] > 1 or any(0 <= j < n and linked[j] for j in (i - 1, i + 1)))}
    core = [i for i in range(n) if not page.off[i] and i not in menu and smooth[i] > 0 and smooth[i] >= limit - 1e-9]
    strong = [i for i in core if ratio[i] >= limit - 1e-9]
    if not strong:
        return []
    elements = [(k, set(range(f, e))) for k, f, e in zip(page.kinds, page.first, page.last, strict=True) if e > f]
    marked = [lines for k, lines in elements if k == "content" and lines & set(core)]
    if marked:
        return sorted(i for i in set().union(*marked) if not page.off[i])
    walls = [i for i in range(n) if i in menu or page.border[i]]
    segment = [sum(w <= i for w in walls) for i in range(n)]
    weight = {s: sum(chars[i] for i in strong if segment[i] == s) for s in set(segment)}
    heaviest = min(s for s in weight if weight[s] == max(weight.values()))
    own = {i for i in strong if segment[i] == heaviest}
    around = [lines for k, lines in elements if k == "region" and own <= lines]
    region = min(around, key=len) if around else None
    mine = [i for i in strong if (i in region if region else weight[segment[i]] >= H.SHARE * weight[heaviest])]

    def goes(i):
        return page.off[i] and not page.border[i] or i not in menu and not page.border[i] and (i in (region or ()) or page.block[i] in H.PROSE)

    lo, hi = mine[0], mine[-1]
    while lo and goes(lo - 1):
        lo -= 1
    while hi + 1 < n and goes(hi + 1):
        hi += 1
    return [i for i in range(lo, hi + 1) if not page.off[i]]


def made(rng):
    """A page of nested blocks, links, named parts and stray tags."""
    out = []
    for _ in range(rng.randint(1, 25)):
        tag = rng.choice(["div", "p", "section", "h1", "h2", "li", "td", "article", "nav", "footer", "span", "aside", "form", "main"][: rng.choice([7, 14])])
        name = rng.choice(["", "", "", " class='ad'", " class='site-header'", " id='comments'", " class='post-body'"])
        words = " ".join(rng.choice(["word", "x", "longerword"]) for _ in range(rng.choice([0, 1, 3, 30])))
        body = f"<a href='#'>{words}</a>" if rng.random() < 0.25 else words
        out.append(f"<{tag}{name}>{body}" + (f"</{tag}>" if rng.random() < 0.8 else "") + rng.choice(["", "", "</div>", "<br>tail", "</p>"]))
    return "".join(out)


def test_same_as_plain_version(spark, sf_dir):
    rng = random.Random(6)
    pages = [p for p, _ in PAGES] + [made(rng) for _ in range(600)] + [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).collect()]
    some = 0
    for html in pages:
        page = H.Page()
        page.feed(html)
        page.done()
        got = H.chosen_lines(page).nonzero()[0].tolist()
        assert got == plain_choice(page), html
        some += bool(got)
    assert some > 300


LARGE = {
    "table": ("<table>" + "".join(f"<tr><td>row {i}</td></tr>" for i in range(50_000)) + "</table>", " ".join(f"row {i}" for i in range(50_000))),
    "nested": ("<div>" * 20_000 + LONG + "</div>" * 20_000, LONG),
    "named": ("<div class=sidebar>" * 20_000 + f"<h1>T</h1><p>{LONG}</p>", f"T {LONG}"),
    "parts": (f"<h1>T</h1><p>{LONG}</p>" + "<div class=ad>buy" * 20_000, f"T {LONG}"),
    "stray": ("</section>" * 20_000 + "<b>" * 20_000 + "</i>" * 20_000 + LONG, LONG),
    "inline": ("<b>" * 20_000 + "".join(f"<p>t{i}" for i in range(20_000)), " ".join(f"t{i}" for i in range(20_000))),
    "line": (f"<p>{LONG * 50_000}</p>", LONG * 50_000),
}


@pytest.mark.parametrize("name", list(LARGE))
def test_large_pages(name):
    began = time.time()
    assert H.main_text(LARGE[name][0]) == LARGE[name][1] and time.time() - began < 20


def test_threshold_counts_characters():
    smooth, chars = np.array([1.0, 10.0, 30.0, 0.0]), np.array([1, 10, 30, 0])
    assert H.threshold(smooth, chars) == pytest.approx(10.0)
