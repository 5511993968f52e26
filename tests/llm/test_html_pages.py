"""Pages whose article has comments, adverts, notices, teasers, lists, tables or a short ending, under fitted weights and under none."""

from __future__ import annotations

import time

import pytest

from sonora.llm import html
from sonora.llm.common import read

A = "<p>The first paragraph of the article goes on for a while.</p><p>And so does the second one, which ends here.</p>"
TEXT = "The first paragraph of the article goes on for a while.\nAnd so does the second one, which ends here."
LONG = "<p>" + "A reader remarks at length on what was said. " * 20 + "</p>"

PAGES = {
    "comment articles beside": (f'<body><article>{A}</article><section id="comments" class="comments"><article class="comment"><p>Nice post by a reader, and a long remark on it.</p></article><article class="comment">{LONG}</article></section></body>', TEXT),
    "comment articles in main": (f'<body><main><article class="post">{A}</article><div id="comments"><h2>2 replies</h2><article class="comment">{LONG}</article></div></main></body>', TEXT),
    "comments inside": (f'<body><article>{A}<div id="comments"><h3>Comments</h3>{LONG}</div></article></body>', TEXT),
    "comment list inside": (f'<body><article>{A}<ol class="commentlist"><li class="comment">{LONG}</ol></article></body>', TEXT),
    "advert inside": (f'<body><article>{A.replace("</p><p>", '</p><div class="advertisement">Buy our very fine things now</div><p>')}</article></body>', TEXT),
    "sidebar inside": (f'<body><main>{A}<div class="sidebar"><p>Other things that you may like to read today.</p></div></main></body>', TEXT),
    "notice inside": (f'<body><article><div class="cookie-notice"><p>We use cookies on this page for many good reasons.</p></div>{A}</article></body>', TEXT),
    "teasers inside": (f'<body><main>{A}<div class="related"><article class="card"><h3>Another story of the day</h3><p>Read on about it over there.</p></article></div></main></body>', TEXT),
    "teasers beside": (f'<body><article>{A}</article><div class="teasers"><article class="teaser"><p>Another story of the day is over there.</p></article></div></body>', TEXT),
    "list, table and heading": (f"<body><article>{A}<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><h2>Fin</h2></article></body>", TEXT + "\na\nb\n1\n2\nFin"),
    "list and table of a page without an article": (f"<body><nav>menu</nav><div class=text>{A}<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><h2>Fin</h2></div></body>", TEXT + "\na\nb\n1\n2\nFin"),
    "last line in three blocks": (f"<body><article>{A}<div><div><div>The end.</div></div></div></article></body>", TEXT + "\nThe end."),
    "last line in three blocks without an article": (f"<body><div>{A}<div><div><div>The end.</div></div></div></div></body>", TEXT + "\nThe end."),
    "several posts": (f"<body><main><article>{A}</article><article>{A}</article><article>{A}</article></main></body>", "\n".join([TEXT] * 3)),
    "small card in main": (f'<body><main>{A}{A}<article><p>A card.</p></article></main></body>', TEXT + "\n" + TEXT + "\nA card."),
    "wrapper of a marked name": (f'<body><div class="widget"><article class="notice">{A}</article></div></body>', TEXT),
    "only article is a comment": ('<body><article class="comment"><p>The only text there is here.</p></article></body>', "The only text there is here."),
    "mostly one marked box": (f'<body><main><div class="banner">{A}{A}</div><p>And a line.</p></main></body>', TEXT + "\n" + TEXT + "\nAnd a line."),
    "menus and forms inside": (f"<body><article><nav>menu here</nav>{A}<form><p>Send it</p></form><aside>Beside</aside><script>x</script></article><footer>foot</footer></body>", TEXT),
    "texts beyond": (f"<body><div><p>{'Words of another place on the page. ' * 30}</p></div><article>{A}</article><div><p>{'More such words stand here too. ' * 30}</p></div></body>", TEXT),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return html.fit(read(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("name", PAGES)
def test_page(fitted, name):
    page, want = PAGES[name]
    assert html.extract(page, fitted) == want
    assert html.extract(page, {}) == want


def test_scan_of_marked_pages_is_linear(fitted):
    def took(n):
        page = "<body><main>" + '<div class="related"><article class="card"><p>x y z</p></article></div><article><p>some words are here</p></article>' * n
        began = time.process_time()
        html.extract(page, fitted)
        return time.process_time() - began

    took(100)
    assert took(16_000) < 20 * max(took(2_000), 0.02)


def test_classes_inside_an_article_are_learnt_as_beyond_where_they_are_marks(spark):
    page = '<body><article><p>Many words of the article {} are here and there.</p><div class="ad-box ad">Buy this thing now</div><div class="note">A note</div></article></body>'
    weight = html.fit(spark.createDataFrame([(i, page.format(i)) for i in range(20)], "page_id long, html string"))
    assert weight["class", "ad"] <= html.CLASS_OUT and weight["class", "note"] > 0
