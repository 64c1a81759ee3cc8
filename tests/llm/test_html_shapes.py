"""Articles in wrappers whose classes, forms or attributes look like what is no article, by hand and against a plain reader."""

import html
import re
from html.parser import HTMLParser

import pytest

from tallyloom.llm import html_extract

STORY = "The river rose again last night and the town woke to water in the lower streets."
MORE = "Boats were out before dawn, and the old bridge held, as it has for two hundred years."
LAST = "By noon the rain had stopped &amp; people came back to look for what was left."
P = f"<p>{STORY}</p><p>{MORE}</p><p>{LAST}</p>"
WANT = [STORY, MORE, html.unescape(LAST)]
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"
SIDE = "<div class='sidebar'><h3>Most read</h3><p>Ten more things that you may want to read today on this site.</p></div>"

SHAPES = {
    "has-sidebar": f"<body>{NAV}<div class='content has-sidebar'><article>{P}</article>{SIDE}</div></body>",
    "no-sidebar": f"<body><div class='layout-no-sidebar'>{P}</div></body>",
    "menu-closed": f"<body>{NAV}<div id=page class='menu-closed'><div>{P}</div></div></body>",
    "related-post": f"<body><div class='post related-post'>{P}</div></body>",
    "form around all": f"<form id=aspnetForm><input type=hidden name=v value=1>{NAV}<label>Search</label><div class=body>{P}</div></form>",
    "sidebar holds the article": f"<div class='sidebar wrap'><article>{P}</article></div>",
    "nav in class of body div": f"<body class='nav-open'><div class='with-menu'><main>{P}</main></div></body>",
    "popup beside": f"<body><div class=main>{P}</div><div class=popup><p>Sign up to our letter now, it is free.</p></div></body>",
    "notice inside": f"<article><div class='cookie notice'><p>We use cookies.</p></div>{P}</article>",
    "form inside": f"<article>{P}<form><p>Write to the editor:</p><textarea>hm</textarea><button>Send</button></form></article>",
    "long comments": f"<article>{P}</article><div id=comments>{'<article class=comment><p>' + 'I do not agree with a word of this, and I have said so before. ' * 6 + '</p></article>'}</div>",
    "comments without article": f"<div class=story>{P}</div><section class='comments'>{'<p>' + 'Well said, and well written too, I must say. ' * 30 + '</p>'}</section>",
    "related cards": f"<div class=text>{P}</div><section class=related>{'<article class=card><h3>Another</h3><p>A short teaser text.</p></article>' * 4}</section>",
    "hidden until loaded": f"<div style='display:none' id=app><div>{P}</div></div>",
    "aria hidden page": f"<div aria-hidden=true><main>{P}</main></div>",
    "header of page": f"<div class='header'><h2>The Daily</h2></div><article>{P}</article><footer>All rights</footer>",
    "share bar": f"<article><p>{STORY}</p><div class='share social'>Share this</div><p>{MORE}</p><p>{LAST}</p></article>",
    "table layout": f"<table><tr><td class=menu>Home News Sport</td><td class=text>{P}</td></tr></table>",
    "promo-less": f"<div class='page ads-disabled'><section>{P}</section></div>",
    "is-subscribed": f"<div class='is-subscribed'><div class='entry'>{P}</div><div class='newsletter'>Get our letter</div></div>",
    "script and style": f"<article><style>p{{}}</style><p>{STORY}</p><script>var a='<p>no</p>'</script><p>{MORE}</p><p>{LAST}</p></article>",
    "advert between": f"<main><p>{STORY}</p><div class=advert><p>Buy now!</p></div><p>{MORE}</p><p>{LAST}</p></main>",
}


class Plain(HTMLParser):
    """All paragraphs of a page, whatever they lie in."""

    def __init__(self):
        super().__init__()
        self.found, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "p"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    page = SHAPES[name]
    got = html_extract.extract(page, None).split("\n")
    assert got == WANT
    plain = Plain()
    plain.feed(re.sub(r"(?s)<script.*?</script>", "", page))
    assert all(x in plain.found for x in got)


def test_votes_of_a_host_with_wrappers(spark):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", SHAPES["has-sidebar"].replace("river", f"river {i}")) for i in range(6)] + [(9, "http://a.b/9", "<div class=menu>Home</div>"), (10, "http://c.d/1", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert all(got[i].split("\n")[1:] == WANT[1:] and f"river {i}" in got[i] for i in range(6)) and got[10] == ""
