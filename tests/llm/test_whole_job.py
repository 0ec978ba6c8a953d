"""Cases in which operators once did less than the whole job."""

from html.parser import HTMLParser

import pytest

from graphloom.llm import html, licenses, queries
from graphloom.llm.frames import table

PROSE = "It was in the evening that she came to the house by the river and saw that the lights were on in all of the rooms but not in the hall, which was dark."


def test_teaser_article_does_not_hide_the_body():
    page = f"<nav><a href='/'>Home</a></nav><article><h2>Teaser</h2></article><div><h1>Title</h1></div><div>{PROSE}</div><div>Short end.</div><div><a href='/b'>More of this kind</a></div>"
    assert html.main_text(page) == f"Teaser Title {PROSE} Short end."


def test_page_without_article():
    page = f"<div><a href='/'>Home</a></div><h1>Title</h1><div>{PROSE}</div><div>Short end.</div><footer>{PROSE}</footer>"
    assert html.main_text(page) == f"Title {PROSE} Short end."


def test_link_density_decides_inside_an_article():
    links = "".join(f"<li><a href='/{k}'>Another story {k}</a></li>" for k in range(3))
    page = f"<article><h1>Title</h1><p>{PROSE}</p><p><a href='/s'>The source</a></p><p>{PROSE}</p><ul>{links}</ul></article>"
    assert html.main_text(page) == f"Title {PROSE} The source {PROSE}"


def test_blocks_of_an_article_are_decided_by_more_than_membership():
    found = html.classify(html.blocks(f"<nav>Menu</nav><article><h1>Title</h1><p>{PROSE}</p></article>"))
    assert [(b.rule, b.good) for b in found] == [("structure", False), ("neighbours", True), ("stop words", True)]


NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
    ("It is released under the GNU General Public License v2 or later.", ["gpl"]),
    ("Licensed under the GNU Affero General Public License, version 3.", ["agpl"]),
    ("Available under the GNU Lesser General Public License, version 2.1.", ["lgpl"]),
    ("Distributed under the terms of the Apache License, Version 2.0.", ["apache-2"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["cc-by-sa"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["cc-by"]),
    ("Shared under CC BY-NC-SA 3.0 by its author.", ["cc-by-nc-sa"]),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", ["mit"]),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["bsd"]),
    ("provided that the above copyright notice and this permission notice appear in all copies", ["isc"]),
    ("The license of the general public was discussed under the terms of the contract.", []),
]


def test_license_notices_and_sections(spark):
    df = spark.createDataFrame([(k, f"some words before {text} some words after") for k, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: sorted({s.label for s in r.spans}) for r in licenses.scan(df).collect()}
    assert got == {k: labels for k, (_, labels) in enumerate(NOTICES)}


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(licenses.ROWS)], "doc_id long, text string")
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan(df).collect()}
    assert [k for k, (label, _) in enumerate(licenses.ROWS) if label not in got[k]] == []


# --- op7 ---

WRAPPERS = ["has-sidebar", "page no-sidebar", "content-with-header", "article search-result", "post sponsored-none", "layout-menu-open", "main content comments-open", "related-work", "sidebar", "widget"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_no_wrapper_takes_the_article_away(name):
    body = f"<h1>Title</h1><p>{PROSE}</p><p>Short end.</p>"
    whole = f"Title {PROSE} Short end."
    top, end = "<nav><a href='/'>Home</a></nav>", "<footer>Bye</footer>"
    assert html.main_text(f"{top}<div class='{name}'><article>{body}</article></div>{end}") == whole
    assert html.main_text(f"{top}<div class='x'><div id='{name}'><main>{body}</main></div></div>{end}") == whole
    assert html.main_text(f"{top}<main><div class='{name}'>{body}</div></main>{end}") == whole
    assert html.main_text(f"{top}<div class='{name}'>{body}</div>{end}") == whole


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad-banner", "nav-menu", "theme-sidebar", "cookie_notice", "related-posts", "comments", "comment-list"])
def test_names_of_what_is_not_the_article(name):
    other = f"<div class='{name}'><p>{PROSE}</p></div>"
    page = f"<article><h1>Title</h1><p>{PROSE}</p>{other}<p>End of it, that was all of the story.</p></article>{other * 5}"
    assert html.main_text(page) == f"Title {PROSE} End of it, that was all of the story."


def test_comments_may_be_longer_than_a_page_without_article():
    comments = f"<div class='comment'>{PROSE}</div>" * 6
    assert html.main_text(f"<h1>Title</h1><div>{PROSE}</div><div id='comments'>{comments}</div>") == f"Title {PROSE}"


def test_article_ends_a_menu_that_is_never_closed():
    assert html.main_text(f"<nav><a href='/'>Home</a><article><h1>Title</h1><p>{PROSE}</p></article><footer><nav>More</nav></footer>") == f"Title {PROSE}"
    # a closed one holds its article
    assert html.main_text(f"<article><h1>Title</h1><p>{PROSE}</p></article><aside><article>{PROSE}</article></aside>") == f"Title {PROSE}"


class Plain(HTMLParser):
    """The given pages' text, told by tags alone: what an article holds outside adverts, forms, asides and scripts."""

    OUT = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html.VOID:
            self.open.append((tag, tag in self.OUT or dict(attrs).get("class") == "ad" or "comment" in (dict(attrs).get("id") or "")))
        if tag not in html.INLINE:
            self.text.append(" ")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag not in html.INLINE:
            self.text.append(" ")

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(out for _, out in self.open):
            self.text.append(data)


def test_given_pages_equal_a_plain_version(spark):
    rows = queries.op7_html_text(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        plain = Plain()
        plain.feed(pages[r.page_id])
        assert r.text == " ".join("".join(plain.text).split()) and r.n_chars == len(r.text)
