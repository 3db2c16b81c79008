import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from spanveil.llm import host_reputation as h
from spanveil.llm import html_extract as x
from spanveil.llm import license_scan as l
from tests.llm.cases import documents, with_clashes

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a> <a href=y>News</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="ad">Buy one of these now and save a lot.</div><article><h1>A   title &amp; more</h1><p>First paragraph of the text with<br>a break, <a href=z>a link</a> and quite a few words to read.</p><script>var a="</p>";</script>
<p>Short.</p><div class="cookie-notice">We use cookies on this site to do things.</div><section id="comments"><p>I liked this article very much, thank you for writing it.</p></section></article>
<aside>Other things to read that are not part of this page at all.</aside><form><p>Subscribe to our letter</p></form><footer>&copy; someone, with all the usual words about rights.</footer></body></html>"""


def test_page_furniture_goes():
    assert x.main_text(PAGE) == "A title & more\nFirst paragraph of the text with a break, a link and quite a few words to read.\nShort."


def test_broken_pages():
    assert x.main_text(None) == "" and x.main_text("") == "" and x.main_text("<nav><a>x</a>") == ""
    assert x.main_text("<article><p>one two three four five six seven</div></nav><p>eight &lt;nine&gt; &nbsp;ten &#233; a < b") == "one two three four five six seven\neight <nine> ten é a < b"
    assert len(x.main_text("<article>" + "<p>word word word</p>" * 20000).split("\n")) == 20000


STORY = "<article><p>one two three four five six seven</p><p>eight nine ten eleven twelve more</p></article>"
STORY_TEXT = "one two three four five six seven\neight nine ten eleven twelve more"


def test_scripts_and_unclosed_silent_elements_hide_no_article():
    for loop in ("for(i=0;i<n;i++){x+=i}", "if(a<b&&c>d){}", "s='<p>no</p><!--'", 'q="<script>"'):
        assert x.main_text(f"<body><script>{loop}</script>{STORY}<SCRIPT>{loop}</SCRIPT ></body>") == STORY_TEXT, loop
    for tag in sorted(x.SILENT - {"script"}):
        assert x.main_text(f"<div><{tag} id=a>Menu</div>{STORY}") == STORY_TEXT, tag
        assert x.main_text(f"<div><{tag}>Menu</div>{STORY}<div><{tag}>More</{tag}></div>") == STORY_TEXT, tag
        assert x.main_text(STORY.replace("<article>", f"<article><{tag}>Share")) == STORY_TEXT, tag
        assert x.main_text(STORY.replace("</p>", f" <{tag}><b>Share</b> it</{tag}></p>")) == STORY_TEXT, tag
    assert x.main_text("<article><object><object>a</object>b</object><button><div>c</div>d</button><p>one two three four five six seven</p></article>") == "one two three four five six seven"


def test_compound_names_and_forms_around_the_article():
    for around in ("<html class='no-cookie'>", "<body class='page has-sidebar'>", "<body class='modal'>", "<div class='with-sidebar'>", "<form id=page>", "<div class='comments-open'><form>"):
        assert x.main_text(around + STORY) == STORY_TEXT, around
    assert x.main_text(STORY.replace("<article>", "<article class='post tag-ads'>")) == STORY_TEXT
    assert x.main_text(f"<div class=has-sidebar><div class=content>{STORY[9:-10]}</div></div>") == STORY_TEXT
    assert x.main_text(f"{STORY}<div class='sidebar'><article><p>other words that are not part of this</p></article></div>") == STORY_TEXT
    assert x.main_text(f"{STORY}<div class='cookie-bar'><div class=content><p>we use cookies here today</p></div></div>") == STORY_TEXT


class SlowArticle(HTMLParser):
    """Blocks of text inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.depth, self.silent = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.silent += tag in ("script", "style")
        self.edge(tag)

    def handle_endtag(self, tag):
        self.edge(tag)
        self.depth -= tag == "article"
        self.silent -= tag in ("script", "style")

    def edge(self, tag):
        if tag in x.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_data(self, data):
        if self.depth and not self.silent:
            self.blocks[-1] += data


def test_whole_table_against_a_slow_parser(spark):
    rows = x.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in rows:
        p = SlowArticle()
        p.feed(r["html"] or "")
        p.close()
        assert r["text"] == "\n".join(" ".join(b.split()) for b in p.blocks if b.split()), r["page_id"]


def test_hostile_pages_take_linear_time():
    pieces = ['<a x="', "<a x='>", "<a ", "<", "<div>", "<!--", "<!", "</div>", "<script>", "<title>", "<select>", "&amp", "<object>", "<button>x", "<li><div>", "<p><b>", '<a x="><p>', "<svg/ >"]
    for piece in [*pieces, "<div>" * 3 + "</section></nav>"]:
        for end in ("", ">", '">'):
            start = time.process_time()
            x.main_text(piece * (300_000 // len(piece)) + end)
            assert time.process_time() - start < 3, (piece, end)
    assert x.main_text("x <b y z").endswith("x <b y z") or x.main_text("x <b y z") == ""
    assert x.blocks("word <a b")[0].text == "word <a b" and x.blocks("<p>one <a x='two>three</p>")[0].text == "one three"


def test_state_names_comment_ends_and_list_items():
    words = STORY[9:-10]
    for around in ("<div class='no-comments'>", "<div class='post tags-page'>", "<main class='menu-open'>", "<div class='ads-enabled'><div>"):
        assert x.main_text(around + words) == STORY_TEXT, around
    assert x.main_text(f"<!-- menu --!>{STORY}<!-->") == STORY_TEXT and x.main_text(f"<!--->{STORY}") == STORY_TEXT
    assert x.main_text(f"<article>{words}<ul><li class=comment><p>nice words you wrote there friend<li>last point of the list here</ul></article>") == STORY_TEXT + "\nlast point of the list here"
    assert x.main_text(f"<div id=comments>{words}</div>") == ""


def test_tree_fits_its_table():
    rows = x.labelled()
    assert sum(x.decide(r[:-1]) == r[-1] for r in rows) >= 0.98 * len(rows)
    used, todo = set(), [x.TREE]
    while todo:
        tree = todo.pop()
        if isinstance(tree, tuple):
            used.add(x.FEATURES[tree[0]])
            todo += tree[2:]
    assert {"words", "links", "words_before", "links_before", "words_after", "links_after", "share", "article", "elsewhere"} - used in (set(), {"links_before"}, {"links_after"}, {"words_before"}, {"words_after"}), used


TEN = [f"Sentence number {k} of the story has quite a few words to read, hasn't it." for k in range(10)]
BODY = "".join(f"<p>{t}</p>" for t in TEN)
TEN_TEXT = "\n".join(TEN)


def test_articles_are_whole():
    """Wrappers, own headers, links and short ends inside an article."""
    for name in ("related-work", "post-tags-content", "article-banner-text", "comments-free-text", "siteFooterStory"):
        for outer in ("main", "article"):
            assert x.main_text(f"<{outer}><div class='{name}'>{BODY}</div></{outer}>") == TEN_TEXT, (outer, name)
    for head in ("<header><h1>Title</h1></header>", "<header class='entry-header'><h1>Title</h1></header>", "<div class='post-header'><h1>Title</h1></div>"):
        assert x.main_text(f"<article>{head}{BODY}</article>") == "Title\n" + TEN_TEXT, head
    assert x.main_text(f"<header class='site-header'><h1>Site name</h1></header><article>{BODY}</article>") == TEN_TEXT
    assert x.main_text(f"<article><p><a href=x>A first paragraph that is a link</a></p>{BODY}</article>") == "A first paragraph that is a link\n" + TEN_TEXT
    links = "".join(f"<li><a href=x>Author {k}, a paper</a></li>" for k in range(4))
    assert x.main_text(f"<article>{BODY}<ol>{links}</ol></article>") == TEN_TEXT + "".join(f"\nAuthor {k}, a paper" for k in range(4))
    nav = "<nav><a href=a>One</a><a href=b>Two</a></nav>"
    assert x.main_text(f"{nav}<article>{BODY}<p>That is where the story ends for now.</p></article>{nav}") == TEN_TEXT + "\nThat is where the story ends for now."
    assert x.main_text(f"<article><h1>A longer title of the story</h1><p><a href=x>By Jane Doe</a></p>{BODY}</article>") == "A longer title of the story\nBy Jane Doe\n" + TEN_TEXT
    assert x.main_text(f"<article>{BODY}<pre>a <span class=comment># note</span> <code><span class=ad>x</span></code></pre><p>see the <span class=menu>File</span> entry</p></article>") == TEN_TEXT + "\na # note x\nsee the File entry"


def test_marked_blocks_go():
    """Furniture on paragraphs, cells, headings, inline and hidden elements, in the article as outside."""
    for mark in ("<p class='cookie-notice'>We use cookies here.</p>", "<p class=advert>Buy this now.</p>", "<h2 class=newsletter>Our letter for you</h2>", "<p>", "<span class=advert>Buy more things</span>", "<div style='color:red; display: none'>Not to be seen</div>", "<p hidden>Not to be seen</p>", "<footer>Filed under things</footer>", "<div class=cookieBanner>We use cookies</div>", "<div class='author-social'>Find me</div>"):
        assert x.main_text(f"<article>{BODY[:-4]} {mark if 'span' in mark else ''}</p>{'' if 'span' in mark else mark}</article>") == TEN_TEXT, mark
    assert x.main_text(f"<table><tr><td class=nav><a href=a>One</a> <a href=b>Two</a><td class=content>{BODY}</td><td class=sidebar>Some other words that are not part of this story at all.</td></tr></table>") == TEN_TEXT
    assert x.main_text(f"<article>{BODY}<h2>3 comments</h2><div><p>I liked this a lot, thank you very much for it.</p></div></article>") == TEN_TEXT
    assert x.main_text(f"<div hidden><article>{BODY}</article></div>") == TEN_TEXT


NAV = "<div><a href=a>Home</a></div><div><ul><li><a href=b>News</a><li><a href=c>About us</a><li><a href=d>Contact</a></ul></div>"
LINE = "<div>Copyright 2024 All rights reserved</div>"
LEAD, LAST = "<h1>The title of the story</h1>", "<p>So it ends.</p>"
WANT = f"The title of the story\n{TEN_TEXT}\nSo it ends."
#: Pages without article or main, each with the whole story and nothing else to find.
PLAIN_PAGES = {
    "divs": f"<body>{NAV}<div>{LEAD}{BODY}{LAST}</div>{LINE}",
    "nested": f"<body><div>{NAV}<div><div>{LEAD}{BODY}{LAST}</div></div>{LINE}</div>",
    "footer": f"<body>{NAV}<div>{LEAD}{BODY}{LAST}</div><footer><p>Copyright 2024 All rights reserved</p></footer>",
    "comments": f"<body>{NAV}<div>{LEAD}{BODY}{LAST}</div><div><h3>2 Comments</h3><p>I liked this one very much, thank you for writing all of it.</p><p>Me too, and so did everyone else that I know.</p></div>{LINE}",
    "sidebar": f"<body>{NAV}<div class=sidebar><p>Some words about the author that are long enough to look like a story of its own, aren't they.</p></div><div>{LEAD}{BODY}{LAST}</div>{LINE}",
    "links": f"<body>{NAV}<div>{LEAD}{BODY}{LAST}</div><div><h3>Other stories</h3><ul><li><a href=a>The cat that came back home</a><li><a href=b>A dog in the rain</a></ul></div>{LINE}",
    "table": f"<body><table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td>{LEAD}{BODY}{LAST}</td></tr><tr><td>Copyright 2024 All rights reserved</td></tr></table>",
    "breaks": f"<body>{NAV}<div>{LEAD}{'<hr>'.join(TEN)}<hr>So it ends.</div>{LINE}",
    "wrapped": f"<body>{NAV}<div>{LEAD}<div>{BODY}{LAST}</div></div>{LINE}",
    "content": f"<body>{NAV}<div id=content>{LEAD}{BODY}{LAST}</div><div>Subscribe to our newsletter</div>{LINE}",
    "search": f"<body><form><input> <p>Search this site</p></form>{NAV}<section>{LEAD}{BODY}{LAST}</section>{LINE}",
    "bare": f"<body><nav><a href=a>Home</a></nav>{LEAD}{BODY}{LAST}<footer>Copyright 2024</footer>",
    "cookies": f"<body><div>This site uses cookies. <a href=x>Privacy policy</a></div>{NAV}<div>{LEAD}{BODY}{LAST}</div>{LINE}",
}


def test_pages_without_an_article_element():
    wrong = {k: x.main_text(page) for k, page in PLAIN_PAGES.items() if x.main_text(page) != WANT}
    assert not wrong, wrong


def test_pages_table(spark):
    pages = with_clashes(spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id int, url string, html string"))
    rows = x.extract_pages(pages).select("page_id", "text").collect()
    assert len(rows) == 4 and all(r["text"] is not None for r in rows)
    assert x.extract_pages(pages.where(F.lit(False))).count() == 0


URLS = ["http://A.Example.com/en/71?x=/y", "https://example.com/en/8", "https://shop.example.net/de/81#f", "https://shop.example.net/de/1", "http://x.org/es/", "http://x.org", None, "no scheme", "ftp://h?q", "http://notexample.com/en/7", "a://b://c/d"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    rows = {r["page_id"]: r for r in h.judge_urls(pages).collect()}
    assert [rows[i]["host"] for i in range(len(URLS))] == ["a.example.com", "example.com", "shop.example.net", "shop.example.net", "x.org", "x.org", "", "", "h", "notexample.com", "b:"]
    assert rows[0]["path"] == "/en/71" and rows[10]["path"] == "//c/d" and rows[8]["path"] == ""
    assert [rows[i]["rule"] for i in range(6)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None] and rows[9]["rule"] == "com/en/"
    assert [rows[i]["verdict"] for i in range(5)] == ["allow", "block", "block", "allow", "block"] and rows[6]["verdict"] == "allow"


def test_long_lists_match_by_join(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    many = h.RULES + [("block", f"host{i}.example/") for i in range(h.INLINE_RULES)]
    key = lambda df: sorted((r["page_id"], str(r["rule"]), str(r["listed"])) for r in df.collect())
    assert key(h.with_rules(pages, many)) == key(h.with_rules(pages))
    assert {r["rule"] for r in h.with_rules(pages, []).collect()} == {None}


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("good.a.com", False)] * 60 + [("bad.b.com", True)] * 60 + [("bad2.b.com", True)] * 60 + [("new.b.com", None)] * 3 + [("one.a.com", True)]
    got = {r["host"]: r for r in h.host_posteriors(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.b.com"]["lower"] > 0.5 > got["good.a.com"]["lower"]
    assert got["new.b.com"]["rate"] > 0.6 and got["one.a.com"]["rate"] < 0.9 and got["one.a.com"]["lower"] < 0.5
    assert h.judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_suffixes_and_domains(spark):
    hosts = ["a.b.example.com", "a.example.co.uk", "com", "", "x.de", "a.me.github.io", "github.io", "www.abc.pvt.k12.ma.us", "x.y.kyoto.jp"]
    df = spark.createDataFrame([(x,) for x in hosts], "host string")
    got = [(r["s"], r["d"]) for r in df.select(h.suffix_of(F.col("host")).alias("s"), h.domain_of(F.col("host")).alias("d")).collect()]
    assert got == [("com", "example.com"), ("co.uk", "example.co.uk"), ("com", "com"), ("", ""), ("de", "x.de"), ("github.io", "me.github.io"), ("github.io", "github.io"), ("pvt.k12.ma.us", "abc.pvt.k12.ma.us"), ("kyoto.jp", "y.kyoto.jp")]
    assert df.select(h.suffix_of(F.lit("a.b.c.d"), ("b.c.d",)).alias("s")).first()["s"] == "b.c.d" and df.select(h.suffix_of(F.lit("a.github.io"), ()).alias("s")).first()["s"] == "io"
    null = spark.createDataFrame([(None, "http://a.org/es/1"), (None, None)], "page_id int, url string")
    assert sorted(r["verdict"] for r in h.judge_urls(null).collect()) == ["allow", "block"]


def test_licence_notices(spark):
    extra = [(20, "some text\nReleased under the MIT License.\nmore", None, None, None), (21, "LICENSED under the apache license (version 2.0)!\nThis work is licensed under the GNU General Public License, version 3.", None, None, None), (22, "Released under the license of nobody at all, or so they say here.", None, None, None)]
    rows = {r["doc_id"]: r["notices"] for r in l.scan_licenses(with_clashes(documents(spark, extra))).collect()}
    assert [(n["line"], n["license"], n["dice"]) for n in rows[20]] == [(2, "MIT", 1.0)]
    assert [(n["line"], n["license"]) for n in rows[21]] == [(1, "Apache-2.0"), (2, "GPL-3.0")] and rows[22] == [] and rows[3] == []
    assert l.scan_licenses(documents(spark).where(F.lit(False))).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"


def slow_windows(text):
    """Best Dice of each licence over all windows of the text that hold what the template requires."""
    ws, best = " ".join(" ".join(re.sub(r"\.(?![0-9])|[^a-z0-9.]", " ", x.lower()).split()) for x in text.split("\n")).split(), {}
    templates = l.TEMPLATES + l.FULL + l.TAGS
    there = {f"{x} {y}" for x, y in zip(ws, ws[1:])}
    for (name, pairs), (_, t) in zip(l.template_bigrams(templates), templates):
        must = set(l.required(t))
        if not must <= there or 2 * len(there & set(pairs)) < 0.8 * len(pairs):
            continue
        for a in range(len(ws)):
            for b in range(a + 2, min(len(ws), a + 2 * len(pairs) + 2) + 1):
                own = {f"{x} {y}" for x, y in zip(ws[a:b], ws[a + 1 : b])}
                if must <= own:
                    best[name] = max(best.get(name, 0), 2 * len(own & set(pairs)) / (len(own) + len(pairs)))
    return best


def test_real_texts_against_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lower(text) LIKE '%licen%' AND n_chars < 3000").limit(120)
    for r in docs.select("text", l.notices(F.col("text")).alias("found")).collect():
        slow = {k: v for k, v in slow_windows(r["text"]).items() if v >= l.THRESHOLD}
        assert abs(max((n["dice"] for n in r["found"]), default=0) - max(slow.values(), default=0)) < 1e-9, r["text"]
        assert {n["license"] for n in r["found"]} <= set(slow) and all(n["license"] in slow and n["dice"] <= slow[n["license"]] + 1e-9 for n in r["found"])


SIBLINGS = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce it.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain it.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "X11": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including more.\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including more.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "Licensed under the Eclipse Public License 1.0.",
    "GPL-2.0-only": "Licensed under the GPL version 2 only.",
    "GPL-2.0-or-later": "// SPDX-License-Identifier: GPL-2.0-or-later",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0",
}
OTHERS = ["Licensed under CC BY-ND 3.0.", "SPDX-License-Identifier: Own-1.0", "This work is licensed under the GNU General Public License, version 9.", "Released under the License of nobody."]


def test_siblings_are_told_apart(spark):
    rows = [(k, f"some words\n{t}\nmore words here") for k, t in SIBLINGS.items()] + [(t, t) for t in OTHERS] + [("both", SIBLINGS["BSD-2-Clause"] + "\n" + SIBLINGS["BSD-3-Clause"])]
    found = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in l.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: v for k, v in found.items() if k in SIBLINGS} == {k: [k] for k in SIBLINGS} and all(found[t] == [] for t in OTHERS) and found["both"] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_wrapped_and_embedded_licences(spark):
    texts = {
        30: "x y\n" + MIT, 31: MIT.replace("\n", " "), 32: "Copyright X. Released under the MIT License. All rights reserved by its authors.", 33: f"# {GPL}", 34: f"{BSD}\n1. Redistributions of source code",
        35: "Released under the MIT\nLicense. Licensed under CC BY 4.0. " * 3, 36: f"{BSD}\n{MIT}\n{GPL}", 37: "licence of the work under the license, version 2.0 of this software " * 20, 38: "license",
        39: "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n Everyone is permitted", 40: GPL.replace("version 3", "version 2"),
    }
    rows = {r["doc_id"]: r["notices"] for r in l.scan_licenses(documents(spark, [(i, t, None, None, None) for i, t in texts.items()])).collect()}
    got = {i: [(n["line"], n["license"]) for n in rows[i]] for i in texts}
    assert got[30] == [(2, "MIT")] and got[31] == [(1, "MIT")] and got[32] == [(1, "MIT")] and got[33] == [(1, "GPL-3.0")] and got[34] == [(1, "BSD-2-Clause")]
    assert got[35] == [(1, "MIT"), (2, "CC-BY-4.0"), (2, "MIT"), (3, "CC-BY-4.0"), (3, "MIT"), (4, "CC-BY-4.0")]
    assert got[36] == [(1, "BSD-2-Clause"), (4, "MIT"), (9, "GPL-3.0")] and got[37] == [] and got[38] == [] and got[39] == [(1, "GPL-2.0")] and got[40] == [(1, "GPL-2.0")]
    for i, t in texts.items():
        slow = {k: v for k, v in slow_windows(t).items() if v >= l.THRESHOLD}
        assert abs(max((n["dice"] for n in rows[i]), default=0) - max(slow.values(), default=0)) < 1e-9, (i, slow)


FILES = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "ISC": "Copyright (c) 2004 X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "AGPL-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as\n    published by the Free Software Foundation, either version 3 of the\n    License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.",
}


def test_licence_files_as_published(spark):
    rows = spark.createDataFrame([(k, f"{PAGE}\n{t}\n{'some code or other ' * 30}") for k, t in FILES.items()], "doc_id string, text string")
    found = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in l.scan_licenses(rows).collect()}
    assert all(set(v) == {k} for k, v in found.items()), found


def test_licence_plan_is_native(spark):
    plan = l.scan_licenses(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
