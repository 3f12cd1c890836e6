import html
import re

import numpy as np
import pytest

from geoplane.llm import htmltext as H
from geoplane.llm.queries import op5_htmltext

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("page,text", [
    ('<div class="cookie-notice">We use cookies</div><h1>Big title</h1><p>A &amp; &eacute;</p><p>two<br>lines'
     '<ul><li>a<li>b</ul><div id=comments><p>nice post</p></div>', "Big title\n\nA & é\n\ntwo lines\n\na\n\nb"),
    ("<p>a<nav>x</nav>b", "a\n\nb"),
    ("", ""), (None, ""),
    ('<article><header><h1>T</h1></header><p>x <a href=q>link</a> y</p><aside>no</aside>'
     '<section class="comments"><article>c</article></section></article><p>out</p>', "T\n\nx link y"),
    ('<div>a<script>if (a<b) "</div>"</script>b</div>', "a b"),
    ("<p>1 < 2 & 3 &lt; 4 &#233;&nbsp;x</p>", "1 < 2 & 3 < 4 é x"),
    ('<main><form><input><p>mail</p></form><p>kept <b>bold<i>it</b> on</p><div hidden>h</div></main><footer>f</footer>',
     "kept boldit on"),
    ("<style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes", "yes"),
    ('<header><h1>Site</h1></header><p>body</p><div style="display: none">x</div><p aria-hidden="true">y</p>', "body"),
    ("<p>" + "word " * 100_000 + "</p>", ("word " * 100_000).strip()),
])
def test_one_page(page, text):
    assert H.extract_group([page]) == [text]


def test_repeated_tokens_equal_brute_force():
    rng = np.random.default_rng(3)
    page = np.sort(rng.integers(0, 8, 400))
    tokens = rng.integers(0, 4, 400)
    tokens[50:70] = tokens[200:220] = tokens[350:370] = np.arange(20) + 10
    for run, least in ((3, 2), (8, 2), (5, 3), (500, 2)):
        grams = {}
        for i in range(len(tokens) - run + 1):
            if page[i] == page[i + run - 1]:
                grams.setdefault(tuple(tokens[i:i + run]), []).append(i)
        want = np.zeros(400, dtype=bool)
        for at in grams.values():
            if len({page[i] for i in at}) >= least:
                for i in at:
                    want[i:i + run] = True
        assert np.array_equal(H.repeated(tokens, page, run, least), want)


def test_host_boilerplate_goes_and_unique_blocks_stay():
    banner = "<div>Welcome to our site where all the best offers can be found today</div>"
    pages = [f"<body>{banner}<h2>Story {i}</h2><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p>"
             f"<div>Copyright and all other rights are reserved by the owners here</div></body>" for i in range(5)]
    for i, t in enumerate(H.extract_group(pages)):
        assert t.startswith(f"Story {i}\n\nw{i}x0 ") and "Welcome" not in t and "Copyright" not in t


def test_whole_table_matches_the_articles(spark):
    got = {r["page_id"]: r for r in op5_htmltext(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
                 for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_hosts_in_parts_and_edges(spark):
    rows = [(i, f"http://A.example/{i}", f"<article><p>text {i} " + "x " * 50 + "</p></article>", "t") for i in range(40)]
    rows += [(None, None, None, "t"), (7, "http://A.example/7", rows[7][2], "t"), (90, "not a url", "<p>z</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_text(df, part_bytes=500).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"] for r in got}[3] == "text 3 " + ("x " * 50).strip()
    assert {r["page_id"]: r["n_chars"] for r in got}[None] == 0
    assert H.extract_text(df.limit(0)).count() == 0


def test_repeats_are_counted_over_the_whole_host_whatever_its_parts(spark):
    def page(i):
        own = " ".join(f"w{i}x{k}" for k in range(30))
        rare = "<div>This offer is shown to readers of three of the pages only</div>" if i in (3, 11, 17) else ""
        twice = "<div>Two of the pages hold this very sentence and no other one</div>" if i in (4, 12) else ""
        links = "".join(f"<li><a href=q>some page of this site number {k}</a>" for k in range(3))
        marked = f"<article><p>{own}</p><ul>{links}</ul></article>" if i % 5 == 0 else f"<p>{own}</p>"
        return f"<body><div>Welcome to our site where all the best offers can be found</div>{rare}{twice}{marked}</body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(50, "http://b.example/1", page(51))] + [
        (60 + i, f"http://c.example/{i}", "<article><p>" + "plain " * 200 + "</p></article>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, H.extract_text(df).collect()))
    for part_bytes in (300, 2000):
        assert sorted(map(tuple, H.extract_text(df, part_bytes=part_bytes).collect())) == whole
    text = {r[0]: r[2] for r in whole}
    assert "offer" not in text[3] and text[4].startswith("Two of") and text[1].startswith("w1x0")
    assert "some page" not in text[0] and text[50].startswith("Welcome")
