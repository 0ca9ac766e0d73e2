"""Operators on pages and vectors against brute force, and their edge cases."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from chatledger.llm import epsilon_grid, html_extract, url_filter, warc
from chatledger.llm.common import Scratch, components


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    edges = [tuple(rng.sample(e, 2)) for e in chain + star] + [(7, 7), (None, 3), (500, 499), (500, 499)]
    got = components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "test")).collect()
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)} | {499: 499, 500: 499}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


URLS = [
    (1, "http://www.Shop.example.com/a//b/?utm_source=x&b=2&a=1#top"),
    (2, "https://shop.example.com:443/a/b?a=1&b=2"),
    (3, "http://user@shop.example.com/a/b/?b=2&ref=z&a=1"),
    (4, "http://shop.example.com/a/c"),
    (5, "http://x.example.net/en/"),
    (6, "http://x.example.net"),
    (7, "http://badexample.net/en/1"),
    (8, "http://example.com/de/1"),
    (9, "http://a.b.org/fr/"),
    (10, "HTTP://A.ORG/fr"),
    (11, None),
    (12, "no scheme/net/"),
    (13, "x://y://z/q"),
    (14, ""),
    (2, "https://shop.example.com:443/a/b?a=1&b=2"),
]


def test_url_rules_then_the_list(spark):
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in URLS], "page_id long, url string, verdict string, key_ int")
    listed = spark.createDataFrame([("http://shop.example.com/a/b?a=1&b=2",), (None,), ("junk",)], "url string")
    got = url_filter.judge(pages, listed).collect()
    assert len(got) == len(URLS)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert found[1] == ("www.shop.example.com", "/a//b/", None, "block")
    assert found[2][3] == found[3][3] == "block" and found[4][3] == "allow"
    assert found[5] == ("x.example.net", "/en/", "example.net/en/", "allow")
    assert found[6] == ("x.example.net", "", None, "allow")
    assert found[7] == ("badexample.net", "/en/1", "net/", "block")
    assert found[8][2:] == ("example.com/de/", "block") and found[9][2:] == ("org/fr/", "allow")
    assert found[10] == ("a.org", "/fr", None, "allow")
    assert found[11] == found[12] == found[14] == ("", "", None, "allow")
    assert found[13][:2] == ("y:", "//z/q")
    nothing = url_filter.judge(pages.limit(0), listed.limit(0), rules=())
    assert nothing.count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), rules=()).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    rows = spark.range(3000).selectExpr("id AS page_id", "concat('http://h.example/', id) AS url")
    got = url_filter.listed(rows, rows.where("page_id % 3 = 0")).collect()
    assert all(r.listed == (r.page_id % 3 == 0) for r in got) and len(got) == 3000


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vector_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 12))
    rows = []
    for v in base:
        for _ in range(rng.integers(1, 6)):
            rows.append((v + rng.normal(size=12) * rng.choice([0, 0.02, 0.09, 0.2])).tolist())
    rows += [rows[0], [x * 5 for x in rows[0]], rng.normal(size=8).tolist(), [1e-30] * 12, [3e30] * 12]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, None]]
    table = list(enumerate(rows + odd))
    got = epsilon_grid.near_duplicates(vectors(spark, table), block=16).collect()
    assert len(got) == len(table)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95

    links = {i: {j for j, b in enumerate(rows) if i != j and cosine(a, b)} for i, a in enumerate(rows)}
    component = {i: i for i, _ in table}
    for _ in table:
        component |= {i: min([component[i], *(component[j] for j in js)]) for i, js in links.items()}
    want = {i: (len(links.get(i, ())), component[i], component[i] == i) for i, _ in table}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_vectors_that_repeat_or_are_missing(spark):
    same = [(i, [1.0, 2.0]) for i in range(50)] + [(3, [1.0, 2.0])]
    got = epsilon_grid.near_duplicates(vectors(spark, same)).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {50} and len(got) == 51
    assert epsilon_grid.near_duplicates(vectors(spark, [])).count() == 0
    lost = epsilon_grid.near_duplicates(vectors(spark, [(None, [1.0]), (2, None)])).collect()
    assert Counter((r.vec_id, r.n_links) for r in lost) == {(None, 0): 1, (2, 0): 1}


LONG = "This is one of the paragraphs that a reader would call the text of the page, and it is long enough. "


def test_main_text_leaves_the_rest_out():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
      <body class="post"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
      <div class="cookie-notice"><p>{LONG}</p></div><!-- <p>no</p> -->
      <article><header><h1>Head&nbsp;line</h1></header><p><b>{LONG}<br>x &lt;b&gt; &amp;amp;<p>Short.</p>
      <div class="ad">{LONG}</div><aside>{LONG}</aside><form><p>Name</p><input></form>
      <ul><li><a href="a">One link</a></li></ul></article>
      <section id="comments"><article class="comment"><p>{LONG}</p></article></section>
      <div class="sidebar">{LONG}</div><footer>&copy; f</footer></body></html>"""
    assert html_extract.main_text(page) == f"Head line\n{LONG}x <b> &amp;\nShort."


def test_article_at_the_side_does_not_take_the_page():
    main = f"<div><h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 2}</p></div>"
    want = f"Head\n{(LONG * 3).strip()}\n{(LONG * 2).strip()}"
    for side in ("aside", "div class=sidebar", "nav"):
        tag = side.split()[0]
        assert html_extract.main_text(f"<body>{main}<{side}>{f'<article><p>{LONG}</p></article>' * 9}</{tag}>") == want
    # Not the side: a wrapper that is only named like it, and an article beside longer text.
    assert html_extract.main_text(f"<div class='page with-sidebar'><article>{main}</article></div>") == want
    assert html_extract.main_text(f"<form id=f><article>{main}</article></form><p>{LONG}</p>").startswith(want)
    assert want in html_extract.main_text(f"{main}<article><p>{LONG}</p></article>")


def test_sections_named_like_comments_stay():
    part = f"<p>{LONG}</p>"
    for name in ("id=discussion", "class=discussion", "class=commentary", "id=reply-to-critics", "id=comments", "class='post comments-open'", "id=response"):
        page = f"<article>{part}<section {name}><h2 id=discussion>Discussion</h2>{part}</section></article>"
        assert html_extract.main_text(page) == f"{LONG.strip()}\nDiscussion\n{LONG.strip()}", name
    for name in ("class=comments", "class='x comment-list'", "class=commentList", "id=disqus_thread", "id=respond", "id=comments"):
        assert html_extract.main_text(f"<article>{part}<div {name}>{part}</div></article>") == LONG.strip(), name


def test_sentences_with_many_links_stay_in_an_article():
    linked = "<a href=a>The history of mills</a>, <a href=b>the history of wheels</a> and of <a href=c>water</a> is told on the next page."
    page = f"<article><p>{LONG}</p><p>{linked}</p><ul><li><a href=z>The other things that you may like to read on this site</a></ul></article>"
    assert html_extract.main_text(page) == f"{LONG.strip()}\nThe history of mills, the history of wheels and of water is told on the next page."


def test_main_text_without_article_elements():
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><h1>Head</h1><p>{LONG * 3}</p><p>Short one.</p><div>{'<a href=z>more of it</a> ' * 9}</div><div>Tail"
    assert html_extract.main_text(page) == f"Head\n{(LONG * 3).strip()}\nShort one."


@pytest.mark.parametrize("page", [None, "", " ", "<p", "<p class='x>", "<!-- x", "<script>x", "<![CDATA[x", "</p></div>", "<a b='>"])
def test_broken_markup_does_not_fail(page):
    assert html_extract.main_text(page) == ""


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", "<p>a &amp; b<p>\U0001f600", 5), (2, None, None, 5), (None, "u", "", 5), (1, "u", "<p>a", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").select("page_id", "url", "html", "text")
    got = html_extract.extract(pages.select("page_id", "url", "html")).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter([(1, "a & b\n\U0001f600", 7), (2, "", 0), (None, "", 0), (1, "a", 1)])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    bodies = [None, "", "é" * 50, "x" * 300_000] + ["".join(rng.choice("abc <p>") for _ in range(2000)) for _ in range(400)]
    rows = [(i, f"http://h/{i} \r\nX: y" if i % 7 else None, rng.choice(bodies)) for i in range(600)]
    rows += [(5, "again", rows[5][2]), (None, "http://n", bodies[3])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int").repartition(3)
    archives = warc.write_archives(pages, limit=100_000)
    for a in archives.collect():
        (tmp_path / a.path).write_bytes(a.content)
        assert a.content[:4] == b"\x5d\x2a\x4d\x18"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = warc.read_archives(files).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", math.inf), math.inf if i is None else i)
    for r in got:
        assert r.error is None
    want = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        least = first[html or ""]
        revisit = i != least
        want[(i, len(body), warc.payload_digest(body), "revisit" if revisit else "response", least if revisit else None, None if revisit else body)] += 1
    assert want == Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got
    )
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_reader_names_what_is_wrong(spark):
    import zstandard

    record = warc.make_record(1, "http://h", b"body", None)

    def archive(*records):
        return b"".join(zstandard.ZstdCompressor().compress(r) for r in records)

    good = archive(record)
    cases = {
        "good": good,
        "skip": b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + good,
        "cut": good[:-5],
        "junk": b"not an archive",
        "long": archive(record + b"more"),
        "length": archive(record.replace(b"Content-Length: 4", b"Content-Length: 5")),
        "version": archive(record.replace(b"WARC/1.1", b"WARC/9.9")),
        "header": archive(record.replace(b"WARC-Date", b"X-Date")),
        "digest": archive(record.replace(b"body", b"BODY")),
        "second": archive(record) + archive(b"WARC"),
        "empty": b"",
    }
    table = spark.createDataFrame(list(cases.items()), "path string, content binary")
    got = warc.read_archives(table, strict=False).collect()
    assert Counter(r.path for r in got if r.error is None) == {"good": 1, "skip": 1, "second": 1}
    assert {r.path for r in got if r.error} == set(cases) - {"good", "skip", "empty"}
    with pytest.raises(Exception, match="cut"):
        warc.read_archives(table.where("path = 'cut'")).collect()


PROSE = {
    "en": "the people of the town met in front of the hall and it was a long evening for all of them",
    "de": "die Leute der Stadt waren an dem Abend in dem Saal und das war für alle ein schöner Tag",
    "pl": "wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem żeby wspólnie świętować rocznicę szkoły",
    "ru": "вчера вечером жители города собрались перед ратушей чтобы вместе отпраздновать годовщину школы",
    "zh": "昨天晚上市民们聚集在市政厅前一起庆祝音乐学校成立周年他们唱歌跳舞直到深夜才回家休息第二天大家又继续工作",
}
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/about'>About us and the team of the site</a></li></ul></nav>"
FOOT = "<footer><p>All of the rights are with the owners of this site, and that is that for the year.</p></footer>"


def paragraph(rng, language):
    words = PROSE[language].split() if language != "zh" else [PROSE[language]]
    return " ".join(rng.choice(words) for _ in range(40)) + "." if language != "zh" else PROSE["zh"] * 3 + str(rng.randrange(1000))


@pytest.mark.parametrize("language", list(PROSE))
def test_generated_pages_give_back_their_main_text(language):
    rng = random.Random(language)
    for _ in range(25):
        wanted = [paragraph(rng, language) for _ in range(rng.randrange(2, 6))]
        main = ""
        for text in wanted:
            frame = rng.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<section id='related-work'><p>{}</p></section>"])
            main += frame.format(text) + rng.choice(["", "<script>var the = 'of the and';</script>", "<!-- the of and -->"])
        holder = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='content'>{}</div>"])
        if holder == "<div>{}</div>":
            main = main.replace(" id='related-work'", "")
        aside = rng.choice(["", "<aside><p>" + paragraph(rng, "en") + "</p></aside>", "<div class='sidebar'><a href='x'>More of it</a></div>"])
        page = f"<html><head><title>t</title></head><body>{MENU}{holder.format(main)}{aside}{FOOT}</body></html>"
        assert html_extract.main_text(page) == "\n".join(wanted), page


@pytest.mark.parametrize(
    "opened", ["section id=related-work", "section id=social-history", "section id=recommendations", "section id=sharing-economy",
               "div class=notice-of-motion", "div class=form", "table class=header-table"],
)
def test_parts_of_an_article_named_like_side_parts_stay(opened):
    text = (PROSE["en"] + " ") * 2 + "."
    tag = opened.split()[0]
    inner = f"<tr><td>{text}</td></tr>" if tag == "table" else f"<p>{text}</p>"
    page = f"<body>{MENU}<article><p>{text}</p><{opened}>{inner}</{tag}></article></body>"
    assert html_extract.main_text(page) == f"{text}\n{text}"


def test_side_parts_of_an_article_go():
    text = (PROSE["en"] + " ") * 2 + "."
    links = "<div class='related-posts'><a href=a>One more story about it</a><a href=b>Two</a></div>"
    mail = "<div class=newsletter>Get the best of our news in a mail every day of the week, for free and for all.</div>"
    form = f"<div class=share><p>{text}</p><input name=q></div>"
    page = f"<article><p>{text}</p>{links}{mail}{form}<section class='advert'><p>{text}</p></section></article>"
    assert html_extract.main_text(page) == text


def test_formulas_stay_and_deep_pages_take_linear_time():
    formula = "<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math>"
    page = f"<article><p>The sum {formula} is the answer to all of it, and that was that for the day in the end.</p></article>"
    assert "The sum x+1 is" in html_extract.main_text(page)

    def seconds(n):
        start = time.perf_counter()
        html_extract.main_text("<div>" * n + "</b>" * n + "x")
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000)
