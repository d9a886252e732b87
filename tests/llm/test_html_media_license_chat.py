import hashlib
import html
import io
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import regex

from prismata.llm import chat_format as C
from prismata.llm import license_scan as L
from prismata.llm import media as M
from prismata.llm.html_extract import extract_pages, main_text, second_pass

# HTML ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies and the like of that.</div><div id="sidebar"><p>side of the page</p></div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text.<br>Same block.</p><p>Tiny.</p><script>var t="</p>";</script><form><input><p>form text</p></form>
<ul><li><a href=a>Related one</a></li></ul><div class="comments"><p>I agree with all of that.</p></div><p>Unclosed &eacute;&#33;<p>Last.</article>
<footer>&copy; someone</footer></body></html>"""


def test_article_blocks():
    assert main_text(PAGE) == "Title & more\nFirst bold text. Same block.\nTiny.\nUnclosed é!\nLast."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "<div>" * 3000, "&", "</p></div>", "\0", "<nav>only</nav>"])
def test_odd_pages(page):
    assert main_text(page) in ("", "<", "&", "\0", "<p")


@pytest.mark.parametrize("page", ["<a '" * 20_000, '<p class="x' * 20_000, "<div>" * 50_000 + "</p>" * 50_000, "<!-" * 50_000, "<article>" + "<p>a" * 30_000, "<div class=widget>a" * 30_000, "<article><div class=nav>" * 20_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 20


def test_plain_page_by_density():
    good = "<p>" + "it was the best of times and it was the worst of times for all of us " * 5 + "</p>"
    links = "<p>" + "<a href=x>word word</a> " * 20 + "</p>"
    assert main_text(f"<div>{links}{good}<p>And a short end.</p>{good}{links}</div>").count("\n") == 2
    assert main_text(f"<div>{links}<p>short</p>{links}</div>") == ""


def test_articles_in_asides_and_comments_are_no_article():
    good = "it was the best of times and it was the worst of times for all of us " * 5
    teasers = "<aside><article><h3>Other story</h3><p>Teaser of it.</p></article></aside>"
    comments = '<section class="comments"><article><p>I agree with all of that.</p></article></section>'
    for page in (f"<div><p>{good}</p></div>{teasers}", f"<div><p>{good}</p></div>{comments}", f"{teasers}<article><p>{good}</p></article><p>{good} outside</p>{comments}"):
        assert main_text(page) == good.strip()


GOOD = "it was the best of times and it was the worst of times for all of us " * 5
RUSSIAN = "Это был обычный день, и никто не знал, что будет дальше. Люди шли по улице и говорили о погоде. " * 3


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout with-sidebar"><article><p>{}</p></article><div class="sidebar"><p>Side of it.</p></div></div>',
        '<div class="sidebar-layout"><main><p>{}</p></main></div><footer>f</footer>',
        '<article class="post related-post"><p>{}</p></article>',
        '<div class="search-page"><div><p>{}</p></div></div>',
        '<form action="x"><div><p>{}</p></div></form>',
        '<article><p>{}</p></article><article class="comment"><p>I am a reader.</p></article>',
        '<article><p>{}</p></article><article id="comment-12"><p>I am a reader, too, and have a lot to say about all of that.</p></article>',
        "<article><p>{}</p><section><article><p>Nested opinion of a reader.</p></article></section></article>",
        '<div><p>{}</p></div><div class="comments"><p>' + GOOD * 4 + "</p></div>",
        '<div><p>{}</p></div><div class="adBox">' + GOOD + '</div><div id="ad-top">buy</div>',
        '<article class="story"><p>{}</p></article><article class="related"><p>' + GOOD + "</p></article>",
        '<div class="no-sidebar has-header"><p>{}</p></div>',
    ],
)
@pytest.mark.parametrize("text", [GOOD, RUSSIAN])
def test_names_are_no_veto(page, text):
    assert main_text(page.format(text)) == text.strip()


def test_own_headers_are_content():
    page = f'<header><h1>Site</h1></header><article><div class="entry-header"><h1>Title</h1></div><header><p>Lead.</p></header><p>{GOOD}</p></article>'
    assert main_text(page) == f"Title\nLead.\n{GOOD.strip()}"
    assert main_text(f'<div class="post-header"><h1>Title</h1></div><div><p>{GOOD}</p></div>') == f"Title\n{GOOD.strip()}"


PROSE = GOOD.strip() + "."
REFERENCES = "<h2>References</h2><ul><li><a href=a>Smith, On rivers, 1999</a></li><li>Jones, <a href=b>On lakes and on the sea</a>, 2003.</li><li><a href=c>Brown, On rain</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div id="content"><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><article class="card"><h3>Other</h3><p>A teaser of it.</p></article>', f"Title\n{PROSE}\n{PROSE}"),
        (f'<article data-title="The hidden valley" data-x=\'display: none\'><p>{PROSE}</p></article>', PROSE),
        (f'<div class="overflow hidden rounded"><article class="x-hidden"><p>{PROSE}</p></article></div>', PROSE),
        (f'<article><p>{PROSE}</p><p hidden>No.</p><p HIDDEN="">No.</p><p aria-hidden=true>No.</p><p style="color:red; DISPLAY : none">No.</p><p style="visibility:hidden">No.</p></article>', PROSE),
        (f'<article data-state="{"x > y < z " * 4_000}"><p title=\'{"a" * 40_000}\'>{PROSE}</p></article>', PROSE),
        (f'<article {" ".join(f"a{i}={chr(34)}>{chr(34)}" for i in range(2_000))}><p>{PROSE}</p></article>', PROSE),
        (f'<article><div id="market-share"><p>{PROSE}</p></div><section class="promo-history"><p>{PROSE}</p></section><p>End.</p></article>', f"{PROSE}\n{PROSE}\nEnd."),
        (f'<article><p>{PROSE}</p><div class="promo-box"><p>{PROSE}</p></div><div class="related-posts"><p>{PROSE}</p></div><div class="cookieNotice"><p>{PROSE}</p></div></article>', PROSE),
        (f"<article><p>{PROSE}</p>{REFERENCES}</article>", f"{PROSE}\nReferences\nSmith, On rivers, 1999\nJones, On lakes and on the sea, 2003.\nBrown, On rain"),
        (f"<article><p>{PROSE}</p><ul><li><a href=a>One of them</a></li><li><a href=b>Two</a></li></ul><p>{PROSE}</p></article>", f"{PROSE}\nOne of them\nTwo\n{PROSE}"),
        (f"<article><p>{PROSE}</p><ul><li><a href=a>Tail one</a></li><li><a href=b>Tail two</a></li></ul></article>", PROSE),
        (f"<nav><a href=x>Home</a></nav><div class=top><h1>A title</h1></div><article><p>{PROSE}</p></article>", f"A title\n{PROSE}"),
        (f"<div><h1>The site</h1></div><article><h1>A title</h1><p>{PROSE}</p></article>", f"A title\n{PROSE}"),
        (f"<div><h1><a href=x>The site</a></h1></div><article><p>{PROSE}</p></article>", PROSE),
    ],
)
def test_ordinary_pages(page, text):
    assert main_text(page) == text
    assert main_text(f"<html><body><header>Site</header>{page}<footer>End of it</footer></body></html>") == text


@pytest.mark.parametrize("page", ["<a \"<a '" * 20_000, "<a '<b \"' \"'\" " * 20_000, "<a ''\"\"" * 30_000, "<a " + "''" * 100_000, ("<a '<b " + "x" * 600 + "' ") * 2_000, "<!" * 50_000, "<a" * 50_000, "<p " + "a='1' " * 50_000 + ">"])
def test_lost_quotes_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def made_page(rng: random.Random) -> tuple[str, str]:
    """A page and its text: article or plain layout, attributes full of telling words, furniture with and without names."""
    words = "it was the best of times and it was the worst of times for all of us in that city by the sea".split()

    def prose(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    text, body = [prose(5)], []
    body.append(f"<h1 {rng.choice(['', 'class=hidden-gem', 'data-x=\"<p hidden>\"'])}>{text[0]}</h1>")
    for _ in range(rng.randint(3, 8)):
        kind = rng.randrange(4)
        line = prose(rng.randint(45, 90))
        text.append(line)
        if kind == 0:
            body.append(f'<div class="{rng.choice(["promo-history", "market-share", "menu-prices", "text"])}"><p>{line}</p></div>')
        elif kind == 1:
            short = prose(4)
            body.append(f"<p title='{'>' * rng.choice([1, 30_000])}'>{line}</p><h2>{short}</h2><p>{line}</p>")
            text += [short, line]
        elif kind == 2:
            body.append(f'<p>{line}</p><div style="display:none">{prose(60)}</div><script>"<p>{line}</p>"</script>')
        else:
            body.append(f'<p>{line[:40]}<a href="x">{line[40:52]}</a>{line[52:]}</p><aside>{prose(70)}</aside>')
    frame = [f'<nav><ul>{"<li><a href=x>Go there</a></li>" * 5}</nav>', f'<div class="{rng.choice(["ad", "promo-box", "cookieNotice"])}"><p>{prose(60)}</p></div>']
    inner = "".join(body)
    if rng.random() < 0.5:
        page = f'<main class="overflow hidden">{inner}</main>'
        if rng.random() < 0.5:  # the title stands before it
            page = f'<div>{body[0]}</div><main>{"".join(body[1:])}</main>'
    else:
        page = f'<div id="content" role="document">{inner}</div><article class="card"><h3>Other</h3><p>{prose(6)}</p></article>'
    return f"<html><head><title>x</title></head><body>{frame[0]}{page}{frame[1]}<footer>{prose(50)}</footer></body></html>", "\n".join(text)


@pytest.mark.parametrize("seed", range(60))
def test_made_pages(seed):
    page, text = made_page(random.Random(seed))
    assert main_text(page) == text


def test_unlisted_languages():
    page = f"<div><ul><li><a href=x>Меню</a></li></ul><div><p>{RUSSIAN}</p><p>Коротко.</p><p>{RUSSIAN}</p></div></div>"
    assert main_text(page) == f"{RUSSIAN.strip()}\nКоротко.\n{RUSSIAN.strip()}"
    chinese = "这是一个普通的日子，没有人知道接下来会发生什么。" * 5
    assert main_text(f"<div><p>{chinese}</p></div>") == chinese


@pytest.mark.parametrize("tag", ["svg", "math", "button", "select", "object", "canvas", "noscript", "audio", "video", "template"])
def test_unclosed_elements_swallow_no_page(tag):
    gone = f"<{tag} x=1><div><b>gone</b></div></{tag}>"
    assert main_text(f"<article><p>One <{tag}></p><p>two.</p>{gone}<p>Three{gone} four.</p></article>") == "One\ntwo.\nThree four."
    assert main_text(f"<article><p>One.</p><{tag}><p>Two.</p></article>{gone}") == "One.\nTwo."
    if tag in ("svg", "math"):
        assert main_text(f"<article><p>One <{tag} id='i'/> two.</p><p>Three <{tag}><{tag}/><{tag}>x</{tag}></{tag}> four.</p></article>") == "One two.\nThree four."
    elif tag in ("button", "select"):
        assert main_text(f"<article><{tag}><p>One.</p>{gone}<p>Two.</p></article>") == "One.\nTwo."


@pytest.mark.parametrize("page", ["<button>" * 50_000, "<svg>" * 50_000, "<object><svg>" * 20_000, "<div><object>" * 20_000, "<p><svg>" * 20_000 + "</svg>", "<div><object><p><svg></p>" * 20_000 + "</div>" * 20_000])
def test_unclosed_elements_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_head_without_end():
    assert main_text("<html><head><title>t</title><article><p>One.</p></article>") == "One."


def test_second_pass_inherits():
    assert second_pass(["good", "short", "good", "short", "bad", "near"], [0] * 6) == [True, True, True, False, False, False]
    assert second_pass(["short", "short"], [1, 1]) == [True, True] and second_pass(["short"], [0]) == [False]
    assert second_pass(["out", "short", "good"], [0, 0, 0]) == [False, True, True]


def test_pages_match_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_pages(rows.withColumnRenamed("x", "text")).collect()}
    for r in rows.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "u", None, "x", 5), (1, "u", None, "x", 5), (None, None, "<article><p>a", "y", 6)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(tuple(r) for r in extract_pages(df).select("text", "n_chars").collect()) == [("", 0), ("", 0), ("a", 1)]
    assert extract_pages(df.where("false")).count() == 0


# media -----------------------------------------------------------------


def brute_resize(x, h, w):
    big = np.kron(x, np.ones((h, w)))
    return big.reshape(h, x.shape[0], w, x.shape[1]).mean((1, 3))


@pytest.mark.parametrize("shape,goal", [((5, 7), (3, 2)), ((2, 3), (4, 5)), ((8, 9), (8, 9)), ((1, 1), (8, 9))])
def test_area_resize(shape, goal):
    x = np.random.default_rng(0).integers(0, 256, shape).astype(float)
    assert np.allclose(M.area_resize(x, *goal), brute_resize(x, *goal))
    assert M.area_resize(np.stack([x] * 3, 2), *goal).shape == (*goal, 3)


def plain_resize(image, height, width):
    """Each target pixel from the source pixels it covers, one by one."""
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            top, bottom, left, right = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            for y in range(int(top), min(h, math.ceil(bottom))):
                for x in range(int(left), min(w, math.ceil(right))):
                    out[i, j] += image[y, x] * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
    return out / (h * w / height / width)


@pytest.mark.parametrize("strip", [7, 1 << 18])
@pytest.mark.parametrize("shape", [(9, 4), (4, 9), (1, 30), (30, 1), (1, 1), (17, 16)])
def test_area_resize_in_strips(monkeypatch, strip, shape):
    monkeypatch.setattr(M, "STRIP", strip)
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(M.area_resize(image, 5, 3), plain_resize(image, 5, 3))


@pytest.mark.parametrize("raw", [b"P5 99999999999 99999999999 255\n" + b"x" * 50, b"P6\n70000 70000\n255\n", b"P4 4000000000 4000000000\nx", b"P1 100000 100000\n01", b"P2 9999999 9999999 255\n1 2", b"P5 " + b"9" * 5000 + b" 1 255\nx", b"P3 3 3 255\n1", b"BM" + b"\xff" * 60, b"BM" + b"\0" * 52, b"P5", b"P7 1 1", b"BM"])
def test_hostile_headers(spark, raw):
    with pytest.raises((ValueError, struct.error, IndexError, OverflowError)):
        M.decode_image(raw)


def test_netpbm_kinds():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (M.decode_image(b"P5\n# note\n4 3\n255\n" + grey.tobytes()) == grey).all()
    assert (M.decode_image(b"P2 4 3 255 " + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (M.decode_image(M.encode_ppm(rgb)) == rgb).all()
    assert (M.decode_image(b"P3 4 2 255\n" + b" ".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    assert (M.decode_image(b"P1 3 2\n1 0 1\n010") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (M.decode_image(b"P4 3 2\n\xa0\x40") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert M.decode_image(b"P5 1 1 65535\n\x01\x02")[0, 0] == 258
    for bad in (b"P6 2", b"XX", b"P5 4 3 255\n12", b""):
        with pytest.raises((ValueError, IndexError)):
            M.decode_image(bad)


@pytest.mark.parametrize("width", [1, 2, 3, 64])
def test_bmp_round_trip(width):
    rgb = np.random.default_rng(width).integers(0, 256, (5, width, 3)).astype(np.uint8)
    assert (M.decode_image(M.encode_bmp(rgb)) == rgb).all()


def test_difference_hash():
    ramp = np.tile(np.arange(72.0), (16, 1))
    assert M.difference_hash(ramp) == "f" * 16 and M.difference_hash(ramp[:, ::-1]) == "0" * 16


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_media_round_trip(spark, form):
    texts = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é" * 500), (4, "x" * 192), (5, "y" * 200_001)]
    df = spark.createDataFrame([(i, t, "clash", b"z") for i, t in texts], "doc_id long, text string, feature string, media binary")
    got = M.media_features(M.store_texts(df, form)).collect()
    assert len(got) == len(texts)
    by = {}
    for (i, t), r in zip(texts, got):
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-16:])
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16, 3)
        assert by.setdefault(t or "", (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert M.store_texts(df.where("false"), form).count() == 0


def test_unreadable_media(spark):
    df = spark.createDataFrame([(1, 3, b"abc"), (2, 0, None), (3, 9, b"P5 99999999999 99999999999 255\nx")], "doc_id long, n_bytes long, media binary")
    a, b, c = M.media_features(df).collect()
    assert c.feature is None and c.media_bytes == 32
    assert a.feature is None and a.media_bytes == 3 and b.media_sha256 is None


# licenses --------------------------------------------------------------


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_words_and_phrases(spark):
    rng = random.Random(3)
    bits = ["GNU", "general", "public", "License", "apache", "license", "MIT", "license,", "cc", "by", "by-nc", "é", "x1", "\n", "  ", "-", "_", "licenses", "cc by", "mit\x00license", "CCBY", "ümit license"]
    texts = [None, "", " ", "mit license", "MIT\n--License!", "cc" + " " * 50 + "by", "a" * 100_000] + [" ".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = L.scan_licenses(df).collect()
    for t, r in zip(texts, got):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t or ""), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.scan_licenses(df.where("false")).count() == 0


def test_edited_notices_are_found():
    finder = L.NoticeFinder()
    rng = random.Random(1)
    for notice, label, tells in L.NOTICES:
        k = L.allowed_edits(notice)
        kept = {i for m in re.finditer(tells or "(?!)", notice) for i in range(m.start() - 1, m.end() + 1)}
        for _ in range(20):
            chars = list(notice)
            for at in rng.sample([i for i in range(2, len(chars) - 2) if i not in kept], k):
                chars[at] = "*"
            text = "zz qq " + "".join(chars) + " ww"
            found = [s for s in finder.find(text) if s[0] == label]
            assert found and found[0][3] >= 1 - k / len(notice) - 1e-9, text
            assert abs(found[0][1] - 6) <= k
    assert finder.find("nothing of that kind is written here") == []


def test_notices_equal_a_full_fuzzy_search():
    finder = L.NoticeFinder()
    rng = random.Random(8)
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 4)):
            notice = rng.choice(L.NOTICES)[0]
            chars = list(notice)
            for _ in range(rng.randint(0, L.allowed_edits(notice) + 2)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", "q", " "])
            parts += ["".join(chars)[rng.choice([0, 0, 5]) :], " ".join(rng.choices(["the", "license", "under", "public", "gnu", "work"], k=rng.randint(0, 6)))]
        text = " ".join(parts)
        want = set()
        for notice, label, tells in L.NOTICES:
            k = L.allowed_edits(notice)
            names = [m.span() for m in re.finditer(tells, text)]
            if any(a >= m.start() - k and b <= m.end() + k for m in regex.finditer(f"(?e)(?:{regex.escape(notice)}){{e<={k}}}", text, overlapped=True) for a, b in names):
                want.add(label)
        assert {s[0] for s in finder.find(text)} == want, text


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under cc by-nd", "cc-by-nd"),
        ("licensed under cc by-nd 4.0", "cc-by-nd"),
        ("licensed undr cc by-nc", "cc-by-nc"),
        ("licensed under cc by nc", "cc-by-nc"),
        ("licensed under cc by-nc-sa 4.0", "cc-by-nc-sa"),
        ("licensed under cc by-nc-nd", "cc-by-nc-nd"),
        ("licensd under cc by-sa", "cc-by-sa"),
        ("licensed under cc by", "cc-by"),
        ("creative comons attribution 4.0", "cc-by"),
        ("creative commons attribution-sharealike", "cc-by-sa"),
        ("creative commons attribution-noncommercial-noderivatives", "cc-by-nc-nd"),
        ("creative commons attribution - noncommercial", "cc-by-nc"),
        ("licensed under the mpl license", "mpl"),
        ("licensed under the mix license", ""),
        ("licensed under the mitt license", ""),
        ("licenced under the mit license", "mit"),
        ("released under the isc licence", "isc"),
        ("released under the bsd license", "bsd"),
        ("licensed under the gpl license", "gpl"),
        ("licensed under the lgpl license", "lgpl"),
        ("licensed under the agpl license", "agpl"),
        ("gnu lesser general public licence", "lgpl"),
        ("gnu affero general public license version 3", "agpl"),
        ("gnu general public licence version 3", "gpl"),
        ("mozila public license", ""),
        ("mozilla publik license", "mpl"),
        ("permission to use, copy, modify, and or distribute this software", "isc"),
    ],
)
def test_near_notices_keep_their_own_label(text, labels):
    found = {s[0] for s in L.NoticeFinder().find(f"we say that {text} and so on")}
    assert ",".join(sorted(found)) == labels


def test_repeated_near_notices_in_a_very_long_text():
    text = "licensed under the mix license, licensed under the mit license. " * 3_000
    began = time.process_time()
    found = L.NoticeFinder().find(text)
    assert time.process_time() - began < 20
    assert {s[0] for s in found} == {"mit"} and len(found) == 3_000


# chat ------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "\\-", "<|im_start|>\\n<|im_end|>", "<<|im_end|>|im_end|>", "\\\\<s>\\-", "a\nb"])
def test_escape_round_trip(text):
    made = C.escape(text)
    assert C.unescape(made) == text and not any(c in made for c in C.CONTROL)


def digests(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("budget,history", [(1024, 256), (30, 10), (1, 0), (60, 1000)])
def test_chats_round_trip(spark, budget, history):
    rng = random.Random(budget)
    chats = {i: [(rng.choice(["user", "assistant", "system", None, "tool\nx"]), rng.choice([None, "", "hi <s> there", "word " * rng.randint(1, 40), "</s>[INST] ok [/INST]", "\\n"])) for _ in range(rng.randint(1, 25))] for i in range(40)}
    chats[None] = [("user", "q"), ("assistant", "a")]
    rows = [(c, i, r, t, "clash") for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    windows = C.format_chats(df, budget, history)
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(windows).collect()}
    assert got == {c: digests(t) for c, t in chats.items()}
    for w in windows.collect():
        turns = C._TURN.findall(w.text)
        first = chats[w.conv_id][0]
        if first[0] == "system":
            assert C.unescape(turns[0][1]) == (first[1] or "")
        new = sum(b - a for a, b in w.new_turns)
        assert new > 0 and (w.n_tokens <= budget or len(w.new_turns) <= 2)
    assert C.format_chats(df.where("false")).count() == 0


def test_empty_and_very_long_conversations(spark):
    df = spark.createDataFrame([(-7, 5, "user", "mine")], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_chats(df.where("false"))).count() == 0
    long = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    r = C.read_back(C.format_chats(long)).first()
    assert (r.n_turns, r.loss_chars) == (30_000, sum(len(f"turn {i}") for i in range(1, 30_000, 2))) and r.n_windows > 100


def test_repeated_turns_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(1, None, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = C.read_back(C.format_chats(df)).first()
    assert r.n_turns == 4 and r.loss_chars == 1
