"""Operators on pages against plain Python, and damaged archives."""

import base64
import gzip
import hashlib
import itertools
import random

import pytest

from tracewell.llm import mincut, reputation, warc

PAGES = [
    (3, "http://a.example.net/en/7", "<p>one</p>"), (1, "http://b.example.org/fr/8?x", "<p>one</p>"), (2, None, None), (5, "no scheme", ""), (4, "http://x y.com/\r\nz", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (None, "http://c.com", "<p>one</p>"), (1, "http://b.example.org/fr/8?x", "<p>one</p>"), (-7, "HTTP://UP.Example.COM:80/de/#f", "t" * 5000), (9, "://", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, host string, n long").repartition(2)


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(pages, least):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, least).collect()), key=str)
    want = []
    for i, _, t in PAGES:
        same = [j for j, _, u in PAGES if (u or "") == (t or "") and j is not None]
        again = i is not None and len((t or "").encode()) >= least and i > min(same)
        want.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def record(n, body=b"hello", digest_of=None):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{n:08x}-0000-4000-8000-000000000000>\r\nWARC-Payload-Digest: sha1:{digest((digest_of or body).decode('latin-1'))}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + warc.END


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    wrap = gzip.compress if zipped else bytes
    parts = [wrap(record(n, bytes([65 + n]) * (n + 3))) for n in range(6)]
    whole = b"".join(parts)
    ids = lambda data: [r["record_id"][10:18] for _, _, r, _ in warc.salvage(data) if r]
    assert len(ids(whole)) == 6
    start = sum(map(len, parts[:2]))
    damaged = {
        "cut off at the end": whole[:-6],
        "garbage between": b"".join(parts[:2]) + b"\x00garbage\xff" + b"".join(parts[2:]),
        "a byte differs": whole[: start + len(parts[2]) - 6] + b"\xee" + whole[start + len(parts[2]) - 5 :],
        "a part is gone": whole[: start + 20] + whole[start + len(parts[2]) - 5 :],
    }
    for what, data in damaged.items():
        gaps = [(a, n) for a, n, r, _ in warc.salvage(data) if not r]
        got = ids(data)
        assert len(got) >= 5 and len(gaps) == 1, what
        covered = sorted([(a, n) for a, n in {(a, n) for a, n, r, _ in warc.salvage(data)}])
        at = 0
        for a, n in covered:
            assert not data[at:a].strip(b"\r\n")
            at = a + n
        assert not data[at:].strip(b"\r\n")


def test_salvage_of_wrong_digest_and_random_bytes():
    bad = record(1, b"abc", b"xyz")
    got = list(warc.salvage(bad + record(2)))
    assert [r is None for _, _, r, _ in got] == [True, False] and "digest" in got[0][3]
    rng = random.Random(4)
    for _ in range(50):
        data = bytearray(b"".join(record(n) for n in range(4)))
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert sum(r is not None for _, _, r, _ in warc.salvage(bytes(data))) >= 1
    assert list(warc.salvage(b"")) == []


def salvaged(data):
    """Ids of the records, and the reasons of gaps; what is found covers all bytes."""
    got, at = list(warc.salvage(data)), 0
    for a, n in sorted({(a, n) for a, n, _, _ in got}):
        assert not data[at:a].strip(b"\r\n")
        at = a + n
    assert not data[at:].strip(b"\r\n")
    return [int(r["record_id"][10:18], 16) for _, _, r, _ in got if r], [why for _, _, r, why in got if not r]


def test_salvage_after_a_writer_died_in_a_payload():
    ids, gaps = salvaged(record(0) + record(1, b"half of a payload" * 9)[:-70] + record(2) + record(3))
    assert ids == [0, 2, 3] and len(gaps) == 1
    ids, gaps = salvaged(gzip.compress(record(0) + record(1, b"half of a payload" * 9)[:-70] + record(2)) + gzip.compress(record(3)))
    assert ids == [0, 2, 3] and len(gaps) == 1


def test_torn_header_is_not_fused_with_the_next_record():
    for cut in (5, 15, 30, 60, 90):
        torn = record(1)[:cut]
        data = record(0) + torn + record(2) + record(3)
        found = list(warc.salvage(data))
        assert [r["record_id"][17:18] for _, _, r, _ in found if r] == ["0", "2", "3"]
        assert [(a, n) for a, n, r, _ in found if not r] == [(len(record(0)), len(torn))]


def test_lines_that_end_in_a_line_feed_only():
    bare = lambda n: record(n, b"no breaks here").replace(b"\r\n", b"\n")
    found = list(warc.salvage(b"".join(bare(n) for n in range(200))))
    assert len(found) == 200 and all(r for _, _, r, _ in found)
    mixed = list(warc.salvage(bare(1) + record(2) + bare(3)[:-20] + bare(4)))
    assert [r["record_id"][17:18] if r else None for _, _, r, _ in mixed] == ["1", "2", None, "4"]


def test_repeated_fields_are_refused():
    twice = record(1).replace(b"Content-Length: 5", b"Content-Length: 5\r\nContent-Length: 7")
    other = record(3).replace(b"WARC-Type", b"WARC-Concurrent-To: a\r\nWARC-Concurrent-To: b\r\nWARC-Type")
    found = list(warc.salvage(twice + record(2) + other))
    assert [bool(r) for _, _, r, _ in found] == [False, True, True] and "repeats" in found[0][3]


def test_headers_without_an_end_take_time_in_proportion():
    import time

    torn = b"WARC/1.0\r\nWARC-Type: resource\r\n" + b"X-Filler: " + b"f" * 500 + b"\r\n"
    seconds = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        found = list(warc.salvage(torn * n + record(1)))
        seconds.append(time.perf_counter() - began)
        assert [bool(r) for _, _, r, _ in found] == [False, True]
    assert seconds[1] < 12 * seconds[0] + 0.5


@pytest.mark.parametrize("level", [0, 9])
def test_salvage_inside_a_member(level):
    rng = random.Random(2)
    parts = [record(n, bytes(rng.randrange(32, 127) for _ in range(3000))) for n in range(40)]
    zipped = lambda x: gzip.compress(x, level)
    bad = b"".join(parts[:7]) + record(7, b"abc", b"xyz") + b"".join(parts[8:])
    ids, gaps = salvaged(zipped(bad) + zipped(record(50)))
    assert ids == [*range(7), *range(8, 40), 50] and len(gaps) == 1 and "digest" in gaps[0]
    whole = zipped(b"".join(parts))
    for what, data in {"cut": whole[: len(whole) * 6 // 10], "crc": whole[:-8] + bytes(8), "no trailer": whole[:-8]}.items():
        for after in (b"", zipped(record(50)) + record(51), gzip.compress(record(50)) + record(51)):
            ids, gaps = salvaged(data + after)
            assert ids == [*range(23 if what == "cut" else 40), *([50, 51] if after else [])], (what, ids)
            assert len(gaps) == 1 or level == 0 and what == "cut" and gaps
    ids, gaps = salvaged(zipped(bad)[:-8])
    assert ids == [*range(7), *range(8, 40)] and len(gaps) == 2


def test_archive_with_damage(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    part = max(tmp_path.glob("w/part*"), key=lambda p: p.stat().st_size)
    data = part.read_bytes()
    for crc in tmp_path.glob("w/.part*"):
        crc.unlink()
    part.write_bytes(data[: len(data) // 2] + b"?" + data[len(data) // 2 + 1 :])
    got = warc.read(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert sum(r.gap is None for r in got) >= len(PAGES) - 1


def test_url_filters(spark, pages):
    known = spark.createDataFrame([(3, 1), (1, 0), (1, 1), (None, 1), (5, None)], "page_id long, good int")
    got = {(r.page_id, r.host, r.path, r.rule) for r in reputation.filter_urls(pages, known).collect()}
    assert got == {
        (3, "a.example.net", "/en/7", "example.net/en/"), (1, "b.example.org", "/fr/8", "org/fr/"), (2, "", "", None), (5, "", "", None), (4, "x y.com", "/\r\nz", None),
        (None, "c.com", "", None), (-7, "up.example.com:80", "/de/", None), (9, "", "", None),
    }
    assert reputation.filter_urls(pages, known.limit(0)).count() == len(PAGES)
    assert reputation.filter_urls(pages.limit(0), known).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("good.one.com", 200, 198), ("bad.two.com", 200, 10), ("new.two.com", 0, 0), ("few.one.com", 2, 0), ("x.co.uk", 5, 5)], "host string, n long, y long")
    got = {r.host: r for r in reputation.reputations(hosts).collect()}
    assert got["good.one.com"].lower > 0.8 and got["bad.two.com"].lower < 0.2
    assert got["bad.two.com"].mean < got["new.two.com"].mean < got["good.one.com"].mean
    assert 0 < got["few.one.com"].mean < got["good.one.com"].mean
    assert all(0 < r.mean < 1 for r in got.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> | <a href="/x">X</a></header><nav><ul><li><a href="/a">Aa</a><li><a href="/b">Bb</a></ul></nav>
<div class="ad-banner">Buy this now, it is cheap and very good for all of you.</div><div id="cookie-notice">We use cookies to make this site better for you.</div>
<article><header><h1>The headline of it</h1></header><p>First   part &amp; <b>bold</b> text, with<br>a break. It goes on for a while.<p>Second&nbsp;part has <a href="/q">one link</a> inside of it.</p>
<aside>See also this other page.</aside><form><label>Name</label><input><button>Send</button></form><ul><li>A point in the list of the text.</li></ul></article>
<section class="comments"><p>I am a reader and I like this article a lot, thank you.</p></section><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_extraction(spark):
    want = "The headline of it\nFirst part & bold text, with a break. It goes on for a while.\nSecond part has one link inside of it.\nA point in the list of the text."
    assert mincut.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "Just words that stand here alone, in a row. " * 5), (5, "u", "<nav>Menu</nav>"), (6, "u", "<p>a < b & c <unclosed 'x"), (7, "u", "<script>never closed")]
    got = {r.page_id: (r.text, r.n_chars) for r in mincut.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[5] == got[7] == ("", 0)
    assert got[None][0].startswith("Just words") and len(got) == 7
    assert mincut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<article><p>The article of the page, with words enough to count as its text.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>How <body> works</title><style>p{}</style>", "<head><noscript><link><body>", "<head><title>x</title></head><body>",
        "<div><noscript><img src=x></div>", "<div><select><option>a<option>b</div>", "<div><svg><path d='M0'></div>", "<div><object><param></div>", "<div><iframe src=x></div><div><iframe></iframe></div>",
        "<p><a href=x><svg><path></a></p>", "<svg><g><a>no</a><title>no</title></g></svg>", "<object><object>no</object>no</object>", "<p>.<noscript><div>no</div>no</noscript></p>",
        "<script>if (a) x = '<!--';</script>", "<script>if (a <b) t = 'it' + \"'\";</script>", "<style>a:after{content:'<!--'}</style>",
    ],
)
def test_raw_elements_end_where_they_do(before):
    texts = [b.text for b in mincut.blocks_of(before + ARTICLE + "<p>It's the end.</p>")]
    assert [t for t in texts if t != "."] == ["The article of the page, with words enough to count as its text.", "It's the end."]


def test_text_ends_a_head():
    assert [b.text for b in mincut.blocks_of("<head><title>x</title>\n<base> Just words")] == ["Just words"]
    assert [b.text for b in mincut.blocks_of("<head><title>x</title> Just <b>words</b><p>and more")] == ["Just words", "and more"]


def test_min_cut_is_least():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 8)
        unary = [rng.randint(-9, 9) for _ in range(n)]
        edges = {(i, j): rng.randint(0, 7) for i in range(n) for j in range(n) if i != j and rng.random() < 0.4}
        cost = lambda side: sum(-u for u, s in zip(unary, side, strict=True) if u < 0 and s) + sum(u for u, s in zip(unary, side, strict=True) if u > 0 and not s) + sum(c for (i, j), c in edges.items() if side[i] and not side[j])  # noqa: B023, E731
        assert cost(mincut.min_cut(unary, edges)) == min(cost(s) for s in itertools.product((False, True), repeat=n))


TEXT = "The quick brown fox jumps over the lazy dog, and then it sleeps for a long time in the sun."
MENU = "<ul>" + "<li><a href=x>some link</a></li>" * 6 + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form id=all><div class=nav>{MENU}</div><article><h1>Title here</h1><p>{TEXT}<p>Ha.</article></form>", ["Title here", TEXT, "Ha."]),
        (f"<article><p>{TEXT}</p><form><label>Name</label><p>Please fill in the form below with care, all of it.</p></form></article>", [TEXT]),
        (f"<article><p>{TEXT}</p><section id=comments>" + f"<article><p>{TEXT} I agree.</p></article>" * 9 + "</section></article>", [TEXT]),
        (f"<article><table><tr><td>1</td><td>ab</td></tr></table><p><a href=x>only link</a></p><p>{TEXT}</p></article>", ["1", "ab", "only link", TEXT]),
        (f"<article><p>{TEXT}</p>{MENU}<p>{TEXT}</p></article>", [TEXT, TEXT]),
        (f"<div>{MENU}</div><div><h1>Head</h1><p>{TEXT}</p><p>Ha.</p><p>{TEXT}</p></div><div>Copyright me</div>", ["Head", TEXT, "Ha.", TEXT]),
        (f'<body class="has-sidebar"><main><p>{TEXT}</p></main><div id=sidebar><p>{TEXT}</p></div></body>', [TEXT]),
        (f"<header><h1>Site of things.</h1></header><article><header><h1>Real title</h1></header><p class=byline>By me</p><p>{TEXT}</p><footer>By me.</footer></article>", ["Real title", "By me", TEXT]),
        ("<article>" + "<p>© 2020 x. All rights reserved.</p>" * 4 + "</article>", ["© 2020 x. All rights reserved."] * 4),
    ],
)
def test_the_cut_decides(page, want):
    assert mincut.main_text(page) == "\n".join(want)


def test_the_cut_mends_the_classifier():
    """On the sample pages, the cut against the sign of the fitted scores; the tags nav, article and footer and the class ad tell what is right."""
    import numpy as np
    import pyarrow.parquet as pq

    pages = [mincut.blocks_of(x.as_py() or "") for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html")]
    known = [(mincut.features(b), b.node.landmark.kind > 0) for p in pages[::2] for b in p if b.node.landmark]
    weights = mincut.fit_weights(np.array([x for x, _ in known]), np.array([y for _, y in known], float))
    changed = by_sign = by_cut = total = 0
    for page in pages[1::2]:
        for b, label in zip(page, mincut.labels_of(page, weights=weights), strict=True):
            right, sign = bool(b.node.landmark and b.node.landmark.kind > 0), mincut.content_score(b, weights) > 0
            changed, by_sign, by_cut, total = changed + (sign != label), by_sign + (sign == right), by_cut + (label == right), total + 1
    assert changed > 0.01 * total and by_sign < by_cut == total


def test_fit_without_landmarks_keeps_the_prior(spark):
    pages = spark.createDataFrame([(1, f"<p>{TEXT}</p>"), (2, None), (None, "<article>x</article>"), (1, "<p>again</p>")], "page_id long, html string")
    assert mincut.fit(pages) == mincut.fit(pages.limit(0)) == mincut.PRIOR
    more = spark.createDataFrame([(i, f"<article><p>{TEXT}</p></article><nav>{MENU}</nav>") for i in range(40)], "page_id long, html string")
    assert mincut.fit(more) == mincut.fit(more.repartition(7)) != mincut.PRIOR


def test_long_page_takes_its_time_in_proportion():
    import time

    began = time.time()
    text = mincut.main_text("<div>" + "".join(f"<p>Short {i}</p>" for i in range(20_000)) + "</div>")
    assert text is not None
    for page in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<x>" * 50_000 + "</y>" * 50_000, "<svg>" + "<x>" * 50_000 + "</y>" * 50_000, "<div><p><section>" + "<x>" * 20_000 + "<h1>" * 20_000, f"<article>{f'<p>{TEXT}' * 20_000}"):
        mincut.main_text(page)
    assert time.time() - began < 30
