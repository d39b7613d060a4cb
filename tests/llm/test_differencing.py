"""Pages against a plain version: all pages of a host compared by their URLs; long and broken pages."""

import random
import re
import time

import pytest

from nearkin.llm import differencing, markup


def brute(rows):
    """The nearest URL of each page by looking at all URLs of its host."""
    heads = {}
    for page_id, url, html in rows:
        m = re.match(r"([a-z]+)://([^/?#]*)([^#]*)", url or "")
        place = (m[2].lower(), m[3]) if m else ("", "")
        heads.setdefault(place, []).append((page_id is not None, page_id or 0, html))
    out = []
    for page_id, url, html in rows:
        m = re.match(r"([a-z]+)://([^/?#]*)([^#]*)", url or "")
        place = (m[2].lower(), m[3]) if m else ("", "")
        urls = sorted((p for p in heads if p[0] == place[0]), key=lambda p: p[1].encode())
        near = None
        if m:
            k = urls.index(place)
            best = -1
            for j in (k - 1, k + 1):
                if 0 <= j < len(urls):
                    common = 0
                    while common < min(len(urls[j][1]), len(place[1])) and urls[j][1][common] == place[1][common]:
                        common += 1
                    if common > best:
                        best, near = common, sorted(heads[urls[j]], key=lambda x: x[:2])[0][2]
        text, n = differencing.main_text(markup.lines(html), None if near is None else markup.lines(near))
        out.append((page_id, url, text, len(text), n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 7, 50])
def test_pages(spark, monkeypatch, n):
    monkeypatch.setattr(differencing, "partitions", lambda _: n)
    r = random.Random(7)
    menu = [f"<div>Menu {k}</div>" for k in range(6)]
    rows = []
    for i in range(90):
        host = r.choice(["hot.example", "hot.example", "a.example", "b.example"])
        path = r.choice(["/view?id=" + str(r.randint(0, 30)), "/x/" + r.choice("abc") * r.randint(1, 3), "", "/é"])
        own = [f"<p>Own {r.randint(0, 9)}</p>" for _ in range(r.randint(0, 4))]
        html = "".join(r.choice([menu, menu[:3], menu[::-1]]) + own + r.choice([[], ["<article>Main</article>"]]) + [r.choice(menu)])
        rows.append((i, f"http://{host}{path}" + r.choice(["", "#f"]), r.choice([html, html, None, ""])))
    rows += [(200 + k, "http://hot.example/view?id=7", menu[0] + "<p>one of many</p>") for k in range(40)]
    rows += [rows[0], rows[0], rows[3], (None, "http://a.example/none", menu[1]), (300, None, menu[2]), (301, "no url", menu[2])]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "page_id long, url string, html string, host string, task int")
    got = sorted((tuple(x) for x in differencing.extract(df).collect()), key=repr)
    assert got == brute(rows) and sum(x[4] for x in got) > 50
    assert differencing.extract(df.limit(0)).collect() == []


def test_halves(monkeypatch):
    monkeypatch.setattr(differencing, "KEPT_BITS", 8)
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        rest = iter(b)
        found = [a[i] for i in sorted(differencing.shared(a, b))]
        assert len(found) == best[-1][-1] and all(x in rest for x in found)


def test_long_and_broken_pages():
    start = time.thread_time()
    assert markup.lines("<a " * 350_000) == [(("<a " * 350_000).strip(), markup.PLAIN)]
    assert len(markup.lines('<a ">" ' * 100_000 + "x")) == 1
    assert markup.lines("<b>" * 100_000 + "</i>" * 100_000 + "x") == [("x", markup.PLAIN)]
    assert len(markup.lines("<p>same line</p>" * 100_000)) == 100_000
    a = ["a", "b"] * 10_000
    assert len(differencing.shared(a, ["x", *a[1:], "y"])) == len(a) - 1
    assert differencing.shared(["same"] * 100_000, ["same"] * 99_999 + ["other"]) == set(range(99_999))
    assert time.thread_time() - start < 60
    assert markup.lines("a<p>b<!-- <p>x --> c <1 d<br>e</p x='>'>f<script>if (a<b) '</p>'</script >g") == [("a", 1), ("b c <1 d", 1), ("e", 1), ("fg", 1)]
