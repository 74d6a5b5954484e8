"""HTML extraction, URL filter and vector search."""

import numpy as np
import pytest

from quantloom.llm import ann, html_extract, url_filter

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav><div class="cookie-notice">We use cookies. Please accept them all.</div>
<article><h1>A  title</h1><p>First <b>para</b>graph with a &lt;tag&gt; and&nbsp;an <a href="#">inner link</a>.</p><p>Short.<br>Second line<script>var x = "</p>";</script></p>
<div class="ad">Buy this now and save money today.</div><p>The end of it</article>
<section id="comments"><p>I disagree with all of this, as a reader.</p></section><aside>Related things to read next.</aside><form>Your name <input></form><footer>&copy; nobody</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "A title First paragraph with a <tag> and an inner link. Short. Second line The end of it"


@pytest.mark.parametrize("page", [None, "", "   ", "<html><head><title>x</title></head></html>", "<nav><a href=x>only a menu</a></nav>"])
def test_pages_without_main_text(page):
    assert html_extract.main_text(page) == ""


def test_cut_and_odd_pages_do_not_fail():
    for k in range(0, len(PAGE), 7):
        html_extract.main_text(PAGE[:k])
    assert html_extract.main_text("<p>" * 2000 + "deep text that goes on for a while, as a sentence does.")
    assert html_extract.main_text("<article><p>" + "word " * 50_000 + "</p></article>").count("word") == 50_000


def test_tree_fits_its_table():
    x, y = html_extract._labelled()
    assert ((html_extract.classify(x) >= 0.5) == y).mean() > 0.95


def test_extract_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, 8), (2, None, None, 8)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == [(1, len(html_extract.main_text(PAGE))), (2, 0), (2, 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("url, want", [
    ("https://A.Example.COM/en/7/x?q=1#f", ("a.example.com", "/en/7/x", "example.com/en/7", "allow")),
    ("https://b.com/en/7", ("b.com", "/en/7", "com/en/", "block")),
    ("http://x.example.net/de/8", ("x.example.net", "/de/8", "example.net/de/8", "block")),
    ("http://x.net/de/9", ("x.net", "/de/9", "net/de/", "allow")),
    ("http://notexample.net/de/8", ("notexample.net", "/de/8", "net/de/", "allow")),
    ("ftp://org?/es/", ("org", "", None, None)),
    ("no scheme.com/en/", ("", "", None, None)),
    (None, ("", "", None, None)),
    ("", ("", "", None, None)),
    ("http://Ä.ORG/es/", ("Ä.org", "/es/", "org/es/", "block")),
])
def test_url_rules(url, want):
    host, path = url_filter.parts(url)
    found = url_filter.rule_for(host, path)
    assert (host, path) == want[:2] and (found[1] if found else None) == want[2] and (found[0] if found else None) == want[3]


def test_url_models(spark):
    ratio = url_filter.Ratio([f"host{k}.example.org" for k in range(50)])
    assert 0.6 < ratio.held_out_accuracy < 1  # of words that the models haven't seen
    good, bad = "https://harbor-notes.example.com/fr/12", "https://casino-slots.example.com/fr/12"
    assert ratio.score(good) < ratio.threshold < ratio.score(bad)
    df = spark.createDataFrame([(1, good), (2, bad), (3, None), (3, ""), (4, "x" * 100_000)], "page_id long, url string")
    got = {(r.page_id, r.host): (r.verdict, r.rule) for r in url_filter.judge(df).collect()}
    assert got[1, "harbor-notes.example.com"] == ("allow", None) and got[2, "casino-slots.example.com"] == ("block", None) and len(got) == 4
    assert url_filter.judge(df.limit(0)).count() == 0


def test_no_host_vouches_for_itself(spark):
    hosts = ["www.spam-farm.example.com", "m.casino-win.example.com", "free-bets.example.com", "blog.adult-x.example.net"]
    clean = [f"{w}.example.{t}" for w, t in zip(url_filter.ACCEPTED[::3], ["com", "net", "org"] * 20)]
    rows = [f"https://{h}/en/{k}.html" for k in range(30) for h in hosts] + [f"https://{h}/de/7" for h in clean]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.host: r.score for r in url_filter.judge(df).collect()}
    assert all(got[h] > 0 for h in hosts) and sum(got[h] > 0 for h in clean) <= len(clean) // 10
    ratio = url_filter.Ratio([*hosts, *clean])
    assert all(abs(got[url_filter.parts(u)[0]] - (ratio.score(u) - ratio.threshold)) < 1e-9 for u in rows[-len(clean) :])


def test_likelihood_is_the_smoothed_product():
    m = url_filter.Markov(2)
    texts = ["abab", "abba", "bb"]
    for t in texts:
        m.learn(t)
    seen = {}
    for t in texts:
        p = "^^" + t + "$"
        for i in range(2, len(p)):
            for k in range(3):
                seen.setdefault(p[i - k : i], []).append(p[i])

    def prob(context, c):
        lower = prob(context[1:], c) if context else 1 / 256
        n = seen.get(context)
        return lower if n is None else (n.count(c) + len(set(n)) * lower) / (len(n) + len(set(n)))

    p = "^^" + "abca" + "$"
    assert abs(m.log_likelihood("abca") - sum(np.log(prob(p[i - 2 : i], p[i])) for i in range(2, len(p)))) < 1e-12


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        i = ids.index(q)
        s = [(-(x[i] * x[j]).sum(), ids[j]) for j in range(len(ids)) if j != i]
        out[q] = [v for _, v in sorted(s)[:k]]
    return out


def test_search_recall_ties_and_edges(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[100]  # a third of the rows are copies
    rows = [(i, [float(v) for v in np.float32(x[i])]) for i in range(1500)]
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 3), (5005, [None] * 16), (None, rows[0][1]), (5006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    x32 = np.float32(x).astype(float)
    want = brute(list(range(1500)), x32, range(0, 1500, 50), 20)
    assert set(got) == set(want) and all([r.rank for r in v] == list(range(1, 21)) for v in got.values())
    hits = [len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    assert all(abs(r.score - (x32[q] * x32[r.vec_id]).sum()) < 1e-9 for q, v in got.items() for r in v)
    copies = [r for r in got[150] if 100 <= r.vec_id < 400]
    assert [r.vec_id for r in copies] == [i for i in range(100, 400) if i != 150][: len(copies)]


def test_url_models_learn_from_all_hosts(spark):
    hosts = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghi'[k // 1000]}.example.org" for k in range(2500)]
    df = spark.createDataFrame([(k, f"https://{h}/{k % 7}/about") for k, h in enumerate(hosts)], "page_id long, url string")
    ratio = url_filter.Ratio(hosts)
    for r in url_filter.judge(df).where("page_id % 100 = 0").collect():
        assert abs(r.score - (ratio.score(f"https://{hosts[r.page_id]}/{r.page_id % 7}/about") - ratio.threshold)) < 1e-9


@pytest.mark.parametrize("n", [2000, 2500])
def test_distance_ratio_alone_chooses_lists(n):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(n, 64))
    c = np.column_stack([0.6 * c / np.linalg.norm(c, axis=1)[:, None], np.zeros(n)])  # means lie inside the sphere
    q = rng.normal(size=(64, 64))
    q = np.column_stack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros(64)])
    q[:8] = c[:8]  # few lists fit these
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    want = [set(np.flatnonzero(x <= x.min() * (1 + ann.PRUNE) ** 2)) for x in d]
    got = ann._probes_of(ann.CentroidGraph(c), q, np.full(n, 2000), 160)
    assert max(map(len, want)) > 512
    assert [len(set(g) ^ w) / len(w) < 0.02 for g, w in zip(got, want, strict=True)] == [True] * 64
    assert all(len(set(g)) == len(g) for g in got)


def test_graph_walk_finds_the_nearest_and_ends():
    rng = np.random.default_rng(2)
    for n in (300, 3000):
        c = rng.normal(size=(n, 32))
        graph = ann.CentroidGraph(c)
        q = rng.normal(size=(200, 32))
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        at, dist = graph.search(q, ann.HOME_BEAM)
        assert (at[:, 0] == d.argmin(1)).mean() >= 0.9 and all(len(set(a)) == len(a) for a in at.tolist())
        near = [len(set(a) & set(b)) / 20 for a, b in zip(at[:, :20].tolist(), d.argsort(1)[:, :20].tolist())]
        assert np.mean(near) >= 0.8 and np.allclose(dist, np.take_along_axis(d, at, 1), rtol=1e-3, atol=1e-3)


def test_search_walks_the_graph_of_many_lists(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 24)).repeat(80, 0) + 0.4 * rng.normal(size=(4800, 24))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(4800)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(4800)), x, range(0, 4800, 100), 20)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.95


def test_search_edges(spark):
    from pyspark.sql import functions as F

    rows = [(k, [1.0, 2.0], 1, 2.0) for k in range(60)] + [(60, [1.0, 0.0, 0.0], 1, 2.0), (61, [0.5, 1.0, 0.0], 1, 2.0), (40, [1.0, 2.0], 1, 2.0), (None, [1.0, 2.0], 1, 2.0), (20, None, 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got[0] == [(k, k, 5.0) for k in range(1, 21)]  # all alike: ties to smaller ids
    assert got[60] == [(1, 61, 0.5)] and set(got) == {0, 20, 40, 60}


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


ARTICLE = "<article><h1>Title here now</h1><p>" + "word " * 30 + "end.</p><p>Short.</p><p>" + "more " * 40 + "end.</p></article>"
PLAIN = ARTICLE.replace("article", "div")
LISTED = "".join(f"<div><a href=x>linked headline number {i} of the day</a></div>" for i in range(6))


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><meta charset=u><body>" + ARTICLE,
    ARTICLE.replace("<article>", '<article title="the hidden valley">'),
    ARTICLE.replace("<p>", '<p data-id="footer-7">'),
    '<body class="has-sidebar">' + ARTICLE,
    '<div class="legal-news">' + PLAIN + "</div>",
    '<div class="social-history">' + PLAIN + "</div>",
    ARTICLE.replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>"),
    ARTICLE.replace("Short.", "Short.<svg width=1 />"),
    ARTICLE.replace("Short.", "Short.<button>"),
    '<form id="aspnetForm">' + ARTICLE + "</form>",
    "<div><a>Home</a></div><div><a>News</a></div>" + PLAIN,
    PLAIN + "<div>" + LISTED + "</div>",
    LISTED + PLAIN,
    '<div class="content">' + LISTED + "</div>" + ARTICLE,
    ARTICLE + '<div id="comments"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I think so too, said the reader.</p></article></li></ol></div>',
    ARTICLE + '<div class="left-sidebar"><p>some text of the side that is long enough to count here.</p></div>',
    ARTICLE + "<p cla",
])
def test_names_and_densities(page):
    assert html_extract.main_text(page) == "Title here now " + "word " * 30 + "end. Short. " + "more " * 40 + "end."


def test_tree_uses_densities():
    def splits(t):
        return [t[0], *splits(t[2]), *splits(t[3])] if isinstance(t, tuple) else []

    used = {html_extract.FEATURES[f] for f in splits(html_extract.trained_tree())}
    assert "link_density" in used and used & {"words", "words_before", "words_after", "largest_near"}


def test_text_after_a_stray_angle_stays():
    assert html_extract.main_text("<article><p>if a < b then c, she said.</p><p>And more of it.</p></article>") == "if a < b then c, she said. And more of it."


def test_url_models_hold_all_pairs_at_any_size(spark):
    hosts = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}é.example.org" for k in range(600)]
    hosts += ["www.spam-farm.example.com", "casino-win.example.com"]
    urls = [f"https://{h}/{k % 7}/about?{'xY' * (k % 3)}" for k, h in enumerate(hosts)] + [None, "", "none", "http://a.example.com/en/1"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *urls[:40]])], "page_id long, url string")
    rows = lambda most: {r.page_id: r for r in url_filter.judge(df, most=most).collect()}
    held, joined = rows(1 << 17), rows(100)
    assert len(held) == len(joined) == len(urls) + 40
    ratio = url_filter.Ratio(hosts + ["a.example.com"])
    for k, r in held.items():
        assert joined[k][:5] == r[:5] and abs(joined[k].score - r.score) < 1e-9
        assert abs(r.score - (ratio.score((urls + urls)[k]) - ratio.threshold)) < 1e-9
