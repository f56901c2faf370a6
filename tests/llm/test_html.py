import collections
import random
import re

from pyspark.sql import functions as F

from tilewright.llm import html_extraction as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use &amp; more</div><main><article class="post"><header class="entry-header"><h1>Ti&eacute;tle</h1><span>Jan 1</span></header><p>One  two<br>three <b>four</b>&nbsp;five<p>Six<aside>related</aside>
<div class="ad">buy</div><ul><li>a<li>b</ul><table><tr><td>x</td><td>y</td></tr></table><form><label>q</label></form><section id="comments"><article class="comment">I like</article></section><p>End &lt;ok&gt; &#8364;</article></main>
<div class="sidebar">x</div><footer>&copy; c</footer></body></html>"""


def article_of(page):
    blocks, kinds = h.page_parts(page)
    return "\n".join(b for b, k in zip(blocks, kinds, strict=True) if k == h.ARTICLE)


def test_article():
    assert article_of(PAGE) == "Tiétle\nOne two three four five\nSix\na\nb\nx y\nEnd <ok> €"
    assert article_of("<article>a</article><p>b<article>c</article><main>d</main>") == "a\nc" and article_of("<p>b<main>d</main>") == "d"


def test_broken_pages():
    assert h.page_parts(None) == ([], [])
    assert h.page_parts("<p>a <b>b<p>c <a href='x")[0] == ["a b", "c"]
    assert h.page_parts("x < y &amp z &unknown; <script>never closed")[0] == ["x < y & z &unknown;"]
    assert article_of("<article><p>cut off &am") == "cut off &am"
    assert article_of("<article>" + "<div>" * 3000 + "deep") == "deep"


def plain_texts(pages):
    """The texts of a host's pages by plain counting of token windows."""
    parts = [h.page_parts(p) for p in pages]
    split = []
    for blocks, kinds in parts:
        outside = [w for b, k in zip(blocks, kinds, strict=True) if k != h.ARTICLE for w in b.split(" ")]
        inside = [b.split(" ") for b, k in zip(blocks, kinds, strict=True) if k == h.ARTICLE]
        split.append((outside, inside))
    streams = h.Streams(parts)
    signature = streams.signatures(len(parts)).tolist()
    grams = lambda s, n: [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
    out_of, in_of = collections.defaultdict(set), collections.defaultdict(set)
    for (blocks, kinds), (outside, inside), sign in zip(parts, split, signature, strict=True):
        for g in grams(outside, h.MIN_RUN):
            out_of[g].add((tuple(blocks), tuple(kinds)))
        for s in inside:
            for g in grams(s, h.ARTICLE_RUN):
                in_of[g].add(sign)

    def mask(s, n, where):
        out = [False] * len(s)
        for i, g in enumerate(grams(s, n)):
            if len(where[g]) >= h.MIN_PAGES:
                out[i : i + n] = [True] * n
        return out

    texts = []
    for (blocks, kinds), (outside, inside) in zip(parts, split, strict=True):
        masks = [mask(s, h.ARTICLE_RUN, in_of) for s in inside]
        if 2 * sum(map(sum, masks)) > sum(map(len, masks)):
            masks = [[False] * len(m) for m in masks]
        rest, kept = mask(outside, h.MIN_RUN, out_of), []
        for b, k in zip(blocks, kinds, strict=True):
            words = b.split(" ")
            if k == h.ARTICLE:
                own = masks.pop(0)
            else:
                own, rest = rest[: len(words)], rest[len(words) :]
                if h.ARTICLE in kinds or k == h.CHROME_BLOCK:
                    continue
            if not all(own):
                runs = "".join("x" if c else "." for c in own)
                long = [c for part in re.findall("x+|[.]+", runs) for c in [part[0] == "x" and len(part) >= h.MIN_RUN] * len(part)]
                kept.append(" ".join(w for w, c in zip(words, long, strict=True) if not c))
        texts.append("\n".join(kept))
    return texts


def made_host(n, seed=0):
    """Pages with menus, notices of 8 to 70 words inside and outside articles, quotes, copies and near copies of articles."""
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(k))
    menu, notices, copied = words(12), [words(k) for k in (5, 9, 49, 50, 51, 70)], words(90)
    pages = []
    for k in range(n):
        body = "".join(f"<p>{words(rng.randint(1, 120))}" for _ in range(rng.randint(1, 4)))
        some = "".join(f"<p>{rng.choice(['', words(2)])} {x} {rng.choice(['', words(3)])}" for x in notices if rng.random() < 0.2)
        if rng.random() < 0.2:
            body = f"<p>{copied} {words(rng.randint(0, 3))}"
        tag = rng.choice(["article", "article", "div"])
        pages.append(f"<div>{menu if rng.random() < 0.7 else words(4)}</div><{tag}>{body}{some}</{tag}><footer>{words(3)}</footer>" if rng.random() < 0.95 or not pages else rng.choice(pages))
    return pages


def test_arrays_match_plain_counting():
    for seed in range(3):
        pages = made_host(60, seed)
        got = h.shard_texts([h.page_parts(p) for p in pages])
        assert got == plain_texts(pages)
        bare = ["\n".join(b for b, k in zip(*parts, strict=True) if k == (h.ARTICLE if h.ARTICLE in parts[1] else h.OUTSIDE)) for parts in map(h.page_parts, pages)]
        assert sum(a != b for a, b in zip(got, bare, strict=True)) > 10  # what the array removed


def test_sharded_host_equals_one_array(spark, monkeypatch):
    """Hosts of many shards, with anchors sent to the tasks and without, get the texts of one array over the host."""
    pages = made_host(300, 7)
    df = spark.createDataFrame([(k, "http://h.example/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    want = dict(enumerate(plain_texts(pages)))
    for name, value in (("SHARD_PAGES", 40), ("BROADCAST_ANCHORS", -1), ("BROADCAST_HOSTS", -1)):
        monkeypatch.setattr(h, name, value)
        assert {r.page_id: r.text for r in h.extract_text(df).collect()} == want


def test_copies_of_a_row_crowd_no_task(spark, monkeypatch):
    """Equal rows, also such with null keys, are dealt over parts of a shard, and get the texts of one array."""
    monkeypatch.setattr(h, "SHARD_PAGES", 10)
    pages = made_host(60, 3)
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [(k, "http://h.example/x", p) for k, p in enumerate(pages)] + [(None, None, f"<p>{menu}<p>x")] * 90 + [(7, "http://h.example/x", pages[7])] * 100 + [(200 + k, None, f"<p>{menu}<p>y{k}") for k in range(4)]
    out = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    want = dict(enumerate(plain_texts(pages))) | {None: "x"} | {200 + k: f"y{k}" for k in range(4)}
    assert len(out) == len(rows) and all(r.text == want[r.page_id] for r in out)


def test_whole_table(spark):
    """The query's rows, host by host, by plain counting."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[re.sub(r"^https?://([^/?#:]*).*", r"\1", r.url, flags=re.S).lower()].append(r)
    want = {r.page_id: t for own in by.values() for r, t in zip(own, plain_texts([r.html for r in own]), strict=True)}
    assert {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows)).collect()} == want


def test_four_thousand_pages(spark):
    """A notice on five of 4,000 pages of a host, one of 60 words in five articles, and the copies of one article."""
    notice, long = " ".join(f"notice{k}" for k in range(12)), " ".join(f"long{k}" for k in range(60))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(70))
    pages = [f"<p>{notice if k % 800 == 0 else ''}<p>{own(k)}" if k % 2 == 0 else f"<article><p>{own(k)}<p>{long if k % 800 == 1 else ''}</article>" for k in range(3990)] + [f"<article>{own('same')}</article><p>{k}" for k in range(10)]
    out = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert all(out[k] == own(k) for k in range(3990)) and all(out[3990 + k] == own("same") for k in range(10)) and len(out) == 4000


def test_hosts_without_articles(spark):
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [(k, f"http://h.example/{k}", f"<div>{menu}</div><div>unique {k} text</div>") for k in range(20)] + [(99, "http://other.example/", f"<div>{menu}</div>")]
    out = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"unique {k} text" for k in range(20)) and out[99] == menu


def test_hot_host_is_sharded(spark):
    menu = " ".join(f"menu{k}" for k in range(12))
    n = 2 * h.SHARD_PAGES + 50
    rows = [(k, "http://h.example/", f"<p>{menu}<p>own {k}") for k in range(n)]
    out = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.where(F.col("text") == F.concat(F.lit("own "), F.col("page_id"))).count() == n


def test_rare_runs_of_a_hot_host(spark):
    """A notice on six of 900 pages, menus that articles' pages share, and a run on three pages."""
    notice, menu, three = (" ".join(f"{w}{k}" for k in range(12)) for w in ("notice", "menu", "three"))
    rows = [(k, "http://h.example/", f"<p>{notice if k < 6 else three if k < 9 else ''}<p>own {k}") for k in range(900)]
    rows += [(1000 + k, "http://a.example/", f"<nav>{menu}</nav><article>text {k}</article>") for k in range(10)] + [(2000, "http://a.example/", f"<div>{menu}</div><p>bare")]
    out = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows) and all(out[k] == (f"{three}\n" if 6 <= k < 9 else "") + f"own {k}" for k in range(900))
    assert all(out[1000 + k] == f"text {k}" for k in range(10)) and out[2000] == "bare"


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, host string, shard int"
    rows = [(1, None, None, "t", "h", 1), (2, "u", "", "t", "h", 1), (None, "//x", "<p>a", None, None, None), (3, "http://a/", "<article>b c</article>", "t", "h", 1), (3, "http://a/", "<article>b c</article>", "t", "h", 1)]
    out = h.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "", 0), ("2", "", 0), ("3", "b c", 3), ("3", "b c", 3), ("None", "a", 1)]
    assert h.extract_text(spark.createDataFrame([], schema)).count() == 0
