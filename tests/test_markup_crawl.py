import re

from pyspark.sql import functions as F

from skarn.functions import markup
from skarn.operators import crawling
from skarn.sources.tables import Store
from skarn.streaming import ingest

HTML = """<html><head><title> A &amp; B </title><script>var p = "</p>";</script></head><body><nav><a href="/menu">m</a></nav>
<!-- <a href="/hidden">x</a> --><p>Some text with <b>bold &lt;words&gt; <a href="b.html#frag">b</a> <a class=x href='https://other.example/'>o</a> <a href="mailto:x@y">mail</a>
<a href="//h.example/c">c</a> <a href="/a/../d?q=1">d</a></p><footer>foot</footer>""" + "<p>" + "more words here " * 10 + "</p>"


def test_extract(spark):
    df = spark.createDataFrame([("http://h.example/dir/a.html", HTML), ("http://h.example/e", "<p>short</p>")], "url string, html string")
    page = crawling.extract_pages(df).collect()
    assert len(page) == 1 and page[0].title == "A & B" and page[0].body_text.startswith("A & B Some text with bold <words> b o mail c d more")
    assert "foot" not in page[0].body_text and "hidden" not in page[0].body_text
    links = sorted(r.link for r in crawling.extract_links(df).collect())
    assert links == ["http://h.example/c", "http://h.example/d?q=1", "http://h.example/dir/b.html"]


def test_links_are_resolved_once_a_row(spark):
    """The filter of nulls makes no second Python evaluation."""
    df = spark.createDataFrame([("http://h/a/b", '<a href="../c#x">c</a><a href="//k/z">z</a><a href="?q">q</a>'), (None, '<a href="q">q</a>')], "url string, html string")
    links = crawling.extract_links(df)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.link for r in links.collect()) == ["http://h/a/b?q", "http://h/c"]


def reference_snippet(text, terms, n=220):
    def esc(s):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            s = s.replace(a, b)
        return s

    pattern = re.compile("|".join(map(re.escape, terms)), re.I) if terms else None
    m = pattern.search(text) if pattern else None
    if not m:
        return esc(text[:n])
    start = max(0, m.start() - 80)
    end = min(len(text), start + n)
    part, out, at = text[start:end], "", 0
    for k in pattern.finditer(part):
        out += esc(part[at : k.start()]) + f"<mark>{esc(k[0])}</mark>"
        at = k.end()
    return ("..." if start else "") + out + esc(part[at:]) + ("..." if end < len(text) else "")


def test_snippets(spark):
    texts = ["alpha <script>x</script> beta", "", None, "he & 'the' \"quot\" amp " * 30, "x" * 300 + " beta " + "y" * 300, "ALPHA beta alphabeta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for terms in (["beta"], ["he", "amp", "quot"], ["alpha", "beta"], []):
        got = {r.i: r.s for r in df.select("i", markup.snippet(F.col("t"), terms).alias("s")).collect()}
        assert got == {i: reference_snippet(t or "", terms) for i, t in enumerate(texts)}
        assert all("<" not in re.sub("</?mark>", "", s) for s in got.values())


def test_upsert_and_frontier(spark):
    old = spark.createDataFrame([(1, "a", "old", 1), (2, "b", "old", 1)], "page_id long, url_hash string, title string, crawled_at int")
    new = spark.createDataFrame([("b", "new", 2), ("c", "x", 2), ("c", "y", 3)], "url_hash string, title string, crawled_at int")
    once = crawling.upsert(old, new)
    rows = {r.url_hash: (r.page_id, r.title) for r in once.collect()}
    assert rows["a"] == (1, "old") and rows["b"] == (2, "new") and rows["c"][1] == "y"
    assert sorted(crawling.upsert(once, new).collect()) == sorted(once.collect())
    rules = spark.createDataFrame([("h", "/private"), ("k", None)], "host string, prefix string")
    urls = spark.createDataFrame([("http://h/private/x",), ("http://h/open",), ("http://k/",), ("http://unknown/",)], "url string")
    assert sorted(r.url for r in crawling.allowed(urls, rules).collect()) == ["http://h/open", "http://k/"]


def test_rules_meet_paths_by_equality(spark):
    """The first rule that a path begins with decides; a host's paths are not compared with all of its rules."""
    rows = [("h", "/a", False, 3), ("h", "/ab", True, 1), ("h", "/abc", False, 2), ("h", "/ü", False, 0), ("h", "/q?x", False, 0), ("h", "", False, -9), ("k", "", True, 0), ("k", "/z", False, 0), ("k", "/z", True, 0), ("n", None, True, 0), (None, "/", True, 0)]
    rules = spark.createDataFrame(rows, "host string, prefix string, allow boolean, ord int")
    urls = ["http://h/a", "http://h/abcd", "http://h/axe", "http://h/b", "http://h", "http://h/üx", "http://h/q?xy", "http://h/q", "http://k/z1", "http://k/y", "http://n/a", "http://other/a", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")

    def brute(url):
        host, path = (url or "").partition("://")[2].partition("/")[::2] if "://" in (url or "") else (None, "")
        own = [(o, a) for h, p, a, o in rows if host is not None and h == host and p is not None and (p or a) and f"/{path}".startswith(p)]
        return host in {r[0] for r in rows if r[0]} and min(own, default=(0, True))[1]

    judged = crawling.judged(df, rules)
    assert {r.url: r.may_fetch for r in judged.collect()} == {u: brute(u) for u in urls}
    text = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in text and "prefix" in text


def test_crawl_levels(spark):
    def page(links):
        return "".join(f'<a href="{x}">l</a>' for x in links) + "<p>" + "enough words " * 10 + "</p>"

    pages = spark.createDataFrame([("http://h/1", page(["2", "3"])), ("http://h/2", page(["4", "1"])), ("http://h/3", page(["4", "9"])), ("http://h/4", page([]))], "url string, html string")
    got = {(r.url[-1], r.level) for r in crawling.crawl(pages, "http://h/1")[0].collect()}
    assert got == {("1", 0), ("2", 1), ("3", 1), ("4", 2)}
    assert crawling.crawl(pages, "http://h/1", max_pages=2)[0].count() == 2
    known = pages.filter("url = 'http://h/1'")
    assert crawling.crawl(pages, "http://h/1", existing=known)[0].count() == 0
    assert crawling.crawl(pages, "http://h/1", existing=known, refresh=True)[0].count() == 4


def test_only_saved_pages_count_and_are_followed(spark):
    text = "<p>" + "enough words " * 10 + "</p>"
    rows = [("http://h/1", f'<a href="/2">a</a><a href="/3">b</a><a href=/4>c</a>{text}', 200, "text/html"), ("http://h/2", '<a href="/5">short</a>', 200, "text/html"), ("http://h/3", text, 500, "text/html"), ("http://h/4", text + '<a href="/6">d</a>', 200, "text/html; charset=utf-8"), ("http://h/5", text, 200, "text/html"), ("http://h/6", text, 200, "text/html")]
    fetched = spark.createDataFrame(rows, "url string, html string, status int, content_type string")
    levels, log = crawling.crawl(fetched, "http://h/1", max_pages=3)
    assert {(r.url[-1], r.level) for r in levels.collect()} == {("1", 0), ("4", 1), ("6", 2)}
    assert {(r.url[-1], r.status) for r in log.collect()} == {("1", 200), ("2", 200), ("3", 500), ("4", 200), ("6", 200)}
    rules = crawling.robots_rules(spark.createDataFrame([("h", "User-agent: *\nAllow: /\nDisallow: /4"), ("k", "")], "host string, body string"))
    assert crawling.crawl(fetched, "http://h/1", rules=rules)[0].count() == 3
    rules = crawling.robots_rules(spark.createDataFrame([("h", "User-agent: bot\nDisallow: /4\n\nUser-agent: *\nDisallow: /")], "host string, body string"), "bot/1.0")
    levels, log = crawling.crawl(fetched, "http://h/1", rules=rules)
    assert levels.count() == 1 and ("http://h/4", 403) in {(r.url, r.status) for r in log.collect()}


def test_crawl_into_the_store(spark, tmp_path):
    from skarn.plans.engine import SearchEngine

    text = "<title>Dogs</title><p>" + "lazy dogs " * 15 + "</p>"
    fetched = spark.createDataFrame([("http://h/1", text + '<a href="/2">n</a>'), ("http://h/2", text)], "url string, html string").withColumn("crawled_at", F.current_timestamp())
    engine = SearchEngine(spark, str(tmp_path))
    assert engine.crawl(fetched, "http://h/1") == {"saved": 2, "visited": 2}
    assert engine.crawl(fetched, "http://h/1") == {"saved": 0, "visited": 2}
    engine.build(engine.store.table("pages"))
    assert engine.metrics()["crawl_attempts"] == 2 and engine.search("dogs")["total"] == 2
    assert engine.store.table("page_rank").agg(F.sum("in_links")).first()[0] == 1


def test_entities(spark):
    import html

    texts = ["a &lt;b&gt; &amp;lt; &#38;lt; &#x41;&#233;&#x1F600; &eacute;&hellip; &nope; &amp;amp; &#0; &#xD800; & x", "", None, "&copy;&copy;&notin;&not;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", markup._decoded(F.col("t")).alias("s")).collect()}
    assert got == {i: html.unescape(t) if t is not None else None for i, t in enumerate(texts)}


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "url string, html string, crawled_at timestamp"
    body = "<title>t</title><p>" + "word " * 40 + '</p><a href="/two">x</a>'
    for k, day in enumerate((1, 2)):
        rows = [("http://h/one", body.replace("word", f"v{day}"), f"2024-01-0{day} 00:00:00")]
        spark.createDataFrame(rows, "url string, html string, t string").selectExpr("url", "html", "timestamp(t) AS crawled_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = ingest.ingest_pages(source, store, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
        page = store.table("pages").collect()
        assert len(page) == 1 and f"v{day}" in page[0].body_text and store.table("crawl_edges").count() == 1
        if k:
            assert page[0].page_id == first
        first = page[0].page_id
    rows = [("http://h/two", body.replace("word", w), t) for w, t in (("newer", "2024-02-02 00:00:00"), ("older", "2024-02-01 00:00:00"))]
    spark.createDataFrame(rows, "url string, html string, t string").selectExpr("url", "html", "timestamp(t) AS crawled_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_pages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination(120)
    two = store.table("pages").filter("url = 'http://h/two'").collect()
    assert len(two) == 1 and "newer" in two[0].body_text and two[0].crawled_at.day == 2
    table = spark.createDataFrame([("2024-01-01 00:10:00", 200), ("2024-01-01 00:50:00", 200), ("2024-01-01 01:10:00", 0)], "t string, status int").selectExpr("timestamp(t) AS crawled_at", "status")
    assert sorted(r.n for r in ingest.hourly_fetches(table).collect()) == [1, 2]


def test_bytes_and_lenient_positions(spark):
    from skarn.operators import indexing

    rows = [(bytearray("é".encode("latin-1")), "ISO-8859-1"), (bytearray("é".encode()), None), (bytearray("é".encode()), "x-unknown")]
    df = spark.createDataFrame(rows, "raw binary, charset string")
    assert [r[0] for r in df.select(markup.decode_bytes(F.col("raw"), F.col("charset"))).collect()] == ["é"] * 3
    texts = ['{"title":[1,2],"body":[]}', '{"title":["x",3,null]}', "nonsense", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.p.title, r.p.body) for r in df.select("i", indexing.parse_positions(F.col("t")).alias("p")).collect()}
    assert got == {0: ([1, 2], []), 1: ([3], []), 2: ([], []), 3: ([], []), 4: ([], [])}
