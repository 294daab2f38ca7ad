"""HTML text, line deduplication, URL filters, decontamination: fixtures and brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib

import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from kindred.llm import decontaminate, html_text, line_dedup, registry, url_filter
from kindred.llm.arrowtext import hash_strings, slices, texts, words
from tests.helpers import SF, assert_same, duck

DOC = "doc_id long, text string"


def docs(spark, texts_, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts_)], DOC)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_contract_query_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF).toPandas(), duck().execute(registry.oracle_sql()[name]).df())


def test_words_follow_the_contract():
    import pyarrow as pa

    samples = [" a B\x0bc\n", "", "É\x1ce\xa0x Y", "  ", "Z" * 300, None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["skip", *samples], pa.string())}).slice(1)
    index, listed, ends = words(texts(batch))
    got = [[listed[i].as_py() for i in index[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    assert got == [re.findall("[^\x20\x09-\x0d]+", lower(s)) for s in samples]
    assert len(set(hash_strings(listed).tolist())) == len(listed)
    assert [len(p) for p in slices(batch, "text", 250)] == [4, 1, 1]


# --- HTML -----------------------------------------------------------------

PAGE = """<html><body class="has-sidebar"><header><a href=/>Home</a> Site</header><div id=cookie-notice>We use cookies</div>
<div class="wrap w7"><main><article class="post-77"><h1>Title &amp; more</h1><p>First <b>para<p>Second&nbsp; para
with <a href=x>link</a>.<ul><li>one<li>two</ul><div class="share-bar">Share!</div><section id=comments><p>Nice post</p></section>
<form><p>Subscribe</form><footer>tags</footer></article></main><aside>side</aside></div><footer>foot</footer><script>if(a<b)"</p>"</script></body>"""


def test_main_text_of_a_page():
    page = html_text.Page(PAGE)
    assert page.vote() == "body>div.w.wrap>main>article.post-"
    assert page.text([])[0] == "Title & more\nFirst para\nSecond para with link.\none\ntwo"


@pytest.mark.parametrize(("source", "expected"), [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<div hidden>h</div>b", "a\nb"), ("<a href=x>only link</a>", "only link"), ('<p title="x>y">q</p>', "q"), ("a < b &lt; c", "a < b < c"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<style>p{}</style><nav>menu</nav>", ""), ("x<script src=/a/>var a=1;</script>y", "xy"), ("<article><p class='search-history'>kept</p><div class='legal-news'>too</div><p>a <math><mi>x</mi></math></p><div class='share-bar'>no</div></article>", "kept\ntoo\na x"), ("<article><h1>Head</h1><p class=lead>lead</p><div>" + "long text " * 40 + "</div><div class=more>more</div></article>", "Head\nlead\n" + ("long text " * 40).strip() + "\nmore"), ("<p title=\"never closed>q</p>", "q"), ("<img src=\"data:" + "x" * 70_000 + "\" alt=\"a>b\">text", "text"), ("<div" + " a=b" * 600 + " c='>'>text", "text"), ("<div class=contenido><p>" + "uno dos " * 30 + "</p></div><div class=navegacion><a href=x>inicio</a></div>", ("uno dos " * 30).strip())])
def test_small_pages(source, expected):
    assert html_text.Page(source).text([])[0] == expected


def test_deep_and_hostile_markup_ends():
    for source in ("<div>" * 20000 + "x", "<li><ul>" * 5000, '<a "' * 3000, "<" * 50000, "<table><tr><td>" * 5000 + "q"):
        html_text.Page(source).text([])


def test_deep_paths_stay_apart():
    deep = "<div class=d>" * 60
    page = html_text.Page(f"{deep}<div class=a><p>one two</p></div><div class=b><p>three</p></div>")
    assert len(set(page.path)) == len(page.path)
    assert max(map(len, page.path)) < 400


def test_host_consensus_carries_thin_pages(spark):
    body = "<div class=story>{}</div><div class=promo2x>{}</div>"
    long, short = "word " * 80, "word"
    rows = [(i, "http://h.example/a", f"<html><body>{body.format(long, 'x')}") for i in range(4)]
    rows += [(9, "http://h.example/b", f"<html><body>{body.format(short, 'tail ' * 30)}"), (10, None, None), (11, "x", "<p>q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[9]["text"] == "word"
    assert (got[10]["text"], got[10]["n_chars"], got[11]["text"]) == ("", 0, "q")
    assert html_text.extract(pages.limit(0)).count() == 0


LONG = "long text " * 40


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div class=wrap><div class=title>Title</div><div class=lead>Lead</div><div class=body>{}</div><div class=more>more</div></div>", "Title\nLead\n{}"),
        ("<article><h2 id=search>Search</h2><p>{}<h2 id=comments>Comments</h2><h2 id=navigation>Way</h2><p class=notice>mind</article>", "Search\n{}\nComments\nWay\nmind"),
        ("<article><p>{}<section id=discussion><p>we discuss <a href=x>it</a></section><div class=menu>soup and bread</div><table class=popular><tr><td>names</table></article>", "{}\nwe discuss it\nsoup and bread\nnames"),
        ("<article><p>{}<div class=menu><a href=x>home</a> <a href=y>news</a></div><div class=notice>closed today</div></article>", "{}"),
        ("<article><p>{}<div class=commentarea>a</div><div class=fb_comments_v2>b</div><div class=kommentare>c</div><div class=werbung>d</div></article>", "{}"),
        ("<ul><li><a href=x>home</a><li><a href=y>news</a></ul><p>{}", "{}"),
        ("<p>{}<object data=x>in place of it</object>", "{} in place of it"),
    ],
)
def test_articles_lose_and_leak_nothing(source, expected):
    assert html_text.Page(source.format(LONG)).text([])[0] == expected.format(LONG.strip())


@pytest.mark.parametrize("chars", [html_text.BROADCAST_CHARS, 0])
def test_consensus_keeps_stories_beside_teasers_and_drops_what_a_host_repeats(spark, chars):
    """Both with the hosts' paths broadcast and joined."""
    rows = [(i, "http://a.example/", f"<main><article>{LONG}{i}</article></main>") for i in range(6)]
    rows += [(6, "http://a.example/", f"<main><article>TEASER</article><div class=story>{LONG}</div></main>")]
    rows += [(10 + i, "http://b.example/", f"<div class=w><div class=x>Read us daily</div><div class=t>Title {i}</div><div class=s>{LONG}{i}</div></div>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, broadcast_chars=chars).collect()}
    assert got == {**{i: f"{LONG}{i}" for i in range(6)}, 6: LONG.strip(), **{10 + i: f"Title {i}\n{LONG}{i}" for i in range(4)}}


def test_hosts_votes_tie_by_name(spark):
    rows = [(i, "http://a.example/", f"<div class={c}>{LONG}{i}</div>") for i, c in enumerate("baab")]
    (host,) = html_text.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert (host["paths"], host["lost"]) == (["body>div.a", "body>div.b"], [])


def test_article_pages_are_whole(spark):
    from html import unescape

    rows = registry.queries()["op1_html_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        plain = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
        assert r["text"] == "\n".join(b for b in plain if b)
        assert r["n_chars"] == len(r["text"])


# --- lines ----------------------------------------------------------------


def brute_lines(rows, least=20, most=3):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(x for x in h if x is not None) for k, h in holders.items() if len(k) >= least and len(h - {None}) >= most}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [300_000, 0])
def test_lines_equal_brute_force(spark, limit):
    draw = random.Random(3)
    pool = ["A repeated line of text " + c for c in "abcdefgh"] + ["short", "", "Ünïcödé line of twenty!", "\tA REPEATED LINE OF TEXT A \r"]
    rows = [(i % 37, "\n".join(draw.choice([*pool, f"own line number {i} of this text"]) for _ in range(draw.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 100000 + "\n" + pool[0]), (None, pool[0] + "\n" + pool[1])]
    table = spark.createDataFrame(rows, DOC).withColumn("n_lines", F.lit("clash")).repartition(5)
    got = line_dedup.dedup_lines(table, broadcast_keys=limit, filter_words=1 << 13).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def test_full_filters_change_nothing_and_empty_tables_pass(spark):
    rows = [(i, f"line number {i % 50} that repeats\nand one of its own {i}") for i in range(200)]
    table = spark.createDataFrame(rows, DOC)
    tiny = line_dedup.dedup_lines(table, filter_words=1 << 13).select("doc_id", "kept_sha256")
    wide = line_dedup.dedup_lines(table, filter_words=1 << 16).select("doc_id", "kept_sha256")
    assert sorted(map(tuple, tiny.collect())) == sorted(map(tuple, wide.collect()))
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


# --- URLs -----------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7817?x", "https://example.com/en/8", "ftp://other.net/de/1#t", "http://x.example.net/de/89", "http://netx/de/1", "http://org/es/", "http://h.org?/es/", "no scheme/en/", None, "://", "http://example.com:80/en/7", "http://e\nf.com/en/\n?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).unionByName(spark.createDataFrame([(0, urls[0], 1)], "page_id long, url string, rule int"))
    rules = spark.createDataFrame([*url_filter.RULES, ("block", None, "/")], "verdict string, host string, path string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()]
    assert len(got) == len(urls) + 1
    by = {g[0]: g[1:] for g in got}
    assert by[0] == ("a.example.com", "/en/7817", "example.com/en/7", "allow")
    assert by[1][2:] == ("com/en/", "block")
    assert by[2] == ("other.net", "/de/1", "net/de/", "allow")
    assert by[3][2:] == ("example.net/de/8", "block")
    assert by[4][2:] == (None, "allow")
    assert by[5][2:] == ("org/es/", "block")
    assert by[6] == ("h.org", "", None, "allow")
    assert by[7] == by[8] == ("", "", None, "allow")
    assert by[10] == ("example.com:80", "/en/7", None, "allow")
    assert by[11] == ("e\nf.com", "/en/\n", "com/en/", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    for blocks in (4, 1 << 12):
        assert url_filter.possible_hits(keys, url_filter.build_filter(keys, blocks)).count() == 500
    others = spark.range(2000).select(F.concat(F.lit("z"), "id").alias("key"))
    assert url_filter.possible_hits(others, url_filter.build_filter(keys, 1 << 12)).count() < 100


# --- benchmark ------------------------------------------------------------


def brute_scan(rows, items, size=10):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    listed = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            listed.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = split(t)
        hit, names = set(), set()
        for k in range(len(w)):
            for window, ids in listed.items():
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    names |= ids
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, 200])
def test_decontamination_equals_brute_force(spark, limit):
    draw = random.Random(11)
    vocabulary = ["the", "cat", "Sat", "ÉTÉ", "no1", "日本"]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([2, 5, 12, 15])))) for k in range(12)] + [(12, None), (13, "..."), (3, "one two three")]
    make = lambda: " ".join(draw.choice(vocabulary) + draw.choice(["", ",", " --", "\n"]) for _ in range(draw.randint(0, 40)))
    rows = [(i, make()) for i in range(30)] + [(30 + k, f"x {make()}; {t} {make()}") for k, t in items if t] + [(90, None), (91, ""), (92, "A" * 50000), (30, "one, TWO three")]
    table = spark.createDataFrame(rows, DOC).withColumn("n_hit", F.lit("clash"))
    marked = decontaminate.scan(table, spark.createDataFrame(items, "item_id long, text string"), max_patterns_bytes=limit)
    got = marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute_scan(rows, items)
    spans = {r["doc_id"]: r["hit_spans"] for r in marked.where("doc_id = 30 and n_words = 3").collect()}
    assert spans == {30: [[0, 14]]}


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.scan(docs(spark, ["a b"]), items).first()["contaminated"]
    assert decontaminate.scan(docs(spark, ["a"]).limit(0), items).count() == 0


def test_parts_give_the_spans_of_one_pass(spark):
    table = docs(spark, ["x One two three. y", "three four FIVE", "one two three four five", "", None, "none of it"])
    items = spark.createDataFrame([("a", "one two three"), ("b", "three four five"), ("b", "three four five"), (None, "none of it")], "item_id string, text string")
    one, many = (sorted((r["doc_id"], r["hit_spans"], r["items"]) for r in decontaminate.scan(table, items, max_patterns_bytes=n).collect()) for n in (1 << 20, 40))
    assert one == many
    assert [x[2] for x in one] == [["a"], ["b"], ["a", "b"], [], [], []]
    assert one[2][1] == [[0, 23]]


def test_folds_use_crc32(spark):
    from kindred.llm.toxicity import fold

    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold("id", 10).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 10 for i in range(50)}


def test_hashes_of_strings_need_little_memory_beside_them():
    rng = random.Random(3)
    values = pa.array(["".join(rng.choice("abcé \U0001f600") for _ in range(rng.choice((0, 1, 7, 24, 30, 48, 200)))) for _ in range(30_000)])
    hash_strings(values[:10])
    tracemalloc.start()
    found = hash_strings(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # 106 MB when all bytes were tabulated at once
    assert found.tolist() == [int(hash_strings(values[i : i + 1])[0]) for i in range(100)] + found[100:].tolist()
    assert (hash_strings(values[5_000:25_000]) == found[5_000:25_000]).all()
