"""Extraction from marked articles and from templates, odd markup, and whole tables."""
import pytest
from pyspark.sql import functions as F

from traceloom.llm import html_text as html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<html><body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two  <b>three</b><p>Four</article><footer>&copy; x</footer>", "T & U\n\nOne two three\n\nFour"),
        ("<article><p>a<script>var x = '<p>no</p>';</script>b</p><style>p{}</style><aside>side</aside><div class='cookie-notice'>no</div><div id=comments><p>no</p></div><form><p>no</form>c</article>", "ab\n\nc"),
        ("<main><p>x &lt;b&gt; &#233;&nbsp;y</p><!-- <p>no</p> --><table><tr><td>1<td>2</table></main>", "x <b> é y\n\n1\n\n2"),
        ("<body><div class=menu><p>no</div><div><p>A long enough text of the page itself.<p>And more of it.</div><div class='ad box'>buy</div>", "A long enough text of the page itself.\n\nAnd more of it."),
        ("<nav><ul><li>never closed<article><p>yes</p></article>", "yes"),
        ("<article><p title='a > b'>attr</p><p>1 < 2 and a<b></p></article>", "attr\n\n1 < 2 and a"),
        ("<article><![CDATA[raw & data]]><p>x</article>", "raw & data\n\nx"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def _site(i, extra=""):
    return f"<html><body><div class=top><p>Welcome to the site</p></div><div class=wrap><div class=story><h2>Title {i}</h2><p>Body of page {i} with its own words {i * 7}.</p>{extra}</div><div class=more><p>Read our other news now</p></div></div><p>Made by us</p></body></html>"


def test_template_without_marks(spark):
    pages = spark.createDataFrame([(i, f"http://Host.example:80/{i}", _site(i, "<p>Same line</p>" if i % 2 else "")) for i in range(20)] + [(99, "https://other.example/", _site(5))], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    got = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    for i in range(20):
        assert got[i].startswith(f"Title {i}\n\nBody of page {i}") and "Welcome" not in got[i] and "other news" not in got[i]
    assert all(got[i].endswith("Same line") for i in range(1, 20, 2))
    found = html.templates(pages.select("page_id", F.lit("h").alias("host"), "html")).first()
    tokens = {t["token"] for t in found.tokens}
    assert {"/html", "/html/body/div.wrap", "/html>"} <= tokens and found.main == "/html/body/div.wrap/div.story"


def test_classes_in_another_order_are_not_used():
    assert html._ordered([("/a", 1), ("/b", 1), ("/c", 2)], ["/b", "/a", "/c"]) == {"/c": 2}


def test_tables(spark):
    rows = [(1, None, None), (2, "no url", "<p>x y</p>"), (2, "no url", "<p>x y</p>"), (None, "http://a.b/", "<article>" + "<p>long text here</p>" * 3000 + "</article>"), (3, "http://a.b/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((repr(r.page_id), r.text, r.n_chars) for r in html.extract_text(pages).collect())
    long = "\n\n".join(["long text here"] * 3000)
    assert got == sorted([("1", "", 0), ("2", "x y", 3), ("2", "x y", 3), ("None", long, len(long)), ("3", "", 0)])
    assert html.extract_text(pages.limit(0)).count() == 0


def test_whole_table_by_hand(spark):
    """The pages of the test data mark their article; a plain reading of it is the brute force."""
    import re
    from html import unescape

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html.op4_html_extraction(spark, folder).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[i] == "\n\n".join(b for b in blocks if b)


def test_template_chooses_without_marks_and_names(spark):
    """Pages whose article, menu, footer and advert are plain containers: on hosts with a template the text stays the same."""
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    marked = {r.page_id: r for r in html.extract_text(pages).collect()}
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), '<div class="ad">', "<div>")
    got = {r.page_id: r for r in html.extract_text(pages.withColumns({"html": plain, "text": F.lit("x"), "main": F.lit("y"), "by_template": F.lit(1), "chars": F.lit(2)})).collect()}
    assert set(got) == set(marked)
    chosen = [i for i, r in got.items() if r.by_template]
    assert len(chosen) >= 0.85 * len(got) and sum(r.by_template for r in marked.values()) >= 0.85 * len(marked)
    assert all(got[i].text == marked[i].text for i in chosen)


def test_marks_do_not_decide_where_there_is_a_template():
    """A page that marks its advert as the article, on a host whose template knows better."""
    pages = [f"<body><div class=a><p>ad {i}</p></div><div class=b><h1>T {i}</h1><p>{'words of the story ' * 5}{i}</p></div><div class=c><a href=x>link to {i} and more and more and more text of links here</a></div></body>" for i in range(6)]
    counted = [html.parse(p)[0] for p in pages]
    paths = [t for t in counted[0] if t.startswith("/body/div") and not t.endswith(">") and t.count("/") == 2]
    stats = {".a": (4, 0, 0), ".b": (100, 0, 0), ".c": (60, 60, 0)}
    template = [{"token": t, "class": 1, "chars": next(v[0] for k, v in stats.items() if k in t), "linked": next(v[1] for k, v in stats.items() if k in t), "beside": 0, "marked": 0, "repeated": 0} for t in paths]
    page = pages[0].replace("<div class=a><p>ad 0</p></div>", "<div class=a><article><p>ad 0</p></article></div>")
    text, by = html.chosen(page, template)
    assert by and text == ["T 0", "words of the story " * 5 + "0"]


def test_lines_that_a_host_repeats_stay_inside_the_article(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x><p>Own text of page {i}, long enough to count as the story.</p><p>License line of all pages.</p></div><div class=y><p>Same on all pages too.</p></div></body>") for i in range(8)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.by_template and r.text == f"Own text of page {r.page_id}, long enough to count as the story.\n\nLicense line of all pages." for r in got)
