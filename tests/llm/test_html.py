import re
from html import unescape

import pytest

from drivetrove.llm.common import table
from drivetrove.llm.html import extract, main_text

PROSE = "Long enough, this sentence has commas, clauses, and words that say something about the subject at hand."


@pytest.mark.parametrize("html, want", [
    ("", ""),
    ("plain &amp; simple\n text", "plain & simple text"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PROSE}<p>B &lt;c&gt;<br>d</article><footer>F</footer>", f"T\n\n{PROSE}\n\nB <c> d"),
    (f"<div id=menu><a>m</a></div><div class='post'><p>{PROSE}</p><p>{PROSE}</p><ul><li>a<li>b</ul></div><div class='comments'><p>{PROSE}</p></div>", f"{PROSE}\n\n{PROSE}\n\na\n\nb"),
    (f"<div><div class=sidebar><p>{PROSE}</p></div><div><p>{PROSE}</p><form>q<input><p>x</p></form><p>{PROSE} <a href=y>link</a>.</p></div></div>", f"{PROSE}\n\n{PROSE} link."),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
    (f"<article><p>{PROSE}</p><aside>no</aside><div class='cookie-notice'>no</div><script>x</script></article>", PROSE),
    (f"<article><p hidden>no<p>{PROSE}</article>", PROSE),
    (f"<ul><li><a href=1>one, two, three, four</a></li><li><a href=2>five, six, seven, eight</a></li></ul><div><p>{PROSE}</p></div>", PROSE),
    (f"<div><p>{PROSE}</p></div><p", PROSE),
    (f'<body><div class="has-sidebar"><article><p>{PROSE}</p></article><div class=sidebar>{PROSE}</div></div>', PROSE),
    (f'<div class="overflow-hidden sidebar"><article><p>{PROSE}</p></article></div>', PROSE),
    (f'<div class="post category-legal"><p>{PROSE}</p><p>{PROSE}</p></div>', f"{PROSE}\n\n{PROSE}"),
    (f'<div class="entry-content share"><p>{PROSE}</p></div><div class=share><a href=x>Share</a></div>', PROSE),
    (f'<div class="legal"><p>{PROSE}</p><p>{PROSE}</p></div><div id=footer-legal>small print</div>', f"{PROSE}\n\n{PROSE}"),
    (f"<article><p>{PROSE}</p></article><div id=comments><article class=comment><p>{PROSE}</p><p>{PROSE}</p></article></div>", PROSE),
    (f"<div><p>{PROSE} <a title=don't href=x>one</a></p><p>{PROSE} it's</p></div>", f"{PROSE} one\n\n{PROSE} it's"),
    (f"<div><p title=\"open>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n\n{PROSE}"),
    (f"<div><p title=\"a class=sidebar > b\">{PROSE}</p><p data-x='>' class = \"lead\" class=ad>{PROSE}</p></div>", f"{PROSE}\n\n{PROSE}"),
])
def test_pages(html, want):
    assert main_text(html) == want


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    made = {r["page_id"]: r for r in extract(pages).collect()}
    assert len(made) == pages.count()
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", inner)]
        got = made[row["page_id"]]
        assert got["text"] == "\n\n".join(x for x in parts if x)
        assert got["n_chars"] == len(got["text"]) and got["url"] == row["url"]
        assert main_text(re.sub(r"<(/?)article\b", r"<\1div", row["html"])) == got["text"]  # by its score alone


def test_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "u", "<p>a</p>", "x"), (2, "u", "<p>a</p>", "x"), (3, "u", "<div>" * 5000 + "deep" + "<p>" * 20000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "a", 1), (2, "a", 1), (2, "a", 1), (3, "deep", 4)], key=str)
    assert extract(df.limit(0)).count() == 0
