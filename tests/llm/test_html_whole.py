"""Pages whose text stands beside or in elements that are not plain blocks: nothing but scripts, styles, titles and form fields is passed over."""

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import html_blocks

ARTICLE = "<article><h1>Head line</h1><p>First paragraph, with text.</p><p>Second one.</p></article>"
MAIN = ["Head line", "First paragraph, with text.", "Second one."]


def _texts(page: str) -> list[str]:
    return [b[1] for b in html_blocks.blocks_of(page)]


@pytest.mark.parametrize("start", [
    "<head><title>x</title><body>", "<html><head><title>x</title><meta charset=utf-8>", "<head>", "<html><head><title>a <b> c</title></head><body>",
    "<head><style>p > a {}</style><script>if (a < b) x = '</p>'</script ><body>", "<title>x<body>", "<head-line></head-line>", "<style-guide></style-guide>",
    "<textarea>", "<textarea rows=2>note<br>", "<form><select><option>a<option>b</form>", "<select><option>a", "<iframe src=x>", "<noscript>", "<object data=x>",
    "<template>", "<svg><title/><path d=''/>", "<svg><script/><style/></svg>"])
def test_article_after_elements_left_open(start):
    blocks = html_blocks.blocks_of(start + ARTICLE)
    assert [b[1] for b in blocks][-3:] == MAIN and len(blocks) == 3
    assert all("article" in b[0] for b in blocks) and not any(e.startswith("head") and e[:5] != "head-" for b in blocks for e in b[0])


def test_text_of_embedded_elements_is_read():
    assert _texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so.</p>") == ["Let x=2 be so."]
    assert _texts("<article><object data=a><p>Fallback text.</p></object><noscript>Plain words</noscript> tail</article>") == [
        "Fallback text.", "Plain words", "tail"]
    assert _texts("<p>See <svg><path d='M0'/><text>Label</text></svg> here") == ["See", "Label", "here"]
    assert html_blocks.blocks_of("<p>See <svg><path d='M0'/></svg> here")[1][0] == ("p",)


def test_form_fields_scripts_and_titles_are_not_read():
    assert _texts("<title>T</title><p>a<select><option>one<option>two</select>b<textarea>t <p>x</p></textarea>c<script>s</script>d<style>e</style>") == list("abcd")


def test_many_titles_left_open_take_linear_time():
    assert _texts("<title>x<p>" * 50_000 + "end") == ["end"]


def test_query_returns_these_articles_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_blocks.train_on(pages)
    filled = [" ".join(f"word{k}" for k in range(40)) + "." for _ in range(4)]
    body = "<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Head line</h1>" + "".join(f"<p>{t}</p>" for t in filled)
    inner = f"<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data=a><p>{filled[0]}</p></object><noscript><p>{filled[1]}</p></noscript>"
    rows = [(1, "u", "<html><head><title>x</title>" + body + "</article></body></html>"), (2, "v", "<html><head></head>" + body + inner + "</article></body></html>")]
    got = {r.page_id: r.text for r in html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("")), model).collect()}
    assert got[1] == " ".join(["Head line", *filled])
    assert got[2] == " ".join(["Head line", *filled, "Let x=2 be.", *filled[:2]])
