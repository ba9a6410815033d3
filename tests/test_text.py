import pytest
from pyspark.sql import functions as F

from passageworks.functions import text as tx


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("c", ["\u001f", " ", "\u0085", "\u000b", "  \n\t"])
def test_blank(spark, c):
    assert c.isspace() and value(spark, c, tx.is_blank)


@pytest.mark.parametrize("c", ["", "​", " a "])
def test_not_blank(spark, c):
    assert not c.isspace() and not value(spark, c, tx.is_blank)


def test_strip_equals_python(spark):
    text = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert value(spark, text + "a b" + text, tx.strip) == "a b"


def test_escape(spark):
    got = value(spark, "it's a\\b \\u0041", tx.escape_sql_text)
    assert got == "it''s a\\\\b \\\\\\u0041"


@pytest.mark.parametrize(
    "path,name,ext",
    [
        ("/a/b/c.tar.gz", "c.tar.gz", ".gz"),
        ("/a/b.d/c", "c", ""),
        ("/a/.hidden", ".hidden", ""),
        ("/a/.hidden.md", ".hidden.md", ".md"),
        ("/a/b/x.MD", "x.MD", ".MD"),
        ("x.md", "x.md", ".md"),
        ("/a/repo/", "repo", ""),
    ],
)
def test_paths(spark, path, name, ext):
    assert value(spark, path, tx.basename) == name
    assert value(spark, path, tx.extension) == ext


def test_repo_and_local_path(spark):
    assert value(spark, "/home/git/docs/a/b.md", lambda p: tx.repo_of(p, "/home/git/")) == "docs"
    assert value(spark, "file:///a/b.md", tx.local_path) == "/a/b.md"
    assert value(spark, "file:/a/b.md", tx.local_path) == "/a/b.md"
    assert value(spark, "s3://a/b.md", tx.local_path) == "s3://a/b.md"


def test_cache_name(spark):
    got = value(spark, "my repo/é-1", lambda r: tx.cache_name(r, F.lit("by sentence"), "parquet"))
    assert got == "embeddings_my_repo_é-1_by_sentence.parquet"
    got = value(spark, "r", lambda r: tx.cache_name(r, F.lit("s"), "other"))
    assert got == "embeddings_r_s.pkl"


def test_html(spark):
    html = (
        "<!DOCTYPE html><p>a &lt;b&gt; &#233;&#x41;&amp;lt; &unknown;</p><script>x='</p>';</script>"
        "<!-- <p>no</p> --><STYLE>p{}</STYLE>1 < 2<br/>end &# 5"
    )
    assert value(spark, html, tx.html_to_text) == "a <b> éA&lt; &unknown;1 < 2end &# 5"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<table><tr><td>a</td><td>b<table><tr><td>1</td><td>2</td></tr></table>c</td></tr><tr><td>d</td></tr></table>",
         "Table:\na,b 1 2 c\nd\n"),
        ("<table><tr><td><table><tr><td>1</td></tr></table></td><td><table><tr><td>2</td></tr></table></td></tr></table>!",
         "Table:\n 1 , 2 \n!"),
        ("<table><tr><td>x<table><tr><td>y<table><tr><td>z</td></tr></table></td></tr></table></td><td>w</td></tr></table>",
         "Table:\nx y z  ,w\n"),
        ("p<table><tr><td>a</td></tr></table>q<table><tr><td>b<table><tr><td>c</td></tr></table></td></tr></table>",
         "pTable:\na\nqTable:\nb c \n"),
        ("<table><tr><td>a<table><tr><td>never closed</td></tr></table>", "a never closed "),
        ("no table </table> here <table>", "no table  here "),
    ],
)
def test_tables_within_tables_stay_in_their_cell(spark, html, want):
    assert value(spark, html, tx.html_to_text).replace("\n\n", "\n") == want.replace("\n\n", "\n")


def test_html_tables_become_lines(spark):
    html = "x<TABLE border=1><tr><th>a</th><td><b>b</b></td></tr><tr></tr></TABLE>y<table></table>"
    assert value(spark, html, tx.html_to_text) == "xTable:\na,b\n\nyTable:\n"
    got = value(spark, html, lambda h: tx.html_to_text(h, indicate_table=False, separator="|"))
    assert got == "xa|b\n\ny"


def test_markdown(spark):
    text = (
        "# Title *em* ***both***\n\n"
        "Some **bold `a_b*` x** and [`link`](http://u/v_(x)) [l](u) <b>hi</b> &amp; `&amp;<b>`"
        " <https://x.y/z> ![pic](p.png).\n\n---\n* item _one_ snake_case_word\n1) two\n\n"
        "| a | b\\c |\n|---|:-:|\n| 1 | `x` |\n|  | *y* |\n\n> quoted\n> more &#233;\n\n"
        "```py\nx = **a** | b\n\ny\n```\nafter `odd"
    )
    assert value(spark, text, tx.markdown_to_text) == (
        "Title em both\n"
        "Some bold a_b* x and link l hi & &amp;<b> https://x.y/z .\n"
        "item one snake_case_word\ntwo\nTable:\na,b\\c\n1,x\n,y\nquoted\nmore é\n"
        "x = **a** | b\n\ny\nafter `odd"
    )
    bare = value(spark, "|a|b|\n|-|-|\n|1|2|", lambda t: tx.markdown_to_text(t, False, ";"))
    assert bare == "a;b\n1;2"


def test_markdown_of_nothing(spark):
    assert spark.range(1).select(tx.markdown_to_text(F.lit(None).cast("string"))).first()[0] is None


def test_cells(spark):
    one = spark.sql("select array(array('a\nb'), array('c')) c").select(
        tx.linearize_cells(F.col("c"), F.lit(1)), tx.linearize_cells(F.col("c"), F.lit(2))
    ).first()
    assert one[0] == "Table:\na\nb\nc\n"
    assert one[1] == "Table:\na b\nc\n"


@pytest.mark.parametrize(
    "mark", ["*", "_", "[", "`", "|", "-", "<", "~", "> ", "#", "| - ", "[a](", "\\", "\n", "\n ", " ", "- a\n\n  "]
)
def test_long_lines_of_marks_stay_linear(spark, mark):
    for line in (mark * 200_000, "y" + mark * 200_000 + "x"):
        assert value(spark, line, lambda t: F.length(tx.markdown_to_text(t))) >= 0
        assert value(spark, line, lambda t: F.length(tx.html_to_text(t))) >= 0


@pytest.mark.parametrize("mark", ["<script>", "<style ", "<!--", "<table>", "<a ", "</script", "&#"])
def test_pages_of_unclosed_elements_stay_linear(spark, mark):
    assert value(spark, mark * 20_000 + "x", lambda t: F.length(tx.html_to_text(t))) >= 1


def test_comments_and_elements_that_do_not_close(spark):
    html = "a --> b<!-- c > d --> e > f <!-- open <i>g</i> <td>h</td> <script>i"
    assert value(spark, html, tx.html_to_text) == "a --> b e > f g h i"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("&#9999999;", "\ufffd"), ("&#xFFFFFF;", "\ufffd"), ("&#xD800;", "\ufffd"), ("&#0;", "\ufffd"),
        ("&#000065;&#x41;", "AA"), ("caf&eacute; &amp;lt; &lt;", "caf\u00e9 &lt; <"),
        ("a & b &nosuch; &; &#; &#x;", "a & b &nosuch; &; &#; &#x;"), ("&#128512;", "\U0001f600"),
    ],
)
def test_references(spark, given, wanted):
    assert spark.range(1).select(tx.unescape_entities(F.lit(given))).first()[0] == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (r"\*not emphasized\* *but this*", "*not emphasized* but this"),
        ("Title\n=====\nbody", "Title\nbody"),
        ("~~~\n*kept*\n~~~\n*gone*", "*kept*\ngone"),
        ("a | b\n--- | ---\n1 | *2*\n", "Table:\na,b\n1,2\n"),
        ("see [the text][1] here\n\n[1]: http://a.example/x", "see the text here\n"),
        ("one\n\n    x = *a* * *b*\n\ntwo", "one\nx = *a* * *b*\ntwo"),
        ("\x0e\x0f and *x*", "\x0e\x0f and x"),
        (r"a\\b \q \`c\`", r"a\b \q `c`"),
        ("`a\\*` and *b*", "a\\* and b"),
        (r"| a \| b | `c\|d` |" + "\n|---|---|\n" + r"| x \\| y\| |", "Table:\na | b,c|d\nx \\,y|"),
        ("a line\\\nnext  \nlast\\", "a line\nnext\nlast\\"),
        ("# head\\\nbody", "head\\\nbody"),
        ("a\\\\\nb", "a\\\nb"),
        ("- one\n  goes on\n\n  second *part*\n\n      x = *y*\n- two", "one\ngoes on\nsecond part\nx = *y*\ntwo"),
        ("- a\n  - b\n\n      of b\n\nend", "a\nb\nof b\nend"),
        ("text\n\n    x = *y*", "text\nx = *y*"),
        ("````\n```\n*a*\n~~~\n````\n*b*", "```\n*a*\n~~~\nb"),
        ("``` a `` b", "``` a `` b"),
        ("", ""),
        ("\n \n", ""),
    ],
)
def test_markdown_forms(spark, given, wanted):
    assert spark.range(1).select(tx.markdown_to_text(F.lit(given))).first()[0] == wanted
