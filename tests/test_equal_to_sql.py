"""Rows on which queries differed from their SQL."""

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import evidence, html


def test_quote_in_other_case(spark):
    """capitals of ß are SS, and a capital sigma at a cut is not a final one."""
    ev = spark.createDataFrame([(1, "a", "Große Straße und λόγος, mehr dazu am Ende")], "query_id int, chunk_id string, text string")
    ci = spark.createDataFrame([(1, "a", q) for q in ("GROSSE STR…Ende", "ΛΌΓΟΣ, MEHR", "GROSSE ΛΌΓΟΣ")], "query_id int, chunk_id string, quote string")
    got = {r.quote: r.findings for r in evidence.validate_citations(ci, ev).collect()}
    assert got == {"GROSSE STR…Ende": [], "ΛΌΓΟΣ, MEHR": [], "GROSSE ΛΌΓΟΣ": ["quote_absent"]}


def test_cut_reference_in_title():
    """a reference without its semicolon stays text; scripts stay as they are."""
    p = html.page_of('<title>A&amp;&amp</title><script>var t="a&&b";</script><h1>B&lt;&amp;&ampC &copy</h1>')
    assert html.titles(p)[0] == "B<&&ampC &copy"
    assert "".join(p.heads["title"]) == "A&&amp"
    assert p.scripts in ([], ['var t="a&&b";'])


def test_version_after_letter(spark):
    """as in the SQL, only ASCII letters, digits and _ before it make a version part of a word."""
    d = spark.createDataFrame([("über 12",), ("äver 123.4",), ("sever 12",), ("_v1.2",), ("öv1.2",)], "t string")
    assert [r[0] for r in d.select(X.version_of(F.col("t"))).collect()] == [None, "ver 123.4", None, None, "v1.2"]
