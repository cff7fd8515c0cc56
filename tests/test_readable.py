"""Summaries as paragraphs of HTML."""

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import report

LINK = '<a href="{0}" target="_blank" rel="noopener">{0}</a>'.format


def test_paragraphs_numbers_and_links(spark):
    cases = {
        None: "",
        "": "",
        "One. Two! three? 'Four'.": "<p>One.</p><p>Two! three?</p><p>'Four'.</p>",
        "一。二！ 三": "<p>一。</p><p>二！</p><p>三</p>",
        "A\n\n\nB.\u3000\nC\nD。\n  E": "<p>A</p><p>B.</p><p>C D。</p><p>E</p>",
        "a<b & \"c\"": "<p>a&lt;b &amp; &quot;c&quot;</p>",
        "see cve-2024-12345, xCVE-2024-1 CVE-2024-123 CVE-2024-123456789": "<p>see <code>cve-2024-12345</code>, xCVE-2024-1 CVE-2024-123 CVE-2024-123456789</p>",
        "at http://a.b/c?d=1&e\u00a0and https://f": f"<p>at {LINK('http://a.b/c?d=1&amp;e')}\u00a0and {LINK('https://f')}</p>",
        "中CVE-2020-0001中": "<p>中<code>CVE-2020-0001</code>中</p>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.h for r in df.select("t", T.summary_html(F.col("t")).alias("h")).collect()} == cases


def test_numbers_of_a_report(spark):
    df = spark.createDataFrame([("cve-2024-0002 and CVE-2024-0001, CVE-2024-0002",), (None,)], "summary string")
    assert [(r.cves, r.summary_html) for r in report.readable(df).collect()][1] == ([], "")
    assert report.readable(df).first().cves == ["CVE-2024-0002", "CVE-2024-0001"]
