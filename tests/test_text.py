from html import unescape

import pytest
from pyspark.sql import functions as F

from forum_signals.functions import text
from forum_signals.functions.casts import safe_int


def column_of(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    return [r.out for r in df.select("id", fn(F.col("v")).alias("out")).orderBy("id").collect()]


def test_entities_like_the_standard_library(spark):
    values = [
        "plain", "a &lt;b&gt; &quot;c&quot; &#39;d&#39; &nbsp;&amp;", "&amp;lt;", "&amp;amp;lt;", "&copy &notit; &middot;",
        "&#x41;&#66;&#0;&#xD800;&#1114112;", "a & b && c &", "&;&#;&#x;", "&LT;&AMP;", "&eacute;é", "&unknown; &ampamp;",
    ]
    assert column_of(spark, text.unescape_entities, values) == [unescape(v) for v in values]
    assert column_of(spark, text.unescape_entities, [None]) == [""]


def test_all_named_entities_and_random_texts(spark):
    import random
    from html.entities import html5

    rng = random.Random(8)
    names = sorted(html5)
    values = [f"a&{n}b" for n in names] + [f"&{n};" for n in names] + [f"&{n[:-1]}" for n in names]
    values += [f"&#{n}{e}" for n in (*range(0, 300), 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**30) for e in (";", "", "x")]
    values += [f"&#{x}{n:x};" for n in (0, 0x41, 0x80, 0x9F, 0xFFFF, 0x1F600, 0x110000) for x in ("x", "X", "x000")]
    pieces = ["&", "&amp", ";", "lt", "copy", "notin", "not", "#", "#x", "41", "1F600", " ", "<", "\n", "é", "a", "&eacute", "&NotEqualTilde;", "0", "x" * 40]
    values += ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(6000)]
    got = column_of(spark, text.unescape_entities, values)
    different = [(v, g, unescape(v)) for v, g in zip(values, got) if g != unescape(v)]
    assert different == []


def test_entities_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("&copy;",)], "v string").select(text.html_to_text(F.col("v")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("html", "prose"),
    [
        ("<p>Use <code>how do i</code> here</p>", "Use here"),
        ("<p>a</p><pre><code>x\ny</code></pre><p>b</p>", "a b"),
        ("<PRE><CODE>x</CODE></PRE>y", "y"),
        ('<pre class="c"><code>kept text</code></pre>', ""),
        ('<code class="c">kept</code>', "kept"),
        ("List&lt;which one&gt; here", "List here"),
        ("a < b and c > d", "a d"),
        ("1 < 2", "1 < 2"),
        ("a\xa0 b\x1cc\n\n\u2003d ", "a b c d"),
        ("<a\nhref='x'>link</a>", "link"),
        ("<code>open only", "open only"),
        ("&lt;code&gt;x&lt;/code&gt;y", "y"),
        ("é <b>ü</b>", "é ü"),
        ("", ""),
        (None, ""),
    ],
)
def test_html_to_text(spark, html, prose):
    assert column_of(spark, text.html_to_text, [html]) == [prose]


def test_parse_tags(spark):
    values = ["<python><c#><.net>", "<a>", "", None, "no tags", "<a><a>", "<>x<b c>"]
    expected = [["python", "c#", ".net"], ["a"], [], [], [], ["a", "a"], ["b c"]]
    assert column_of(spark, text.parse_tags, values) == expected


def test_tokenize(spark):
    values = ["Don't use C++11, naïve É", None, "", "123", "Kelvin İs"]
    expected = [["don", "t", "use", "c", "na", "ve"], [], [], [], ["kelvin", "i", "s"]]
    assert column_of(spark, text.tokenize, values) == expected


def test_safe_int(spark):
    values = ["5", " 5 ", "+5", "-5", "1_000", "", "x", "1.5", "99999999999", None, "_1", "1__0"]
    assert column_of(spark, lambda c: safe_int(c, "int"), values) == [5, 5, 5, -5, 1000] + [None] * 7
    assert column_of(spark, lambda c: safe_int(c, "int", 0), values)[5:] == [0] * 7
    assert column_of(spark, lambda c: safe_int(c, "bigint"), ["99999999999"]) == [99999999999]


def test_only_blanks_that_change_are_replaced(spark):
    texts = ["a b", " a  b ", "\ta\tb\n", "a \tb", "a\t b", "a\x1cb \x1c c", "é\xa0a \xa0 b c d", "  ", "", "é  é é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = [r[0] for r in df.orderBy("id").select(text.collapse_whitespace(F.col("t"))).collect()]
    assert found == [" ".join(t.split()) for t in texts]


def test_markup_entities_take_the_short_way(spark):
    texts = ["&amp;lt; &lt;b&gt; & &quot;", "&lt;&amp;", "&amp;quot;", "&quot;&lt;&#39;", "&nbsp;a", "a & b", "&copy;&lt;", "&amp"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").orderBy("id")
    decoded = df.select(text.unescape_entities(F.col("t")).alias("t"))
    assert [r[0] for r in decoded.collect()] == [unescape(t) for t in texts]
    assert text._BEYOND_MARKUP in decoded._jdf.queryExecution().logical().toString()
