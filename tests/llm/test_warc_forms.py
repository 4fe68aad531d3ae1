"""Forms of links and entities that web pages have and the test tables don't."""

import hashlib
from urllib.parse import unquote_plus

from pyspark.sql import functions as F

from docweave.llm.op5_warc import derivatives, outlinks, plain_text, responses, serialized


def test_links_in_any_quotes(spark):
    html = """<a href=/x>1</a><A class=b HREF = /y/?q=1&r=2 id=z>2</a><a href="/o'neil">3</a><a href='/say"so"'>4</a><a href="/x">5</a><a href="">6</a><a id="k">7</a>"""
    got = spark.createDataFrame([(html,), (None,)], "h string").select(outlinks(F.col("h"))).collect()
    assert got[0][0] == ["/x", "/y/?q=1&r=2", "/o'neil", '/say"so"', ""] and got[1][0] == []


def test_numeric_entities(spark):
    html = "<p>it&#8217;s &#x2019;&#X1F600; &#0065; &#146; a&#160;b &#38;#65; &amp;#65; &#x26;lt; &#60;b&#62; &#0;&#xD800;&#9999999; &#12345678; &euro;</p>"
    want = "it’s ’\U0001f600 A ’ a b &#65; &#65; &lt; <b> ��� &#12345678; €"
    assert spark.createDataFrame([(html,)], "h string").select(plain_text(F.col("h"))).first()[0] == want


def test_text_around_tags_and_names(spark):
    html = "<p>a < b and <i>c</i> &eacute;&copy;&AMP;&nosuch; 3<4 &amp;eacute; x&lt;y</p><?xml v?><!doctype html>"
    assert spark.createDataFrame([(html,)], "h string").select(plain_text(F.col("h"))).first()[0] == "a < b and c é©&&nosuch; 3<4 &eacute; x<y"


def test_fields_hold_one_line_and_the_source(spark):
    pages = spark.createDataFrame([(1, "http://a.example/\r\nX: y", '<a href="/l\n2">é</a>', "own")], "page_id long, url string, html string, record_id string")
    got = {r.record_type: bytes(r.record).decode() for r in serialized(derivatives(responses(pages))).collect()}
    assert "\r\noutlink: /l%0A2\r\n" in got["metadata"]
    for text in got.values():
        head = dict(x.split(": ", 1) for x in text.partition("\r\n\r\n")[0].split("\r\n")[1:])
        assert head["WARC-Target-URI"] == "http://a.example/%0D%0AX: y"
        source = unquote_plus(head["WARC-Source-Headers"])
        assert source.startswith("HTTP/1.1 200 OK\r\n") and source.endswith("\r\n\r\n")
        body = pages.first().html
        assert head["WARC-Source-Block-Digest"] == "sha1:" + hashlib.sha1((source + body).encode()).hexdigest()
        assert head["WARC-Source-Payload-Digest"] == "sha1:" + hashlib.sha1(body.encode()).hexdigest()


def test_a_very_long_page(spark):
    html = "<p>" + "word &eacute; < tag <b>x</b>\n" * 40_000
    got = derivatives(responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).where("record_type = 'conversion'").first()
    assert got.block == " ".join(["word é < tag x"] * 40_000)
