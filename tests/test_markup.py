from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest

from marlstream.functions.markup import repaired
from marlstream.sources import files

#: broken text and what it is repaired to
GOLDEN = [
    ("<a><b>x</a>", "<a><b>x</b></a>"),
    ("<a><b>x<c>y", "<a><b>x<c>y</c></b></a>"),
    ("<a><b>x</a>y</b>", "<a><b>x</b></a>y"),
    ("</z><a>x</a></a>", "<a>x</a>"),
    ("<a>AT&T < 3 && &lt; &nbsp; &#65; 2 > 1</a>", "<a>AT&amp;T &lt; 3 &amp;&amp; &lt; &amp;nbsp; &#65; 2 &gt; 1</a>"),
    ("<a k=v l='1' m=\"&\" n k=w>x</a>", '<a k="v" l="1" m="&amp;" n="">x</a>'),
    ("<?xml version='1.0'?><!DOCTYPE a><!-- <b> --><a/>", "<a/>"),
    ("<a><![CDATA[<b> & ]] ></b>]]></a>", "<a>&lt;b&gt; &amp; ]] &gt;&lt;/b&gt;</a>"),
    ("<a><![CDATA[x", "<a>x</a>"),
    ("<a>x</a <b>y</b>", "<a>x</a><b>y</b>"),
    ("<a\n<b>x</b></a>", "<a><b>x</b></a>"),
    ("a\x00b\x0b<wp:meta_key>é</wp:meta_key>", "ab<wp:meta_key>é</wp:meta_key>"),
    ("", ""),
]


@pytest.mark.parametrize(("broken", "wanted"), GOLDEN)
def test_golden(broken, wanted):
    assert repaired(broken) == wanted == repaired(wanted)


def test_anything_becomes_well_formed():
    r = random.Random(1)
    parts = ["<a>", "</a>", "<b k='", "'>", "<c x=y ", "/>", "</c", "&", "<", ">", "]]>", "<![CDATA[", "<!--", "-->", '"', "t", "\x01", "<1>", "</>", "<?p", "é", "<!D", "=", "&#0;"]
    for _ in range(3000):
        broken = "".join(r.choice(parts) for _ in range(r.randint(0, 25))).replace("&#0;", "&")
        found = repaired(broken)
        ET.fromstring(f"<r>{found}</r>")
        assert repaired(found) == found


def test_a_feed_is_repaired_row_by_row(spark, tmp_path):
    items = [
        "<item><title>one & <b>two</title><wp:post_id>1</wp:post_id></item>",
        "<item><title>no end<wp:post_id>2</wp:post_id></title>",
        "<item attr><title><![CDATA[a < b]]></title><wp:post_id>3</wp:post_id><category domain=tag nicename='n'>C</category><category>D</item>",
        "<item><title>crossed <i>x</title></i><wp:post_id>4</wp:post_id></item>",
        "<items>not a row</items><item><wp:post_id>5</wp:post_id>",
    ]
    (tmp_path / "f.xml").write_text("<?xml version='1.0'?><rss><channel><title>feed</title>" + "\n".join(items) + "</channel></rss>")
    found = {x["wp:post_id"]: x for x in files.feed_items(spark, str(tmp_path / "f.xml"), repair=True).collect()}
    assert set(found) == {"1", None, "3", "4", "5"}
    assert found["3"].title == "a < b" and [(c.text, c._domain, c._nicename) for c in found["3"].category] == [("C", "tag", "n"), ("D", None, None)]
    # well-formed rows are read alike with and without repair
    good = "<rss>" + "".join(f"<item><title>t{i} &amp; é</title><wp:post_id>{i}</wp:post_id></item>" for i in range(50)) + "</rss>"
    (tmp_path / "g.xml").write_text(good, encoding="utf-8")
    plain, mended = (sorted(map(repr, files.feed_items(spark, str(tmp_path / "g.xml"), repair=x).collect())) for x in (False, True))
    assert plain == mended and len(plain) == 50
