"""Repair of broken XML: a tolerant reader that closes, ignores and escapes until the text is well-formed.

* An element that isn't closed is closed where its parent is, or at the end; an end tag closes all that is open inside its
  element, and one that closes nothing is left out. So of crossed elements the inner one ends with the outer one.
* A bare & or a < that begins no tag is text. Attributes may lack quotes or values; of repeated ones the first stays.
* Comments, declarations and processing instructions go; CDATA becomes text, and is closed at the end if it isn't.
* Characters that XML 1.0 doesn't have go. Named entities of XML stay, of others the ampersand is text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_:À-퟿-�\U00010000-\U000EFFFF][\w:.\-·]*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>{_NAME})[^<>]*>?|<(?P<start>{_NAME})(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)>?",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"(?P<name>{_NAME})(?:\s*=\s*(?:\"(?P<two>[^\"]*)\"|'(?P<one>[^']*)'|(?P<bare>[^\s\"'>]+)))?")
_AMPERSAND = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)")
_NOT_XML = re.compile(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]")


def _text(raw: str) -> str:
    return _AMPERSAND.sub("&amp;", raw).replace("<", "&lt;").replace(">", "&gt;")


def repaired(broken: str) -> str:
    broken = _NOT_XML.sub("", broken)
    out, open_, at = [], [], 0
    for token in _TOKEN.finditer(broken):
        out.append(_text(broken[at : token.start()]))
        at = token.end()
        if (cdata := token["cdata"]) is not None:
            out.append(cdata.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif (name := token["end"]) is not None:
            if name in open_:
                while (last := open_.pop()) != name:
                    out.append(f"</{last}>")
                out.append(f"</{name}>")
        elif (name := token["start"]) is not None:
            rest = token["attributes"]
            alone = rest.rstrip().endswith("/")
            found = {}
            for a in _ATTRIBUTE.finditer(rest.rstrip()[:-1] if alone else rest):
                value = next((v for v in (a["two"], a["one"], a["bare"]) if v is not None), "")
                found.setdefault(a["name"], _text(value).replace('"', "&quot;"))
            out.append(f"<{name}{''.join(f' {k}="{v}"' for k, v in found.items())}{'/' * alone}>")
            if not alone:
                open_.append(name)
    out.append(_text(broken[at:]))
    return "".join(out + [f"</{name}>" for name in reversed(open_)])


def repaired_xml(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired, na_action="ignore")

    return run(column)
