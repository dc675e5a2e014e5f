"""Document trees: HTML and rich-text nodes. The recursion is per document and needs a parser, so it is in Arrow-batched
functions; everything around it (lookups, filters, counts) stays in DataFrame operations on the flat node rows.

A node is {"type", "attrs", "children"} or a text node {"text", marks...}; trees are kept as JSON text.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: fixed values: elements without an end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: element -> node type
NODE_TYPES = {"p": "p", "h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "h5": "h5", "h6": "h6", "ul": "ul", "ol": "ol", "li": "li", "blockquote": "blockquote", "hr": "hr", "table": "table", "thead": "thead", "tbody": "tbody", "tr": "tr", "td": "td", "th": "th", "a": "a", "img": "img", "div": "div", "span": "span", "code": "code", "pre": "code"}
#: fixed values: element -> mark
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strikethrough", "del": "strikethrough", "sub": "subscript", "sup": "superscript"}
#: fixed values: source rich-text node type -> node type
SOURCE_TYPES = {"document": "doc", "paragraph": "p", "heading-1": "h1", "heading-2": "h2", "heading-3": "h3", "heading-4": "h4", "heading-5": "h5", "heading-6": "h6", "unordered-list": "ul", "ordered-list": "ol", "list-item": "li", "blockquote": "blockquote", "hr": "hr", "table": "table", "table-row": "tr", "table-cell": "td", "table-header-cell": "th", "hyperlink": "a"}
SKIPPED = frozenset(("script", "style"))


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"type": "doc", "attrs": {}, "children": []}
        self.open, self.marks, self.skipped = [(None, self.root)], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in MARKS:
            self.marks.append((tag, MARKS[tag]))
        elif tag in NODE_TYPES:
            node = {"type": NODE_TYPES[tag], "attrs": {k: v or "" for k, v in attrs}, "children": []}
            self.open[-1][1]["children"].append(node)
            if tag not in VOID:
                self.open.append((tag, node))
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in MARKS:
            for i in range(len(self.marks) - 1, -1, -1):
                if self.marks[i][0] == tag:
                    del self.marks[i]
                    break
        elif any(tag == t for t, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self.open.pop()
            self.open.pop()

    def handle_data(self, data):
        if self.skipped or not data.strip() and len(self.open) == 1:
            return
        self.open[-1][1]["children"].append({"text": data} | {m: True for _, m in self.marks})


def tree_of_html(text: str | None) -> dict:
    builder = _TreeBuilder()
    builder.feed(text or "")
    builder.close()
    return builder.root


def tree_of_rich_text(node: dict, resolve: Callable[[str, str], str | None] = lambda kind, uid: None) -> dict | None:
    """A source tree {nodeType, content, data, value, marks} as nodes. `resolve` gives the content type of an entry or
    the URL of an asset by id; embedded ones that it doesn't know are left out."""
    kind = node.get("nodeType", "")
    if kind == "text":
        return {"text": node.get("value", "")} | {m["type"]: True for m in node.get("marks") or []}
    target = ((node.get("data") or {}).get("target") or {}).get("sys", {}).get("id")
    children = [c for c in (tree_of_rich_text(x, resolve) for x in node.get("content") or []) if c is not None]
    if kind.startswith(("embedded-", "entry-hyperlink", "asset-hyperlink")):
        what = "asset" if "asset" in kind else "entry"
        found = resolve(what, target)
        if found is None:
            return None
        attrs = {"display-type": "link" if "hyperlink" in kind else "inline" if "inline" in kind else "block", "type": what, "uid": target, "content-type" if what == "entry" else "href": found}
        return {"type": "reference", "attrs": attrs, "children": children or [{"text": ""}]}
    attrs = {"url": (node.get("data") or {}).get("uri", "")} if kind == "hyperlink" else {}
    if kind == "table":
        attrs = {"rows": len(children), "cols": max((len(r.get("children", [])) for r in children), default=0)}
    return {"type": SOURCE_TYPES.get(kind, "p"), "attrs": attrs, "children": children or [{"text": ""}]}


def html_of_tree(node: dict) -> str:
    if "text" in node:
        out = html.escape(node["text"], quote=False)
        for tag, mark in (("strong", "bold"), ("em", "italic"), ("u", "underline"), ("s", "strikethrough"), ("sub", "subscript"), ("sup", "superscript")):
            if node.get(mark):
                out = f"<{tag}>{out}</{tag}>"
        return out
    inner = "".join(map(html_of_tree, node.get("children", [])))
    kind = node.get("type")
    if kind == "doc":
        return inner
    attrs = dict(sorted((node.get("attrs") or {}).items()))
    if kind == "a" and "url" in attrs:
        attrs["href"] = attrs.pop("url")
    if kind == "reference":
        kind = "span"
        attrs = {f"data-{k}": v for k, v in attrs.items()}
    if kind == "table":
        attrs = {}
    head = f"<{kind}" + "".join(f' {k}="{html.escape(str(v))}"' for k, v in attrs.items()) + ">"
    return head if kind in VOID else f"{head}{inner}</{kind}>"


def markdown_of_tree(node: dict, depth: int = 0, number: int = 0) -> str:
    if "text" in node:
        out = node["text"]
        for sign, mark in (("**", "bold"), ("*", "italic"), ("~~", "strikethrough")):
            if node.get(mark) and out.strip():
                out = f"{sign}{out}{sign}"
        return out
    kind, children = node.get("type"), node.get("children", [])
    if kind in ("ul", "ol"):
        items = [markdown_of_tree(c, depth + 1, i + 1 if kind == "ol" else 0) for i, c in enumerate(children)]
        return "".join(items) + ("\n" if not depth else "")
    inner = "".join(markdown_of_tree(c, depth, number) for c in children)
    if kind == "li":
        return "  " * (depth - 1) + (f"{number}. " if number else "- ") + inner.strip() + "\n"
    if kind and len(kind) == 2 and kind[0] == "h" and kind[1].isdigit():
        return "#" * int(kind[1]) + f" {inner}\n\n"
    attrs = node.get("attrs") or {}
    if kind == "a":
        return f"[{inner}]({attrs.get('url') or attrs.get('href', '')})"
    if kind == "img":
        return f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
    if kind == "blockquote":
        return "".join(f"> {line}\n" for line in inner.strip().split("\n")) + "\n"
    return {"hr": "---\n\n", "p": f"{inner}\n\n", "code": f"`{inner}`"}.get(kind, inner)


def text_of_tree(node: dict) -> str:
    return node["text"] if "text" in node else " ".join(map(text_of_tree, node.get("children", [])))


def flattened(value, path: str = "", indexed: str = "[{}]") -> Iterator[tuple[str, object]]:
    """(path, leaf) of nested data: a.b[0].c, or a.b.0.c with indexed=".{}"; empty arrays and objects are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flattened(v, f"{path}.{k}" if path else k, indexed)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flattened(v, (path + indexed.format(i)).removeprefix("."), indexed)
    elif path:
        yield path, value


def unflattened(leaves: dict[str, object]):
    """The nested data of {"a.b[0].c": leaf}."""
    root: dict = {}
    for path, leaf in leaves.items():
        keys = [int(k[1:-1]) if k.startswith("[") else k for part in path.split(".") for k in _keys(part)]
        here = root
        for key, after in zip(keys, [*keys[1:], None], strict=True):
            empty = leaf if after is None else [] if isinstance(after, int) else {}
            if isinstance(here, list):
                here.extend([None] * (key + 1 - len(here)))
                if after is None or here[key] is None:
                    here[key] = empty
            elif after is None or key not in here:
                here[key] = empty
            here = here[key]
    return root


def _keys(part: str) -> list[str]:
    name, *places = part.split("[")
    return ([name] if name else []) + [f"[{p}" for p in places]


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _text_function(f: Callable[[str], str | None]):
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else f(x))

    return run


def parsed_text(column: Column) -> Column:
    """Text of HTML as a parser sees it, white space collapsed."""
    return _text_function(lambda x: " ".join(text_of_tree(tree_of_html(x)).split()))(column)


def html_to_tree(column: Column) -> Column:
    return _text_function(lambda x: _json(tree_of_html(x)))(column)


def tree_to_html(column: Column) -> Column:
    return _text_function(lambda x: html_of_tree(json.loads(x)))(column)


def tree_to_markdown(column: Column) -> Column:
    return _text_function(lambda x: markdown_of_tree(json.loads(x)).strip())(column)


def markdown_rows(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, markdown) of an HTML column. A task holds the texts of few pages at a time and no text of their trees."""
    rows = rows.select(*keys, F.col(column).alias("__html"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [None if x is None else markdown_of_tree(tree_of_html(x)).strip() for x in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(texts, pa.string())], [*keys, "markdown"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("markdown", StringType())]))


def json_flattened(column: Column) -> Column:
    """JSON text as an object of dotted paths."""
    return _text_function(lambda x: _json(dict(flattened(json.loads(x)))))(column)


def json_unflattened(column: Column) -> Column:
    return _text_function(lambda x: _json(unflattened(json.loads(x))))(column)


_TEXT_KEY = ["__text1", "__text2"]


def _text_key(column: str) -> dict[str, Column]:
    """Two independent hashes of a text, which tell texts apart in a join. Null texts get numbers of their own, so that they
    don't meet in one task."""
    return {"__text1": F.when(F.col(column).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(column)), "__text2": F.when(F.col(column).isNotNull(), F.xxhash64(F.lit(1), column)).otherwise(0)}


def rich_text_to_tree(rows: DataFrame, column: str, index: DataFrame, name: str = "tree") -> DataFrame:
    """rows with the node tree of a source rich-text column. The ids that a row's tree names are looked up in index
    (kind, uid, target) by a join first, so that nothing is collected or broadcast to the parser."""
    named = r'"sys"\s*:\s*\{[^{}]*"id"\s*:\s*"([^"]*)"'
    each = rows.withColumns(_text_key(column)).select(*_TEXT_KEY, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(named), 1))).alias("uid")).distinct()
    found = each.join(index, "uid").groupBy(*_TEXT_KEY).agg(F.to_json(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws("/", "kind", "uid"), "target"))))).alias("__known"))

    @F.pandas_udf("string")
    def run(trees: pd.Series, known: pd.Series) -> pd.Series:
        def one(tree, targets):
            if tree is None:
                return None
            targets = json.loads(targets) if targets else {}
            return _json(tree_of_rich_text(json.loads(tree), lambda kind, uid: targets.get(f"{kind}/{uid}")))

        return pd.Series([one(t, k) for t, k in zip(trees, known, strict=True)], dtype=object)

    return rows.withColumns(_text_key(column)).join(found, _TEXT_KEY, "left").withColumn(name, run(F.col(column), F.col("__known"))).drop(*_TEXT_KEY, "__known")


#: rows of a batch that is handed back
MOST = 20_000
#: pages of a batch that are texts in Python at a time
SLICE = 500
NODE_ROW = "pos int, depth int, parent int, type string, text string, href string"


def node_rows(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for each node of an HTML column, in pre-order: keys, pos, depth, parent's pos, type, text, link target."""
    rows = rows.select(*keys, F.col(column).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", " + NODE_ROW

    def frame(out):
        return pd.DataFrame(out, columns=[*keys, "pos", "depth", "parent", "type", "text", "href"]).astype({"parent": "Int32"})

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                stack, pos = [(tree_of_html(row[-1]), 0, None)], 0
                while stack:
                    node, depth, parent = stack.pop()
                    attrs = node.get("attrs") or {}
                    out.append((*row[:-1], pos, depth, parent, node.get("type", "text"), node.get("text"), attrs.get("href") or attrs.get("src")))
                    stack += [(c, depth + 1, pos) for c in reversed(node.get("children", []))]
                    pos += 1
                    if len(out) == MOST:
                        yield frame(out)
                        out = []
            if out:
                yield frame(out)

    return rows.mapInPandas(run, schema)


def canonical(column: Column) -> Column:
    """JSON text with sorted keys and without what only tells a position, for signatures."""
    return _text_function(lambda x: _json(_without_places(json.loads(x))))(column)


def _without_places(value, drop=("id", "position", "index")):
    if isinstance(value, dict):
        return {k: _without_places(v) for k, v in value.items() if k not in drop}
    return [_without_places(v) for v in value] if isinstance(value, list) else value


def descended(column: Column, key: str) -> Column:
    """Every value under a key, at any depth, in document order, as JSON texts."""

    def found(value):
        if isinstance(value, dict):
            for k, v in value.items():
                if k == key:
                    yield _json(v)
                yield from found(v)
        elif isinstance(value, list):
            for v in value:
                yield from found(v)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else list(found(json.loads(x))))

    return run(column)


def _rows_of_trees(rows: DataFrame, keys: list[str], column: str, extra: str, walk) -> DataFrame:
    rows = rows.select(*keys, F.col(column).alias("__json")).where("__json IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", " + extra
    names = [*keys, *[x.split()[0] for x in extra.split(", ")]]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(*row[:-1], *node) for row in batch.itertuples(index=False) for node in walk(json.loads(row[-1]))], columns=names)

    return rows.mapInPandas(run, schema)


def component_rows(models: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for each component of a page model: keys, pre (place in pre-order), post (place in post-order), depth,
    path, type, props. Children come in the order of `:itemsOrder`, or else as they stand."""

    def walk(model):
        out, pre, post = [], 0, 0
        # a stack of (node, path, depth, its place in out if its children are done)
        stack = [(model, "", 0, None)]
        while stack:
            node, path, depth, place = stack.pop()
            if place is not None:
                out[place][1] = post
                post += 1
                continue
            props = {k: v for k, v in node.items() if k not in (":items", ":itemsOrder", ":type")}
            out.append([pre, 0, depth, path, node.get(":type"), _json(props)])
            stack.append((node, path, depth, pre))
            pre += 1
            items = node.get(":items") or {}
            order = [k for k in node.get(":itemsOrder") or items if k in items]
            stack += [(items[k], f"{path}/{k}", depth + 1, None) for k in reversed(order) if isinstance(items[k], dict)]
        return out

    return _rows_of_trees(models, keys, column, "pre int, post int, depth int, path string, type string, props string", walk)


def schema_rows(models: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Flat rows of a nested field schema: keys, pos, depth, uid (dotted), label (joined by ` > `), type."""

    def walk(model):
        out, stack = [], [(f, (), ()) for f in reversed(model if isinstance(model, list) else model.get("schema") or [])]
        while stack:
            field, uids, labels = stack.pop()
            uids, labels = (*uids, field.get("uid", "")), (*labels, field.get("display_name") or field.get("title") or field.get("uid", ""))
            out.append((len(out), len(uids), ".".join(uids), " > ".join(labels), field.get("data_type")))
            stack += [(f, uids, labels) for f in reversed((field.get("schema") or []) + (field.get("blocks") or []))]
        return out

    return _rows_of_trees(models, keys, column, "pos int, depth int, uid string, label string, type string", walk)


def with_assets(rows: DataFrame, column: str, index: DataFrame, name: str = "tree") -> DataFrame:
    """rows whose node trees have their images replaced by asset references where index (src, uid) knows the source. The
    sources that a row's tree names are looked up by a join first."""
    named = F.regexp_extract_all(column, F.lit(r'"src":"([^"]*)"'), 1)
    each = rows.select(*[v.alias(k) for k, v in _text_key(column).items()], F.explode(F.array_distinct(named)).alias("src")).distinct()
    found = each.join(index.groupBy("src").agg(F.min("uid").alias("uid")), "src").groupBy(*_TEXT_KEY).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("src", "uid")))).alias("__known"))

    def rewritten(node, known):
        uid = known.get((node.get("attrs") or {}).get("src")) if node.get("type") == "img" else None
        if uid is not None:
            return {"type": "reference", "attrs": {"display-type": "display", "type": "asset", "uid": uid, "href": node["attrs"]["src"]}, "children": [{"text": ""}]}
        return node | {"children": [rewritten(c, known) for c in node["children"]]} if "children" in node else node

    @F.pandas_udf("string")
    def run(trees: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _json(rewritten(json.loads(t), json.loads(k) if k else {})) for t, k in zip(trees, known, strict=True)], dtype=object)

    return rows.withColumns(_text_key(column)).join(found, _TEXT_KEY, "left").withColumn(name, run(F.col(column), F.col("__known"))).drop(*_TEXT_KEY, "__known")
