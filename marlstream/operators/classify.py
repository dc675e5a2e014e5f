"""Ordered classification rules: the first that holds wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: (kind, parts of the component type, any of which makes it that kind), in order of precedence
COMPONENT_KINDS = (
    ("breadcrumb", ("/breadcrumb",)),
    ("title", ("/components/title", "/content/title")),
    ("textbanner", ("/textbanner",)),
    ("text", ("/text", "/richText")),
    ("languagenavigation", ("/languagenavigation",)),
    ("navigation", ("/navigation",)),
    ("separator", ("/separator",)),
    ("search", ("/search",)),
    ("folder", ("nt:folder",)),
    ("teaser", ("/teaser", "/heroTeaser", "/overlayBannerTeaser")),
    ("spacer", ("/spacer",)),
    ("customembed", ("/customembed",)),
    ("productlisting", ("/productlisting", "/productlist")),
    ("button", ("/button",)),
    ("image", ("/image",)),
    ("carousel", ("/carousel",)),
)


def component_kind(kind: Column, heading: Column) -> Column:
    """Kind of a page component from its type; a title also needs a heading level."""
    found = F.lit(None).cast("string")
    for name, parts in reversed(COMPONENT_KINDS):
        holds = reduce(Column.__or__, [F.contains(kind, F.lit(p)) for p in parts])
        if name == "title":
            holds = holds & heading.rlike("^h[1-6]$")
        found = F.when(holds, F.lit(name)).otherwise(found)
    return found


def fragment_confidence(kind: Column, path: Column, template: Column) -> Column:
    """How sure it is that an item is a shared fragment: high, medium, low, or null if it isn't one."""
    return (
        F.when(F.contains(kind, F.lit("/experiencefragment")) | F.contains(template, F.lit("xf-web-variation")), "high")
        .when(F.contains(path, F.lit("/experience-fragments/")), "medium")
        .when(F.contains(template, F.lit("fragment")), "low")
    )


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda found, rule: F.when(rule[0], rule[1]).otherwise(found), reversed(rules), F.lit(default))


#: fixed values: (status, step) -> next status; other pairs stay
STEPS = {(0, 1): 1, (1, 2): 2, (2, 3): 3, (3, 4): 4, (4, 5): 5}


def next_status(status: Column, step: Column, steps: dict[tuple[int, int], int] = STEPS) -> Column:
    found = status
    for (s, t), to in steps.items():
        found = F.when((status == s) & (step == t), to).otherwise(found)
    return found


def path_kind(path: Column) -> Column:
    """Container, fragment or plain component, by the path of its type."""
    return F.when(F.contains(path, F.lit("/experiencefragment")) | F.contains(path, F.lit("/contentfragment")), "fragment").when(path.rlike("/(container|responsivegrid|parsys)$"), "container").otherwise("component")
