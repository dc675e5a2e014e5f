"""Text functions of the content transforms: Column in, Column out, all inside whole-stage code generation.

Where the source systems disagree on how a key becomes an identifier, each rule has a function of its own; joins between
two systems must use the same one on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: identifiers that the destination reserves
RESERVED_UIDS = ("locale", "publish_details", "tags")
#: fixed values: endings that count as images
IMAGE_ENDINGS = ("jpeg", "jpg", "png", "gif", "webp", "svg")


def _replaced(column: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, column)


def first_segment(column: Column, separator: str) -> Column:
    return F.substring_index(column, separator, 1)


def last_segment(column: Column, pattern: str) -> Column:
    return F.try_element_at(F.split(column, pattern), F.lit(-1))


def compact_id(column: Column) -> Column:
    """Without braces and hyphens, lower-cased; unchanged if nothing would be left."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(column, "[-{}]", "")), F.lit("")), column)


_TO_UNDERSCORE = ((r"[ -]", "_"), (r"[^\w]+", "_"))
_TIDY = ((r"_+", "_"), (r"^_|_$", ""))


def snake_uid(column: Column) -> Column:
    """Identifier with camel case split at every capital."""
    return _replaced(F.lower(_replaced(column, *_TO_UNDERSCORE, ("([A-Z])", "_$1"))), *_TIDY)


def flat_uid(column: Column) -> Column:
    """Identifier with camel case run together."""
    return _replaced(F.lower(_replaced(column, *_TO_UNDERSCORE)), *_TIDY)


def _digit_prefixed(column: Column, prefix: str) -> Column:
    return F.when(column.rlike(r"^\d"), F.concat(F.lit(prefix), column)).otherwise(column)


def digit_safe_uid(column: Column) -> Column:
    return F.lower(F.regexp_replace(_digit_prefixed(column, "a_"), "[ -]", "_"))


def feed_uid(column: Column) -> Column:
    """As digit_safe_uid, but with a bare underscore before a digit, and rid of the first dollar sign."""
    return F.lower(F.regexp_replace(_replaced(_digit_prefixed(column, "_"), ("[ -]", "_")), r"^([^$]*)\$", "$1"))


def affixed_uid(column: Column, affix: str, restricted: tuple[str, ...] = RESERVED_UIDS) -> Column:
    """Restricted names, and those that begin or end in _ids, get the affix."""
    clash = column.isin(*restricted) | F.startswith(column, F.lit("_ids")) | F.endswith(column, F.lit("_ids"))
    return F.lower(F.when(clash, F.regexp_replace(F.concat(F.lit(f"{affix}_"), column), "[^a-zA-Z0-9]+", "_")).otherwise(column))


def component_uid(column: Column) -> Column:
    """Identifier of a page component: camel case split only between a small letter or digit and a capital."""
    tidy = _replaced(column, ("^:", ""), ("([a-z0-9])([A-Z])", "$1_$2"), ("[ :-]", "_"), (r"[^\w]", ""))
    return F.lower(F.when(tidy.rlike("^[a-zA-Z]"), tidy).otherwise(F.concat(F.lit("a"), tidy)))


def word_uid(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"[^\w]", "_"))


def camel_to_snake(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, "([A-Z])", "_$1"))


def field_uid(column: Column) -> Column:
    """Identifier that starts with a letter and isn't a reserved one."""
    tidy = _replaced(column, ("[^a-zA-Z0-9_]", "_"), ("^_+", ""))
    tidy = F.when(tidy.rlike("^[a-zA-Z]"), tidy).otherwise(F.concat(F.lit("field_"), tidy))
    return F.lower(F.when(tidy.isin(*RESERVED_UIDS), F.concat(F.lit("cm_"), tidy)).otherwise(tidy))


def schema_uid(column: Column) -> Column:
    """Identifier with acronyms kept together and camel case split by both usual rules."""
    words = (("URL", "url"), ("API", "api"), ("ID", "id"), ("UI", "ui"))
    camel = (("([A-Z]+)([A-Z][a-z])", "$1_$2"), (r"([a-z\d])([A-Z])", "$1_$2"))
    tidy = F.lower(_replaced(column, ("^[^a-zA-Z]+", ""), ("[^a-zA-Z0-9]", "_"), *words, *camel, *_TIDY))
    return F.when(tidy == "", "field").when(tidy == "locale", "cm_locale").otherwise(tidy)


def slug(column: Column) -> Column:
    return _replaced(F.lower(column), (r"\|", ""), (r"[^\w\s-]", ""), (r"\s+", "-"), ("-+", "-"), ("^-+|-+$", ""))


def title_slug(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, "[^a-zA-Z0-9]+", "-"))


def title_or(column: Column, *fallbacks: Column) -> Column:
    """The title unless it is blank, then the first fallback that isn't empty."""
    return F.coalesce(F.when(F.trim(column) != "", column), *[F.nullif(x, F.lit("")) for x in fallbacks])


def human_title(column: Column) -> Column:
    """Words apart, the first letter a capital and the others unchanged."""
    tidy = F.trim(_replaced(column, ("[-_]+", " "), (r"\s+", " ")))
    return F.concat(F.upper(F.substring(tidy, 1, 1)), F.substr(tidy, F.lit(2)))


def author_url(column: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(F.regexp_replace(column, " +", "_")))


def html_text(column: Column) -> Column:
    """Text of HTML by patterns: scripts and styles dropped, tags to spaces. functions.documents has the parsed form."""
    return F.trim(_replaced(column, (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), ("(?s)<[^>]*>", " "), (r"\s+", " ")))


def without_block_comments(column: Column) -> Column:
    """Rid of escaped editor comments."""
    return F.regexp_replace(column, r"(?s)&lt;!--?\s+/?wp:.*?--&gt;", "")


def component_name(column: Column) -> Column:
    """The part of a resource type from `components/` on, or the whole."""
    return F.coalesce(F.nullif(F.regexp_extract(column, r"components(?:/[\w-]+)+", 0), F.lit("")), column)


def log_level(message: Column) -> Column:
    text = F.lower(message)
    wrong = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ("error", "failed", "exception", "not found")])
    return F.when(wrong, "error").when(F.contains(text, F.lit("warn")), "warn").otherwise("info")


def without_colours(column: Column) -> Column:
    return F.regexp_replace(column, "\\x1b\\[\\d+m", "")


def app_name(column: Column) -> Column:
    """What is in parentheses, else the whole, without `-App`."""
    inside = F.when(column.rlike(r"\([^)]+\)"), F.regexp_extract(column, r"\(([^)]+)\)", 1)).otherwise(column)
    return F.trim(F.replace(inside, F.lit("-App"), F.lit("")))


def media_uid(url: Column) -> Column:
    """Identifier of a media URL; other URLs stay."""
    bare = F.when(F.contains(url, F.lit("?")), F.regexp_replace(F.substring_index(url, "?", 1), r"^(.*?)\.jpg", "$1")).otherwise(url)
    found = F.when(bare.rlike("/media/.*.ashx"), F.regexp_extract(bare, "/media/(.*).ashx", 1)).otherwise(F.nullif(F.regexp_extract(bare, "/media/(.*)", 1), F.lit("")))
    return F.when(F.contains(url, F.lit("/media")), found).otherwise(url)


def absolute_url(url: Column, base: Column) -> Column:
    return F.when(url.rlike(r"^(https?://|www\.)"), url).otherwise(F.concat(base, F.regexp_replace(url, "^/+", "")))


def encoded_uri(url: Column) -> Column:
    """Percent-encodes what may not stand in a URI, and leaves its separators."""
    kept = {"%3B": ";", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%2C": ",", "%23": "#", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    coded = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), kept.items(), coded)


def asset_path(url: Column) -> Column:
    """Path of an asset without query, host and rendition."""
    return _replaced(F.trim(url), (r"\?.*$", ""), ("^https?://[^/]+", ""), ("/jcr:content.*$", ""), ("/_jcr_content.*$", ""), (r"\.transform/.*$", ""))


def after_base(url: Column, base: Column) -> Column:
    """What follows the base URL, or a slash if nothing does."""
    return F.coalesce(F.nullif(F.replace(url, base, F.lit("")), F.lit("")), F.lit("/"))


def truncated(column: Column, n: int = 255) -> Column:
    return F.substring(column, 1, n)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def is_image(path: Column) -> Column:
    return path.rlike(rf"(?i)\.({'|'.join(IMAGE_ENDINGS)})$")


def is_path(column: Column) -> Column:
    return column.rlike("^/")


def is_html(column: Column) -> Column:
    return column.rlike(r"(?s)<[a-zA-Z][^>]*>")


def safe_file_name(column: Column) -> Column:
    return F.regexp_replace(column, r"[^a-zA-Z0-9_.\s-]", "")


def is_safe_id(column: Column) -> Column:
    return column.rlike("^[a-zA-Z0-9_.-]+$") & (F.length(column) <= 256)


def is_affix(column: Column) -> Column:
    return column.rlike("^[a-zA-Z][a-zA-Z0-9]{1,4}$")


def short_name(column: Column) -> Column:
    return F.when(F.length(column) > 25, F.concat(F.substring(column, 1, 15), F.lit("..."), F.right(column, F.lit(8)))).otherwise(column)


def file_size(n: Column) -> Column:
    """Bytes, KB or MB with one decimal; what lies in the middle goes to the even one, as with 249.25 KB."""
    one = lambda x: F.format_string("%.1f", F.bround(x, 1))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("bytes")))
        .when(n < 1048576, F.concat(one(n / 1024), F.lit("KB")))
        .otherwise(F.concat(one(n / 1048576), F.lit("MB")))
    )


def age(then: Column, now: Column) -> Column:
    """How long ago, up to a week; then the date."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    said = lambda n, unit: F.concat(n.cast("string"), F.when(n > 1, f" {unit}s ago").otherwise(f" {unit} ago"))
    part = lambda k: F.floor(seconds / k + 0.5)
    return (
        F.when(seconds >= 7 * 86400, F.date_format(then, "MMM d, yyyy"))
        .when(seconds < 0, F.lit("1 second ago"))
        .when(seconds < 60, said(seconds, "second"))
        .when(part(60) < 60, said(part(60), "minute"))
        .when(part(3600) < 24, said(part(3600), "hour"))
        .otherwise(said(part(86400), "day"))
    )


def clean_leaf(column: Column) -> Column:
    """Last segment, between dots or angle brackets, that isn't blank; empty if there is none."""
    parts = F.filter(F.transform(F.split(column, "[.>]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def is_blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def letters_and_digits(column: Column) -> Column:
    """Key under which display names are compared."""
    return F.lower(F.regexp_replace(column, "[^a-zA-Z0-9]+", ""))


def without_system_marks(column: Column) -> Column:
    """False for keys of system fields."""
    return ~F.contains(column, F.lit("__"))
