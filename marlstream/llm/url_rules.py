"""URL filters: listed rules first, then association rules mined from labelled URLs.

A URL is turned into a set of tokens (scheme, registered domain, host labels, path segments, extension, query
keys). Token sets that are frequent together with a "block" label are mined; those whose confidence is high enough
become rules, and a rule is dropped if a shorter one inside it is at least as confident. URLs are matched through an
inverted index: a rule is listed under its rarest token, and fires when all its tokens are found. Only distinct token
sets are matched, so a host with a third of all URLs costs one row there.

A URL of n tokens has 2 ** n sets, so not all of them may be made:

* Tokens that are in exactly the same labelled URLs are one class, and sets of classes are mined. Such tokens stand for
  each other in a rule, and no rule that stays has two of them.
* Where no labelled URL has more than FP_CLASSES frequent classes, Spark's FP-growth gives the frequent sets, 2 **
  FP_CLASSES of a URL at most. Longer URLs are grown by the same pattern growth, a class at a time, from sets that may
  still be in a rule that stays: with a set that is in just the URLs of a smaller one, or that is always blocked, all that
  hold it go. Both ways give the same rules.
* Whether a rule is dropped is found level by level: a set takes the best confidence inside it from its sets of one class
  less.

Defined cases: a null URL or one without "://" has empty host and path and no tokens, and is allowed; repeated
rows each get their verdict; labels whose both flags are null teach nothing; several label rows of one page count
as block if any of them blocks; without labelled URLs there are no mined rules. Of the input tables only the
named columns are used, so further columns can't clash.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.llm.common import dropped, lower_ascii, table, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
BLOCK = "!block"
#: frequent classes of a URL up to which FP-growth is used
FP_CLASSES = 12
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null where none fits. Rules are a parameter of the
    job, one predicate each, so neither a join nor a shuffle is needed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; numbers inside a path segment are all one token."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)
    number = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    parts = [
        F.when(scheme != "", F.array(F.concat(F.lit("s:"), lower_ascii(scheme)))),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))),
        F.transform(F.when(F.size(labels) >= 3, F.slice(labels, 1, F.size(labels) - 2)), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("p:"), number(x))),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
    ]
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in parts]))))


def _classes(sets: DataFrame, least: int) -> DataFrame:
    """(token, class) of the tokens in `least` blocked URLs or more; equal classes are in the same sets (tokens, n, n_block).
    There are 1 / min_support times as many as a URL has tokens on average, at most, whatever the number of URLs."""
    token = sets.select(F.explode("tokens").alias("token"), "n", "n_block", F.xxhash64("tokens").alias("x"), F.xxhash64(F.lit(1), "tokens").alias("y"))
    where = ["n_all", "n_block", "x", "y"]
    frequent = written(token.groupBy("token").agg(F.sum("n").alias("n_all"), F.sum("n_block").alias("n_block"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("n_block") >= least))
    named = frequent.groupBy(*where).agg(F.min("token").alias("class"))
    return written(frequent.join(named, where).select("token", "class"))


def _of_classes(sets: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """(tokens, *more, classes): the sorted classes of each set's tokens, one for each token."""
    each = sets.select("tokens", *more, F.explode("tokens").alias("token")).join(F.broadcast(classes), "token")
    return each.groupBy("tokens", *more).agg(F.array_sort(F.collect_list("class")).alias("classes"))


def _by_fp_growth(labelled: DataFrame, least: int):
    """Levels of frequent sets of rows (classes, n, n_block), all mined at once."""
    copies = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))
    items = labelled.select(F.concat("classes", F.array(F.lit(BLOCK))).alias("items"), F.explode(copies(F.col("n_block")))).union(labelled.select("classes", F.explode(copies(F.col("n") - F.col("n_block"))))).select("items")
    n = items.count()
    frequent = written(FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=1.0).fit(items).freqItemsets)
    blocked = F.array_contains("items", BLOCK)
    alone = frequent.where(~blocked).select(F.array_sort("items").alias("set"), F.col("freq").alias("n_all"))
    together = frequent.where(blocked & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("set"), F.col("freq").alias("n_block"))
    sets = written(alone.join(together, "set"))
    dropped(frequent)
    return lambda k, before: sets.where(F.size("set") == k)


def _by_growth(labelled: DataFrame, least: int):
    """Levels of frequent sets of rows (classes, n, n_block), each grown from the one before."""
    last = labelled.select("*", F.array().cast("array<string>").alias("set"))

    def level(k: int, before: DataFrame | None) -> DataFrame:
        nonlocal last
        grown = last if before is None else last.join(before.select("set"), "set", "left_semi")
        later = F.filter("classes", lambda x: x > F.coalesce(F.get("set", F.size("set") - 1), F.lit("")))
        wider = written(grown.select("classes", "n", "n_block", "set", F.explode(later).alias("c")).withColumn("set", F.concat("set", F.array("c"))).drop("c"))
        dropped(last)
        last = wider
        return last.groupBy("set").agg(F.sum("n").alias("n_all"), F.sum("n_block").alias("n_block")).where(F.col("n_block") >= least)

    return level


def _minimal(level_of, min_confidence: float) -> tuple[DataFrame, list[DataFrame]]:
    """(set, n_all, confidence) of the rules that no rule inside them equals in confidence; and the stored levels that they
    are read from."""
    levels, before, k = [], None, 0
    confidence = F.col("n_block") / F.col("n_all")
    rule = confidence >= min_confidence
    while before is None or not before.isEmpty():
        k += 1
        sets = level_of(k, before).withColumn("inside", F.lit(None).cast("double"))
        if before is not None:
            less = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("set", lambda x, j: j != i))
            smaller = before.select(F.col("set").alias("less"), F.col("n_all").alias("n_less"), "best")
            sets = (
                sets.select("set", "n_all", "n_block", F.explode(less).alias("less")).join(smaller, "less").where("n_less > n_all")
                .groupBy("set", "n_all", "n_block").agg(F.max("best").alias("inside"), F.count("*").alias("m")).where(F.col("m") == k)
            )
        stays = rule & (F.col("inside").isNull() | (F.col("inside") < confidence))
        level = written(sets.select("set", "n_all", "n_block", confidence.alias("confidence"), stays.alias("stays"), F.greatest("inside", F.when(rule, confidence)).alias("best")))
        levels.append(level)
        before = level.where("n_block < n_all")
    rules = levels[0]
    for more in levels[1:]:
        rules = rules.unionByName(more)
    return rules.where("stays").select("set", "n_all", "confidence"), levels


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (listed, set, confidence) and classes (token, class) from rows (tokens, blocked). A set holds one class or
    more, and any token of a class will do; listed is the rarest of them."""
    sets = written(labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("n_block")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(Fraction(str(min_support)) * total))
    classes = _classes(sets, least)
    # URLs that have the same classes are one row
    kinds = _of_classes(sets, classes, "n", "n_block").select(F.array_distinct("classes").alias("classes"), "n", "n_block")
    mapped = written(kinds.groupBy("classes").agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block")))
    longest = mapped.agg(F.max(F.size("classes"))).first()[0]
    if longest is None:
        return classes.select(F.col("class").alias("listed"), F.array("class").alias("set"), F.lit(0.0).alias("confidence")).where("false"), classes
    rules, levels = _minimal((_by_fp_growth if longest <= FP_CLASSES else _by_growth)(mapped, least), min_confidence)
    frequency = mapped.select(F.explode("classes").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("often"))
    each = rules.select("set", "confidence", F.explode("set").alias("c")).join(F.broadcast(frequency), "c")
    rules = written(each.groupBy("set", "confidence").agg(F.min_by("c", F.struct("often", "c")).alias("listed")))
    dropped(sets, mapped, *levels)
    return rules, classes


def fired(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Of distinct rows (tokens), those on which a rule fires: (tokens, n_fired, confidence). Each choice of tokens that
    makes a rule fire counts."""
    own = _of_classes(token_sets, classes)
    probe = own.select("tokens", "classes", F.explode(F.array_distinct("classes")).alias("listed")).join(rules, "listed")
    all_found = F.forall("set", lambda c: F.array_contains("classes", c))
    ways = F.aggregate("set", F.lit(1).cast("long"), lambda x, c: x * F.size(F.filter("classes", lambda y: y == c)))
    return probe.where(all_found).groupBy("tokens").agg(F.sum(ways).alias("n_fired"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_fired) for every row of pages."""
    seen = written(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")))
    flags = (
        labels.where("toxic IS NOT NULL OR quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("blocked"))
    )
    labelled = seen.select("page_id", "tokens").where(F.size("tokens") > 0).join(flags, "page_id")
    mined, classes = mine(labelled, min_support, min_confidence)
    # written, so that Spark can split the join where one token set has very many pages
    hits = written(fired(seen.select("tokens").where(F.size("tokens") > 0).distinct(), mined, classes))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    return seen.join(hits, "tokens", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("n_fired") > 0, "block").otherwise("allow")).alias("verdict"), F.coalesce("n_fired", F.lit(0)).cast("long").alias("n_fired")
    )


def op9_url_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in ordered) + " END"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH u AS (
      SELECT page_id, coalesce(url, '') AS url,
             {low("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    t0 AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS hl,
             list_filter(string_split(path, '/'), lambda x: x <> '') AS sg,
             list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> '') AS ks,
             regexp_extract(url, '(?s)^(.*?)://', 1) AS sc FROM u),
    t AS (SELECT page_id, host, path, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_sort(list_distinct(
             (CASE WHEN sc <> '' THEN ['s:' || {low('sc')}] ELSE [] END)
             || (CASE WHEN len(hl) >= 2 THEN ['d:' || hl[len(hl) - 1] || '.' || hl[len(hl)]] ELSE [] END)
             || (CASE WHEN len(hl) >= 3 THEN list_transform(hl[1:len(hl) - 2], lambda x: 'h:' || x) ELSE [] END)
             || list_transform(sg, lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
             || list_transform(ks, lambda x: 'q:' || x))) END AS tokens FROM t0),
    f AS (SELECT doc_id AS page_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS blocked
          FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY 1),
    l AS (SELECT tokens, blocked FROM t JOIN f USING (page_id) WHERE len(tokens) > 0),
    n AS (SELECT ceil({MIN_SUPPORT} * count(*)) AS least FROM l),
    s AS (SELECT list_filter(tokens, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS a, blocked
          FROM (SELECT tokens, blocked, unnest(range(1, (1 << len(tokens))::BIGINT)) AS m FROM l)),
    c AS (SELECT a, count(*) AS n_all, count(*) FILTER (WHERE blocked) AS n_block FROM s GROUP BY a),
    r AS (SELECT a, n_block::DOUBLE / n_all AS confidence FROM c, n
          WHERE n_block >= least AND n_block > 0 AND n_block::DOUBLE / n_all >= {MIN_CONFIDENCE}),
    p AS (SELECT * FROM r b WHERE NOT EXISTS (SELECT 1 FROM r a WHERE len(a.a) < len(b.a) AND a.confidence >= b.confidence AND list_has_all(b.a, a.a))),
    d AS (SELECT DISTINCT tokens FROM t),
    h AS (SELECT tokens, count(*) AS n_fired FROM d JOIN p ON list_has_all(d.tokens, p.a) GROUP BY tokens)
    SELECT page_id, host, path, {rule} AS rule,
           coalesce({verdict}, CASE WHEN n_fired > 0 THEN 'block' ELSE 'allow' END) AS verdict,
           coalesce(n_fired, 0)::BIGINT AS n_fired
    FROM t LEFT JOIN h USING (tokens)
    """


QUERIES = {"op9_url_rules": op9_url_rules}
ORACLE = {"op9_url_rules": _oracle()}
