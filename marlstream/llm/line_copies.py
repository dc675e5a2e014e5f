"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is its words, joined by single spaces. It is removed if an equal line, or one that differs by one word
(put in, left out or replaced), starts earlier in the corpus: at a smaller (doc_id, line number). Lines are judged
on the input, not on what is left. The edit bound is one word in lines of MIN_WORDS words or more and none in
shorter ones, of which one word is too large a part; lines without words always stay.

1. Every line is hashed, and a pre-aggregated group-by finds each distinct line's first place.
2. Two lines within the bound share their first half or their last half, counted in words of the shorter one, so
   lines whose halves no other line has can't have a neighbour. Of the others the words are fetched, and the same
   is asked of all parts but one of PARTS parts. This loses nothing and leaves a few per cent.
3. Those emit a hashed key for the line itself and for each variant with one word left out. The sum of a hash of
   (place, word) is the key, so running sums give all variants of a line of any length in one pass. Keys that
   occur once go.
4. Equal keys are joined. Lines that lose the word at the same place are all neighbours of one another, as a line
   is of those that give it by losing a word; so each key needs only its earliest line for each place, and no key
   emits all pairs. The earliest neighbour found is verified on the words themselves.

Defined cases: a null text has no lines and stays null; an empty text has one empty line; a null doc_id comes
before all others; repeated rows (same id and text) are one document and get equal results; rows of one id with
different texts are ordered by a hash of the text; only the named columns are used and replaced, so further
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstream.llm.common import dropped, of_ids, table, written

MIN_WORDS = 5
#: parts of a line of which an edit changes one
PARTS = 8
_SPACE = r"[\x20\x09-\x0D]+"
#: sums of place hashes stay far below the range of a long
_PLACE_BITS = 43


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, _SPACE), "")


def _row_id() -> Column:
    """With the id it tells a row from others of that id."""
    return F.xxhash64("doc_id", "text")


def _halves(words: Column) -> list[Column]:
    """Hashes of the first and the last half, and of the one that is shorter by a word in a line of a word less."""
    n = F.size(words)
    h = F.floor(n / 2).cast("int")
    shorter = F.when(n % 2 == 1, F.slice(words, h + 2, h)).otherwise(F.slice(words, F.lit(1), h - 1))
    halves = (F.slice(words, F.lit(1), h), F.slice(words, h + 1, n - h), shorter)
    return [F.when(n >= MIN_WORDS, F.xxhash64(x)).alias(f"half{i}") for i, x in enumerate(halves)]


def _half_keys() -> Column:
    """Keys of both halves, for partners of the same length and of one word less."""
    n, odd = F.col("n_words"), F.col("n_words") % 2 == 1
    first, last, shorter = (F.col(f"half{i}") for i in range(3))
    key = lambda half, length, side: F.xxhash64(half, length, F.lit(side))
    less = (F.when(odd, first).otherwise(shorter), F.when(odd, shorter).otherwise(last))
    return F.array(key(first, n, 0), key(last, n, 1), key(less[0], n - 1, 0), key(less[1], n - 1, 1))


def _part_keys(words: Column) -> Column:
    """Keys of all but one of PARTS parts, for partners of the same length and of one word less: the line with a word more
    has it in the part that is left out."""
    n = F.size(words)

    def keys(length, more):
        edge = lambda i: F.floor(length * i / PARTS).cast("int")
        for i in range(PARTS):
            before, after = F.slice(words, F.lit(1), edge(i)), F.slice(words, edge(i + 1) + more + 1, length - edge(i + 1))
            yield F.xxhash64(length, F.lit(i), before, F.lit(0), after)

    return F.array(*keys(n, 0), *keys(n - 1, 1))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, no, k1, k2, n_words, half0, half1, half2) of every line that has words; k1 and k2 are hashes of the
    line."""
    # the filter is on the line, not on its words, as Spark would then find the words twice
    # and the hash of the whole text is made before the text is split, not for each line
    exploded = docs.select("doc_id", "text", _row_id().alias("row")).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("words")
    return exploded.withColumn("words", words_of(F.col("line"))).select(
        "doc_id", "row", "no", F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(7), words).alias("k2"), F.size(words).alias("n_words"), *_halves(words)
    )


def _shared(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The members of keys that have more than one. The counts are pre-aggregated and a join finds the members, which
    Spark can split where a key is hot."""
    many = rows.groupBy(key).agg((F.min(member) != F.max(member)).alias("many")).where("many").select(key)
    return rows.join(many, key, "left_semi").select(member).distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(k1, k2, at, key1, key2) from (k1, k2, words): at is the place of the word left out, from 1, and 0 for the whole
    line."""
    line = ["k1", "k2"]
    each = lines.select(*line, F.posexplode("words").alias("p", "word"))
    upto = Window.partitionBy(*line).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda p, seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p, F.col("word")), 64 - _PLACE_BITS)
    each = each.select(*line, "p", *[place(F.col("p") - back, seed).alias(f"h{seed}{back}") for seed in (0, 1) for back in (0, 1)])
    every = Window.partitionBy(*line)
    keys = []
    for seed in (0, 1):
        own, moved = F.col(f"h{seed}0"), F.col(f"h{seed}1")
        keys.append((F.sum(own).over(upto) - own + F.sum(moved).over(every) - F.sum(moved).over(upto)).alias(f"key{seed + 1}"))
    # the whole line comes with its first word
    whole = [F.sum(f"h{seed}0").over(every).alias(f"whole{seed + 1}") for seed in (0, 1)]
    found = each.select(*line, (F.col("p") + 1).alias("at"), *keys, *whole)
    own = F.struct("at", "key1", "key2")
    both = F.when(F.col("at") == 1, F.array(own, F.struct(F.lit(0).alias("at"), F.col("whole1").alias("key1"), F.col("whole2").alias("key2")))).otherwise(F.array(own))
    return found.select(*line, F.explode(both).alias("v")).select(*line, "v.*")


def _without(words: Column, at: Column) -> Column:
    return F.when(at == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0)))))


def _words(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, k2, first, words) of distinct lines (k1, k2, first)."""
    places = lines.groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("k1", "k2", "first")).alias("lines"))
    own = of_ids(docs, places.select("doc_id").distinct()).select(F.col("doc_id").alias("__id"), _row_id().alias("__row"), "text")
    texts = own.join(places, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row")))
    # an explode after the join: only the lines asked for leave the document. The text is split once, as the one element
    # of another: of a mere column Spark would make it a part of the expression for each line
    split = texts.select("lines", F.explode(F.array(F.split("text", "\n"))).alias("split"))
    return split.select("split", F.explode("lines").alias("x")).select("x.k1", "x.k2", "x.first", words_of(F.get("split", F.col("x.first.no"))).alias("words")).dropDuplicates(["k1", "k2"])


def _near(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, k2) of the distinct lines that have an earlier neighbour."""
    halves = distinct.where("half0 IS NOT NULL").select("k1", F.explode(_half_keys()).alias("half"))
    might = written(distinct.join(_shared(halves, "half", "k1"), "k1", "left_semi").select("k1", "k2", "first"))
    fetched = written(_words(might, docs))
    parts = fetched.select("k1", F.explode(_part_keys(F.col("words"))).alias("part"))
    lines = written(fetched.join(_shared(parts, "part", "k1"), "k1", "left_semi"))
    dropped(might, fetched)
    key, line = ["key1", "key2"], ["k1", "k2"]
    every = written(_variants(lines.select(*line, "words")))
    again = every.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    variants = written(every.join(again, key, "left_semi").join(lines.select(*line, "first"), line))
    dropped(every)
    left_out, whole = variants.where("at > 0"), variants.where("at = 0")
    here = F.struct("first", *line)
    at_same = left_out.groupBy(*key, "at").agg(F.min(here).alias("v"), F.count("*").alias("n")).where("n > 1").select(*key, "at", "v")
    of_any = left_out.groupBy(*key).agg(F.min(F.struct("first", *line, "at")).alias("v"))
    own = [*line, "first", "at"]
    found = (
        left_out.join(at_same, [*key, "at"]).select(*own, "v.first", "v.k1", "v.k2", "at")
        .union(left_out.join(whole.select(*key, here.alias("v")), key).select(*own, "v.first", "v.k1", "v.k2", F.lit(0)))
        .union(whole.join(of_any, key).select(*own, "v.first", "v.k1", "v.k2", "v.at"))
        .toDF("k1", "k2", "first", "at", "v_first", "v_k1", "v_k2", "v_at")
        .where(F.col("v_first") < F.col("first"))
        .groupBy(*line).agg(F.min(F.struct("v_first", "v_k1", "v_k2", "at", "v_at")).alias("v")).select(*line, "v.*")
    )
    own = lines.select(*line, "words")
    other = lines.select(F.col("k1").alias("v_k1"), F.col("k2").alias("v_k2"), F.col("words").alias("v_words"))
    near = written(found.join(own, line).join(other, ["v_k1", "v_k2"]).where(_without(F.col("words"), F.col("at")) == _without(F.col("v_words"), F.col("v_at"))).select(*line))
    dropped(variants, lines)
    return near


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, removed): for each document that loses lines, their numbers."""
    lines = written(lines_of(docs))
    place, line = F.struct("doc_id", "no", "row"), ["k1", "k2"]
    once = [F.first(c).alias(c) for c in ("n_words", "half0", "half1", "half2")]
    distinct = written(lines.groupBy(*line).agg(F.min(place).alias("first"), F.count("*").alias("n"), *once))
    near = _near(distinct, docs)
    again = written(distinct.join(near.withColumn("near", F.lit(True)), line, "left").where("n > 1 OR near").select(*line, "first", F.coalesce("near", F.lit(False)).alias("near")))
    dropped(distinct, near)
    gone = lines.select(*line, "doc_id", "no", "row").join(again, line).where(F.col("near") | (place != F.col("first")))
    found = written(gone.groupBy("doc_id", "row").agg(F.collect_set("no").alias("removed")))
    dropped(lines, again)
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """docs with `text` rid of repeated lines, and n_lines and n_removed; the other columns stay."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__hash"), F.col("removed").alias("__removed"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    own = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn("__row", _row_id())
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")), "left").withColumn("__lines", lines)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rest],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Pipeline stage: texts without their repeated lines; a document that loses all lines with words goes."""
    found = dedup(docs)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.where((F.col("n_removed") == 0) | has_words).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {
    "op2_line_dedup": rf"""
    WITH l AS (SELECT doc_id, text, i - 1 AS no, list_filter(regexp_split_to_array(string_split(text, chr(10))[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
               FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    d AS (SELECT w, min((doc_id, no)) AS first FROM l WHERE len(w) > 0 GROUP BY w),
    v AS (SELECT w, first, i, CASE WHEN i = 0 THEN array_to_string(w, ' ') ELSE array_to_string(w[:i - 1] || w[i + 1:], ' ') END AS k
          FROM (SELECT *, unnest(range(0, len(w) + 1)) AS i FROM d WHERE len(w) >= {MIN_WORDS})),
    same AS (SELECT k, i, min(first) AS least FROM v WHERE i > 0 GROUP BY ALL),
    whole AS (SELECT k, first AS least FROM v WHERE i = 0),
    part AS (SELECT k, min(first) AS least FROM v WHERE i > 0 GROUP BY ALL),
    near AS (SELECT DISTINCT w FROM (
        SELECT w FROM v JOIN same USING (k, i) WHERE least < first
        UNION ALL SELECT w FROM v JOIN whole USING (k) WHERE i > 0 AND least < first
        UNION ALL SELECT w FROM v JOIN part USING (k) WHERE i = 0 AND least < first)),
    g AS (SELECT l.doc_id, l.text, l.no, len(l.w) > 0 AND ((l.doc_id, l.no) <> d.first OR near.w IS NOT NULL) AS gone
          FROM l LEFT JOIN d ON l.w = d.w LEFT JOIN near ON l.w = near.w),
    r AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                 coalesce(string_agg(string_split(text, chr(10))[no + 1], chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept FROM g GROUP BY doc_id, text)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN documents.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
    FROM documents LEFT JOIN r USING (doc_id, text)
    """
}
