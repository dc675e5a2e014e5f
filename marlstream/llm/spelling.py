"""Spelling variant grouping by bands of letter-parity masks.

A word's mask has a bit for each letter that it holds an odd number of times. Putting a letter in or leaving one out flips
one bit, replacing one flips two at most; so of three bands of the mask at least one is equal in two near words. Words meet
by an equi-join on equal bands, with the length as a part of the key, and each meeting is verified.

1. Words are found, damaged and counted in the tasks, block by block; Spark adds the counts.
2. A band alone has few values and would bring together a part of all words that doesn't shrink as the vocabulary grows:
   in 280,000 words of the check's tables 3 * 10 ** 9 pairs meet. So its group is split by what the edit leaves alone: it
   falls into one of PARTS parts of the longer word, counted in letters, and the rest is equal in both. The key is
   (length of the longer word, part, rest, band); 8 * 10 ** 6 pairs meet in the same words and no near pair is lost, as
   each near pair has an equal band and an equal rest.
3. A pair meets for each equal band and, in runs of a letter, for two parts; it is kept for the first of them. The masks
   must differ in two bits at most, and the edit distance must be one.
4. A word's form is its most frequent near word if that occurs RATIO times as often as itself. Forms are followed by pointer
   doubling; counts at least double along them, so the rounds are few.

Defined cases: a null or empty text has no words; a null id counts as an empty one when words are damaged; repeated rows
are counted each; ties go to the smaller word in code-point order; an empty table has no words; texts of any length are
read in blocks; only the named columns are used, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, table, written
from marlstream.llm.runs import BLOCK, crc32_sql, crcs, joined_crcs, runs

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
PARTS = 3
BANDS = 3
#: one run in so many, by the CRC-32 of id and run, loses a letter; None damages nothing
DAMAGE = 97
#: bits for U+00C0 to U+00FF; two letters on one bit only make the mask coarser
_OTHER_BITS = 31

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _letters(data: np.ndarray) -> np.ndarray:
    lead = data == _LEAD
    own = _ASCII[data] | lead
    own[1:] |= lead[:-1]
    return own


def _damaged(word: str, crc: int) -> str:
    k = crc % len(word)
    return word[:k] + word[k + 1 :]


def _count(damage: int | None):
    def count(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", 4 * BLOCK):
                ids = [f"{'' if i is None else i}:".encode() for i in batch.column("doc_id").to_pylist()]
                prefix = np.frombuffer(b"".join(ids), np.uint8)
                ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
                id_crc = crcs(prefix, ends - [len(i) for i in ids], ends) if damage else None
                data, offsets = utf8(batch.column("text"))
                for block, start, end, doc in runs(data, offsets, _letters, BLOCK):
                    if not len(start):
                        continue
                    low, length = _LOWER[block], end - start
                    own = np.zeros(len(block) + 1, np.int32)
                    own[start] += 1
                    own[end] -= 1
                    joined = low[np.cumsum(own[:-1]).astype(bool)]
                    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
                    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(joined))
                    more = []
                    if damage:
                        crc = joined_crcs(id_crc[doc], crcs(low, start, end), length)
                        hit = crc % np.uint32(damage) == 0
                        more = [_damaged(w, int(c)) for w, c in zip(found.filter(pa.array(hit)).to_pylist(), crc[hit], strict=True)]
                        found = found.filter(pa.array(~hit))
                    for words in (found, pa.array(more, pa.large_string())):
                        counts = pc.value_counts(words)
                        yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], ["word", "n"])

    return count


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count(damage), "word string, n long").where(F.char_length("word") >= least_letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mask(word: Column) -> Column:
    bit = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(26 + (F.ascii(c) - 0xC0) % _OTHER_BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))))


def _band(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(sum(1 << b for b in range(i, 26 + _OTHER_BITS, BANDS))))


def _rest(word: Column, longer: Column, part: int, less: int) -> Column:
    """A word without its part; it has `less` letters less than the longer word, from that part."""
    at = lambda i: F.floor(longer * i / PARTS).cast("int")
    return F.concat(F.substring(word, F.lit(1), at(part)), F.lit("\0"), F.substring(word, at(part + 1) + (1 - less), longer))


def _keys(words: DataFrame, less: int) -> DataFrame:
    """A row for each part and band under which a word waits for a partner, the longer word having `less` letters more."""
    longer = F.col("length") + less
    keys = [
        F.struct(F.xxhash64(longer, F.lit(part), _rest(F.col("word"), longer, part, less), F.lit(band), _band(F.col("mask"), band)).alias("key"), F.lit(part).alias("part"), F.lit(band).alias("band"))
        for part in range(PARTS) for band in range(BANDS)
    ]
    return words.select("word", "n", "mask", "length", F.explode(F.array(*keys)).alias("k")).select("word", "n", "mask", "length", "k.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all near words of (word, n), each pair once."""
    words = written(words.select("word", "n", _mask(F.col("word")).alias("mask"), F.char_length("word").alias("length")))
    longer = _keys(words, 0).toDF(*[f"b_{c}" for c in ("word", "n", "mask", "length", "key", "part", "band")])
    waiting = _keys(words, 0).unionByName(_keys(words, 1))
    a, b = F.col("word"), F.col("b_word")
    # of two words of one length the smaller is a
    turned = (F.col("length") < F.col("b_length")) | (a < b)
    met = waiting.join(longer, (F.col("key") == F.col("b_key")) & (F.col("part") == F.col("b_part")) & (F.col("band") == F.col("b_band")) & turned)
    both = F.col("mask").bitwiseXOR(F.col("b_mask"))
    first_band = [F.when(F.col("band") > i, _band(both, i) != 0).otherwise(True) for i in range(BANDS - 1)]
    less, size = F.col("b_length") - F.col("length"), F.col("b_length")

    def same_rest(part):
        own = F.when(less == 0, _rest(a, size, part, 0)).otherwise(_rest(a, size, part, 1))
        return own == _rest(b, size, part, 0)

    first_part = [F.when(F.col("part") > i, ~same_rest(i)).otherwise(True) for i in range(PARTS - 1)]
    kept = met.where((less >= 0) & (less <= 1) & (F.bit_count(both) <= 2))
    for rule in (*first_band, *first_part, F.levenshtein(a, b, 1) == 1):
        kept = kept.where(rule)
    found = written(kept.select(a.alias("a"), F.col("n").alias("a_n"), b.alias("b"), F.col("b_n")))
    dropped(words)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("to")))
    while True:
        onward = now.select(F.col("word").alias("at"), F.col("to").alias("next"))
        step = written(now.select("word", "to").join(onward, F.col("to") == F.col("at"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        dropped(now)
        if step.where("moved").isEmpty():
            return step.select("word", F.col("to").alias("root"))
        now = step


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = written(words.select("word", "n"))
    pairs = near_pairs(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = pairs.select(F.explode(ways).alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.m")).alias("m"), F.col("x.other").alias("other"))).alias("best"))
    best = -F.col("best.m")
    told = written(
        words.join(near, "word", "left")
        .withColumn("taken", F.coalesce(best >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("best.other")).alias("form"), F.when(F.col("taken"), best).alias("form_n"))
    )
    dropped(words, pairs)
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int | None = None) -> DataFrame:
    """The spelling variants of the words of docs' texts."""
    return variants(vocabulary(docs, least_letters, least_count, damage), ratio)


def op11_spelling_variants(spark, sf_dir):
    return grouped(table(spark, sf_dir, "documents"), damage=DAMAGE)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE = {
    "op11_spelling_variants": f"""
    WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
    k AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w),
    h AS (SELECT w, n, {crc32_sql("doc_id || ':' || w")} AS h FROM k),
    d AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
          UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
    b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * v.n THEN (SELECT min(other) FROM p WHERE p.word = v.word AND p.m = b.m) END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n
          FROM v LEFT JOIN b USING (word)),
    t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
    SELECT f.word, form, t.root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
    """
}
