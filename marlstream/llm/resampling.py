"""Target-distribution importance resampling: draws the documents that look most like a target, with noise.

Features are all runs of one and two consecutive words, hashed into buckets by CRC-32. Two passes over the texts:

1. Each task adds its texts' bucket numbers up with np.bincount into one vector of BUCKETS counts; treeReduce merges
   the tasks' vectors, so the driver gets a few vectors whatever the number of tasks. The target is counted likewise.
   A bucket's gain is the scaled log ratio of its smoothed shares in the target and in all documents.
2. The gains (BUCKETS integers) are broadcast. Each feature gathers its bucket's gain, and np.bincount with these as
   weights sums them by document. Texts aren't shuffled in either pass.

Adding Gumbel noise that depends on the id alone and taking the highest scores is drawing without replacement by weight.
The scores are ranked by a range sort of rows without texts and per-task totals.

Defined cases: a null or empty text, or one without words, has no features and weight 0; a null id is hashed as an empty
one and comes before all others among ties; repeated rows are documents of their own and are drawn one by one, and ties
of one id go to the smaller hash of the text; with an empty target or without documents the smoothing alone decides;
texts of any length are read in blocks; further columns can't clash, as only the named ones are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import table, written
from marlstream.llm.runs import BLOCK, crc32_sql, crcs, joined_crcs, runs
from marlstream.operators.windows import numbered

BUCKETS = 10_000
SCALE = 1000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = np.uint32(0xE96CCF45)  # CRC-32 of one space


def _features(batch: pa.RecordBatch):
    """(text number, bucket) of all features of a batch, block by block."""
    data, offsets = utf8(batch.column("text"))
    last_doc, last_crc = -1, np.uint32(0)
    for block, start, end, doc in runs(data, offsets, lambda x: _WORD[_LOWER[x]], BLOCK):
        if not len(start):
            continue
        length = end - start
        one = crcs(_LOWER[block], start, end)
        before, of = np.concatenate([[last_crc], one[:-1]]).astype(np.uint32), np.concatenate([[last_doc], doc[:-1]])
        two = np.flatnonzero(of == doc)
        behind = joined_crcs(np.full(len(two), _SPACE), one[two], length[two])
        pairs = joined_crcs(before[two], behind, length[two] + 1)
        yield np.concatenate([doc, doc[two]]), np.concatenate([one, pairs]) % np.uint32(BUCKETS)
        last_doc, last_crc = doc[-1], one[-1]


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for batch in batches_of(whole, "text", 4 * BLOCK):
            for _, bucket in _features(batch):
                total += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def _text() -> Column:
    return F.coalesce("text", F.lit("")).alias("text")


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    vectors = docs.select(_text()).mapInArrow(_count, "counts binary").rdd.map(lambda row: np.frombuffer(row.counts, np.int64))
    return vectors.treeReduce(lambda a, b: a + b) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs with n_features and weight, the floored mean gain of a document's features; the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_features", "weight")], F.col("text").isNull().alias("__null"))

    def weigh(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", 4 * BLOCK):
                n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for doc, bucket in _features(batch):
                    n += np.bincount(doc, minlength=batch.num_rows)
                    total += np.bincount(doc, shared.value[bucket], batch.num_rows)
                weight = total.astype(np.int64) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("rest"), pa.array(n), pa.array(weight)], ["text", "rest", "n_features", "weight"])

    asked = docs.select(_text(), rest.alias("rest"))
    found = asked.mapInArrow(weigh, StructType([*asked.schema, StructField("n_features", LongType()), StructField("weight", LongType())]))
    own = {"text": F.when(~F.col("rest.__null"), F.col("text")).alias("text")}
    return found.select(*[own.get(c, F.col(f"rest.`{c}`")) for c in docs.columns if c not in ("n_features", "weight")], "n_features", "weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, scaled as the gains are."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, n_features, weight, score, rank) of every document, without its text: rank is null unless it is among
    the `percent` of those with enough words that are drawn. row is a hash of the text."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    scored = weighted(own, gain).select("doc_id", "row", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    # a place of their own for rows that are equal in all, so that the range sort can part them
    scored = written(scored.withColumn("place", F.monotonically_increasing_id()))
    enough = F.col("n_features") >= 2 * least_words - 1
    most = percent * scored.where(enough).count() // 100
    rank = numbered(scored.where(enough), [F.desc("score"), F.asc_nulls_first("doc_id"), "row", "place"], "rank")
    columns = ["doc_id", "row", "n_features", "weight", "score"]
    drawn = rank.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents with all their columns. Of rows that are equal in id and text all are kept if one is drawn."""
    drawn = ranked(docs, target, percent, seed, least_words).where("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left_semi")


def op13_importance_resampling(spark, sf_dir):
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}


def _features_sql(table: str, key: str) -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {key}, {words} AS w FROM {table})"


ORACLE = {
    "op13_importance_resampling": f"""
    WITH s AS ({_features_sql("documents", "doc_id")}), t AS ({_features_sql("benchmark", "item_id")}),
    b AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM s UNION SELECT f FROM t)),
    c AS (SELECT bucket, sum(source)::BIGINT AS s, sum(target)::BIGINT AS t
          FROM (SELECT f, 1 AS source, 0 AS target FROM s UNION ALL SELECT f, 0, 1 FROM t) JOIN b USING (f) GROUP BY bucket),
    g AS (SELECT bucket, floor({SCALE} * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS gain FROM c),
    w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM s JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
    h AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('{SEED}:' || doc_id)[i]) - 1)::BIGINT), lambda a, v: a * 16 + v) AS h
          FROM documents LEFT JOIN w USING (doc_id)),
    r AS (SELECT doc_id, n_features, weight, weight + floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
    n AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= {2 * LEAST_WORDS - 1})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM r LEFT JOIN n USING (doc_id)
    """
}
