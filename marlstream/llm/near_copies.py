"""MinHash near-dedup.

1. One pass makes each document's set of 5-word shingles (64-bit fingerprints), a fingerprint of the whole set, and
   from BANDS * ROWS universal hash minima the keys of the BANDS bands and an 8-bit signature. Documents with equal
   sets are one class, with a number of its own, and only its smallest id goes on.
2. Band buckets with more than one class give candidates. No bucket emits all pairs: first each member is paired
   with the bucket's smallest id. Pairs whose signatures agree too little to be links are dropped, the others are
   verified on the full sets. Verified links make components (large-star and small-star).
3. A bucket whose members are then in several components may hide links between them. In one of SMALL members at
   most, each meets those of other components directly, SMALL - 1 at most. The documents of larger ones go through
   an exact prefix filter instead: with each set's shingles in order of rarity, two sets of x and y shingles that are similar
   enough have ceil(0.75 / 1.75 (x + y)) in common, so they share one early in that order, at places that leave
   enough shingles behind both. Keys are made for each pair of size classes, so that most documents of a large
   group of nearly similar ones emit none, and a passage common to many otherwise different documents none at all.
4. All verified links together make the final components.

At a similarity of 0.75 a pair shares no band with a probability of 1e-6; signatures lose one in 1e9.

Defined cases: a null text and one without words have an empty set and link with nothing; a document whose doc_id
is null links with nothing, has a null component and is kept; rows that repeat a doc_id are one document, with the
links of all of them that have words, whatever their texts; only the named columns are used, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, of_ids, table, written
from marlstream.llm.components import components
from marlstream.llm.hashing import LOWER, coefficients, mixed, sequence_hashes, word_hashes, words

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 50, 5
#: members of a bucket that still meet one another directly
SMALL = 16
#: sizes within one class differ by this factor at most
CLASS = 1.05
BATCH_BYTES = 2 << 20
#: agreement of signatures below which a pair can't be a link: 0.75 less six standard deviations
LEAST_AGREEMENT = 0.75 - 6 * (0.75 * 0.25 / (BANDS * ROWS)) ** 0.5


def _sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct shingles of each text."""
    data = LOWER[data]
    start, end, of = words(data, offsets)
    hashes = word_hashes(data, start, end)
    edge = np.searchsorted(of, np.arange(len(offsets)))
    wide = sequence_hashes(hashes, SHINGLE, 1)
    for i in range(len(offsets) - 1):
        a, b = edge[i], edge[i + 1]
        if b - a >= SHINGLE:
            yield np.unique(wide[a : b - SHINGLE + 1])
        elif b > a:
            yield sequence_hashes(hashes[a:b], b - a, 2 + b - a)
        else:
            yield wide[:0]


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b modulo 2 ** 32, in blocks that stay in the cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (a[:, None] * x[None, at : at + 256] + b[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fp1, fp2, bands, signature); bands and signature are null for an empty set."""
    schema = docs.select("doc_id").schema.add("n", "long").add("fp1", "long").add("fp2", "long").add("bands", T.ArrayType(T.LongType())).add("signature", "binary")

    def run(batches):
        a = coefficients(BANDS * ROWS, 3).astype(np.uint32) | np.uint32(1)
        b = (coefficients(BANDS * ROWS, 4) >> np.uint64(32)).astype(np.uint32)
        rows, band = coefficients(ROWS, 5), coefficients(BANDS, 6)
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                n, fp, keys, signs = [], [], [], []
                for s in _sets(*utf8(batch.column("text"))):
                    n.append(len(s))
                    fp.append(_prints(s))
                    if len(s):
                        least = _minima(s, a, b)
                        keys.append(mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * rows).sum(axis=1, dtype=np.uint64) + band).astype(np.int64))
                        signs.append((mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes())
                    else:
                        signs.append(None)
                n, fp = np.array(n, np.int64), np.array(fp, np.uint64).reshape(-1, 2).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), lists, pa.array(signs, pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _prints(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two fingerprints of a set."""
    return mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(fp1, fp2, shingles): the sorted distinct shingles as packed uint64."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                sets = list(_sets(*utf8(batch.column("text"))))
                fp = np.array([_prints(s) for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp1", "fp2", "shingles"])

    return docs.select("text").mapInArrow(run, "fp1 long, fp2 long, shingles binary")


def _agree(batches):
    for batch in batches:
        x, y = (np.frombuffer(utf8(batch.column(c))[0], np.uint8).reshape(-1, BANDS * ROWS) for c in ("sign_u", "sign_v"))
        keep = (x == y).mean(axis=1) >= LEAST_AGREEMENT
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("u", "v")], ["u", "v"]).filter(pa.array(keep))


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("u", "v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(numbers: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the classes with these numbers (id)."""
    asked = written(classes.join(numbers, "id").select("id", "fp1", "fp2", "rep"))
    own = shingle_sets(of_ids(docs, asked.select(F.col("rep").alias("doc_id")).distinct()))
    # rows of one id may have different texts, so the set is found by its fingerprints
    return own.join(asked.select("id", "fp1", "fp2"), ["fp1", "fp2"]).select("id", "shingles").dropDuplicates(["id"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (u, v) of class numbers those that are links: by signature first, then on the full sets."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"sign_{c}"))
    fits = 100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v")
    likely = written(pairs.join(side("u"), "u").join(side("v"), "v").where(fits).select("u", "v", "sign_u", "sign_v").mapInArrow(_agree, "u long, v long"))
    sets = written(_sets_of(likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct(), classes, docs))
    full = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    links = written(likely.join(full("u"), "u").join(full("v"), "v").mapInArrow(_similar, "u long, v long"))
    dropped(likely, sets)
    return links


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """(rep, shingle), a row for each element of each set (id, shingles)."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "shingles", BATCH_BYTES):
                data, offsets = utf8(batch.column("shingles"))
                reps = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["rep", "shingle"])

    return sets.mapInArrow(run, "rep long, shingle long")


def _prefix_pairs(open_docs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) by an exact prefix filter among open_docs (rep, n, component), not within a component."""
    rows = written(_shingle_rows(_sets_of(open_docs.select(F.col("rep").alias("id")), classes, docs)))
    common = written(rows.groupBy("shingle").agg(F.count("*").alias("n_docs")).where("n_docs > 1"))
    share = PERCENT / (100 + PERCENT)
    n, place = F.col("n"), F.col("n") - F.size("shared") + F.col("at") + 1
    early = (
        rows.join(common, "shingle")
        .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n_docs", "shingle"))).alias("shared"))
        .join(open_docs, "rep")
        .select("rep", "n", "component", "shared", F.posexplode("shared").alias("at", "s"))
        .select("rep", "n", "component", F.col("s.shingle").alias("shingle"), place.alias("place"))
        .where(F.col("place") <= n - F.ceil(n * PERCENT / 100) + 1)
    )
    number = lambda x: F.floor(F.log(x) / F.log(F.lit(CLASS)) + 1e-9)
    partner = F.explode(F.sequence(number(n * PERCENT / 100) - 1, number(n * 100 / PERCENT) + 1))
    smallest = F.pow(F.lit(CLASS), F.col("other")) * (1 - 1e-6)
    keyed = early.withColumn("class", number(n)).withColumn("other", partner).where(F.col("place") <= n - F.ceil(share * (n + smallest)) + 1)
    key = ["shingle", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high")]
    keyed = written(keyed.select("rep", "n", "component", "place", *key))
    dropped(common, rows)
    x, y = keyed.alias("x"), keyed.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    together = 1 + F.least(nx - F.col("x.place"), ny - F.col("y.place"))
    return (
        x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
               & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & ((100 + PERCENT) * together >= PERCENT * (nx + ny)))
        .select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")).distinct()
    )


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of rows that repeat a doc_id."""
    prints = F.struct("fp1", "fp2")
    ids = full.groupBy("doc_id").agg((F.min(prints) != F.max(prints)).alias("several")).where("several").select("doc_id")
    members = written(full.select("doc_id", "fp1", "fp2").join(ids, "doc_id").distinct().join(classes.select("fp1", "fp2", "id"), ["fp1", "fp2"]).select("doc_id", "id"))
    least = members.groupBy("doc_id").agg(F.min("id").alias("u"))
    return members.join(least, "doc_id").where(F.col("id") != F.col("u")).select("u", F.col("id").alias("v"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id long, text)."""
    return _groups(docs)[0]


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups(), and the stored frame that it still reads."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(signatures(docs))
    full = seen.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("n", "bands", "signature"), "doc_id")
    classes = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), first.alias("x"), F.count("*").alias("size"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "fp1", "fp2", "rep", "size", "x.*"))
    rows = classes.select(F.col("id").alias("rep"), F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    # the first document is likely to be what the others were made from
    shared = rows.groupBy("key").agg(F.min_by("rep", F.struct("doc", "rep")).alias("least"), F.count("*").alias("size")).where("size > 1")
    members = written(rows.drop("doc").join(shared.drop("size"), "key"))
    links = verified(members.where(F.col("rep") != F.col("least")).select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct(), classes, docs)
    links = written(links.unionByName(_same_id(full, classes)))
    found = components(links)
    placed = written(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component")))
    dropped(members)
    apart = written(placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a != b").select("key", "size"))
    few = written(placed.join(apart.where(F.col("size") <= SMALL), "key"))
    other = few.select("key", F.col("rep").alias("v"), F.col("component").alias("other"))
    met = few.join(other, "key").where((F.col("rep") < F.col("v")) & (F.col("component") != F.col("other"))).select(F.col("rep").alias("u"), "v")
    open_docs = written(placed.join(apart.where(F.col("size") > SMALL), "key", "left_semi").select("rep", "component").distinct().join(classes.select(F.col("id").alias("rep"), "n"), "rep"))
    dropped(placed)
    more = verified(written(met.union(_prefix_pairs(open_docs, classes, docs)).distinct()), classes, docs)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # a component is told by the smallest doc_id of its classes
    placed = written(classes.select("id", "fp1", "fp2", "rep", "size").join(found.withColumnRenamed("node", "id"), "id", "left"))
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("component_id"))
    told = written(placed.where("component IS NOT NULL OR size > 1").join(least, "component", "left").select("fp1", "fp2", F.coalesce("component_id", "rep").alias("component_id")))
    dropped(classes, links, more, few, apart, open_docs, placed)
    found = (
        seen.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp1")).alias("fp1"), "fp2")
        .join(told, ["fp1", "fp2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    return found, seen


def op8_minhash(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark, docs, sf_dir):
    """Pipeline stage: one document of each group stays, that of the smallest id; of rows with one id that of the least
    hash of its text stays, or any of equal texts. Texts are moved only for ids that have several rows."""
    found, seen = _groups(docs)
    left = of_ids(docs, found.where("NOT kept").select("doc_id").distinct(), "left_anti")
    dropped(seen)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = of_ids(left, again).groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64("text")).alias("x")).select("x.*")
    return of_ids(left, again, "left_anti").select(*columns).unionByName(one)


QUERIES = {"op8_minhash": op8_minhash}
ORACLE = {
    "op8_minhash": rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= {SHINGLE}),
    s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, concat_ws(' ', word, {", ".join(f"lead(word, {j}) OVER r" for j in range(1, SHINGLE))}) AS k, lead(word, {SHINGLE - 1}) OVER r IS NOT NULL AS whole
          FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i)) WHERE whole
          UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.v FROM reach JOIN l ON l.u = reach.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """
}
