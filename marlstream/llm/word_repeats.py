"""Substring dedup over words by recompression.

A word is removed if a window of WIDTH words covers it whose word sequence also starts earlier: in a document of a
smaller doc_id, or before in the same one. Windows are judged on the input, not on what is left.

ROUNDS rounds of recompression (see recompress.py) name runs and pairs of words. A window's anchor is the symbol of
the highest round that its own words make be there, the one of least hash among several; windows near a text's
ends may have none and take one of a lower round, in the end a word. Spark counts the anchors, keeps those that are
shared, and within them compares the whole stretches around them, and where those differ each window (see
anchored.py); an anchor's fingerprint is of all words that make it be there. Stretches and windows are equal if two
independent 64-bit fingerprints of all their words are.

Defined cases: a null or empty text has no words; texts of fewer than WIDTH words lose nothing; a null doc_id comes
before all others; repeated rows (same id and text) are one document and get equal results; rows of one id with
different texts are each searched for repeats, at equal starts ordered by a hash of the text; only the named
columns are used, so further columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstream.llm import anchored
from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, table, written
from marlstream.llm.hashing import word_hashes, words
from marlstream.llm.recompress import anchors, levels

WIDTH = 20
ROUNDS = 2
BATCH_BYTES = 1 << 20


def anchor_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (a, r, s, doc, tag, place) of docs (doc, tag, text)."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                data, offsets = utf8(batch.column("text"))
                start, end, of = words(data, offsets)
                names = word_hashes(data, start, end)
                n = np.bincount(of, minlength=batch.num_rows)
                starts = anchored.windows_of(n, width)
                stretch, second = anchored.Stretches(names), anchored.Stretches(word_hashes(data, start, end, 1), 1)
                base = np.cumsum(n) - n
                left, out = starts, []
                for number, level in reversed(list(enumerate(levels(names, of, ROUNDS)))):
                    found = anchors(level, left, width)
                    has = found >= 0
                    own, at = left[has], found[has]
                    first, last = anchored.runs_of(own, at)
                    symbol = at[first]
                    a = stretch.hashes(level.low[symbol], level.high[symbol], number + 1)
                    r, s = (x.hashes(own[first], own[last] + width) for x in (stretch, second))
                    text = of[own[first]] if len(first) else np.zeros(0, np.int64)
                    out.append((a, r, s, text, own[first], last - first + 1))
                    left = left[~has]
                    if not len(left):
                        break
                a, r, s, text, first, count = (np.concatenate(x) for x in zip(*out, strict=True))
                doc, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
                place = anchored.packed(first - base[text], count)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (a, r, s)), pa.array(doc[text]), pa.array(tags[text]), pa.array(place)], ["a", "r", "s", "doc", "tag", "place"])

    return docs.mapInArrow(run, "a long, r long, s long, doc long, tag long, place long")


def _single_windows(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(w, v, doc, tag, place): two fingerprints of each window of the places."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                data, offsets = utf8(batch.column("text"))
                start, end, of = words(data, offsets)
                stretches = [anchored.Stretches(word_hashes(data, start, end, i), i) for i in (0, 1)]
                base = np.searchsorted(of, np.arange(batch.num_rows))
                listed = batch.column("places")
                text = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                first, count = anchored.unpacked(listed.flatten().to_numpy(zero_copy_only=False))
                at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                text = np.repeat(text, count)
                doc, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
                w, v = (x.hashes(at + base[text], at + base[text] + width).astype(np.int64) for x in stretches)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(v), pa.array(doc[text]), pa.array(tags[text]), pa.array(anchored.packed(at, np.ones(len(at), np.int64)))], ["w", "v", "doc", "tag", "place"])

    return anchored.with_places(docs, anchored.by_document(places)).mapInArrow(run, "w long, v long, doc long, tag long, place long")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(__doc, __tag, places): the windows of each document that also start earlier."""
    docs, _ = anchored.once(docs.select(anchored.doc_key().alias("doc"), anchored.tag().alias("tag"), "text").where("text IS NOT NULL"))
    shared = anchored.repeated(anchor_rows(docs, width))
    first = anchored.first_places(shared)
    here = F.struct("doc", "place", "tag")
    again = first.where("n > 1").select("a", "r", "s", here.alias("f"))
    later = shared.join(again, ["a", "r", "s"]).where(here != F.col("f")).select("doc", "tag", "place")
    single = written(_single_windows(docs, first.where("many").select("doc", "tag", "place"), width))
    least = written(single.groupBy("w", "v").agg(F.min(here).alias("f"), F.count("*").alias("n")).where("n > 1").select("w", "v", "f"))
    edges = single.join(least, ["w", "v"]).where(here != F.col("f")).select("doc", "tag", "place")
    found = written(anchored.by_document(later.unionByName(edges)))
    dropped(shared, first, single, least)
    return found


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each row of docs; kept are the words left, joined by
    single spaces."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), anchored.doc_key().alias("doc"), anchored.tag().alias("tag"))
    found = repeats(docs, width)
    joined = anchored.with_places(own, found, "left").select("doc_id", "text", "places")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept", "string")

    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                each = text.as_py().split()
                n_words.append(len(each))
                gone = 0
                if places.is_valid:
                    mask = anchored.covered(len(each), places.values.to_numpy(zero_copy_only=False), width)
                    gone = int(mask.sum())
                    each = [w for w, m in zip(each, mask.tolist(), strict=True) if not m]
                left = b" ".join(each)
                n_removed.append(gone)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode())
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.string())] if with_text else [])], schema.names)

    return joined.mapInArrow(run, schema)


def op4_recompression(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op4_recompression": op4_recompression}
ORACLE = {
    "op4_recompression": rf"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
    k AS (SELECT doc_id, i, word, concat_ws(' ', word, {", ".join(f"lead(word, {j}) OVER r" for j in range(1, WIDTH))}) AS k, lead(word, {WIDTH - 1}) OVER r IS NOT NULL AS whole
          FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM k WHERE whole),
    c AS (SELECT w.doc_id, w.i, w.word, coalesce(max(CASE WHEN g.again THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW), -1) > 0 AS gone
          FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i),
    r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)
    """
}
