"""Audio columns: chroma fingerprints, and alignment of recordings by them.

A recording is cut into overlapping frames; the energy of a frame's spectrum is summed by pitch class (12 to the
octave) and scaled to length one. Over the picture that the frames make, FILTERS compare areas of it (read off an
integral image), and each is quantised to two bits in Gray code, so that a frame has one packed integer of 32 bits.

Recordings with equal integer lists are one class. Query classes meet the others on equal integers in Spark, runs of one
integer as a whole, so that held notes give a row for each offset and not for each two frames; a pair's offsets make a histogram, whose fullest bin (the least absolute offset of equals, the negative one first) aligns
it. A pair counts with MIN_HITS integers in that bin, and a share of differing bits in the overlap of MAX_ERROR or less.

Defined cases: a null, broken or too short recording has no integers and aligns with nothing; silence has integers,
but of frames that are all silent none is looked up; a null id is never a query nor a partner; rows that repeat an
id are recordings of their own; a recording isn't counted as its own partner; only the named columns are used, so
further columns can't clash.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.llm.common import table, written

RATE = 11025
FRAME, HOP = 4096, 1365
CLASSES = 12
LOWEST, HIGHEST = 55.0, 3520.0
#: frames that one integer looks at
SPAN = 16
MIN_HITS = 3
MAX_ERROR = 0.25
#: filter values beyond this go to the outer two of the four levels
OUTER = 0.08
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, width in frames, first pitch class, height): four kinds of comparison at four sizes."""
    found = []
    for i in range(16):
        height = (12, 8, 6, 10)[i // 4]
        found.append((i % 4, (4, 6, 12, 16)[i // 4], i * 3 % (CLASSES - height + 1), height))
    return found


FILTERS = _filters()


def _pitch_class_map() -> np.ndarray:
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)
    inside = np.flatnonzero((bins >= LOWEST) & (bins <= HIGHEST))
    number = np.round(12 * np.log2(bins[inside] / 440.0)).astype(int) % CLASSES
    found = np.zeros((len(bins), CLASSES), np.float32)
    found[inside, number] = 1
    return found


_MAP = _pitch_class_map()
_SHAPE = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch classes of each frame, of length one, or all zero for a silent frame."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, CLASSES), np.float32)
    out = np.empty((n, CLASSES), np.float32)
    for at in range(0, n, 64):  # long recordings in bounded memory
        own = np.stack([samples[i * HOP : i * HOP + FRAME] for i in range(at, min(n, at + 64))])
        spectrum = np.fft.rfft(own * _SHAPE, axis=1)
        out[at : at + 64] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _MAP
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-3, out / np.maximum(length, 1e-3), 0).astype(np.float32)


def packed(frames: np.ndarray) -> np.ndarray:
    """One integer for each SPAN frames in a row."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(frames) + 1, CLASSES + 1))
    total[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(n)

    def area(x0, x1, y0, y1):
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for k, (kind, width, y, height) in enumerate(FILTERS):
        x, mid = width // 2, y + height // 2
        whole = area(0, width, y, y + height)
        if kind == 0:
            first = area(0, width, y, mid)
        elif kind == 1:
            first = area(0, x, y, y + height)
        elif kind == 2:
            first = area(0, x, y, mid) + area(x, width, mid, y + height)
        else:
            third = width // 3
            first = area(third, width - third, y, y + height) * (width / (2 * (width - 2 * third)))
        value = np.log((1 + first) / (1 + np.maximum(0, whole - first)))
        out |= _GRAY[np.digitize(value, (-OUTER, 0.0, OUTER))] << np.uint32(2 * k)
    # a stretch of silence says nothing
    return np.where(area(0, SPAN, 0, CLASSES) > 0, out, np.uint32(0))


def wav_samples(data: bytes | None) -> np.ndarray:
    """Samples of a WAV file (16-bit PCM), channels averaged, at RATE; none if it is null or broken."""
    none = np.zeros(0, np.float32)
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, rate, channels, found = 12, 0, 0, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if form != 1 or bits != 16 or not channels or not rate:
                return none
        elif name == b"data":
            found = body
        at += 8 + size + size % 2
    if not channels:
        return none
    x = np.frombuffer(found[: len(found) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1).astype(np.float32) / 32768
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x) - 1, rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x


def fingerprints(media: DataFrame, id_column: str, column: str, samples=wav_samples) -> DataFrame:
    """(id, ints) of each row; `samples` turns a cell of `column` into samples at RATE."""

    def run(batches):
        for batch in batches:
            ints = [packed(chroma(samples(x))).view(np.int32) for x in batch.column("media").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ints])]).astype(np.int32)
            values = np.concatenate(ints) if ints else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ints"])

    own = media.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("media"))
    return own.mapInArrow(run, T.StructType().add("id", "long").add("ints", T.ArrayType(T.IntegerType())))


def runs(prints: DataFrame) -> DataFrame:
    """(id, key, at, n) of each run of one integer in prints (id, ints): a held note is one row, however long."""
    starts = F.filter(F.sequence(F.lit(0), F.size("ints") - 1), lambda i: (i == 0) | (F.get("ints", i) != F.get("ints", i - 1)))
    each = prints.where(F.size("ints") > 0).select("id", "ints", starts.alias("starts")).select("id", "ints", "starts", F.posexplode("starts").alias("k", "at"))
    return each.select("id", F.get("ints", F.col("at")).alias("key"), "at", (F.coalesce(F.get("starts", F.col("k") + 1), F.size("ints")) - F.col("at")).alias("n"))


def align(prints: DataFrame, queries: DataFrame, min_hits: int = MIN_HITS, max_error: float = MAX_ERROR) -> DataFrame:
    """(id, partner, offset, hits, error) of class representatives: prints (id, ints) are unique, queries (id) some of
    their ids. A pair of two queries comes both ways."""
    found = runs(prints).where("key != 0")
    asked = found.join(queries, "id", "left_semi").select(F.col("id").alias("q"), F.col("at").alias("q_at"), F.col("n").alias("q_n"), "key")
    # two runs of one integer meet at each offset as often as they overlap when one is moved by it
    first, last = F.col("q_at") - F.col("at") - F.col("n") + 1, F.col("q_at") + F.col("q_n") - 1 - F.col("at")
    met = asked.join(found, "key").where(F.col("q") != F.col("id")).select("*", F.explode(F.sequence(first, last)).alias("offset"))
    both = F.least(F.col("q_at") + F.col("q_n"), F.col("at") + F.col("n") + F.col("offset")) - F.greatest(F.col("q_at"), F.col("at") + F.col("offset"))
    hits = met.groupBy("q", "id", "offset").agg(F.sum(both.cast("long")).alias("hits"))
    best = hits.groupBy("q", "id").agg(F.max(F.struct("hits", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("side"))).alias("b")).where(F.col("b.hits") >= min_hits).select("q", "id", (-F.col("b.side")).alias("offset"), "b.hits")
    pairs = best.join(prints.select("id", F.col("ints").alias("b")), "id").join(prints.select(F.col("id").alias("q"), F.col("ints").alias("a")), "q")
    begin, shift = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    n = F.least(F.size("a") - begin, F.size("b") - shift)
    differ = F.zip_with(F.slice("a", begin + 1, n), F.slice("b", shift + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    error = F.aggregate(differ, F.lit(0).cast("long"), lambda s, x: s + x) / (n * 32)
    return pairs.withColumn("error", error).where(F.col("error") <= max_error).select(F.col("q").alias("id"), F.col("id").alias("partner"), "offset", "hits", "error")


def search(prints: DataFrame, is_query) -> DataFrame:
    """(id, n_ints, n_aligned, best, best_offset, best_error) for each row of prints (id, ints) with is_query. Of
    equal errors the smaller id is best."""
    prints = written(prints.withColumn("class", F.sha2(F.concat_ws(",", "ints"), 256)))
    some = prints.where(F.col("id").isNotNull() & (F.size("ints") > 0))
    classes = written(some.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("ints").alias("ints"), F.max(is_query).alias("asked")))
    found = align(classes.select("id", "ints"), classes.where("asked").select("id")).join(classes.select(F.col("id").alias("partner"), F.col("n").alias("partner_n")), "partner")
    others = found.groupBy("id").agg(F.sum("partner_n").alias("others"), F.min(F.struct("error", F.col("partner").alias("best"), "offset")).alias("b"))
    # within a class all align at offset 0 without an error; the least other member is the representative or the next
    least = F.struct("id")
    second = some.join(classes.where("n > 1").select("class", F.col("id").alias("rep")), "class").where(F.col("id") != F.col("rep")).groupBy("class").agg(F.min(least)["id"].alias("second"))
    own = classes.join(second, "class", "left").join(others, "id", "left").select("class", F.col("id").alias("rep"), "n", "second", "others", "b")
    rows = prints.where(is_query).select("id", F.size("ints").alias("n_ints"), "class").join(own, "class", "left")
    twin = F.when(F.col("n") > 1, F.when(F.col("id") != F.col("rep"), F.col("rep")).otherwise(F.coalesce("second", "rep")))
    return rows.select(
        "id", F.col("n_ints").cast("long").alias("n_ints"),
        (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("long").alias("n_aligned"),
        F.coalesce(twin, F.col("b.best")).alias("best"),
        F.when(twin.isNotNull(), 0).otherwise(F.col("b.offset")).cast("long").alias("best_offset"),
        F.when(twin.isNotNull(), 0.0).otherwise(F.round("b.error", 6)).alias("best_error"),
    )


NOTE = 1024


def _notes() -> np.ndarray:
    """The waveform of each of 49 semitones from 110 Hz on."""
    t = np.arange(NOTE) / RATE
    pitch = 110.0 * 2 ** (np.arange(49) / 12)
    shape = np.hanning(NOTE)
    return (np.sin(2 * np.pi * pitch[:, None] * t) * shape).astype(np.float32)


_NOTES = _notes()


def melody(vector: list[float] | None) -> np.ndarray:
    """The tables have no recordings, so a vector is played: each component is a note, the higher the greater it is."""
    if not vector:
        return np.zeros(0, np.float32)
    x = np.array([0.0 if v is None else v for v in vector])
    x = np.where(np.isfinite(x), x, 0.0)
    return _NOTES[np.clip(np.round(24 + 60 * x), 0, 48).astype(int)].ravel()


def op6_audio_fingerprints(spark, sf_dir):
    # a vector of some hundred bytes becomes seconds of sound, so that tasks by bytes would be few and long
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism)
    prints = fingerprints(vectors, "vec_id", "embedding", melody)
    return search(prints, F.coalesce(F.col("id") % 100 == 0, F.lit(False))).withColumnRenamed("id", "vec_id")


QUERIES = {"op6_audio_fingerprints": op6_audio_fingerprints}
