from __future__ import annotations

import struct
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marlstream.llm import media


def wav(x, rate=media.RATE, channels=1):
    data = np.repeat((np.clip(x, -1, 1) * 32000).astype("<i2"), channels).tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16, b"data", len(data))
    return head + data


def song(seed, notes=90):
    r = np.random.default_rng(seed)
    return media._NOTES[r.integers(0, 49, notes)].ravel()


def brute(prints, queries):
    """Every pair compared in plain Python."""
    out = {}
    for q, a in queries:
        best, n = None, 0
        for t, b in prints:
            if t == q or t is None or not a or not b:
                continue
            bins = Counter(i - j for i, x in enumerate(a) for j, y in enumerate(b) if x == y and x)
            if not bins:
                continue
            offset = min(bins, key=lambda o: (-bins[o], abs(o), o))
            if bins[offset] < media.MIN_HITS and a != b:
                continue
            if a == b:
                offset = 0
            over = [(x, b[i - offset]) for i, x in enumerate(a) if 0 <= i - offset < len(b)]
            error = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in over) / (32 * len(over))
            if error <= media.MAX_ERROR:
                n += 1
                best = min(best or (9, 0, 0), (0 if a == b else 1, error, t, offset)[1:] if a != b else (-1, t, 0))
        out[q] = (n, *((None, None, None) if best is None else (best[1], best[2], round(max(0.0, best[0]), 6))))
    return out


def test_recordings_against_brute_force(spark):
    base = song(1)
    cut = base[media.HOP * 20 :]
    noisy = base + np.random.default_rng(5).normal(0, 0.01, len(base)).astype(np.float32)
    rows = [(0, wav(base)), (1, wav(cut)), (2, wav(noisy)), (3, wav(song(2))), (4, wav(base)), (100, wav(song(2))), (200, wav(np.concatenate([song(3)[: media.HOP * 8], base]))),
            (300, None), (400, b"RIFF broken"), (500, wav(base[:5000])), (600, wav(np.zeros(60000))), (None, wav(base)), (7, wav(song(9), channels=2))]
    df = spark.createDataFrame(rows, "id long, audio binary").withColumn("ints", F.lit(1))
    prints = media.fingerprints(df, "id", "audio")
    found = {x.id: tuple(x)[2:] for x in media.search(prints, F.coalesce(F.col("id") % 100 == 0, F.lit(False))).collect()}
    local = [(x.id, x.ints) for x in prints.collect()]
    want = brute(local, [x for x in local if x[0] is not None and x[0] % 100 == 0])
    assert found == want
    assert found[0][0] >= 3 and found[0][1] == 4 and found[200][2] in (7, 8, 9)
    assert found[300] == (0, None, None, None) and found[600][0] == 0


def test_query_against_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = media.fingerprints(vectors, "vec_id", "embedding", media.melody)
    local = [(x.id, x.ints) for x in prints.collect()]
    found = {x.vec_id: tuple(x)[2:] for x in media.op6_audio_fingerprints(spark, sf_dir).collect()}
    assert found == brute(local, [x for x in local if x[0] % 100 == 0])


def test_empty_table_and_odd_cells(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert media.search(media.fingerprints(empty, "vec_id", "embedding", media.melody), F.col("id") % 100 == 0).collect() == []
    odd = spark.createDataFrame([(0, None), (100, []), (200, [None, float("nan")] * 40)], "vec_id long, embedding array<float>")
    found = media.search(media.fingerprints(odd, "vec_id", "embedding", media.melody), F.col("id") % 100 == 0).collect()
    assert sorted(x.id for x in found) == [0, 100, 200]
