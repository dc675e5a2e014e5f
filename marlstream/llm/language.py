"""Language ID by prediction by partial matching (PPM).

For each language a byte context tree of order ORDER is counted on labelled texts; the statistics are then frozen.
A byte is coded in the longest context that the tree has: method C gives it n / (T + D), or the escape D / (T + D)
and the next shorter context, T being the context's count and D its number of followers; after the empty context
comes a uniform byte. (No exclusions.) The exact code length of the whole text under each language is summed, the
shortest wins, and the score is its posterior under equal priors.

A byte's cost in all languages follows from the longest known context, so it is worked out once for every counted
gram; scoring is then a few NumPy look-ups a byte, over all texts of a batch at once.

Training uses a bounded sample: about MAX_TRAINING_DOCS whole texts of each language, picked by a hash of the id, and of
these, in the order of a hash, as many as have MAX_TRAINING_BYTES together (one text at least; longer ones last). Grams
seen once are left out at orders of 3 and more, which with the sample bounds the statistics of a language.

A model's tables are dense in the languages that it holds, so it holds as many as keep grams * languages within
MODEL_CELLS (and LANGUAGES_AT_ONCE at most): all models together grow with the number of languages and not with its
square. Models of PASS_CELLS together score the texts in one pass, in one Python worker; the next pass goes on from the
last one's stored result. So all labelled languages can be told, however many, in bounded memory.

The pipeline's stage rejects texts that are `und`, that no language codes better than uniform bytes, and those whose
language is in doubt (a score below LEAST_SCORE), and gives texts without a label the language found.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the first language by name;
without training rows all is `und`; rows with a null id are never trained on and not held out; repeated rows get
equal results; only the named columns are used, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, table, written

ORDER = 4
MAX_TRAINING_DOCS = 400
MAX_TRAINING_BYTES = 4 << 20
LANGUAGES_AT_ONCE = 64
#: costs in the tables of a model, and of the models of a pass: 16 MB and 256 MB of them
MODEL_CELLS = 4 << 20
PASS_CELLS = 64 << 20
BATCH_BYTES = 1 << 20
#: posterior below which a text's language is in doubt
LEAST_SCORE = 0.5
#: bits a byte of a text that no model codes better than uniform bytes
UNLIKE_ANY = 8.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, most: int = MAX_TRAINING_DOCS, most_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """About `most` labelled rows (text, lang) of each language with `most_bytes` or fewer together, none of them held
    out. The first text stays whatever its length; rows equal in id and text stay or go together."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und")).select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(1_000_000.0) * most / F.col("n")).alias("share"))
    # a row for each language
    some = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))
    size = F.octet_length("text").cast("long")
    place = F.struct((size > most_bytes).alias("long"), F.xxhash64("doc_id", "text").alias("h"))
    # some `most` rows of each language, without their texts
    by_place = Window.partitionBy("lang").orderBy("place")
    placed = some.select("lang", place.alias("place"), size.alias("size")).select("lang", "place", F.sum("size").over(by_place).alias("bytes"), F.rank().over(by_place).alias("rank"))
    last = placed.where((F.col("bytes") <= most_bytes) | (F.col("rank") == 1)).groupBy("lang").agg(F.max("place").alias("last"))
    return some.join(F.broadcast(last), "lang").where(place <= F.col("last")).select("text", "lang")


def _windows(data: np.ndarray, offsets: np.ndarray, order: int):
    """The texts with `order` line feeds before each, and where the texts' own bytes are."""
    n = np.diff(offsets)
    buffer = np.full(len(data) + order * len(n), 10, np.uint8)
    start = offsets[:-1] + order * np.arange(1, len(n) + 1)
    own = np.ones(len(buffer), bool)
    pads = (start[:, None] - np.arange(1, order + 1)).ravel()
    own[pads] = False
    buffer[own] = data
    return buffer, own, start


def _grams(buffer: np.ndarray, order: int) -> np.ndarray:
    """For each position the last order + 1 bytes as an integer, the latest byte lowest."""
    key = np.zeros(len(buffer), np.uint64)
    for back in range(order, -1, -1):
        key <<= np.uint64(8)
        key[back:] |= buffer[: len(buffer) - back].astype(np.uint64)
    return key


def _count(order: int):
    def count(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                langs = np.array(batch.column("lang").to_pylist())
                for lang in sorted(set(langs)):
                    texts = batch.column("text").filter(pa.array(langs == lang))
                    buffer, own, _ = _windows(*utf8(texts), order)
                    key = _grams(buffer, order)[own]
                    for k in range(order + 1):
                        gram, n = np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "k": pa.array(np.full(len(gram), k, np.int32)), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return count


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, n), k being the length of the context; bounded as the module says."""
    counted = rows.mapInArrow(_count(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    return counted.where((F.col("k") < 3) | (F.col("n") > 1))


class _Table:
    """Open addressing from integers to row numbers."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.rows[at[left]] < 0
            self.rows[at[left][free]] = left[free]  # of several that want one slot the last gets it
            self.keys[at[left][free]] = keys[self.rows[at[left][free]]]
            left = left[self.rows[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        rows = np.where(self.keys[at] == keys, self.rows[at], -1)
        left = np.flatnonzero((rows < 0) & (self.rows[at] >= 0))
        at = at[left]
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            rows[left] = np.where(self.keys[at] == keys[left], self.rows[at], -1)
            more = (rows[left] < 0) & (self.rows[at] >= 0)
            left, at = left[more], at[more]
        return rows


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.order, self.langs = order, sorted(counts["lang"].unique())
        number = {lang: i for i, lang in enumerate(self.langs)}
        shorter_keys, shorter_cost = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))
        self.found, self.cost, self.contexts, self.escape = [], [], [], []
        self.cells = len(counts) * len(self.langs)
        for k in range(order + 1):
            rows = counts[counts["k"] == k]
            gram = rows["gram"].to_numpy().astype(np.uint64)
            keys, at = np.unique(gram, return_inverse=True)
            n = np.zeros((len(keys), len(self.langs)))
            n[at, rows["lang"].map(number).to_numpy(dtype=int)] = rows["n"]
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[of] / n)
            below = np.full((len(keys), len(self.langs)), 8.0)
            if k:
                below = shorter_cost[np.searchsorted(shorter_keys, keys & np.uint64((1 << 8 * k) - 1))]
            cost = np.where(n > 0, own, escape[of] + below)
            self.found.append(_Table(keys))
            self.cost.append(cost.astype(np.float32))
            self.contexts.append(_Table(contexts))
            self.escape.append(escape.astype(np.float32))
            shorter_keys, shorter_cost = keys, cost

    def _costs(self, key: np.ndarray) -> np.ndarray:
        """Bits of the latest byte of each gram, for each language."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        left = None
        for k in range(self.order, -1, -1):
            gram = key if left is None else key[left]
            gram = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            row = self.found[k].find(gram) if len(self.cost[k]) else np.full(len(gram), -1)
            if left is None:
                if len(self.cost[k]):
                    np.take(self.cost[k], row, axis=0, out=out, mode="clip")
                left = np.flatnonzero(row < 0)
                out[left] = 0
            else:
                hit = row >= 0
                out[left[hit]] += self.cost[k][row[hit]]
                left = left[~hit]
            if not len(left):
                return out
            if not len(self.escape[k]):
                continue
            context = self.contexts[k].find((key[left] & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            known = context >= 0
            out[left[known]] += self.escape[k][context[known]]
        out[left] += 8
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        bits = np.zeros((len(offsets) - 1, len(self.langs)))
        if len(bits) == 0 or not self.langs:
            return bits
        buffer, own, start = _windows(data, offsets, self.order)
        first = start - self.order
        step = BATCH_BYTES * 8 // max(8, len(self.langs))
        for at in range(0, len(buffer), step):
            to = min(len(buffer), at + step)
            back = min(at, self.order)
            cost = self._costs(_grams(buffer[at - back : to], self.order)[back:])
            cost[~own[at:to]] = 0
            doc = np.searchsorted(first, at, side="right") - 1
            end = np.searchsorted(first, to, side="left")
            edges = np.maximum(first[doc:end], at) - at
            bits[doc:end] += np.add.reduceat(cost, edges, axis=0, dtype=np.float64)
        return bits


def _runs(items: list, fits) -> list[list]:
    """The items in order, a new run begun where fits(run) would fail; one item at least in each."""
    found: list[list] = []
    for item in items:
        if found and fits([*found[-1], item]):
            found[-1].append(item)
        else:
            found.append([item])
    return found


def train(docs: DataFrame, order: int = ORDER, most: int = MAX_TRAINING_DOCS) -> list[Model]:
    """Models of all languages in their order, each of LANGUAGES_AT_ONCE languages and MODEL_CELLS costs at most."""
    rows = written(training_rows(docs, most))
    counted = written(count_grams(rows, order))
    # a row for each language
    sizes = {x.lang: x["count"] for x in counted.groupBy("lang").count().collect()}
    groups = _runs(sorted(sizes), lambda g: len(g) <= LANGUAGES_AT_ONCE and len(g) * sum(sizes[x] for x in g) <= MODEL_CELLS)
    models = [Model(counted.where(F.col("lang").isin(group)).toPandas(), order) for group in groups]
    dropped(rows, counted)
    return models


#: a text's result after some models: the least code length, its language, and the sum of 2 ** (least - length) of all
STATE = {"__least": "double", "__lang": "string", "__sum": "double"}


def _carried(known: Model, texts: pa.Array, least_before: np.ndarray, lang_before: np.ndarray, sum_before: np.ndarray):
    """STATE of texts carried on by a model's languages."""
    bits = known.code_lengths(*utf8(texts))
    best, least = bits.argmin(axis=1), bits.min(axis=1)
    total = np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
    lang = np.array(known.langs, object)[best]
    old = ~np.isnan(least_before)
    # of equal lengths the first language by name, which an earlier model has
    stays = old & (least_before <= least)
    both = np.where(old, np.minimum(np.where(old, least_before, 0), least), least)
    with np.errstate(invalid="ignore"):
        total = total * np.exp2(both - least) + np.where(old, sum_before * np.exp2(both - least_before), 0)
    lang[stays] = lang_before[stays]
    return both, lang, total


def _scored(docs: DataFrame, models: list[Model]) -> DataFrame:
    """docs (__text, STATE, ...) with STATE carried on by the languages of some models."""
    shared = [docs.sparkSession.sparkContext.broadcast(model) for model in models]
    names = docs.columns

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "__text", BATCH_BYTES):
                texts = batch.column("__text")
                least, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__least", "__sum"))
                lang = np.array(batch.column("__lang").to_pylist(), object)
                for known in shared:
                    least, lang, total = _carried(known.value, texts, least, lang, total)
                new = {"__least": pa.array(least), "__lang": pa.array(lang.tolist(), pa.string()), "__sum": pa.array(total)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """docs with lang_pred, score and bits (a byte, under the best language); the other columns stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "bits", "text")]
    state = docs.select(*rest, F.coalesce("text", F.lit("")).alias("__text"), F.col("text").isNull().alias("__null"), *[F.lit(float("nan") if kind == "double" else None).cast(kind).alias(c) for c, kind in STATE.items()])
    for number, some in enumerate(_runs(models, lambda run: sum(m.cells for m in run) <= PASS_CELLS)):
        # two passes in one stage would have two workers a task, each with its tables
        state = _scored(written(state) if number else state, some)
    told = F.col("__text").rlike(r"\p{L}") & F.col("__lang").isNotNull()
    bits = F.col("__least") / F.greatest(F.lit(1), F.octet_length("__text"))
    text = F.when(~F.col("__null"), F.col("__text")).alias("text")
    return state.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "bits")], F.when(told, F.col("__lang")).otherwise("und").alias("lang_pred"), F.when(told, 1 / F.col("__sum")).otherwise(0.0).alias("score"), F.when(F.col("__lang").isNotNull(), bits).otherwise(0.0).alias("bits"))


def op3_language_ppm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.round("bits", 4).alias("bits"))


def keep_known_languages(spark, docs, sf_dir):
    """Pipeline stage: drops texts that are null, have no letter, that no language codes better than uniform bytes, or whose
    language is in doubt; a null `lang` becomes the language found."""
    # columns whose names may clash go into a struct; the text isn't in it, so that it goes to Python once
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = predict(docs.select("text", rest.alias("__rest")), train(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits") < UNLIKE_ANY) & (F.col("score") >= LEAST_SCORE))
    own = {"text": F.col("text"), "lang": F.coalesce("__rest.lang", "lang_pred").alias("lang")}
    return kept.select(*[own.get(c, F.col(f"__rest.`{c}`")) for c in docs.columns])


QUERIES = {"op3_language_ppm": op3_language_ppm}
