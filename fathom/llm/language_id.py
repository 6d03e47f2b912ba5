"""Operator 2: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of 1 to 3 letters.  Document frequencies come from every
training text.  The weights are fitted on a sample, about ``PER_LANG`` texts a language and ``MOST_TEXTS`` in all, of
the ``MOST_LANGS`` most frequent languages, by follow-the-regularised-leader with elastic-net penalties; a part of the
sample that is not fitted sets the temperature that calibrates the scores.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

FEATURES = 1 << 14
#: Expected number of texts a language in the fitted sample; which ones, a hash of doc_id says.
PER_LANG = 400
#: Bounds of the sample: languages that are learned, and texts in all.
MOST_LANGS, MOST_TEXTS = 256, 20_000
#: Features of a text that the weights are fitted on, the most frequent ones: 6 bytes each, so 250 MB for all texts.
MOST_FEATURES = 2_048
#: Follow-the-regularised-leader's rates and penalties, and how often it sees the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.01, 4
#: One in so many texts of the sample sets the temperature.
CALIBRATE = 5

_TABLE: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower-case letter, or 0 if it is neither letter nor mark; and whether it is a letter."""
    if not _TABLE:
        table, alone = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x40000):  # there are no letters beyond
            c = chr(i)
            alone[i] = c.isalpha()
            if alone[i] or unicodedata.category(c)[0] == "M":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLE.extend((table, alone))
    return _TABLE[0], _TABLE[1]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a whole text and their counts; None without a letter."""
    table, alone = _letters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not alone[points].any():
        return None
    codes = table[points]
    gap = codes == 0
    codes = codes[~(gap & np.concatenate((gap[1:], [True])))]  # one of each run of gaps, none at the end
    codes = np.concatenate(([0][: int(codes[0] > 0)], codes, [0])).astype(np.uint32)
    with np.errstate(over="ignore"):
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + codes[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1)
        grams = np.concatenate((one[codes > 0], two, three))
        grams = (grams ^ (grams >> np.uint32(16))) * np.uint32(0x7FEB352D)
    counts = np.bincount(grams >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found.astype(np.uint16), counts[found]


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that nothing is learned from; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def training_features(docs: DataFrame) -> tuple[int, np.ndarray, list[tuple[str, np.ndarray, np.ndarray]]]:
    """Number of training texts, documents by feature over all of them, and the sample's (lang, features, counts)."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    each = min(PER_LANG, MOST_TEXTS // max(1, len(sizes)))
    part = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, each / r["count"])))) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(1_000_003))
    rows = train.select("text", "lang", place.alias("place"), F.coalesce(place < F.element_at(part, F.col("lang")) * 1_000_003, F.lit(False)).alias("sampled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for text, lang, at, sampled in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("lang", "place", "sampled"))):
                grams = ngrams(text.as_py())
                if grams is None:
                    continue
                total += 1
                seen[grams[0]] += 1
                if sampled:
                    if len(grams[0]) > MOST_FEATURES:
                        kept = np.sort(np.argsort(-grams[1], kind="stable")[:MOST_FEATURES])
                        grams = grams[0][kept], grams[1][kept]
                    out.append((lang, at, grams[0].tobytes(), grams[1].astype(np.uint32).tobytes(), 0))
            yield table(out)
        yield table([(None, -1, None, seen.tobytes(), total)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["lang", "place", "features", "counts", "n"])

    made = store.written(rows.mapInArrow(store.tidied(run), "lang string, place long, features binary, counts binary, n long"), "features")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column("counts").to_pylist(), batch.column("n").to_pylist()):
                seen += np.frombuffer(raw, np.int64)
                total += n
        yield table([(None, -1, None, seen.tobytes(), total)])

    # a vector a task: they are added in a few tasks before the last step
    sums = made.filter("features IS NULL").select("lang", "place", "features", "counts", "n").repartition(8).mapInArrow(add, made.schema).collect()
    frequency = sum((np.frombuffer(r["counts"], np.int64) for r in sums), np.zeros(FEATURES, np.int64))
    sample = sorted(made.filter("features IS NOT NULL").collect(), key=lambda r: (r["place"], r["lang"], bytes(r["features"])))
    return sum(r["n"] for r in sums), frequency, [(r["lang"], np.frombuffer(r["features"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in sample]


class Model:
    """Languages, inverse document frequencies, sparse weights and temperature."""

    def __init__(self, n: int, frequency: np.ndarray, sample: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({lang for lang, _, _ in sample})
        self.idf = (np.log((n + 1) / (frequency + 1)) + 1).astype(np.float32)
        self.weights = np.zeros((FEATURES + 1, len(self.langs)), np.float32)
        self.temperature = 1.0
        if self.langs:
            self._fit(sample)

    def vector(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts.astype(np.float32))) * self.idf[features]
        return x / np.sqrt(x @ x)

    def _fit(self, sample: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        rows = [(self.langs.index(lang), np.append(f.astype(np.int64), FEATURES), np.append(self.vector(f, c), 0.1)) for lang, f, c in sample]
        fit, rest = [r for i, r in enumerate(rows) if (i + 1) % CALIBRATE], rows[CALIBRATE - 1 :: CALIBRATE]
        z = np.zeros((FEATURES + 1, len(self.langs)))
        squares = np.zeros_like(z)

        def weights(at) -> np.ndarray:
            zs = z[at]
            return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(squares[at])) / ALPHA + L2))

        for _ in range(EPOCHS):
            for k, at, x in fit:
                w = weights(at)
                p = self._softmax(x @ w)
                p[k] -= 1
                g = x[:, None] * p
                old = squares[at]
                squares[at] = old + g * g
                z[at] += g - (np.sqrt(squares[at]) - np.sqrt(old)) / ALPHA * w
        self.weights = weights(slice(None)).astype(np.float32)
        if rest:
            logits = np.stack([x @ self.weights[at] for _, at, x in rest])
            truth = [k for k, _, _ in rest]
            choices = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
            # n texts can't show error rates below about 1/n, so that much of each truth goes to the other languages
            aim = np.full(logits.shape, 1 / (len(rest) + 2) / max(1, len(self.langs) - 1))
            aim[np.arange(len(rest)), truth] = 1 - 1 / (len(rest) + 2)
            loss = [-(aim * np.log(np.maximum(1e-12, self._softmax(logits / t)))).sum(axis=1).mean() for t in choices]
            self.temperature = float(choices[int(np.argmin(loss))])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if self.langs else None
        if grams is None:
            return "und", 0.0
        x = self.vector(*grams)
        p = self._softmax((x @ self.weights[grams[0]] + 0.1 * self.weights[FEATURES]) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text, lang).

    lang is used only where doc_id isn't held out.  Texts that are null or have no letter (marks, digits and emoji
    are none) are ``und`` with score 0; so are all if there is nothing to learn from.  Very long texts count whole,
    repeated rows get the same prediction each, further columns of any name are ignored, and an empty table gives an
    empty result.
    """
    model = Model(*training_features(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(store.tidied(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: all documents."""
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
