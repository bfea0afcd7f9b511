"""Language identification by the nearest of several centroids per language.

A text becomes counts of hashed byte n-grams (one to three bytes, lower case,
everything but letters as a blank), damped, weighted by inverse document
frequency and normalised.  Each language has up to ``CENTROIDS`` centroids from
spherical k-means.  The nearest centroid by cosine gives the language, its
cosine the score.  A text is rejected if its cosine is below ``MARGIN`` times
what 99% of the training texts of that centroid with about as many different
n-grams reach when judged by a model that has not seen them.

The model is fitted on at most ``SAMPLE`` labelled documents, spread evenly over
the languages and chosen by a hash of doc_id and text; prediction reads every
whole text.  At most ``SAMPLE`` rows of counts reach the driver, whatever ids and
texts repeat.

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; so is every text if nothing could be learned; rows with a null
language are not learned from; a null doc_id counts as the empty text in the
split; equal cosines give the language that sorts first; repeated rows are
judged alike; input columns named like an output column give way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.texts import as_bytes, give_back, slices, with_fields

DIMENSIONS, CENTROIDS, SAMPLE, MARGIN, BAND_ROWS = 4096, 4, 6000, 0.8, 50
LEAST = 20  # documents a language; with more languages than SAMPLE / LEAST the rarest are not learned
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
# Bytes: A-Z lower-cased, letters and non-ASCII kept, the rest a blank.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams of one to three bytes."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    b = np.frombuffer(text.translate(_BYTES), np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    for size in (1, 2, 3):
        if len(b) >= size:
            code = b[:len(b) - size + 1].copy()
            for i in range(1, size):
                code = code << np.uint32(8) | b[i:len(b) - size + 1 + i]
            slots = ((code + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(slots, minlength=DIMENSIONS)
    return counts


def has_letter(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


def _centres(rows: np.ndarray, names: np.ndarray, centroids: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Spherical k-means of each language: languages and centres."""
    languages, found = [], []
    random = np.random.default_rng(seed)
    for language in sorted(set(names)):
        own = rows[names == language]
        centres = own[random.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(12):
            nearest = (own @ centres.T).argmax(1)
            sums = np.stack([own[nearest == k].sum(0) if (nearest == k).any() else centres[k]
                             for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        languages += [language] * len(centres)
        found.append(centres)
    return languages, np.concatenate(found).astype(np.float32) if found else np.zeros((0, DIMENSIONS), np.float32)


def band_of(counts: np.ndarray) -> np.ndarray:
    """Texts by the number of their different n-grams, doubling from band to band."""
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(np.int64)


class Model:
    """Inverse document frequencies and centroids with their language and, for each band, their bound."""

    def __init__(self, counts: np.ndarray, languages: list[str], centroids: int = CENTROIDS, seed: int = 7):
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        rows, names, bands = self.vectors(counts), np.array(languages), band_of(counts)
        self.languages, self.centres = _centres(rows, names, centroids, seed)
        fold, unseen = np.random.default_rng(seed).permutation(len(rows)) % 2, np.zeros(len(rows))
        for k in (0, 1):
            if (fold == k).any() and (fold != k).any():
                other = _centres(rows[fold != k], names[fold != k], centroids, seed)[1]
                unseen[fold == k] = (rows @ other.T).max(1)[fold == k]
        nearest = (rows @ self.centres.T).argmax(1) if len(rows) else np.zeros(0, np.int64)
        self.bounds = np.zeros((len(self.languages), int(np.log2(DIMENSIONS)) + 1))
        for centre in range(self.bounds.shape[0]):
            for band in range(self.bounds.shape[1]):
                self.bounds[centre, band] = MARGIN * self._reached(unseen, nearest == centre, np.abs(bands - band))

    @staticmethod
    def _reached(unseen: np.ndarray, mine: np.ndarray, gap: np.ndarray) -> float:
        """Cosine that 99% reach: of one centroid's rows in the band, else of any rows in it or in bands ever further off."""
        for chosen in (mine & (gap == 0), *(gap <= width for width in range(int(gap.max(initial=0)) + 1))):
            if chosen.sum() >= BAND_ROWS:
                break
        return float(np.quantile(unseen[chosen], 0.01)) if chosen.any() else 0.0

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts, dtype=np.float32)
        rows *= self.idf
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
        return rows

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.centres.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
        return [self.languages[i] for i in best], score, score < self.bounds[best, band_of(counts)]


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Model of the labelled documents that are not held out; None without any."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out())
    counted = known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max(1, sample // LEAST)).collect()
    sizes = {r[lang]: r["count"] for r in counted}
    if not sizes:
        return None
    each = sample // len(sizes)
    place = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30))
    keep = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (
        F.lit(k), F.lit(min(1 << 30, (each << 30) // n)))]), F.col(lang))
    chosen = known.where(F.col(lang).isin(list(sizes))).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), place.alias("place"), keep.alias("keep")).where("place < keep")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(gram_counts(t), k, p) for t, k, p in zip(
                as_bytes(batch["text"]), batch["lang"].to_pylist(), batch["place"].to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.compress(np.minimum(c, 65535).astype("<u2").tobytes(), 1) for c, _, _ in rows], pa.binary()),
                 pa.array([k for _, k, _ in rows], pa.string()), pa.array([p for _, _, p in rows], pa.int64())],
                names=["counts", "lang", "place"])

    made = chosen.select("text", "lang", "place").mapInArrow(count, "counts binary, lang string, place long")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "counts"))  # cut before the shuffle
    table = made.withColumn("nth", first).where(F.col("nth") <= F.lit(each)).select("counts", "lang").toArrow()
    if not len(table):
        return None
    counts = np.empty((len(table), DIMENSIONS), "<u2")
    for i, packed in enumerate(table["counts"]):
        counts[i] = np.frombuffer(zlib.decompress(packed.as_py()), "<u2")
    return Model(counts, table["lang"].to_pylist())


def predict_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ["lang_pred", "score", "rejected"]

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            names, scores, out = [], [], []
            for part in slices(batch):
                texts = as_bytes(part)
                asked = [i for i, t in enumerate(texts) if known is not None and has_letter(t)]
                found = [(UNDETERMINED, 0.0, True)] * len(texts)
                if asked:
                    judged = known.predict(np.stack([gram_counts(texts[i]) for i in asked]))
                    for i, name, score, reject in zip(asked, *judged):
                        found[i] = name, float(score), bool(reject)
                for column, values in zip((names, scores, out), zip(*found) if found else ((), (), ())):
                    column += values
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=fields)
        give_back()

    return with_fields(docs, run(F.col(text)), fields)
