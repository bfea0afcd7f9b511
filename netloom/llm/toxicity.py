"""Toxicity by a chain of linear classifiers.

The categories are label columns in a given order.  Each has a logistic model on
the words a text has and on the log-odds of all earlier categories, so later
models can use what earlier ones found.  In training these log-odds are
out-of-fold: a document's earlier probabilities come from models that did not
see it, as it will be in use.

The chain is fitted on at most ``SAMPLE`` labelled documents with different
texts, chosen by a hash of the text.  Words are those that tell most about some
category (``WORDS`` for each, by chi-squared over the sample); prediction reads
every whole text.

Cases: a null text, and one without words, has probability 0 in every category;
documents with a null label are not learned from; with no labels at all, or one
class only, probabilities are the smoothed share of that class; a repeated
doc_id counts once for each of its rows; input columns named like an output
column give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import as_bytes, slices, with_fields
from netloom.session import cut_lineage

SAMPLE, WORDS, FOLDS, PENALTY, ROUNDS = 8000, 256, 3, 0.5, 150
# Words are runs of a-z and non-ASCII bytes; A-Z become a-z.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_set(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_BYTES).split())


class Features:
    """Rows of word numbers, held flat, with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, width: int):
        self.n, self.width, self.dense = len(rows), width, dense
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.word = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)

    def dot(self, w: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, w[self.word], self.n) + self.dense @ dense + bias

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Features, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS):
    """Weights of words, of dense columns, and bias: penalised likelihood by Adam steps."""
    k = x.dense.shape[1]
    theta, m, v = np.zeros(x.width + k + 1), 0.0, 0.0
    share = (y.sum() + 0.5) / (len(y) + 1)
    theta[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return theta[:x.width], theta[x.width:-1], theta[-1]
    for t in range(1, rounds + 1):
        g = sigmoid(x.dot(theta[:x.width], theta[x.width:-1], theta[-1])) - y
        grad = np.concatenate([x.back(g), x.dense.T @ g, [g.sum()]]) + penalty * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.15 * (1 - t / (rounds + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta[:x.width], theta[x.width:-1], theta[-1]


class Chain:
    """Words and, for each category, the model that follows those before it."""

    def __init__(self, categories: list[str], words: list[bytes], rows: list[np.ndarray], labels: np.ndarray):
        self.categories, self.models = list(categories), []
        self.number = {w: i for i, w in enumerate(words)}
        fold = np.arange(len(rows)) % FOLDS
        odds = np.zeros((len(rows), 0))
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            self.models.append(fit_logistic(Features(rows, odds, len(words)), y))
            out = np.zeros(len(rows))
            for f in range(FOLDS):  # earlier probabilities as models give them that did not see the row
                seen, asked = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(asked):
                    continue
                model = fit_logistic(Features([rows[i] for i in seen], odds[seen], len(words)), y[seen]) if len(seen) \
                    else self.models[-1]
                out[asked] = Features([rows[i] for i in asked], odds[asked], len(words)).dot(*model)
            odds = np.column_stack([odds, np.clip(out, -6, 6)])

    def rows(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
        known, number, rows, empty = self.number.keys(), self.number, [], []
        for text in texts:
            words = word_set(text)
            empty.append(not words)
            rows.append(np.array(sorted(number[w] for w in words & known), np.int64))
        return rows, np.array(empty, bool)

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """Probabilities, one column for each category."""
        rows, empty = self.rows(texts)
        odds, out = np.zeros((len(rows), 0)), []
        for model in self.models:
            z = Features(rows, odds, len(self.number)).dot(*model)
            out.append(np.where(empty, 0.0, sigmoid(z)))
            odds = np.column_stack([odds, np.clip(z, -6, 6)])
        return np.column_stack(out) if out else np.zeros((len(rows), 0))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text",
              sample: int = SAMPLE, words: int = WORDS) -> Chain:
    """Chain over ``categories``, 0/1 columns of ``labels``."""
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    total = known.count()
    both = docs.select("doc_id", F.col(text).alias("t")).where("t is not null").join(known, "doc_id")
    place = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    ys = [f"y{i}" for i in range(len(categories))]
    chosen = both.where(place < F.lit(min(1 << 30, (sample << 30) // max(total, 1)))).select("t", *ys)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(word_set(t)) for t in as_bytes(batch["t"])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sets, pa.list_(pa.binary())), *[batch[y] for y in ys]], names=["id", "words", *ys])

    shape = ", ".join(["id long", "words array<binary>", *[f"{y} int" for y in ys]])
    one = chosen.groupBy(F.xxhash64("t").alias("id")).agg(F.first("t").alias("t"), *[F.max(y).alias(y) for y in ys])
    sets = cut_lineage(one.mapInArrow(numbered, shape))
    n, *positive = sets.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
    positive = [p or 0 for p in positive]
    counts = sets.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(
        F.count("*").alias("df"), *[F.sum(y).alias(y) for y in ys]).where("df >= 3")
    top = None
    for y, p in zip(ys, positive):
        # chi-squared of word and category
        a, df = F.col(y).cast("double"), F.col("df").cast("double")
        expected = df * p / max(n, 1)
        score = F.pow(a - expected, 2) / F.greatest(expected * (1 - df / max(n, 1)) * (1 - p / max(n, 1)), F.lit(1e-9))
        part = counts.select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(words)
        top = part if top is None else top.unionByName(part)
    chosen_words = sorted({bytes(r["word"]) for r in top.select("word").distinct().collect()})
    number = {w: i for i, w in enumerate(chosen_words)}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[number[w] for w in ws if w in number] for ws in batch["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(rows, pa.list_(pa.int32())), *[batch[y] for y in ys]], names=["id", "found", *ys])

    shape = ", ".join(["id long", "found array<int>", *[f"{y} int" for y in ys]])
    table = sets.mapInArrow(kept, shape).toArrow().sort_by("id")
    rows = [np.array(r, np.int64) for r in table["found"].to_pylist()]
    y = np.column_stack([table[c].to_numpy() for c in ys]) if len(table) else np.zeros((0, len(ys)))
    return Chain(categories, chosen_words, rows, y)


def predict_toxicity(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds p_<category> and the decision <category> for every category of the chain."""
    shared, names = docs.sparkSession.sparkContext.broadcast(chain), chain.categories
    fields = [f"p_{c}" for c in names] + list(names)
    shape = ", ".join([f"`p_{c}` double" for c in names] + [f"`{c}` boolean" for c in names])

    @F.arrow_udf(shape)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            p = np.concatenate([shared.value.predict(as_bytes(part)) for part in slices(batch)])
            columns = [pa.array(p[:, i]) for i in range(len(names))]
            yield pa.StructArray.from_arrays(
                columns + [pa.array(p[:, i] >= threshold) for i in range(len(names))], names=fields)

    return with_fields(docs, run(F.col(text)), fields)
