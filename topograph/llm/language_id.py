"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text; a feature's value is its share of the text's n-grams times its inverse
document frequency. Document frequencies cover every learnable row. The weights are fitted by
follow-the-regularised-leader (McMahan et al., 2013) with L1 and L2 penalties on a bounded sample (SAMPLE rows, chosen by seeded hash, evenly over
the languages), and a temperature is fitted on a fifth of it that the weights haven't seen. Prediction takes whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; between equally likely languages the first in sorted order wins; without
a learnable row every text is ``und``; rows with a null language teach nothing; repeated rows count as often as they come; a very long text is counted in
pieces, in memory that its length doesn't set but for its characters; more than LANGUAGES languages raise an error; other columns are kept, and columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, widened

FEATURES = 1 << 16
#: Rows that the weights and the temperature are fitted on, at most about so many.
SAMPLE = 2400
#: Characters of the snippets that the temperature is fitted on, beside whole texts.
SNIPPET = 24
#: Languages that may be learned; what a label is has to be few.
LANGUAGES = 200
#: Of follow-the-regularised-leader; at this L1 penalty most weights of seen features are zero.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.03, 1e-6, 3
#: Characters whose n-grams are hashed at once.
PIECE = 1 << 18
_SALT = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def counts_of(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the text, one for each place and n."""
    c = np.concatenate([[32], np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), [32]]).astype(np.uint32)
    out = np.zeros(FEATURES, np.int64)
    for start in range(0, len(c), PIECE):
        part = c[start : start + PIECE + 2]
        h, found = np.zeros(len(part), np.uint32), []
        for n in range(3):
            h = (h[: len(part) - n] if n else h) + part[n:] * _SALT[n]
            x = h * np.uint32(0x27D4EB2F)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x165667B1 + 2 * n)
            found.append((x >> np.uint32(16))[:PIECE])
            h = h[:-1] if n < 2 else h
        out += np.bincount(np.concatenate(found), minlength=FEATURES)
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's features and their shares."""
    counts = counts_of(text)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / counts.sum()


def document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: how many texts have each feature, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += counts_of(t.as_py()) > 0
                n += 1
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(df[ids], n))], names=["f", "n"])

    found = bounded_batches(rows.select(F.col(f"`{text}`").alias("text"))).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # FEATURES rows at most
    df = np.zeros(FEATURES, np.int64)
    own = found[found.f >= 0]
    df[own.f.to_numpy()] = own.n
    return df, int(found[found.f < 0].n.sum())


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        return self.score(counted(text))

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ids, shares = found
        return shares @ self.weights[ids] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    order = np.random.default_rng(seed)

    def weights(ids: np.ndarray) -> np.ndarray:
        zz = z[ids]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            ids, x = rows[i]
            ids, x = np.append(ids, FEATURES), np.append(x * idf[ids] * 10, 1.0)
            w = weights(ids)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1] * idf[:, None] * 10, w[-1]


def sampled(rows: DataFrame) -> DataFrame:
    """rows (u, lang, tag, text) with features, at most FEATURES of each text, and snippets in place of texts, so that the driver gets no whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = [counted(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("u", "lang", "tag")), pa.array([i.astype(np.int64).tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()),
             pa.array([[t[:SNIPPET], t[len(t) // 2 : len(t) // 2 + SNIPPET]] for t in texts], pa.list_(pa.string()))],
            names=["u", "lang", "tag", "ids", "shares", "snippets"],
        )

    return map_texts(rows, "text", run, "u double, lang string, tag long, ids binary, shares binary, snippets array<string>")


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of a grid with the least negative log likelihood."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    return min(np.geomspace(0.05, 10, 60).tolist(), key=loss) if len(labels) else 1.0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, seed: int = 5) -> Model | None:
    """A model from labelled rows. The key only decides which rows are sampled."""
    rows = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").cast("string").alias("key")).filter(has_letter(F.col("text")) & F.col("lang").isNotNull())
    sizes = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).toPandas().itertuples(index=False))
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not sizes:
        return None
    df, total = document_frequencies(rows, "text")
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / len(sizes) / n))).otherwise(share)
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 11) / F.lit(float(1 << 53))).alias("u")
    chosen = sampled(rows.withColumn("u", drawn).filter(F.col("u") < share).select("u", "lang", F.xxhash64("text").alias("tag"), "text")).toPandas().sort_values(["u", "lang", "tag"], ignore_index=True)
    languages = sorted(sizes)
    labels = chosen["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 0.1, 0.0)
    x = [(np.frombuffer(i, np.int64), np.frombuffer(s)) for i, s in zip(chosen["ids"], chosen["shares"], strict=True)]
    cal = np.arange(len(x)) % 5 == 4
    weights, bias = ftrl([r for r, c in zip(x, cal, strict=True) if not c], labels[~cal], idf, len(languages), seed)
    # short snippets as well as whole texts, as confidence has to hold for both
    model = Model(languages, weights.astype(np.float32), bias, 1.0)
    unseen = [f for r, own, c in zip(x, chosen["snippets"], cal, strict=True) if c for f in (r, *map(counted, own))]
    logits = np.array([model.score(f) for f in unseen]).reshape(-1, len(languages))
    model.temperature = temperature(logits, np.repeat(labels[cal], 3).astype(int))
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    kept = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = widened(kept, lang_pred="string", score="double")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        out = [own.predict(t) if own and t and any(map(str.isalpha, t)) else ("und", 0.0) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_texts(kept, text, run, schema)


def held_out(key: Column) -> Column:
    """The rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def label(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """df with held_out, lang_pred and score; the model learns from the rows that are not held out."""
    model = fit(df.filter(~held_out(F.col(f"`{key}`"))), text, lang, key)
    return predict(df.withColumn("held_out", held_out(F.col(f"`{key}`"))), model, text)


def accuracy(labelled: DataFrame, lang: str = "lang") -> pd.DataFrame:
    """Held-out accuracy for each language."""
    return labelled.filter("held_out").groupBy(lang).agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col(lang)).cast("double")).alias("accuracy"), F.avg("score").alias("score")).toPandas()
