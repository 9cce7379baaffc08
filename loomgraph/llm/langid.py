"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become counts of lower-cased character n-grams of orders 1 to 3, hashed into DIMENSIONS places, damped
by log(1 + count), weighted by inverse document frequency and scaled to length one. Weights are learnt by
follow-the-regularised-leader with elastic-net penalties; a temperature fitted on a part of the sample
that isn't trained on calibrates the probabilities.

Document frequencies cover all labelled training rows. The weights are fitted on a sample of at most about
PER_LANGUAGE rows of each language, chosen by a hash of the row: that bound is the documented parameter of
the fit. Prediction reads whole texts.

Null texts and texts without a letter are `und` with score 0. Without any training row, everything is `und`.
Rows without a label are predicted but not learnt from. Repeated rows stay. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, release, releasing

DIMENSIONS = 1 << 15
PER_LANGUAGE = 800
UNKNOWN = "und"


def held_out() -> Column:
    return crc_of_id("doc_id") % 4 == 2


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the n-grams of a text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    counts = np.zeros(DIMENSIONS, np.int64)
    for h in (one, two, three):
        counts += np.bincount(((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(17), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf[at]
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, counts = places(text)
        p = softmax(self.logits(at, self.vector(at, counts)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> None:
    """Follow-the-regularised-leader (proximal); l1 and l2 are the elastic net. Places never seen keep weight 0."""
    k = len(model.languages)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))
    rng = np.random.default_rng(3)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            y, at, v = rows[i]
            at, x = np.append(at, DIMENSIONS), np.append(v, 1.0)  # the last place is the bias
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    every = weights(np.arange(DIMENSIONS + 1))
    model.weights, model.bias = every[:-1], every[-1]


def temperature(x: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss of logits x and classes y, by Newton steps for its reciprocal.

    Classes are smoothed by one row in all, so that logits without an error have a finite optimum too.
    """
    n, k = x.shape
    q = np.full((n, k), 1 / (k * (n + 1)))
    q[np.arange(n), y] += n / (n + 1)
    beta = 1.0
    for _ in range(100):
        p = softmax(beta * x)
        mean = (p * x).sum(axis=1)
        slope, bend = (mean - (q * x).sum(axis=1)).mean(), ((p * x * x).sum(axis=1) - mean**2).mean()
        step = float(np.clip(beta - slope / max(bend, 1e-12), beta / 2, beta * 2)) - beta
        beta += step
        if abs(step) < 1e-9 * beta:
            break
    return 1 / beta


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Sets the temperature, from rows that weren't trained on."""
    if rows:
        model.temperature = temperature(np.array([model.logits(at, v) for _, at, v in rows]), np.array([r[0] for r in rows]))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang; rows without text or lang teach nothing."""
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0)

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMENSIONS, np.int64)
        for f in frames:
            for text in f["text"]:
                df[places(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"place": at, "n": df[at]})

    df = np.zeros(DIMENSIONS)
    for r in rows.select("text").mapInPandas(releasing(frequencies), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r.place] = r.n
    model = Model(languages, np.log((1 + sum(sizes.values())) / (1 + df)) + 1, np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages)), 1.0)

    def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [places(t) for t in f["text"]]
            yield pd.DataFrame({"lang": f["lang"], "h": f["h"], "at": [a.astype("<u2").tobytes() for a, _ in got], "n": [np.minimum(c, 2**31 - 1).astype("<u4").tobytes() for _, c in got]})

    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()))
    h = F.xxhash64(F.lit(11), "doc_id", "text")
    picked = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    sample = sorted(picked.select("text", "lang", "h").mapInPandas(releasing(sampled), "lang string, h long, at binary, n binary").collect(), key=lambda r: (r.h, r.lang))
    index = {k: i for i, k in enumerate(languages)}
    made = []
    for r in sample:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        made.append((index[r.lang], at, model.vector(at, np.frombuffer(r["n"], "<u4"))))
    kept = [x for i, x in enumerate(made) if i % 5]
    train_ftrl(model, kept or made)
    calibrate(model, made[::5] if kept else [])
    return model


def identify(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """columns of docs with lang_pred and score; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x languages, whatever the input's size

    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([sent.value.predict(t) for t in text], columns=["lang_pred", "score"])
        release()
        return out

    predicted = predicted.asNondeterministic()  # else a filter on its columns runs it twice
    return docs.withColumn("_p", predicted("text")).select(*columns, "_p.lang_pred", "_p.score")
