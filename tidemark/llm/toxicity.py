"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of n-grams of 3, 5 and 7 letters in a whole text. Each is scaled by its log ratio of
shares in toxic and other labelled texts, and logistic regression learns weights on the scaled features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, share, slim, work_table
from .letters import chunks, grams, sequences
from .shingles import mix

ORDERS = (3, 5, 7)
#: Labelled texts of each class that are learned from, chosen by a hash of their ids; features; least texts with a feature.
SAMPLE, FEATURES, LEAST = 3000, 1 << 13, 4
FILTER_BITS = 21


def _hashed(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the n-grams, starts of each text's own)."""
    if order <= 4:
        g, own = grams(codes, starts, order)
        return mix(g, order), own
    g, own = grams(codes, starts, 4)
    # a window of up to eight codes is that of its first four and of its last four
    skip = order - 4
    count = np.maximum(np.diff(own) - skip, 0)
    at = np.repeat(own[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return mix(g[at] ^ mix(g[at + skip], 7), order), np.concatenate(([0], np.cumsum(count)))


@dataclass
class Model:
    key: np.ndarray  # sorted hashes of the features
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once."""
        out = []
        if len(self.key):
            for a, b in chunks(texts):
                codes, starts = sequences(texts[a:b], 1)
                for order in ORDERS:
                    h, own = _hashed(codes, starts, order)
                    hit = np.flatnonzero(self.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
                    real = self.key[at] == h[hit]
                    text = np.searchsorted(own, hit[real], side="right") - 1 + a
                    out.append(text * len(self.key) + at[real])
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pairs // max(len(self.key), 1), pairs % max(len(self.key), 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, feature = self.features(texts)
        z = self.bias + np.bincount(text, self.weight[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, y: np.ndarray, n_cols: int, ridge: float = 1e-4, rounds: int = 60, close: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse rows, by L-BFGS with a memory of ten steps, until the
    gradient is as small as `close`. The bias isn't held down."""
    n = len(y)
    held = np.append(np.full(n_cols, ridge), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, w[cols] * value, n) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.append(np.bincount(cols, e[rows] * value, n_cols), e.sum()) + held * w
        return float((np.logaddexp(0, z) - y * z).mean() + 0.5 * (held * w * w).sum()), grad

    w = np.zeros(n_cols + 1)
    now, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() < close:
            break
        d, used = -grad, []
        for s, g in reversed(steps):
            used.append((s @ d) / (s @ g))
            d = d - used[-1] * g
        if steps:
            d = d * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        else:
            d = d / max(np.abs(grad).sum(), 1e-12)
        for (s, g), a in zip(steps, reversed(used)):
            d = d + s * (a - (g @ d) / (s @ g))
        size, slope = 1.0, grad @ d
        while True:  # half the step until it lowers the loss enough
            new, new_grad = loss(w + size * d)
            if new <= now + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        if new >= now:
            break
        s, g = size * d, new_grad - grad
        w, now, grad = w + s, new, new_grad
        if s @ g > 1e-12:
            steps = [*steps[-9:], (s, g)]
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows of labels (doc_id, toxic) and the texts of docs (doc_id, text): about `sample` rows of each class.

    Rows with a null label, id or text teach nothing; of an id labelled twice the higher label counts. What
    reaches the driver is bounded by the sample and by FEATURES: an id on many rows teaches once, by the first of its
    texts. With rows of one class or none, every score is 0.
    """
    with Scratch() as inner:
        model = _learn(docs, labels, sample)
    inner.drop()
    return model


def _learn(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    spark = docs.sparkSession
    known = work_table(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    parts = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(parts))
    part = F.when(F.col("y") == 1, F.lit(min(1.0, sample / sizes[1]))).otherwise(F.lit(min(1.0, sample / sizes[0])))
    chosen = known.filter(draw < part * parts).limit(3 * sample)  # two classes of about `sample`: far below the limit
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = work_table(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"))

    def count(batches):
        import pyarrow as pa

        found = []
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1).to_numpy()
            for a, z in chunks(texts):
                codes, starts = sequences(texts[a:z], 1)
                for order in ORDERS:
                    h, own = _hashed(codes, starts, order)
                    for side in (0, 1):
                        some = [np.unique(h[own[i] : own[i + 1]]) for i in range(z - a) if y[a + i] == side]
                        if some:
                            found.append((side, *np.unique(np.concatenate(some), return_counts=True)))
        if not found:
            return
        key = np.unique(np.concatenate([k for _, k, _ in found]))
        n = np.zeros((2, len(key)), np.int64)
        for side, k, c in found:
            n[side][np.searchsorted(key, k)] += c
        for i in range(0, len(key), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(n[0][s]), pa.array(n[1][s])], ["h", "other", "toxic"])

    n0, n1 = (rows.filter(f"y = {k}").count() for k in (0, 1))
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    counted = rows.mapInArrow(slim(count), "h long, other long, toxic long").groupBy("h").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 1.0) / (n1 + 2.0)) - F.log((F.col("other") + 1.0) / (n0 + 2.0))
    best = counted.filter(F.col("other") + F.col("toxic") >= LEAST).withColumn("r", ratio)
    # by how far the ratio is from 0 for the texts it rests on
    top = best.orderBy(F.desc(F.abs("r") * F.sqrt(F.col("other") + F.col("toxic"))), "h").limit(FEATURES).toPandas()
    key, r = top.h.to_numpy(np.int64).view(np.uint64), top.r.to_numpy()
    order = np.argsort(key)
    key, r = key[order], r[order]
    empty = share(spark, Model(key, np.zeros(len(key)), 0.0))

    def design(batches):
        import pyarrow as pa

        m = empty.value
        for b in batches:
            text, feature = m.features(b.column(0).to_pylist())
            own = [feature[a:z].astype(np.int32).tobytes() for a, z in zip(*(np.searchsorted(text, np.arange(b.num_rows), side=s) for s in ("left", "right")))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), b.column(1)], ["features", "y"])

    got = rows.mapInArrow(slim(design), "features binary, y int").toPandas().sort_values(["y", "features"])
    own = [np.frombuffer(x, np.int32) for x in got.features]
    y = got.y.to_numpy(np.float64)
    text, feature = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own]), np.concatenate(own)
    w, bias = logistic(text, feature, r.astype(np.float32)[feature], y, len(key))
    # the sample has other shares of the classes than the labels have
    bias += np.log(sizes[1] / sizes[0]) - np.log(n1 / n0)
    return Model(key, w * r, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text). A null or empty text has no feature and
    gets the score of the bias; texts are taken whole; repeated rows get equal scores; an empty table gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch() as inner:
        shared = share(docs.sparkSession, model)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()))], ["doc_id", "score"])

        out = work_table(docs.select("doc_id", "text").mapInArrow(slim(run), f"doc_id {kind}, score double"))
    inner.drop(out)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id modulo 4 is not 2."""
    return labels.filter(fold_of(F.col("doc_id"), 4) != 2)
