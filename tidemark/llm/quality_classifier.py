"""Quality by positive-unlabelled learning.

Texts labelled good are trusted positives; the web text at large is unlabelled, a mixture of good texts, in an
estimated share, and others. A linear classifier on counts of a text's form and on its hashed words minimises the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic
loss. The share of good texts, the prior, comes from positives and unlabelled texts alone: of all thresholds on a
first classifier's scores, the one is taken at which the share of unlabelled texts above it, over the share of
positives above it, is surely smallest, and that ratio is the prior. Labels of bad texts are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, share, slices, slim, text_buffer, word_bounds, work_table
from .shingles import mix, word_hashes

#: Trusted positives and unlabelled texts that are learned from, chosen by a hash of their ids.
POSITIVES, UNLABELLED = 8000, 16000
#: Features that words are hashed to, and counts of form.
HASHED, FORMS = 256, 12

_KIND = np.zeros((6, 256), np.float64)
_KIND[0][[ord(c) for c in "#*$%&|<>"]] = 1
_KIND[1][[ord(c) for c in "!?"]] = 1
_KIND[2][65:91] = 1
_KIND[3][97:123] = 1
_KIND[4][48:58] = 1
_KIND[5][[ord(c) for c in ".,;:"]] = 1
_KIND = _KIND.astype(np.uint8)
_ENDS = np.zeros(256, bool)
_ENDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:"]] = True


def forms(column) -> np.ndarray:
    """A row of counts, mostly shares, for each text of an Arrow string array; zeros for one without words."""
    offsets, raw = text_buffer(column)
    out = []
    for first, last in slices(offsets, 1 << 20):
        part = offsets[first : last + 1]
        text, at = raw[part[0] : part[-1]], part - part[0]
        start, end = word_bounds(text, at)
        own = np.searchsorted(start, at)
        n_words, n_bytes = np.diff(own).astype(float), np.diff(at).astype(float)
        each = lambda flags, where: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[where]).astype(float)
        symbols, shouts, upper, lower, digits, marks = (each(k[text], at) for k in _KIND)
        h, _ = word_hashes(text, at)
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[own[:-1][n_words > 0]] = False
        tidy = each(_ENDS[text[end - 1]], own)
        short = each(end - start == 1, own)
        lines = each(text == 10, at) + 1
        kinds = np.array([len(np.unique(h[a:b])) for a, b in zip(own[:-1], own[1:])], float)
        words, size, letters = np.maximum(n_words, 1), np.maximum(n_bytes, 1), np.maximum(upper + lower, 1)
        spread = np.log1p(kinds) / np.log1p(words)  # falls slowly with the length of ordinary text
        x = np.stack((
            np.sqrt(symbols / size), np.sqrt(shouts / size), upper / letters, np.sqrt(digits / size), np.sqrt(marks / size),
            np.sqrt(each(again, own) / words), 1 - tidy / words, np.sqrt(short / words), np.minimum(size / words, 30) / 10, 1 - spread,
            np.minimum(lines / words, 1), np.log1p(n_words) / 10,
        ), 1)
        x[n_words == 0] = 0
        # words by hash, with a sign, so that those that meet in one feature cancel out rather than add up
        place = mix(h, 21)
        text_of = np.repeat(np.arange(len(n_words)), np.diff(own))
        at_feature = text_of * HASHED + (place >> np.uint64(1)).astype(np.int64) % HASHED
        sign = np.where(place & np.uint64(1), 1.0, -1.0)
        bag = np.bincount(at_feature, sign, len(n_words) * HASHED).reshape(-1, HASHED)
        bag = np.sign(bag) * np.sqrt(np.abs(bag) / words[:, None])
        out.append(np.concatenate((x, bag), 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, FORMS + HASHED), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk_and_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive term, negative term, gradient of each) of the unbiased risk with the logistic loss, at weights w."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -80, 80)))
    zp, zu = p @ w, u @ w
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_pos = -prior * (p.T @ sigmoid(-zp)) / len(p)
    g_neg = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
    return float(positive), float(negative), g_pos, g_neg


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4, ridge_words: float = 3e-3) -> Model:
    """Adam on the non-negative risk; while its second term is below zero, a step goes against that term."""
    both = np.concatenate((p, u))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    one = lambda x: np.append(np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)), 1).astype(np.float32)
    p, u = one(p), one(u)
    w = np.zeros(p.shape[1], np.float32)
    shrink = np.concatenate((np.full(FORMS, ridge), np.full(len(w) - FORMS - 1, ridge_words), [0])).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, negative, g_pos, g_neg = risk_and_gradient(w, p, u, prior)
        grad = (g_pos + g_neg if negative >= 0 else -g_neg) + shrink * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1].astype(np.float64), float(w[-1]), prior)


def estimated_prior(p: np.ndarray, u: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled scores u, given scores p of positives: at the threshold where the ratio of
    the shares above it, with what chance may add, is smallest. 0.02 to 0.98."""
    if not len(p) or not len(u):
        return 0.5
    p, u = np.sort(p), np.sort(u)
    above = lambda x, at: 1 - np.searchsorted(x, at, side="left") / len(x)
    at = np.unique(p)
    share_p, share_u = above(p, at), above(u, at)
    chance = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((share_u + chance) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """The prior from halves - each scored by a classifier of positives against unlabelled that saw the other - and then
    the classifier on all."""
    halves = [(x[::2], x[1::2]) for x in (p, u)]
    scores: list[list[np.ndarray]] = [[], []]
    if min(len(p), len(u)) > 1:
        for k in (0, 1):
            first = non_negative_risk(halves[0][k], halves[1][k], 0.5, rounds=100)
            for kind in (0, 1):
                scores[kind].append(first.score(halves[kind][1 - k]))
        prior = float(np.mean([estimated_prior(a, b) for a, b in zip(*scores)]))
    else:
        prior = 0.5
    return non_negative_risk(p, u, prior)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """From labels (doc_id, quality) and docs (doc_id, text): the rows labelled 1 are the positives, a sample of all
    texts, whatever their labels, is the unlabelled text. Rows with a null id, label or text teach nothing; of an id
    labelled twice the higher label counts; an id on many rows teaches once, by the first of its texts. The samples'
    counts, never texts, reach the driver: at most twice as many as `positives` and `unlabelled` say. Without positives
    or texts there is no model.
    """
    with Scratch() as inner:
        model = _learn(docs, labels, positives, unlabelled)
    inner.drop()
    return model


def _learn(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> Model | None:
    good = labels.filter((F.col("quality") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    n_good = good.count()
    if not n_good:
        return None
    total = texts.agg(F.approx_count_distinct("doc_id")).first()[0]
    parts = 1 << 30
    drawn = lambda seed, share: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(parts)) < int(parts * min(1.0, share))
    chosen = good.filter(drawn(51, positives / n_good)).limit(2 * positives)
    once = lambda rows: rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    p = once(texts.join(F.broadcast(chosen), "doc_id", "left_semi")).select("text", F.lit(1).alias("y"))
    u = once(texts.filter(drawn(52, unlabelled / max(total, 1)))).select("text", F.lit(0).alias("y")).limit(2 * unlabelled)

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in forms(b.column(0))], pa.binary()), b.column(1)], ["x", "y"])

    got = work_table(p.union(u).mapInArrow(slim(count), "x binary, y int"))
    x = [sorted(bytes(r["x"]) for r in got.filter(F.col("y") == y).select("x").collect()) for y in (1, 0)]
    p, u = (np.frombuffer(b"".join(v), np.float32).reshape(-1, FORMS + HASHED) for v in x)
    if not len(p) or not len(u):
        return None
    return fit(p, u)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text). A null or empty text counts zero of
    everything and is scored on that; without a model every score is 0.5; repeated rows get equal scores; an empty
    table gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch() as inner:
        shared = share(docs.sparkSession, model)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = forms(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x) if shared.value else np.full(len(x), 0.5))], ["doc_id", "score"])

        out = work_table(docs.select("doc_id", "text").mapInArrow(slim(run), f"doc_id {kind}, score double"))
    inner.drop(out)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(table: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 5 is not 0."""
    return table.filter(fold_of(F.col("doc_id"), 5) != 0)
