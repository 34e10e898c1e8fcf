"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

A model is a set of sorted arrays of hashes (four characters packed in 64 bits) with log probabilities in all
languages beside them, so a text is read once, not once a language. The language of the lowest cross-entropy a
character is taken; a text is rejected if even that is above a limit set on rows that the models haven't seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, share, slim, work_table
from .letters import chunks, grams, per_text, sequences

#: Characters that each language is learned from, in whole texts chosen by a hash of id and text; with many languages each
#: gets its part of ALL_CHARS, which bounds what reaches the driver.
SAMPLE_CHARS, ALL_CHARS = 600_000, 60_000_000
ORDER = 4
#: A text has letters, or characters that this Java doesn't know and Python may.
LETTER = r"[\p{L}\p{Cn}]"
#: Bits a character by which the entropy of a text may exceed what nearly all texts of its language have: half the way to
#: what texts of other languages cost, within these; and SHORT / sqrt(characters) more for a short text.
LEAST_SLACK, SLACK, SHORT = 0.75, 1.5, 6.0


@dataclass
class Level:
    """n-grams of one order: log2 P(last | rest) by language; and contexts of that length - 1: log2 of the weight of lower orders."""

    key: np.ndarray
    logp: np.ndarray
    context: np.ndarray
    weight: np.ndarray


@dataclass
class Models:
    languages: list[str]
    levels: list[Level]  # of orders ORDER, ORDER - 1, .., 1
    floor: np.ndarray  # log2 P of a character never seen, by language
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logp(self, g: np.ndarray) -> np.ndarray:
        """log2 P(last character | those before) by language, for packed grams of ORDER characters."""
        return self._logp(g, 0)

    def _logp(self, g: np.ndarray, depth: int) -> np.ndarray:
        if depth == len(self.levels):
            return np.broadcast_to(self.floor, (len(g), len(self.languages)))
        level = self.levels[depth]
        at = np.minimum(np.searchsorted(level.key, g), len(level.key) - 1)
        out = level.logp[at]
        miss = np.flatnonzero(level.key[at] != g)
        if len(miss):
            rest = g[miss] >> np.uint64(16)
            at = np.minimum(np.searchsorted(level.context, rest), len(level.context) - 1)
            weight = np.where((level.context[at] == rest)[:, None], level.weight[at], 0)
            shift = np.uint64(16 * (len(self.levels) - 1 - depth))
            out[miss] = weight + self._logp(g[miss] & ((np.uint64(1) << shift) - np.uint64(1)), depth + 1)
        return out

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character by language, characters) for each text."""
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            g, starts = grams(*sequences(texts[a:b], ORDER - 1), ORDER)
            size[a:b] = np.diff(starts)
            if len(self.languages) and len(g):
                bits[a:b] = per_text(self.logp(g), starts)
        return -bits / np.maximum(size, 1)[:, None], size


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Models:
    """counts: for each language, the sorted grams of ORDER characters and how often each occurs.

    The highest order uses the counts, each lower one in how many kinds of the order above a gram ends. The
    discount is n1 / (n1 + 2 * n2); below single characters stands a uniform share, over the characters of all
    languages, so that no language is cheap for what it hasn't seen.
    """
    per_order, now = [], counts
    for order in range(ORDER, 0, -1):
        per_order.append(now)
        mask = (np.uint64(1) << np.uint64(16 * (order - 1))) - np.uint64(1)
        now = [np.unique(k & mask, return_counts=True) for k, _ in now]
    n_lang = len(languages)
    alphabet = np.full(n_lang, len(np.unique(np.concatenate([k for k, _ in per_order[-1]]))) + 1, float)
    floor = np.zeros(n_lang)
    levels: list[Level] = []
    for depth in range(ORDER - 1, -1, -1):  # from single characters up
        own = per_order[depth]
        key = np.unique(np.concatenate([k for k, _ in own]))
        context = np.unique(key >> np.uint64(16))
        mass, weight = np.zeros((len(key), n_lang)), np.ones((len(context), n_lang))
        for j, (k, c) in enumerate(own):
            n1, n2 = int((c == 1).sum()), int((c == 2).sum())
            cut = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
            ctx, of = np.unique(k >> np.uint64(16), return_inverse=True)
            total = np.bincount(of, c)
            mass[np.searchsorted(key, k), j] = (c - cut) / total[of]
            weight[np.searchsorted(context, ctx), j] = cut * np.bincount(of) / total
        of = np.searchsorted(context, key >> np.uint64(16))
        if depth == ORDER - 1:
            lower = np.broadcast_to(1 / alphabet, (len(key), n_lang))
            floor = np.log2(1 / alphabet)
        else:
            below = Models(languages, levels, floor)
            shift = np.uint64(16 * (ORDER - 1 - depth))
            lower = np.exp2(below.logp(key & ((np.uint64(1) << shift) - np.uint64(1))))
        logp = np.log2(mass + weight[of] * lower)
        levels = [Level(key, logp.astype(np.float32), context, np.log2(weight).astype(np.float32)), *levels]
    return Models(languages, levels, floor)


def _count(batches):
    """(lang, text) to (lang, gram, n)."""
    import pyarrow as pa

    found: dict[str, list] = {}
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            g, _ = grams(*sequences([t for t, x in zip(texts, langs) if x == lang], ORDER - 1), ORDER)
            found.setdefault(lang, []).append(np.unique(g, return_counts=True))
    for lang, parts in found.items():
        key, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(of, np.concatenate([c for _, c in parts])).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        for i in range(0, len(key), 1 << 16):
            part = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["lang", "gram", "n"])


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Models:
    """From rows of docs (doc_id, text, lang) with a text and a lang: about sample_chars characters of each language.

    Four fifths of the sample make the models, the rest sets each language's limit from both sides: what its own texts
    cost, and what texts of other languages cost whose best model it would be if their own were missing. Where that leaves less than half
    of what a language has (a few texts, or very long ones), more of its texts are drawn and all of them make the
    model; its limit is then the cost of characters drawn uniformly from those of all languages. Counts of the sample
    reach the driver. A language without letters isn't learned; without rows there is no language. The model is dense
    in languages: there may be hundreds. A row that is repeated is drawn as often as it stands there, or not at all.
    """
    with Scratch() as inner:
        models = _learn(docs, sample_chars)
    inner.drop()
    return models


def _learn(docs: DataFrame, sample_chars: int) -> Models:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    sample_chars = min(sample_chars, ALL_CHARS // max(len(sizes), 1))
    parts = 1 << 20
    draw = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(parts))
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(5)).alias("part")
    spark = docs.sparkSession

    def drawn(shares: dict[str, float]) -> DataFrame:
        small = F.broadcast(spark.createDataFrame(sorted(shares.items()), "lang string, share double"))  # a row a language
        return work_table(known.join(small, "lang").filter(draw < F.col("share") * parts).select("lang", "text", part))

    def characters(rows: DataFrame) -> dict[str, int]:
        return {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}

    shares = {lang: min(1.0, sample_chars / n) for lang, n in sizes.items()}
    sample = drawn(shares)
    enough = {lang: min(n, sample_chars) / 2 for lang, n in sizes.items()}
    have = characters(sample.filter("part > 0"))
    thin = sorted(lang for lang in sizes if have.get(lang, 0) < enough[lang])
    learned = sample.filter("part > 0").filter(~F.col("lang").isin(thin)).select("lang", "text")
    rest = {lang: shares[lang] for lang in thin}
    while rest:
        rows = drawn(rest)
        have = characters(rows)
        done = [lang for lang in rest if have.get(lang, 0) >= enough[lang] or rest[lang] >= 1]
        learned = learned.union(rows.filter(F.col("lang").isin(done)).select("lang", "text"))
        rest = {lang: min(1.0, 4 * x) for lang, x in rest.items() if lang not in done}
    counted = work_table(learned.mapInArrow(slim(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))).toPandas()
    languages = sorted(counted.lang.unique())
    if not languages:
        return Models([], [], np.zeros(0), np.zeros(0))
    counts = []
    for lang in languages:
        own = counted[counted.lang == lang]
        key = own.gram.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        counts.append((key[order], own.n.to_numpy(np.int64)[order]))
    models = kneser_ney(counts, languages)
    shared = share(spark, models)

    def own_entropy(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            langs = b.column(0).to_pylist()
            bits, size = m.entropy(b.column(1).to_pylist())
            at = np.arange(len(langs)), [m.languages.index(x) for x in langs]
            own = bits[at]
            bits[at] = np.inf  # as if the text's own language hadn't been learned
            near = pa.array([m.languages[j] for j in bits.argmin(1)], pa.string())
            columns = [b.column(0), pa.array(own), near, pa.array(bits.min(1)), pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bits", "near", "away", "size"])

    unseen = sample.filter("part = 0").filter(F.col("lang").isin([x for x in languages if x not in thin])).select("lang", "text")
    unseen = work_table(unseen.mapInArrow(slim(own_entropy), "lang string, bits double, near string, away double, size long")).filter("size > 0")

    def quantile(by: str, bits: str, at: float) -> dict[str, float]:
        """A quantile of long texts, or of all where none is long, less what predict() adds for a short one."""
        long, short = F.when(F.col("size") >= 200, F.col(bits)), F.col(bits) - SHORT / F.sqrt("size")
        found = unseen.groupBy(by).agg(F.percentile_approx(long, at).alias("q"), F.percentile_approx(short, at).alias("s")).collect()
        return {r[by]: r["s"] if r["q"] is None else r["q"] for r in found}

    own, strange = quantile("lang", "bits", 0.99), quantile("near", "away", 0.01)
    high = {x: q + min(SLACK, max(LEAST_SLACK, (strange.get(x, np.inf) - q) / 2)) for x, q in own.items()}
    models.limit = np.array([high.get(x, -models.floor[j]) for j, x in enumerate(languages)])
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs (doc_id, text and any more) to (doc_id, lang_pred, score, bits, rejected) for every row.

    lang_pred: the language of the lowest bits a character; und for a null text, one without letters, or if no
    language was learned. score: how far the best language leads, times how well the text fits it, 0 to 1.
    rejected: und, or more bits than the language's limit (plus SHORT / sqrt(characters)). Repeated rows get
    equal results; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch() as inner:
        shared = share(docs.sparkSession, models)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                lang, score, bits, rejected = predict(shared.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

        schema = f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean"
        out = work_table(docs.select("doc_id", "text").mapInArrow(slim(run), schema))
    inner.drop(out)
    return out


def predict(m: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    bits, size = m.entropy(texts)
    known = (size > 0) & (len(m.languages) > 0)
    if not m.languages:
        zero = np.zeros(len(texts))
        return ["und"] * len(texts), zero, zero, np.ones(len(texts), bool)
    best = bits.argmin(1)
    low = bits[np.arange(len(texts)), best]
    share = 1 / np.exp2(np.minimum(4 * (low[:, None] - bits), 0)).sum(1)
    limit = m.limit[best] + SHORT / np.sqrt(np.maximum(size, 1))
    fit = 1 / (1 + np.exp2(np.clip(4 * (low - limit), -60, 60)))
    lang = [m.languages[j] if k else "und" for j, k in zip(best.tolist(), known.tolist())]
    return lang, np.where(known, share * fit, 0.0), np.where(known, low, 0.0), ~known | (low > limit)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that models may learn from: crc32 of the id modulo 4 is not 2."""
    return docs.filter(fold_of(F.col("doc_id"), 4) != 2)


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs that identify() doesn't reject, with all their columns, in one pass."""
    at = [f.name for f in docs.schema].index("text")
    with Scratch() as inner:
        shared = share(docs.sparkSession, models)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield b.filter(pa.array(~predict(shared.value, b.column(at).to_pylist())[3]))

        out = work_table(docs.mapInArrow(slim(run), docs.schema))
    inner.drop(out)
    return out
