"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes that a text is good (1), bad (-1) or abstains (0). Votes are counted by pattern: with R rules
there are 3**R patterns at most, however many documents there are. Expectation-maximisation over those counts
estimates the share of good texts and, for each rule, how often it votes either way on good and on bad texts.
A document's posterior probability of being good follows from its votes as a sum of log odds, which is a
column expression again; it replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, work_table

#: Base rules, fixed by the contract.
LEAST_WORDS, MOST_REPEAT_PCT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_ends", "n_stutter")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _beside(h: Column, by: int, f) -> Column:
    """f(x[i], x[i + by]) for all i for which there are both."""
    n = F.greatest(F.size(h) - by, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + by), n), f)


def _covered(at: Column) -> Column:
    """Words that lie in windows found twice or more; at: (hash, first word) of the windows in order. A column
    of its own, for inside a function of elements an expression would be worked out for each element anew."""
    twice = lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"])
    pairs = F.transform(at, lambda x, k: F.struct(x["i"].alias("i"), twice(x, k).alias("twice")))
    found = F.sort_array(F.transform(F.filter(pairs, lambda x: x["twice"]), lambda x: x["i"]))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
    return F.aggregate(found, none, step, lambda a: a["n"])


def add_stats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the counts of STATS, their names after prefix. A null text has no words and no lines. Other columns
    may have any names but those of the counts.

    Words are hashed once; the hash of a window of eight is put together from those of its halves, three times over.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = free_name([*docs.columns, *(prefix + k for k in STATS)])
    words, hashes, two, four, eight, at, lines = (own + k for k in ("w", "h", "2", "4", "8", "at", "l"))
    pair = lambda a, b: F.xxhash64(a, b)
    staged = docs.withColumn(words, _words(text)).withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x)))
    for new, old, by in ((two, hashes, 1), (four, two, 2), (eight, four, 4)):
        staged = staged.withColumn(new, _beside(F.col(old), by, pair))
    # most texts have no window twice: that is cheap to see
    twice = F.size(F.array_distinct(eight)) < F.size(eight)
    placed = F.transform(eight, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    staged = staged.withColumn(at, F.when(twice, F.array_sort(placed)))
    staged = staged.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.regexp_count(text, F.lit("[" + SYMBOLS + "]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(at).isNull(), F.lit(0)).otherwise(_covered(F.col(at))),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_lower": F.regexp_count(text, F.lit(r"\p{Ll}+")),
        # words that end in a letter or digit, with one mark of a sentence at most
        "n_ends": F.regexp_count(text, F.lit(r"[\p{L}\p{N}][.,;:!?]?(?=[\x20\x09-\x0D]|\z)")),
        "n_stutter": F.size(F.filter(_beside(F.col(hashes), 1, lambda a, b: a == b), lambda same: same)),
    }
    staged = staged.withColumns({prefix + k: v.cast("long") for k, v in counts.items()})
    return staged.drop(words, hashes, two, four, eight, at, lines)


def votes(prefix: str = "") -> dict[str, Column]:
    """Name of a rule -> its vote: 1 good, -1 bad, 0 abstains. All use counts of whole texts."""
    c = {k: F.col(prefix + k) for k in STATS}
    n = c["n_words"]

    def rule(good: Column, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)

    return {
        "length": rule(n >= 50, n < LEAST_WORDS),
        "symbols": rule(c["n_symbols"] * 50 <= n, c["n_symbols"] * 4 > n),
        "lines": rule(c["n_dup_lines"] * 10 <= c["n_lines"], c["n_dup_lines"] * 10 > c["n_lines"] * 3),
        "repeats": rule(c["n_repeat_words"] * 20 <= n, c["n_repeat_words"] * 100 > n * MOST_REPEAT_PCT),
        "word_length": rule((c["word_chars"] >= n * 3) & (c["word_chars"] <= n * 9), (c["word_chars"] < n * 2) | (c["word_chars"] > n * 14)),
        # n_lower counts runs: about one a word in ordinary text
        "case": rule(c["n_upper"] * 2 <= n, (c["n_upper"] > n * 2) & (c["n_lower"] * 2 < n)),
        "endings": rule(c["n_ends"] * 10 >= n * 8, c["n_ends"] * 10 < n * 6),
        "stutter": rule(c["n_stutter"] * 10 <= n, c["n_stutter"] * 4 > n),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and of each rule P(vote | good) and P(vote | bad) for the votes -1, 0, 1."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def accuracies(self) -> list[float]:
        """How often a rule that votes is right."""
        out = []
        for g, b in zip(self.good, self.bad):
            right, wrong = self.prior * g[2] + (1 - self.prior) * b[0], self.prior * g[0] + (1 - self.prior) * b[2]
            out.append(right / (right + wrong) if right + wrong else 0.5)
        return out

    def log_odds(self, vote: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v + 1] / b[v + 1]) for g, b, v in zip(self.good, self.bad, vote))

    def posterior(self, vote_columns: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(vote_columns, self.good, self.bad):
            w = [math.log(x / y) for x, y in zip(g, b)]
            odds = odds + F.when(v == -1, F.lit(w[0])).when(v == 0, F.lit(w[1])).otherwise(F.lit(w[2]))
        return 1 / (1 + F.exp(-odds))


#: What is believed of any rule before it is seen: P(vote is -1, 0, 1) on good and on bad texts. A bad text
#: has one or two faults, so most rules find nothing wrong with it.
GOOD, BAD = (0.01, 0.04, 0.95), (0.3, 0.1, 0.6)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, belief: float = 0.01) -> LabelModel:
    """EM over (votes, count). GOOD and BAD count as `belief` times as many rows as there are, and ten more: enough to
    say which class is the good one, and for no probability to be 0; what each rule is worth comes from the rows.
    Without patterns they are the result."""
    total = sum(n for _, n in patterns)
    weight = belief * total + 10
    model = LabelModel(0.8, (GOOD,) * n_rules, (BAD,) * n_rules)
    for _ in range(rounds):
        sums = [[[weight * p for p in side] for _ in range(n_rules)] for side in (GOOD, BAD)]
        share = 0.0
        for v, n in patterns:
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(v)))))
            share += q * n
            for j, x in enumerate(v):
                sums[0][j][x + 1] += q * n
                sums[1][j][x + 1] += (1 - q) * n
        prior = min(0.999, max(0.001, (share + 0.8 * weight) / (total + weight)))
        new = LabelModel(prior, *(tuple(tuple(x / sum(r) for x in r) for r in side) for side in sums))
        if abs(new.prior - model.prior) < 1e-9 and all(abs(a - b) < 1e-9 for x, y in zip(new.good + new.bad, model.good + model.bad) for a, b in zip(x, y)):
            return new
        model = new
    return model


def learn(stats: DataFrame, prefix: str = "") -> LabelModel:
    """From a table with the counts of add_stats: patterns of votes are counted over all rows."""
    return _fitted(stats, list(votes(prefix).values()))


def _fitted(rows: DataFrame, vote_columns: list[Column]) -> LabelModel:
    patterns = rows.groupBy(*[v.alias(f"_v{j}") for j, v in enumerate(vote_columns)]).count().collect()  # 3**8 rows at most
    return fit(sorted((tuple(p[:-1]), p[-1]) for p in map(tuple, patterns)), len(vote_columns))


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < LEAST_WORDS) | (F.col(prefix + "n_repeat_words") * 100 > n * MOST_REPEAT_PCT)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text): the counts, base_failed, posterior and kept.

    A null or empty text has no words and fails the base rules, as does any text of under 20 words; repeated
    rows get equal results; an empty table gives an empty one; further columns of docs are not looked at.
    """
    stats = work_table(add_stats(docs.select("doc_id", "text")).drop("text"))
    model = learn(stats)
    out = stats.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior(list(votes().values())))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns of docs and nothing else; names that clash with
    the counts don't matter. Texts are counted over once: the rows are written beside their votes, and the filter
    reads those."""
    mark = free_name(docs.columns)
    counted = add_stats(docs, mark)
    rules = [v.cast("byte").alias(f"{mark}v{j}") for j, v in enumerate(votes(mark).values())]
    voted = work_table(counted.select(*[F.col(f"`{c}`") for c in docs.columns], *rules, base_failed(mark).alias(mark + "failed")))
    columns = [F.col(f"{mark}v{j}") for j in range(len(rules))]
    kept = voted.filter(~F.col(mark + "failed") & (_fitted(voted, columns).posterior(columns) >= threshold))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
