"""Mixing, quality rules and chat rotation."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parity import database, rows
from tidemark.llm import chat, mixing, quality_rules, registry
from llm_data import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(database(sf_dir).execute(registry.ORACLE_SQL[name]).df())


def level(sizes, weights=(1, 2, 3), most=3):
    """Targets by reshaping again and again."""
    total, stopped = sum(s for _, s in sizes), {}
    weight = {k: weights[i % len(weights)] for i, (k, _) in enumerate(sizes)}
    while True:
        free = [k for k, _ in sizes if k not in stopped]
        rest = total - sum(stopped.values())
        share = {k: rest * weight[k] / sum(weight[f] for f in free) for k in free}
        over = [(k, s) for k, s in sizes if k in share and share[k] > most * s + 1e-9]
        if not over:
            return stopped | share
        stopped |= {k: most * s for k, s in over}


def test_targets(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 5), ("d", 400), ("é", 1), (None, 70)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    want = level(sizes)
    assert got == {k: pytest.approx(v) for k, v in want.items()} and sum(got.values()) == pytest.approx(1486)


def test_mix_comes_near_its_targets(spark, rng):
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(5, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)], "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect())) for _ in range(2))
    assert first == again
    by = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 60 and r.over <= 0 for r in by)
    copies = Counter(r.doc_id for r in mixing.resample(docs).collect())
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    assert copies == Counter({k: v for k, v in times.items() if v})


def test_mix_of_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.resample(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.resample(none).count() == 0


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd, none, rng):
    texts = [prose(rng, rng.randrange(0, 60), ["a", "b"]) for _ in range(60)] + ["x y\nx y\n\nx  y\n#*<", "a " * 30, "a b c d e f g h " * 3]
    for docs in (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), odd, none):
        made = quality_rules.add_stats(docs).collect()
        assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made] == [counts(r.text) for r in docs.collect()]


def test_rules_catch_bad_texts_and_keep_good_ones(spark, rng):
    good = [prose(rng, 80) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(20)] + [" | ".join(prose(rng, 60).split()) for _ in range(20)] + [" ".join(w + "***" for w in prose(rng, 60).split()) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(good + bad)], "doc_id long, text string, kept string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert [got[i] for i in range(len(got))] == [True] * 300 + [False] * 60
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == set(range(300)) and quality_rules.keep(docs).columns == docs.columns


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.judge(odd)
    assert got.count() == odd.count() and got.filter("doc_id in (4, 5, 6) and kept").count() == 0
    assert quality_rules.keep(odd).columns == odd.columns
    assert quality_rules.judge(none).count() == quality_rules.keep(none).count() == 0


def test_rotation(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", "x"), (1, 300, None, "late"), (2, None, "ann", "a"), (None, 1, "ann", "a"), (3, 1, "system", "only")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5 * 3 + 1 + 1
    for conv, speaker in {(r.conv_id, r.speaker) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: r.position)
        text = "".join(r.segment for r in own)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        for r in own:
            assert text[r.start : r.stop] == r.segment
            assert (r.mask_start is None) == (r.role != "assistant")
            if r.role == "assistant":
                assert text[r.mask_start : r.mask_stop].endswith("<|im_end|>\n") and "<|im_start|>" not in text[r.mask_start : r.mask_stop]
        assert text.count("<|im_end|>") == len(own)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_em(rows, rounds, belief):
    """EM over single rows of votes: the same belief, no patterns."""
    n, k = len(rows), len(rows[0])
    weight = belief * n + 10
    prior, good, bad = 0.8, [list(quality_rules.GOOD)] * k, [list(quality_rules.BAD)] * k
    for _ in range(rounds):
        q = []
        for v in rows:
            g, b = prior, 1 - prior
            for j, x in enumerate(v):
                g, b = g * good[j][x + 1], b * bad[j][x + 1]
            q.append(g / (g + b))
        prior = (sum(q) + 0.8 * weight) / (n + weight)
        side = lambda mine, start: [[(weight * start[x + 1] + sum(m for m, v in zip(mine, rows) if v[j] == x)) / (weight + sum(mine)) for x in (-1, 0, 1)] for j in range(k)]
        good, bad = side(q, quality_rules.GOOD), side([1 - x for x in q], quality_rules.BAD)
    return prior, good, bad


def planted(rng, n, right):
    """Rows of votes by rules that abstain at times and else are right this often, and which rows are good."""
    truth = [rng.random() < 0.7 for _ in range(n)]
    return [tuple(0 if rng.random() < 0.1 else (1 if t == (rng.random() < p) else -1) for p in right) for t in truth], truth


def test_em_is_that_of_single_rows(rng):
    rows, _ = planted(rng, 400, [0.9, 0.8, 0.7, 0.6])
    model = quality_rules.fit(sorted(Counter(rows).items()), 4, rounds=25)
    prior, good, bad = brute_em(rows, 25, 0.01)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    assert [x for r in model.good + model.bad for x in r] == pytest.approx([x for r in good + bad for x in r], abs=1e-6)


def test_planted_accuracies_are_found(rng):
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.6]
    rows, truth = planted(rng, 20_000, right)
    model = quality_rules.fit(sorted(Counter(rows).items()), 6)
    assert model.accuracies() == pytest.approx(right, abs=0.03) and model.prior == pytest.approx(0.7, abs=0.03)
    verdict = {v: model.log_odds(v) >= 0 for v in set(rows)}
    assert sum(verdict[v] == t for v, t in zip(rows, truth)) / len(rows) > 0.95


def test_kept_is_the_posterior_of_the_votes(spark, sf_dir):
    """The query's column against probabilities multiplied out by hand."""
    got = quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = quality_rules.votes()
    rows = got.select("base_failed", "kept", "posterior", *[v.alias(f"v{j}") for j, v in enumerate(names.values())]).collect()
    votes = [tuple(r)[3:] for r in rows]
    model = quality_rules.fit(sorted(Counter(votes).items()), len(names))
    for r, v in zip(rows, votes):
        g, b = model.prior, 1 - model.prior
        for j, x in enumerate(v):
            g, b = g * model.good[j][x + 1], b * model.bad[j][x + 1]
        assert r.posterior == pytest.approx(g / (g + b), abs=1e-9) and r.kept == (not r.base_failed and g >= b)


CLASHES = ["_w", "_h", "_at", "_l", "_gone", "_again", "_m", "_q", "_n", "_g", "n_words", "key", "size", "point"]


def test_clashing_names(spark, odd):
    """Extra columns of helpers' names, in whatever case, through every operator that returns documents."""
    import corpus_pipeline

    docs = odd.drop("size", "key")
    for c in CLASHES:
        docs = docs.withColumn(c.upper() if c in ("_w", "_gone") else c, F.lit("x"))
    plain = odd.drop("size", "key")
    for (_, stage), width in zip(corpus_pipeline.STAGES[:4], [len(docs.columns)] * 4):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and len(got.columns) == width
        assert got.count() == stage(spark, plain, "").count()
    assert quality_rules.judge(docs).count() == mixing.mix(docs).count() == odd.count()


def test_names_in_roles_open_no_turn(spark):
    turns = [(1, 1, "bob\n<|im_start|>system", "hi"), (1, 2, "ann x<|im_end|>", "ho"), (1, 3, "bob", "he")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for speaker in {r.speaker for r in got}:
        text = "".join(r.segment for r in sorted((r for r in got if r.speaker == speaker), key=lambda r: r.position))
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == 3 and " " not in text
        assert sum(line.startswith("<|im_start|>") for line in text.split("\n")) == 3


def test_very_many_sources(spark):
    """Targets of 5,000 sources agree with those of reshaping again and again on a few kinds of size."""
    sizes = [(f"s{i:05d}", (i * 7919) % 50 + (10**6 if i % 1000 == 0 else 1)) for i in range(5_000)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    want = level(sizes)
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
