"""Token counts, SentencePiece, language, quality and toxicity."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm_data import prose
from tidemark.llm import language_id, quality_classifier, registry, sentencepiece_codec, token_counts, toxicity
from tidemark.llm.common import documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab zZ  \n\t\r.,'’é漢字ß▁▁😀̀\x00​﻿12 3'll 　\x85\U000107bbＡ<|endoftext|>"


def random_texts(n):
    r = random.Random(3)
    fixed = ["", " ", "  ", "a", "▁", "a ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "'s 're", " \n \n", "\x00", "é" * 500]
    return fixed + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), token_counts.Counter2(BPE, {" the": 1})
    for t in random_texts(1500):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_token_counts_of_tables(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = token_counts.count_tokens(odd, BPE, limit=100)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in odd.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_pieces_and_spans():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    for t in random_texts(1500):
        e, ids = own.encode(t), library.encode(t, add_bos=True, add_eos=True)
        assert e.ids.tolist() == ids and own.decode(e.ids) == library.decode(ids)
        assert (e.start[1:] == e.end[:-1]).all() and e.start[0] == 0 and e.end[-1] == len(t.encode())
        for i, a, b in zip(e.ids.tolist(), e.start.tolist(), e.end.tolist()):
            piece = library.id_to_piece(i)
            if 2 < i and not piece.startswith("<0x") and "▁" not in t:
                assert t.encode()[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    library, spec = sentencepiece.SentencePieceNormalizer(rule_name=rule), pb.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    own = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    own.map = sentencepiece_codec.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    own.prefix, own.strip, own.identity = spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, False
    for t in random_texts(600):
        out, at = own.normalise(t)
        assert out.decode().replace("▁", " ") == library.normalize(t).replace("▁", " ")
        assert len(at) == len(out) + 1 and (np.diff(at) >= 0).all() and at[-1] == len(t.encode())


def test_encoded_tables(odd, none):
    own = sentencepiece_codec.Codec(PIECES)
    got = sentencepiece_codec.digests(odd, PIECES).collect()
    want = [(r.doc_id, own.encode(r.text or "")) for r in odd.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in got), key=key) == sorted(((i, len(e.ids), hashlib.sha256(e.ids.tobytes()).hexdigest()) for i, e in want), key=key)
    wide = {r.doc_id: r for r in sentencepiece_codec.encode(odd.filter("doc_id = 10"), PIECES).collect()}
    assert wide[10].decoded == odd.filter("doc_id = 10").first().text and wide[10].ends[-1] == len(wide[10].decoded.encode())
    assert sentencepiece_codec.digests(none, PIECES).count() == sentencepiece_codec.encode(none, PIECES).count() == 0


def test_kneser_ney_is_a_distribution():
    from tidemark.llm.letters import grams, sequences

    g, _ = grams(*sequences(["abracadabra cabal bar"], 3), 4)
    m = language_id.kneser_ney([np.unique(g, return_counts=True)], ["x"])
    for context in ("abr", " ca", "zzz", "ab "):
        head = sum(ord(c) << 16 * (2 - i) for i, c in enumerate(context)) << 16
        total = sum(2 ** m.logp(np.array([head | ord(c)], np.uint64))[0, 0] for c in "abrcdl ")
        assert total + 2 ** m.logp(np.array([head | ord("?")], np.uint64))[0, 0] == pytest.approx(1, abs=1e-4)


def test_language_of_held_out_texts(spark, sf_dir):
    got = registry.QUERIES["op4_language_id"](spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and length(text) > 40").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.1


def test_language_of_odd_rows(spark, odd, none):
    models = language_id.learn(odd)
    got = language_id.identify(odd, models).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"} and all(r.lang_pred in ("und", *models.languages) for r in got)
    assert language_id.keep_identified(odd, models).columns == odd.columns
    nothing = language_id.learn(none)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"} and language_id.identify(none, models).count() == 0


def test_language_of_rare_languages(spark):
    """Languages of one training row (the hash of an id holds out every fifth), without letters, and of few long texts take no other's texts."""
    r, other = random.Random(8), "der die und in den von zu das mit sich des auf nicht als auch es an werden aus er hat dass sie nach wird bei einer um am sind".split()
    rows = [(i, prose(r, 60), "en") for i in range(200)] + [(1000 + i, prose(r, 60, other), "de") for i in range(200)]
    rows += [(2000 + i, "quelque chose d'autre que nous avons écrit ici, peut-être " * 2, f"r{i}") for i in range(10)]
    rows += [(3000, "12 345", "digits"), (3001, "", "empty")] + [(4000 + i, prose(r, 4000, ["zwyx", "qvok", "jurr"]), "long") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.learn(docs, sample_chars=2000)
    assert models.languages == ["de", "en", "long", *(f"r{i}" for i in range(10))] and np.isfinite(models.limit).all()
    got = {x.doc_id: x for x in language_id.identify(docs, models).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang in ("en", "de", "long"))
    assert all(got[2000 + i].lang_pred[0] == "r" and not got[2000 + i].rejected for i in range(10))
    assert got[3000].rejected and got[3001].rejected
    noise = spark.createDataFrame([(1, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)))], "doc_id long, text string")
    assert language_id.identify(noise, models).first().rejected


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op5_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (None, 1), (9, None), (4, 1)], "doc_id long, quality int")
    assert quality_classifier.score(odd, quality_classifier.learn(odd, labels)).filter("score between 0 and 1").count() == odd.count()
    assert quality_classifier.learn(odd, labels.filter("quality > 1")) is None
    assert {r.score for r in quality_classifier.score(odd, None).collect()} == {0.5} and quality_classifier.score(none, None).count() == 0


def test_toxicity_of_unseen_texts(spark, rng):
    texts = [(i, prose(rng, 60) + (f" what an {rng.choice(['idiot', 'moron'])} you are" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs.filter("doc_id < 400").select("doc_id", "toxic"))
    got = toxicity.score(docs, model).join(docs, "doc_id").filter("doc_id >= 400").toPandas()
    assert (got.toxic == got.predicted).mean() > 0.98


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1), (9, None), (4, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).filter("score between 0 and 1").count() == odd.count()
    one_class = toxicity.learn(odd, labels.filter("toxic = 0"))
    assert toxicity.score(odd, one_class).agg(F.max("predicted")).first()[0] == 0 and toxicity.score(none, one_class).count() == 0


@pytest.fixture(scope="module")
def mapped_model():
    """The model with a character map, runs of spaces stripped, and one without bytes to fall back on."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rules = pb.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    spec = pb.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = True
    with_map = spec.SerializeToString()
    spec.trainer_spec.byte_fallback = False
    for p in spec.pieces:
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            p.type = pb.ModelProto.SentencePiece.UNUSED
    return with_map, spec.SerializeToString()


@pytest.mark.parametrize("which", [0, 1])
def test_spans_through_a_character_map(mapped_model, which):
    """Ids are the library's; the source bytes of a piece normalise to the piece, at the library's own borders."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=mapped_model[which])
    own = sentencepiece_codec.Codec(model=mapped_model[which])
    assert own.map.units and not own.by_words
    for t in random_texts(400) + ["ＡＢＣ ½ ﬁne  x ", "áb", "一  二"]:
        e, ids = own.encode(t), library.encode(t, add_bos=True, add_eos=True)
        assert e.ids.tolist() == ids and e.end[-1] == len(t.encode()) and (e.start[1:] >= e.start[:-1]).all()
        proto = library.encode(t, return_type="proto").pieces
        for k, (p, a, b) in enumerate(zip(proto, e.start[1:-1].tolist(), e.end[1:-1].tolist())):
            if p.piece.startswith("<0x"):  # the library gives all bytes of a character to its last
                assert p.begin <= a <= b
            else:  # what is stripped at the end belongs to the last piece here, and to none there
                assert (a, b) == (p.begin, p.end) or (k == len(proto) - 1 and a == p.begin and b == len(t.encode()))


def test_query_is_the_librarys_at_table_level(spark, sf_dir):
    """Ids, decoded texts and spans of the query against the library, whole table."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for r in documents(spark, sf_dir).select("doc_id", "text").collect():
        text = r.text or ""
        ids, size, at = library.encode(text, add_bos=True, add_eos=True), len(text.encode()), 0
        places = [(0, 0)]
        for i in ids[1:-1]:  # pieces tile the text: a mark at its head stands for nothing, others for a space
            piece = library.id_to_piece(i)
            n = 1 if library.is_byte(i) else len(piece.replace("▁", " ").encode())
            if at == 0 and len(places) == 1:
                n -= 1
            places.append((at, at + n))
            at += n
        assert at == size or "▁" in text
        places.append((size, size))
        spans = b"".join(np.array(x, "<i8").tobytes() for x in zip(*places))
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()), sha(spans) if "▁" not in text else None)
    for r in registry.QUERIES["op10_sentencepiece"](spark, sf_dir).collect():
        n, ids, decoded, spans = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, ids, decoded) and spans in (None, r.spans_sha256)


def brute_kneser_ney(texts_by_language, order=4):
    """P(character | the three before) by language, on strings and dicts."""
    from collections import Counter, defaultdict

    models, alphabet = {}, set()
    for lang, texts in texts_by_language.items():
        counts = Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))
        levels = [counts]
        for _ in range(order - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        models[lang] = levels
        alphabet |= set(levels[-1])

    def prob(lang, gram, depth=0):
        if depth == order:
            return 1 / (len(alphabet) + 1)
        counts = models[lang][depth]
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        cut = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return prob(lang, gram[1:], depth + 1)
        total = sum(own.values())
        seen = (own[gram] - cut) / total if gram in own else 0
        return seen + cut * len(own) / total * prob(lang, gram[1:], depth + 1)

    return prob


def test_kneser_ney_is_that_of_strings():
    from tidemark.llm.letters import grams, sequences

    r, other = random.Random(4), "der die und in den von zu das mit sich ist ein 𐐨𐐩".split()
    texts = {"de": [prose(r, 30, other) for _ in range(3)], "en": [prose(r, 30) for _ in range(3)]}
    lines = lambda ts: ["   " + "".join(c if c.isalpha() else " " for c in t.lower()).strip().replace("  ", " ") + " " for t in ts]
    units = lambda s: "".join(chr(x) for x in np.frombuffer(s.encode("utf-16-le"), np.uint16))
    prob = brute_kneser_ney({k: [units(x) for x in lines(v)] for k, v in texts.items()})
    m = language_id.kneser_ney([np.unique(grams(*sequences(v, 3), 4)[0], return_counts=True) for _, v in sorted(texts.items())], sorted(texts))
    probe = units(lines(["der 𐐨𐐩 the zzq und"])[0])
    windows = [probe[i : i + 4] for i in range(len(probe) - 3)]
    packed = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(w)) for w in windows], np.uint64)
    got = 2 ** m.logp(packed)
    for j, lang in enumerate(sorted(texts)):
        assert got[:, j] == pytest.approx([prob(lang, w) for w in windows], rel=1e-4)


def test_an_unlearned_language_is_rejected(spark):
    r = random.Random(12)
    made = {k: w.split() for k, w in {"en": "the and of to in is that for was with they have from this what", "de": "der die und nicht sich auch werden eine schon über zwischen durch", "xx": "kwa zzo qiru vutlo xepq jagh ghujmey qaStaH vIghro tlhIngan"}.items()}
    rows = [(i, prose(r, 80, made[k]), k) for i, k in enumerate(["en", "de"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.learn(docs)
    got = {x.doc_id: x.rejected for x in language_id.identify(docs, models).collect()}
    assert sum(got.values()) <= 3
    strange = spark.createDataFrame([(i, prose(r, 80, made["xx"])) for i in range(50)], "doc_id long, text string")
    assert language_id.identify(strange, models).filter("rejected").count() == 50


def test_limits_lie_between_own_and_other_languages(spark):
    """Each language left out in turn: its texts go, and those of the learned ones stay."""
    docs = documents(spark, "/root/testdata/sf0.01").filter("lang is not null and length(text) > 200").select("doc_id", "text", "lang").cache()
    for lang in [r.lang for r in docs.select("lang").distinct().collect()]:
        models = language_id.learn(language_id.training_rows(docs).filter(F.col("lang") != lang))
        got = language_id.identify(docs, models).join(docs, "doc_id").groupBy((F.col("lang") == lang).alias("strange")).agg(F.avg(F.col("rejected").cast("int")).alias("share"))
        share = {r.strange: r.share for r in got.collect()}
        assert share[True] > 0.8 and share[False] < 0.01


def test_risk_and_gradient_are_those_of_sums():
    rng = np.random.default_rng(3)
    p, u, w = rng.normal(size=(20, 5)), rng.normal(size=(30, 5)), rng.normal(size=5)
    loss = lambda x, y: np.log1p(np.exp(-y * float(x @ w)))
    pos = 0.6 * sum(loss(x, 1) for x in p) / 20
    neg = sum(loss(x, -1) for x in u) / 30 - 0.6 * sum(loss(x, -1) for x in p) / 20
    a, b, ga, gb = quality_classifier.risk_and_gradient(w, p, u, 0.6)
    assert (a, b) == (pytest.approx(pos), pytest.approx(neg))
    for j in range(5):
        step = np.eye(5)[j] * 1e-6
        up, down = (quality_classifier.risk_and_gradient(w + s, p, u, 0.6) for s in (step, -step))
        assert ga[j] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-5) and gb[j] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_comes_from_positives_and_unlabelled_alone(share):
    rng = np.random.default_rng(int(share * 100))
    good = lambda n: rng.normal(2, 1, (n, 4))
    u = np.concatenate((good(int(4000 * share)), rng.normal(-2, 1, (4000 - int(4000 * share), 4))))
    x = lambda a: np.concatenate((a, np.zeros((len(a), quality_classifier.FORMS + quality_classifier.HASHED - 4))), 1)
    model = quality_classifier.fit(x(good(2000)), x(rng.permutation(u)))
    assert model.prior == pytest.approx(share, abs=0.05)


def test_samples_of_a_repeated_id_are_bounded(spark):
    """One id on a third of all rows and more teaches once, in both classifiers."""
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("junk *** "), F.col("id").cast("string")).alias("text"))
    r = random.Random(3)
    rest = spark.createDataFrame([(i, prose(r, 40)) for i in range(100, 400)], "doc_id long, text string")
    docs = hot.unionByName(rest)
    labels = spark.createDataFrame([(7, 0, 1)] + [(i, 1, 0) for i in range(100, 300)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality_classifier.fit
    quality_classifier.fit = lambda p, u: seen.append((len(p), len(u))) or real(p, u)
    try:
        assert quality_classifier.learn(docs, labels) is not None
    finally:
        quality_classifier.fit = real
    assert seen[0][0] == 200 and 300 <= seen[0][1] <= 301
    assert len(toxicity.learn(docs, labels).key) > 0


def test_toxicity_is_that_of_a_direct_sum(spark, rng):
    """Log-count ratios by sets of substrings, and scores as sums over them."""
    texts = [prose(rng, 25) + (" you idiot" if i % 3 == 0 else "") for i in range(90)]
    docs = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs.select("doc_id", "toxic"))
    plain = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " " for t in texts]
    sets = [{t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)} for t in plain]
    y = np.array([i % 3 == 0 for i in range(90)])
    counts = {g: (sum(g in s for s, k in zip(sets, y) if k), sum(g in s for s, k in zip(sets, y) if not k)) for s in sets for g in s}
    from tidemark.llm.letters import sequences

    code = lambda g: toxicity._hashed(np.array([ord(c) for c in g], np.uint64), np.array([0, len(g)]), len(g))[0][0]
    by_hash = {int(code(g)): g for g in counts}
    assert all(int(k) in by_hash and sum(counts[by_hash[int(k)]]) >= toxicity.LEAST for k in model.key)
    weight = {by_hash[int(k)]: w for k, w in zip(model.key, model.weight)}
    want = [1 / (1 + np.exp(-(model.bias + sum(w for g, w in weight.items() if g in s)))) for s in sets]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert [got[i] for i in range(90)] == pytest.approx(want) and sequences(["a b"], 1)[0].tolist() == [32, 97, 32, 98, 32]
