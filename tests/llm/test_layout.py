"""Packing, manifests and fill-in-the-middle against brute force."""

import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm_data import prose
from tidemark.llm import infill, manifest, packing, registry

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPACES = [" ", "\n", "\t", "\x0b", "\x85", "\xa0", " ", " ", "　", "\x1c", "\x1f"]
ODD = list("aB's1,.!éÉeßKÅΣİª²漢😀\0ſĸ") + ["́", "̸", "​", "<|endoftext|>", "<|startoftext|>", "'S", "'ll", "<|", *SPACES]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(rng):
    encode, want = packing.Encoder(WORDS), library()
    assert encode.by_chunks
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["a" * 5000, "x" * 70 + " " + "é" * 70]
    for t in texts:
        assert list(struct.unpack(f"<{len(want(t))}I", encode(t))) == want(t), repr(t)
    other = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_chunks and other("Hi there") == other.whole("Hi there")


def test_memory_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    made = []
    own = packing.Remembered(lambda k: made.append(k) or k.encode())
    assert [own[k] for k in "abcadefa"] == [k.encode() for k in "abcadefa"]
    assert made == list("abcdef") and len(own) <= 3
    assert own["z" * 99] == b"z" * 99 and "z" * 99 not in own


def naive_fit(sizes, capacity):
    fills, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(fills)) if fills[b] + sizes[i] <= capacity]
        b = max(fits, key=lambda b: fills[b]) if fits else len(fills)
        if not fits:
            fills.append(0)
        out[i] = b
        fills[b] += sizes[i]
    return sorted(fills)


def test_best_fit(rng):
    import numpy as np

    for most in (10, 60, 100):
        sizes = np.array([rng.randrange(1, most + 1) for _ in range(300)])
        bins, at, fills = packing.best_fit(sizes, 100)
        assert sorted(fills.tolist()) == naive_fit(sizes.tolist(), 100)
        for b in range(len(fills)):
            own = sorted((int(a), int(s)) for a, s in zip(at[bins == b], sizes[bins == b]))
            assert [a for a, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))]
    assert [len(x) for x in packing.best_fit(np.zeros(0, np.int64), 100)] == [0, 0, 0]


def check_packed(rows, texts, capacity):
    """Pieces of (doc_id, text) rows, each id once, lie in gapless sequences. The number of sequences."""
    encode = library()
    want = {}
    for doc_id, text in texts:
        ids = [*encode(text), 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.setdefault((doc_id, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    return len(held)


def test_packing_of_the_query(spark, sf_dir):
    rows = registry.QUERIES["op11_best_fit_packing"](spark, sf_dir).collect()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert check_packed(rows, texts, 4096) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_of_odd_rows(spark, odd, none):
    texts = odd.select("doc_id", "text").collect()
    check_packed(packing.pack(odd, WORDS).collect(), texts, 4096)
    clash = odd.selectExpr("*", "1 as piece", "2 as bin", "3 as `into`", "4 as sequence_id", "5 as _g", "6 as ids")
    check_packed(packing.pack(clash, WORDS).collect(), texts, 4096)
    assert packing.pack(none, WORDS).count() == 0
    assert packing.pack(none, WORDS).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    named = spark.createDataFrame([("x", "one two"), ("y", None)], "doc_id string, text string")
    assert {r.doc_id: r.length for r in packing.pack(named, WORDS).collect()} == {"x": 3, "y": 1}


@pytest.mark.parametrize("block, items", [(8, 64), (1 << 16, 10), (1 << 16, 1 << 14)])
def test_rounds_fill_what_small_blocks_leave(spark, rng, monkeypatch, block, items):
    """Blocks of 8 pieces leave many bins underfull; rounds of groups put them together."""
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "ITEMS", items)
    texts = [(i, prose(rng, rng.choice([2, 5, 9, 20, 45, 90, 300]))) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(12)
    rows = packing.pack(docs, WORDS, capacity=128).collect()
    whole = naive_fit([r.length for r in rows], 128)  # as if one task had them all
    assert check_packed(rows, texts, 128) <= 1.03 * len(whole) + 1


def test_rounds_end_where_nothing_fits_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 16)
    texts = [(i, "one two three four five six") for i in range(200)]  # 7 ids, two of which don't fit in 13
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORDS, capacity=13).collect()
    assert check_packed(rows, texts, 13) == 200


def test_sequences(spark, rng):
    texts = [(i, prose(rng, rng.choice([2, 5, 45, 90]))) for i in range(100)]
    packed = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), WORDS, capacity=64, ids=True).cache()
    encode, whole = library(), {}
    ids = {r.sequence_id: (r.ids, r.bounds) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        seq, bounds = ids[r.sequence_id]
        assert len(seq) <= 64 and r.offset in bounds
        whole.setdefault(r.doc_id, []).append((r.piece, seq[r.offset : r.offset + r.length]))
    for doc_id, text in texts:
        assert sum((p for _, p in sorted(whole[doc_id])), []) == [*encode(text), 1]
    packed.unpersist()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(docs):
    """Sorted (doc_id, leaf, subroot, root, proof, folded_root, verified) of dicts."""
    leaf = lambda d, n: sha("".join(told(x) for x in (d["doc_id"], d["source"], d["lang"], n, d["text"])))
    by = {}
    for d in docs:
        by.setdefault(d["lang"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["n_chars"]), d))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    for v in langs:
        by[v].sort(key=lambda x: x[:3])
    trees = {v: levels([x[2] for x in by[v]]) for v in langs}
    upper, out = levels([trees[v][-1][0] for v in langs]), []
    for at, v in enumerate(langs):
        for i, (known, doc_id, own, d) in enumerate(by[v]):
            n, siblings = d["n_chars"], []
            if known and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None:
                n += 1
            h = leaf(d, n)
            for tree, j in ((trees[v], i), (upper, at)):
                for level in tree[:-1]:
                    other = level[j ^ 1] if j ^ 1 < len(level) else ""
                    siblings.append(other)
                    h = sha(other + h if j % 2 else h + other)
                    j //= 2
            out.append((str(d["doc_id"]), own, trees[v][-1][0], upper[-1][0], sha("".join(siblings)), h, h == upper[-1][0]))
    return sorted(out)


def audited(docs):
    out = manifest.audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, {"n_chars": F.col("n_chars") + 1})
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.hash", ""), 256), "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("block_levels", [10, 3, 1])
def test_manifest(spark, odd, rng, monkeypatch, block_levels):
    monkeypatch.setattr(manifest, "LEVELS", block_levels)
    rows = [(i, prose(rng, 3), rng.choice(["en"] * 9 + ["de", "漢", None, ""]), rng.choice(["a", None]), rng.choice([None, 3, 9])) for i in rng.sample(range(-50, 900), 130)]
    rows.append((5000, None, "alone", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert audited(docs) == brute_manifest([r.asDict() for r in docs.collect()])
    odd = odd.withColumn("n_chars", F.col("size")).selectExpr("*", "1 as pos", "2 as grp", "3 as _by", "4 as leaf")
    assert audited(odd) == brute_manifest([r.asDict() for r in odd.collect()])


def test_manifest_of_few_rows(spark, none):
    empty = none.withColumn("n_chars", F.col("size"))
    assert audited(empty) == []
    one = spark.createDataFrame([(7, "x", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert audited(one) == brute_manifest([r.asDict() for r in one.collect()])


def test_proofs_tell_the_side(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.audit(docs, F.lit(False), {}).orderBy("doc_id").collect()
    assert all(r.verified for r in got)
    assert [[(p.left, p.hash is None) for p in r.proof] for r in got] == [
        [(False, False), (False, False), (False, False)], [(True, False), (False, False), (False, False)],
        [(False, False), (True, False), (False, False)], [(True, False), (True, False), (False, False)],
        [(False, True), (False, True), (True, False)],
    ]


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_split(doc_id, text, units, plain_pct=10, spm_pct=20):
    t = text or ""
    u = units(t)
    assert "".join(u) == t
    n, digest = len(u), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_pct:
        return n, "plain", None, None, None, t
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_pct else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def split_rows(docs, *args, **kw):
    out = infill.split_middle(docs, *args, **kw)
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    return sorted((str(r.doc_id), tuple(r)[1:]) for r in out.collect())


@pytest.mark.parametrize("segment", [1 << 16, 7, 1])
def test_split_middle(spark, odd, rng, monkeypatch, segment):
    monkeypatch.setattr(infill, "SEGMENT", segment)
    alphabet = list("abcXYZ  \n\r.,é漢😀\0$ ") + ["word", "<P>"[:2], "P>", "S>", "<"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "a" * 300), (1003, "has <P> in it"), (1004, "x<S>"), (None, "some words here"), (1005, "😀" * 20), (1006, "\n\n\n"), (1006, "\n\n\n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((str(i), (*(w := brute_split(i, t, UNIT.findall)), t or "")) for i, t in texts)
    assert split_rows(docs) == want
    if segment > 100:
        clash = odd.selectExpr("*", "1 as t", "2 as n", "3 as form", "4 as h1", "5 as segments")
        assert split_rows(clash) == sorted((str(r.doc_id), (*brute_split(r.doc_id, r.text, UNIT.findall), r.text or "")) for r in odd.collect())


def test_other_grammars(spark, rng, none):
    texts = [(i, "".join(rng.choice("ab1 2\n.😀") for _ in range(rng.randrange(30)))) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    grammars = {
        infill.CHARACTERS: list,
        infill.LINES: re.compile(r"[^\n]*\n|[^\n]+").findall,
        infill.runs_of("A-Za-z", "0-9", r"\s"): re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]").findall,
    }
    for boundary, units in grammars.items():
        want = sorted((str(i), (*brute_split(i, t, units, 0, 50), t)) for i, t in texts)
        assert split_rows(docs, boundary, plain_pct=0, spm_pct=50) == want
    assert infill.split_middle(none).count() == 0


def test_part_of_the_forms(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two three' as text")
    got = {r.form: r["count"] for r in infill.split_middle(docs).groupBy("form").count().collect()}
    assert 320 < got["plain"] < 480 and 0.16 < got["spm"] / (got["spm"] + got["psm"]) < 0.24
