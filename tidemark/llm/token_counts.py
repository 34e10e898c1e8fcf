"""Token counts of whole texts by a byte-level BPE, through two tiers of lookup and no shuffle of pre-tokens.

A text's pre-tokens are encoded one by one, so its count is the sum of their lengths. First tier: a compact
table, broadcast, of the lengths of the corpus's most frequent words; only each task's own top words are
gathered for it, and its size is fixed. Second tier: each worker process remembers what it had to encode.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, share, slim, work_table

#: Entries of the broadcast table, of each task's report for it, of a worker's memory.
TABLE, REPORT, MEMORY = 1 << 15, 1 << 13, 1 << 19
#: Characters of the longest word that is remembered.
LONGEST = 63
#: The split of byte-level BPE before its merges: a fixed value of the format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Unassigned:
    """Whether a text has characters that this Python's tables don't know; split rules of other versions may differ on them."""

    def __init__(self) -> None:
        self.unknown = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.some = re.compile(f"[^\\x00-{chr(int(self.unknown.argmax()) - 1)}]")  # the first such character is far from Latin letters

    def __call__(self, text: str) -> bool:
        return self.some.search(text) is not None and bool(self.unknown[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Lengths(dict):
    """Pre-token -> tokens. What it lacks is looked for among words of before, and encoded if it isn't there. Once MEMORY
    / 2 words have come in, they are the words of before; those in use come back, the others go."""

    def __init__(self, tokenizer, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tokenize, self.table, self.before, self.letters = tokenizer.model.tokenize, table, {}, _byte_letters()

    def __missing__(self, word: str) -> int:
        n = self.before.get(word)
        if n is None:
            n = len(self.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        if len(self) - len(self.table) >= MEMORY // 2:
            self.before = dict(self)
            self.clear()
            self.update(self.table)
        if len(word) <= LONGEST:
            self[word] = n
        return n


class Counter2:
    """Counts tokens as the tokenizers library does for the file at path."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.lengths = Lengths(self.tokenizer, table)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.by_parts = plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        # strings of added tokens count as one token each, the longest first
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.split, self.odd = regex.compile(SPLIT), Unassigned()

    def count(self, text: str) -> int:
        if not self.by_parts or self.odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        get, found = self.lengths.__getitem__, self.split.findall
        if self.added is None or not self.added.search(text):
            return sum(map(get, found(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(get, found(p))) for p in parts)


def frequent_words(docs: DataFrame) -> list[str]:
    """The most frequent runs of a space and letters, from reports of every task; TABLE at most."""

    def report(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        run = re.compile(r" [^\W\d_]{1,%d}(?![^\W\d_])" % LONGEST)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(run.findall(text))
                if len(seen) > MEMORY:
                    seen = Counter(dict(seen.most_common(MEMORY // 4)))
        top = [x for x in seen.most_common(REPORT) if x[1] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    top = docs.select("text").mapInArrow(slim(report), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE)
    return [r["word"] for r in top.collect()]


_counters: dict = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    path: of a tokenizer file that every executor can read. No begin, end or added tokens are put in; texts are
    taken whole; strings of added tokens inside a text count as the library's default has it. A null text is
    empty and has no tokens; repeated rows are counted each; an empty table gives an empty one.
    """
    from tokenizers import Tokenizer

    with Scratch() as inner:
        words = frequent_words(docs)
        tokenizer = Tokenizer.from_file(path)
        lengths = np.array([len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)], np.uint8)
        shared = share(docs.sparkSession, ("\n".join(words).encode(), lengths))
        key = (path, uuid.uuid4().hex)

        def run(batches):
            import pyarrow as pa

            if key not in _counters:
                blob, sizes = shared.value
                _counters.clear()
                _counters[key] = Counter2(path, dict(zip(blob.decode().split("\n"), sizes.tolist())) if len(sizes) else {})
            count = _counters[key].count
            for b in batches:
                texts = b.column(1)
                for i in range(0, b.num_rows, 256):
                    some = [t or "" for t in texts[i : i + 256].to_pylist()]
                    n = [count(t) for t in some]
                    yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], pa.array([len(t.encode()) for t in some], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        out = work_table(docs.select("doc_id", "text").mapInArrow(slim(run), f"doc_id {kind}, n_bytes long, n_tokens long"))
    inner.drop(out)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
