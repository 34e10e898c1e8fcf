"""Packing of tokenized documents into sequences of a fixed capacity, by best fit in a hierarchy of rounds.

Every task tokenizes its documents, cuts those longer than a sequence into pieces, and packs its pieces by best
fit, the longest first, a block of BLOCK pieces at a time. Bins that are nearly full are sequences. The others are
items of the next round, each as long as it is full: rounds deal them into groups of about ITEMS, which are packed by
best fit again, and the groups become fewer as bins fill up. A round that spares hardly a bin is the last. So no task
ever holds more than a block, however many pieces or however few of them fit together.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slim, work_table

#: Pieces that a task packs at once, and underfull bins of a group of a later round.
BLOCK, ITEMS = 1 << 16, 1 << 14
#: A bin with at most a 256th of the capacity left is nearly full.
NEARLY = 256
#: A round that takes away less than a 512th of the bins that came into it is the last.
SPARES = 512
#: How many chunks a worker remembers (twice as many at most), and the longest of them in characters.
MEMORY, LONGEST = 1 << 19, 63

# Fixed values of the tokenizer format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of Latin-1 and Latin Extended-A but one, and ASCII: no other character composes with them, each has one lower case.
PLAIN = "[!-~À-ÖØ-öø-įı-ſ]+"
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+"


class Remembered(dict):
    """What make(key) gave. Once MEMORY keys have come in, they are the keys of before; those in use come back."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
        if len(key) <= LONGEST:
            self[key] = got
        return got


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them for the
    file at path, without begin, end or added special tokens.

    Where the tokenizer drops white space and nothing reaches over it, a text's ids are those of its chunks between
    white space, which workers remember. A chunk of plain characters is put together from its words in lower case, which
    are chunks themselves.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.kept = [c for c in spaces if self.whole(c)]  # white space for Python, but not for the library
        self.by_chunks = self._drops_spaces(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added) or r"\b\B").search
        self.plain, self.split = re.compile(PLAIN).fullmatch, re.compile(PLAIN_WORDS).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # letters that byte-level BPE writes bytes as
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.chunks = Remembered(self._chunk)

    @staticmethod
    def _drops_spaces(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = norm.get("normalizers") or []
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        cuts = pre.get("pretokenizers") or []
        first = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        then = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        added = spec.get("added_tokens") or []
        alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added)
        return steps == known and cuts == [first, then] and alone and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        got = [t.id for t in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(got)}I", *got)

    def _chunk(self, chunk: str) -> bytes:
        if not self.plain(chunk):
            return self.whole(chunk)
        low = chunk.lower()
        if low.isalpha():
            return self._word(low) if low == chunk else self.chunks[low]
        if self.added(chunk):
            return self.whole(chunk)
        words = self.split(low)
        return self._word(low) if len(words) == 1 else b"".join([self.chunks[w] for w in words])

    def __call__(self, text: str) -> bytes:
        if not self.by_chunks or any(c in text for c in self.kept):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its place there, fill of each bin): the longest items first, each into the open bin that it
    fills best, or else a new one. Bins of the same room are alike, so a bit set of the rooms finds that bin."""
    bins, at, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            same = open_bins[room]
            b = same.pop()
            if not same:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], at[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            open_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, at, np.array(fills, np.int64)


_encoders: dict = {}


def _local(docs: DataFrame, path: str, capacity: int, end_id: int, ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, bin, offset, fill[, ids]) of all pieces, packed block by block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = (path, uuid.uuid4().hex)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(path)
        encode, end = _encoders[key], np.array([end_id], "<u4").tobytes()
        next_bin = TaskContext.get().partitionId() << 33
        owners, rows, n_rows = [], [], 0

        def packed():
            nonlocal next_bin, owners, rows, n_rows
            piece, start, length, crc, *more = (np.concatenate(x) if not ids or k < 4 else sum(x, []) for k, x in enumerate(zip(*rows)))
            bins, at, fills = best_fit(length, capacity)
            doc_ids = pa.concat_arrays(owners)
            columns = [doc_ids, piece.astype(np.int32), start, length, crc, bins + next_bin, at, fills[bins]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            if ids:
                columns.append(pa.array(more[0], pa.list_(pa.int32())))
                names.append("ids")
            next_bin += len(fills)
            owners, rows, n_rows = [], [], 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

        for b in batches:
            for first in range(0, b.num_rows, 256):
                texts = b.column(1)[first : first + 256].to_pylist()
                owner, piece, start, length, crc, own = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    body = (encode(text) if text else b"") + end
                    for k in range(0, len(body), 4 * capacity):
                        part = body[k : k + 4 * capacity]
                        owner.append(first + i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            own.append(np.frombuffer(part, "<i4"))
                owners.append(b.column(0).take(pa.array(owner, pa.int64())))
                rows.append((*(np.array(x, np.int64) for x in (piece, start, length, crc)), *([own] if ids else [])))
                n_rows += len(owner)
                if n_rows >= BLOCK:
                    yield packed()
        if n_rows:
            yield packed()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(slim(run), schema)


def _round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """(bin, into, shift, fill) of items (bin, fill): each goes behind others into one bin, named by its first item."""

    def pack(group):
        import pyarrow as pa

        names = group.column("bin").to_numpy()
        order = np.argsort(names)  # rows of a group come in any order; the result doesn't depend on it
        names, sizes = names[order], group.column("fill").to_numpy()[order]
        bins, at, fills = best_fit(sizes, capacity)
        first = np.empty(len(fills), np.int64)
        first[bins[at == 0]] = names[at == 0]
        return pa.table([names, first[bins], at, fills[bins]], names=["bin", "into", "shift", "fill"])

    dealt = items.withColumn("_g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(lambda t: pack(t.drop_columns("_g")), "bin long, into long, shift long, fill long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece of docs (doc_id, text).

    A document is the ids that the tokenizers library gives for the file at path, without added special tokens, and then
    end_id. Only documents longer than `capacity` are cut, every `capacity` ids. Pieces of a sequence lie one behind
    the other from 0 and take at most `capacity` together. A null text is empty: one piece, end_id alone. Repeated rows
    are packed each; a null id is an id; further columns aren't looked at; an empty table gives an empty one. Which
    sequence takes a piece depends on how rows lie in files, not on chance.
    """
    nearly = capacity - capacity // NEARLY
    with Scratch() as inner:
        pieces = work_table(_local(docs, path, capacity, end_id, ids))
        left = pieces.filter((F.col("offset") == 0) & (F.col("fill") < nearly)).select("bin", "fill")
        rounds, n = [], left.count()
        while n > 1:
            groups = -(-n // ITEMS)
            done = work_table(_round(left, groups, capacity))
            rounds.append(done)
            left = done.filter((F.col("shift") == 0) & (F.col("fill") < nearly)).select("bin", "fill")
            bins, under = done.filter("shift = 0").count(), left.count()
            if groups == 1 or n - bins < n / SPARES:
                break
            n = under
        moves = None  # where each underfull bin of the first round ends up
        for done in reversed(rounds):
            step = done.select("bin", "into", "shift")
            if moves is not None:
                on = moves.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
                step = step.join(on, "into", "left").select("bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            moves = step
        if moves is None:
            out = pieces.withColumn("sequence_id", F.col("bin"))
        else:
            # moves are as many as underfull bins of the first round, so their size decides on the kind of join
            out = pieces.join(moves.withColumnRenamed("bin", "_bin"), F.col("bin") == F.col("_bin"), "left")
            out = out.withColumn("sequence_id", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ids
        out = out.select(*names)
    inner.drop(out)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, bounds) of pack(.., ids=True): the ids of each sequence, and where its pieces begin. At most
    `capacity` ids, and so pieces, meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.offset").alias("bounds"))
