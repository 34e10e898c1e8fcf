"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

Text is normalised here, by the longest prefix that the model's compiled character map (a double-array trie)
knows, and each normalised byte remembers the source byte it came from. Pieces tile the normalised text, so
their lengths give each piece's span in the source. The pieces themselves come from the library.

If no piece of the model holds a space mark behind another character, merges never reach over the border
before a run of marks; then each word is encoded alone, and workers remember words.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import slim, work_table

MARK = "▁"
#: Words that a worker remembers, and the longest of them in characters: a few MB in all.
MEMORY, LONGEST = 1 << 16, 32


class CharacterMap:
    """The compiled map of a model: longest-prefix replacement of bytes."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes | None]:
        """Bytes that the longest known prefix of text[at:] has, and what replaces them; (0, None) if none is known."""
        units, best = self.units, (0, None)
        if not units:
            return best
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, i = step(units[0]), at
        while i < len(text):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            i += 1
            node ^= step(unit)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                best = (i - at, self.strings[start : self.strings.index(b"\0", start)])
        return best


@dataclass
class Encoded:
    """ids with the bytes [start, end) of the source that each stands for; begin and end ids stand for none."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Codec:
    def __init__(self, path: str | None = None, model: bytes | None = None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.strip = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.identity = not self.map.units and not self.strip and norm.escape_whitespaces
        kinds = spec.SentencePiece
        self.surface = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in spec.pieces]
        self.length = np.array([0 if p.type == kinds.CONTROL else len(s) for p, s in zip(spec.pieces, self.surface)], np.int64)
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN}
        bpe = spec.trainer_spec.model_type == spec.trainer_spec.BPE and spec.trainer_spec.byte_fallback
        odd = any(p.type == kinds.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        self.by_words = self.identity and self.prefix and bpe and not odd and not spec.trainer_spec.treat_whitespace_as_suffix
        self.words: dict[str, bytes] = {}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for their end, the source byte it came from."""
        source = text.encode()
        if self.identity:
            raw = np.frombuffer(source, np.uint8)
            if not len(raw):
                return b"", np.zeros(1, np.int64)
            wide = np.where(raw == 32, np.uint8(3), np.uint8(1))
            out = ((MARK if self.prefix else "") + text.replace(" ", MARK)).encode()
            at = np.repeat(np.arange(len(raw) + 1, dtype=np.int32 if len(raw) < 2**31 - 1 else np.int64), np.append(wide, np.uint8(1)))
            return out, np.concatenate((np.zeros(3 * self.prefix, at.dtype), at))
        parts, at, i = [], [], 0
        while i < len(source):
            n, new = self.map.longest(source, i)
            if new is None:
                n = 1 if source[i] < 0x80 else 2 if source[i] < 0xE0 else 3 if source[i] < 0xF0 else 4
                new = source[i : i + n]
            parts.append((new, i))
            i += n
        space, mark = b" ", MARK.encode()
        if self.strip:  # runs of spaces count once, none at either end
            kept, before = [], True
            for new, i in parts:
                own = bytearray()
                for c in new:
                    if c != 32 or not before:
                        own.append(c)
                    before = c == 32
                kept.append((bytes(own), i))
            while kept and not kept[-1][0].rstrip(space):
                kept.pop()
            if kept:
                kept[-1] = (kept[-1][0].rstrip(space), kept[-1][1])
            parts = [x for x in kept if x[0]]
        out = [mark] if self.prefix and parts else []
        at = [parts[0][1]] * 3 * bool(out) if parts else []
        for new, i in parts:
            new = new.replace(space, mark)
            out.append(new)
            at += [i] * len(new)
        joined = b"".join(out)
        if self.strip:  # marks at the end go as well, even the one put in front
            joined = joined[: len(joined) - next((k for k in range(0, len(joined) + 1, 3) if not joined[: len(joined) - k].endswith(mark)), 0)]
        return joined, np.array([*at[: len(joined)], len(source)], np.int64)

    def _word(self, word: str) -> bytes:
        """Ids of a word with its marks, as bytes."""
        got = self.words.get(word)
        if got is None:
            ids = self.library.encode(word[1:]) if len(word) > 1 else [self.library.piece_to_id(MARK)]
            got = np.array(ids, "<u4").tobytes()
            if len(word) <= LONGEST:
                if len(self.words) >= MEMORY:
                    self.words.clear()
                self.words[word] = got
        return got

    def pieces(self, text: str, normalised: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and how many bytes of the normalised text each stands for: they tile it."""
        if self.by_words:
            body = b"".join(map(self._word, self.cut.findall(normalised.decode())))
            ids = np.frombuffer(body, "<u4")
            return ids, self.length[ids]
        got = self.library.encode(text, return_type="proto").pieces
        ids = np.array([p.id for p in got], "<u4")
        length = self.length[ids] if len(ids) else np.zeros(0, np.int64)
        for k, p in enumerate(got):  # an unknown piece stands for the characters that it names
            if p.id in self.unknown:
                length[k] = len(p.piece.encode())
        return ids, length

    def encode(self, text: str) -> Encoded:
        """With begin and end ids, as the library encodes it, without sampling."""
        normalised, at = self.normalise(text)
        ids, length = self.pieces(text, normalised)
        if length.sum() != len(normalised):
            raise ValueError("the pieces don't tile the normalised text")
        stop = np.cumsum(length)
        start = stop - length
        n = at[-1]
        return Encoded(
            np.concatenate(([self.library.bos_id()], ids, [self.library.eos_id()])).astype("<u4"),
            np.concatenate(([0], at[start], [n])).astype("<i8"),
            np.concatenate(([0], at[stop], [n])).astype("<i8"),
        )

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model file and worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(docs: DataFrame, path: str, schema: str, columns, batch: int = 64) -> DataFrame:
    """columns: (codec, text) -> the values of schema for one text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    import pyarrow as pa

    known = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, kinds = zip(*((f.split()[0], known[f.split()[1]]) for f in schema.split(", ")))

    def run(batches):
        own = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                got = list(zip(*(columns(own, t or "") for t in b.column(1)[i : i + batch].to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + batch], *(pa.array(x, t) for x, t in zip(got, kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(slim(run), f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row of docs (doc_id, text): ids with begin and end ids, the
    source bytes [start, end) of each, and what the ids decode to. A null text is empty; texts are taken whole;
    repeated rows are encoded each; an empty table gives an empty one; further columns aren't looked at. path: a model
    file that executors can read."""

    def one(c: Codec, text: str):
        e = c.encode(text)
        return e.ids.astype(np.int32), e.start, e.end, c.decode(e.ids)

    return _mapped(docs, path, "ids array<int>, starts array<long>, ends array<long>, decoded string", one)


def digests(docs: DataFrame, path: str, spans: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with its wide columns reduced where they arise. With
    spans also spans_sha256, of the starts and then the ends of all pieces as little-endian signed 64-bit integers."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def one(c: Codec, text: str):
        e = c.encode(text)
        out = len(e.ids), sha(e.ids.tobytes()), sha(c.decode(e.ids).encode())
        return (*out, sha(e.start.tobytes() + e.end.tobytes())) if spans else out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", spans_sha256 string" * spans
    return work_table(_mapped(docs, path, schema, one))
