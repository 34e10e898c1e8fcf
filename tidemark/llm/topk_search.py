"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of b bits is cut into m segments of 16. If two codes differ in fewer than m * (r + 1) bits, some segment of
theirs differs in r bits at most. So a query looks up, segment by segment, the values within radius r of its own,
verifies whole codes, and lets r grow until its kth verified distance is below m * (r + 1): then nothing that it
hasn't seen can be nearer, or as near. Equal codes are one entry with its smallest ids, which is all that a top-k
can return. The index is cut into blocks of bounded size, the queries too; every query visits every block, and
the blocks' answers are merged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_table

SEGMENT = 16
#: Distinct codes of an index block, distinct query codes of a query block.
BLOCK_CODES, BLOCK_QUERIES = 1 << 17, 1 << 14

_masks: dict[int, np.ndarray] = {}


def masks(r: int) -> np.ndarray:
    """All values of a segment with r bits."""
    if r not in _masks:
        _masks[r] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.int64)
    return _masks[r]


def codes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dims, code): a bit for each component, set if it is above 0 (NaN and null are not), in words of 64 bits.
    Rows with a null id or a null or empty vector have no code and aren't returned."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, out, dims = b.column(0).to_pylist(), [], []
            for v in b.column(1):
                x = np.array([c or 0.0 for c in v.as_py()], np.float64) > 0 if b.column(1).null_count else np.nan_to_num(v.values.to_numpy(zero_copy_only=False)) > 0
                bits = np.packbits(x, bitorder="little")
                out.append(bits.tobytes() + bytes(-len(bits) % 8))
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dims", "code"])

    some = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    return some.mapInArrow(run, "id long, dims int, code binary")


class Index:
    """Codes (n, words) of uint64, each standing for `weight` ids."""

    def __init__(self, code: np.ndarray, weight: np.ndarray) -> None:
        self.code, self.weight = code, weight
        parts = np.ascontiguousarray(code).view(np.uint16).astype(np.int64)
        self.m = parts.shape[1]
        self.order = np.argsort(parts, axis=0, kind="stable")
        self.start = [np.searchsorted(parts[self.order[:, s], s], np.arange((1 << SEGMENT) + 1)) for s in range(self.m)]
        self.seen = np.zeros(len(code), bool)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances): all entries as near as the kth id or nearer; all, if there are fewer than k ids."""
        own = query.view(np.uint16).astype(np.int64)
        found, distance = [], []
        near = np.zeros(64 * len(query) + 1, np.int64)  # ids by distance
        for r in range(SEGMENT + 1):
            if self.m * len(masks(r)) > len(self.code):  # more look-ups than entries: verify what is left
                self._verify(np.flatnonzero(~self.seen), query, found, distance, near)
                break
            for s in range(self.m):
                value = own[s] ^ masks(r)
                a, b = self.start[s][value], self.start[s][value + 1]
                full = np.flatnonzero(b > a)
                if len(full):
                    a, n = a[full], b[full] - a[full]
                    at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    entry = self.order[at, s]
                    self._verify(entry[~self.seen[entry]], query, found, distance, near)
            if np.searchsorted(np.cumsum(near), k) < self.m * (r + 1):
                break
        entry, d = np.concatenate(found), np.concatenate(distance)
        self.seen[entry] = False
        last = np.searchsorted(np.cumsum(near), k)
        keep = d <= last
        return entry[keep], d[keep]

    def _verify(self, entry, query, found, distance, near) -> None:
        d = np.bitwise_count(self.code[entry] ^ query).sum(1, dtype=np.int64)
        self.seen[entry] = True
        found.append(entry)
        distance.append(d)
        near += np.bincount(d, self.weight[entry], len(near)).astype(np.int64)


def _search(k: int):
    """Rows (dims, block, part, ids, code), a block's index entries (ids not null) before its queries, to (dims, code, id, distance)."""

    def run(batches):
        import pyarrow as pa

        key, entries, index = None, [], None
        for b in batches:
            out = []
            for dims, block, part, ids, code in zip(*(b.column(c).to_pylist() for c in range(5))):
                if (dims, block, part) != key:
                    key, entries, index = (dims, block, part), [], None
                if ids is not None:
                    entries.append((ids, code))
                    continue
                if index is None and entries:
                    index = Index(np.stack([np.frombuffer(c, np.uint64) for _, c in entries]), np.array([len(i) for i, _ in entries]))
                if index is not None:
                    entry, d = index.search(np.frombuffer(code, np.uint64), k)
                    near = sorted((x, i) for e, x in zip(entry.tolist(), d.tolist()) for i in entries[e][0])[:k]
                    out += [(dims, code, i, x) for x, i in near]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.int64(), pa.int32()))], ["dims", "code", "id", "distance"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): for every row of queries the k rows of `rows` with the nearest codes.

    Distance: bits in which the codes differ; ties go to the smaller id; the query's own id is left out. Rows with a
    null id or an empty or null vector neither ask nor answer; vectors of another length are at no distance. Ids that
    are repeated are looked at once for each code. Fewer than k rows give fewer answers; an empty table gives none.
    """
    spark = rows.sparkSession
    coded, asked = work_table(codes(rows, key, vector)), work_table(codes(queries, key, vector).distinct())
    rank = F.row_number().over(Window.partitionBy("dims", "code").orderBy("id"))
    # Spark limits such groups before the shuffle, so a code with a third of all rows sends k + 1 a task
    entries = coded.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("dims", "code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = work_table(entries)
    kinds = work_table(asked.select("dims", "code").distinct())
    n_blocks = max(1, -(-entries.count() // BLOCK_CODES))
    n_parts = max(1, -(-kinds.count() // BLOCK_QUERIES), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    left = entries.select("dims", spread(n_blocks).alias("block"), every(n_parts).alias("part"), "ids", "code")
    right = kinds.select("dims", every(n_blocks).alias("block"), spread(n_parts).alias("part"), F.lit(None).cast("array<bigint>").alias("ids"), "code")
    both = left.union(right).repartition("dims", "block", "part").sortWithinPartitions("dims", "block", "part", F.col("ids").isNull())
    found = both.mapInArrow(_search(k + 1), "dims int, code binary, id long, distance int")
    order = Window.partitionBy("dims", "code").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank")
    answers = asked.withColumnRenamed("id", "query_id").join(best, ["dims", "code"]).filter(F.col("id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return answers.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
