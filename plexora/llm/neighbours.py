"""The most similar vectors of every vector: an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook, trained on a bounded sample; every vector is indexed
under its pair of centroids, its cell. A query walks the pairs in the order of their summed distance with a heap until
the cells it has met hold enough entries, and the entries are reranked by exact cosine.

Cells are packed into shards of a bounded number of entries (from the counts of all cells, at most K * K numbers on the
driver), and a query is sent once to each shard that holds a cell it wants. Equal vectors are indexed once.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.scale import stage

#: Vectors of the sample that the codebooks are trained on; the sample is bounded, the index holds every vector.
SAMPLE = 20_000
#: Most centroids per half.
MAX_CENTROIDS = 1024
#: Entries that a query's cells must hold before its walk ends, and the least number of cells it walks.
ENTRIES, LEAST_CELLS = 1200, 8
#: Entries of a shard.
SHARD_ENTRIES = 8_000


def latest(rows: DataFrame, key: str, vector: str, order: str, dim: int) -> DataFrame:
    """id, vec: per key the row of the highest `order` (null lowest; of ties the greater vector), if its vector is usable.

    Usable are vectors of `dim` finite numbers that are not all zero. A key whose last row isn't usable is left out.
    """
    best = (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).alias("id"), F.struct(F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**62))).alias("o"), F.col(vector).cast("array<float>").alias("v")).alias("s"))
        .groupBy("id")
        .agg(F.max("s").alias("s"))
        .select("id", F.col("s.v").alias("vec"))
    )
    fine = (F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists("vec", lambda x: x != 0)
    return best.where(F.coalesce(fine, F.lit(False)))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(4)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c.astype(np.float32)


@dataclass
class MultiIndex:
    """Both codebooks, the number of entries of each cell, and the shards of each cell (first shard, number of shards)."""

    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return tuple(  # type: ignore[return-value]
            np.maximum(0, -2 * y @ c.T + (c * c).sum(1) + (y * y).sum(1)[:, None]) for y, c in ((x[:, :h], self.books[0]), (x[:, h:], self.books[1]))
        )

    def walk(self, a: list[float], ia: list[int], b: list[float], ib: list[int], entries: int, least: int) -> list[tuple[int, int]]:
        """Cells in the order of the summed distance of their centroids, until they hold `entries` vectors."""
        heap = [(a[0] + b[0], 0, 0)]
        out: list[tuple[int, int]] = []
        have, k, counts = 0, len(a), self.counts
        while heap:
            _, i, j = heapq.heappop(heap)
            # each pair is reached from one side only: along the second list, or down the first at its start
            if j + 1 < k:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            n = counts[ia[i]][ib[j]]
            if n:
                out.append((ia[i], ib[j]))
                have += n
                if have >= entries and len(out) >= least:
                    break
        return out


def train_books(sample: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves: about a quarter of the root of the collection's size, a power of two."""
    k = 2 ** round(np.log2(max(4.0, np.sqrt(max(total, 1)) / 4)))
    k = int(min(k, MAX_CENTROIDS, max(1, len(sample))))
    h = sample.shape[1] // 2
    return _kmeans(sample[:, :h], k), _kmeans(sample[:, h:], k)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell: neighbouring cells of a row share a shard, large ones get several."""
    first, parts = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    shard, room = 0, size
    for i in range(counts.shape[0]):
        for j in range(counts.shape[1]):
            n = counts[i, j]
            if n > size:
                shard += room < size
                parts[i, j] = -(-n // size)
                first[i, j] = shard
                shard, room = shard + parts[i, j], size
            else:
                if n > room:
                    shard, room = shard + 1, size
                first[i, j] = shard
                room -= n
    return first, parts


def similar_pairs(collection: DataFrame, k: int = 5, least: float = 0.85, dim: int = 64, entries: int = ENTRIES) -> DataFrame:
    """id_a, id_b, cosine: unordered pairs in which one is among the k others of highest cosine to the other one, and the
    cosine is at least `least`.

    collection: id, vec with usable vectors. Ties go to the smaller id. Equal vectors are one entry: its k + 1 smallest
    ids stand for all of them, and every further id is paired with the k smallest, which is what the tie rule gives. An
    empty collection, or one vector, gives no rows. What is found for one side of a pair is offered to the other too.
    """
    spark = collection.sparkSession
    unit_bytes = _unit_bytes(collection)
    base = stage(unit_bytes, "imi-vectors")
    total = base.count()
    if total == 0:
        return spark.createDataFrame([], "id_a string, id_b string, cosine double")
    # some two samples' worth by one hash, of which another one's order takes SAMPLE: few rows, whatever the table's size
    some = base.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, total // (2 * SAMPLE)))) == 0)
    few = some.orderBy(F.xxhash64("id", F.lit(2)), "id").select("vec").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in few), np.float32).reshape(-1, dim) if few else np.eye(2, dim, dtype=np.float32)
    books = train_books(sample, total)
    assigned = stage(_assign(_copies(base, k), books, dim), "imi-cells")
    kk = len(books[0])
    counts = np.zeros((kk, kk), np.int64)
    for r in assigned.groupBy("c1", "c2").count().collect():  # at most K * K rows
        counts[r["c1"], r["c2"]] = r["count"]
    first, parts = _pack(counts, SHARD_ENTRIES)
    index = spark.sparkContext.broadcast(MultiIndex(books, counts, first, parts))
    found = _search(assigned, index, k, least, dim, entries)
    return _merge(found.unionByName(_within_copies(base, assigned, k)), k)


def _unit_bytes(collection: DataFrame) -> DataFrame:
    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = _unit(pdf["vec"].tolist())
            # copies, also those at another length that is a power of two, have the same unit vector
            same = [hashlib.blake2b((v + np.float32(0)).tobytes(), digest_size=16).hexdigest() for v in x]
            yield pd.DataFrame({"id": pdf["id"], "vec": [v.tobytes() for v in x], "same": same})

    return collection.mapInPandas(work, "id string, vec binary, same string")


def _copies(base: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest ids, and how many it has beyond them.

    The rank limit is applied before the shuffle too (the planner's window group limit), so a vector with very many
    copies sends only a few rows.
    """
    w = Window.partitionBy("same").orderBy("id")
    few = base.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    return few.groupBy("same").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vec", "id").alias("vec"))


def _assign(entries: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int) -> DataFrame:
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = dim // 2
        for pdf in it:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, dim)
            c = [(-2 * y @ b.T + (b * b).sum(1)).argmin(1) for y, b in zip((x[:, :h], x[:, h:]), shared.value)]
            yield pdf.assign(c1=c[0].astype("int32"), c2=c[1].astype("int32"))

    return entries.mapInPandas(work, "same string, ids array<string>, vec binary, c1 int, c2 int")


def _search(assigned: DataFrame, index, k: int, least: float, dim: int, entries: int) -> DataFrame:
    """id_a, id_b, cosine: what each entry finds in each of its shards, k of each at most."""

    def send(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: MultiIndex = index.value
        ix.counts = [list(map(int, r)) for r in ix.counts] if not isinstance(ix.counts, list) else ix.counts
        for pdf in it:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, dim)
            da, db = ix.distances(x)
            oa, ob = da.argsort(1), db.argsort(1)
            sa, sb = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
            rows, shards, cells = [], [], []
            for r in range(len(x)):
                want: dict[int, list[int]] = {}
                for c1, c2 in ix.walk(sa[r].tolist(), oa[r].tolist(), sb[r].tolist(), ob[r].tolist(), entries, LEAST_CELLS):
                    for s in range(ix.first[c1, c2], ix.first[c1, c2] + ix.parts[c1, c2]):
                        want.setdefault(int(s), []).append(c1 * 65536 + c2)
                for s, cs in want.items():
                    rows.append(r)
                    shards.append(s)
                    cells.append(cs)
            yield pd.DataFrame({"shard": np.array(shards, np.int32), "role": np.int8(1), "ids": pdf["ids"].to_numpy()[rows], "vec": pdf["vec"].to_numpy()[rows], "cells": cells})

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: MultiIndex = index.value
        for pdf in it:
            c1, c2 = pdf["c1"].to_numpy(), pdf["c2"].to_numpy()
            shard = ix.first[c1, c2] + np.array([zlib.crc32(h.encode()) for h in pdf["same"]], np.int64) % ix.parts[c1, c2]
            yield pd.DataFrame({"shard": shard.astype(np.int32), "role": np.int8(0), "ids": pdf["ids"], "vec": pdf["vec"], "cells": [[int(a) * 65536 + int(b)] for a, b in zip(c1, c2)]})

    schema = "shard int, role byte, ids array<string>, vec binary, cells array<int>"
    both = assigned.mapInPandas(place, schema).unionByName(assigned.mapInPandas(send, schema))
    n = max(1, int(index.value.first.max() + index.value.parts.max()))
    width = max(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, 20_000))
    both = both.repartition(width, "shard").sortWithinPartitions("shard", "role")

    def rank(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted: of each shard first its entries (a bounded number), then the queries sent to it, in batches
        held: list[pd.DataFrame] = []
        shard, table = None, None
        for pdf in it:
            for s, g in pdf.groupby("shard", sort=True):
                if s != shard:
                    shard, held, table = s, [], None
                e, q = g[g["role"] == 0], g[g["role"] == 1]
                if len(e):
                    held.append(e)
                    table = None
                if len(q) and held:
                    if table is None:
                        table = _Table(pd.concat(held), dim)
                    yield table.answer(q, k, least)

    return both.mapInPandas(rank, "id_a string, id_b string, cosine double")


class _Table:
    """The entries of a shard, grouped by cell."""

    def __init__(self, e: pd.DataFrame, dim: int):
        cell = np.array([c[0] for c in e["cells"]])
        order = cell.argsort(kind="stable")
        self.ids = [list(x) for x in e["ids"].to_numpy()[order]]
        #: place of each entry's first id in order, which ties go by
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[sorted(range(len(self.ids)), key=lambda i: self.ids[i][0])] = np.arange(len(self.ids))
        self.x = np.frombuffer(b"".join(e["vec"].to_numpy()[order]), np.float32).reshape(-1, dim).astype(np.float64)
        self.x /= np.linalg.norm(self.x, axis=1, keepdims=True)
        cell = cell[order]
        names, start = np.unique(cell, return_index=True)
        self.span = {int(c): (int(a), int(b)) for c, a, b in zip(names, start, [*start[1:], len(cell)])}
        self.dim = dim

    def answer(self, q: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
        x = np.frombuffer(b"".join(q["vec"]), np.float32).reshape(-1, self.dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # all queries that want a cell are compared with it at once
        by: dict[int, list[int]] = {}
        for r, cells in enumerate(q["cells"]):
            for c in cells:
                if c in self.span:
                    by.setdefault(c, []).append(r)
        hit_q, hit_e, hit_s = [], [], []
        for c, rs in by.items():
            a, b = self.span[c]
            for i in range(0, len(rs), 1024):
                part = np.array(rs[i : i + 1024])
                s = x[part] @ self.x[a:b].T
                u, v = np.nonzero(s >= least - 1e-9)
                hit_q.append(part[u])
                hit_e.append(v + a)
                hit_s.append(s[u, v])
        out: list[tuple[str, str, float]] = []
        if hit_q:
            hq, he, hs = np.concatenate(hit_q), np.concatenate(hit_e), np.concatenate(hit_s)
            order = np.lexsort((self.rank[he], -hs, hq))
            ids = q["ids"].to_numpy()
            last, n = -1, 0
            for o in order:
                r = hq[o]
                if r != last:
                    last, n = r, 0
                own = ids[r]
                if n >= k + 1 or hs[o] < least:
                    continue
                other = self.ids[he[o]]
                if other[0] == own[0]:
                    continue
                n += 1
                sim = min(1.0, float(hs[o]))
                for i in own[: k + 1]:
                    for j in other[:k]:
                        out.append((i, j, sim))
        return pd.DataFrame(out, columns=["id_a", "id_b", "cosine"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best others of each id of all that was found, from either side, as unordered pairs.

    An id that very many others found is thinned before the shuffle by the planner's window group limit.
    """
    # both directions from one pass; a union of it with its mirror would search twice
    ends = F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))).alias("e")
    both = found.select(ends, "cosine").select("e.*", "cosine").groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id_a").orderBy(F.desc("cosine"), "id_b")
    top = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine").distinct()


def _within_copies(base: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """Pairs of equal vectors: each id with the k smallest other ids of its vector.

    A sort-merge join of ids with the few ids that stand for their vector; a vector with very many copies is split by
    the adaptive skew join.
    """
    groups = assigned.where(F.size("ids") > 1).select("same", "ids")
    pairs = base.select("id", "same").join(groups, "same")
    other = F.explode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k))
    pairs = pairs.select("id", other.alias("o"))
    return pairs.select(F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b"), F.lit(1.0).alias("cosine"))
