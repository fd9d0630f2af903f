"""Mixing sources to target weights: quotas in tokens, split over output shards by a multivariate-hypergeometric tree.

1. Sizes in tokens per document. A document's place in its source is a hash of its id, so that any range of places is a
   random sample of the source. Sizes of BUCKETS ranges per source come to the driver.
2. The total is the largest at which every source can fill its share with max_repeats copies of itself. A source is
   used whole as often as it fits, and once more up to a place, which is found by cutting the range that holds it into
   BUCKETS again, until what is left is a bounded number of tokens; of that, document by document.
3. Each use of a source falls into blocks of about shard_tokens / BLOCKS_PER_SHARD tokens. They are dealt to the output
   shards by recursive halving: each node of the tree splits its exact per-source block counts between its halves by a
   multivariate hypergeometric draw. The tasks descend the tree themselves, as every draw is told by its node: a block's
   place in a permutation of its source's blocks leads it to its leaf. A leaf's documents are shuffled locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from plexora.scale import stage

#: Ranges whose sizes come to the driver, per source and round, as a number of bits; and the bits of a place.
BUCKET_BITS, PLACE_BITS = 9, 62
BUCKETS = 1 << BUCKET_BITS
#: Tokens of a range that one task may go through document by document.
RANGE_TOKENS = 20_000_000
#: Blocks that a shard is made of, about.
BLOCKS_PER_SHARD = 16
#: Subtrees that rows are brought to before they descend further.
GROUPS = 1024
#: Most sources; the driver gets BUCKETS sizes of each.
MAX_SOURCES = 2000


@dataclass(frozen=True)
class Quota:
    """What of a source is used: `whole` copies of all, and of one more copy all blocks before `cut`, and of block `cut`
    documents up to `rest` tokens."""

    source: str
    whole: int
    cut: int
    rest: int


def plan_quotas(blocks: dict[str, list[int]], targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[float, list[Quota]]:
    """The total in tokens and each source's quota. blocks: sizes of the blocks of each source, in permuted order.

    Sources without any token or with a share of 0 are left out; the shares of the others still refer to the total, so
    that an absent source limits it to 0 only if its share is above 0 and it has no documents: then it is skipped and
    the shares of the rest are scaled up.
    """
    usable = [(s, w, max(1, int(r))) for s, w, r in targets if s is not None and w and w > 0 and sum(blocks.get(s, []))]
    mass = sum(w for _, w, _ in usable)
    if not usable:
        return 0.0, []
    most = min(sum(blocks[s]) * r / (w / mass) for s, w, r in usable)
    total = most if total is None else min(total, most)
    out = []
    for s, w, r in usable:
        size, want = sum(blocks[s]), w / mass * total
        whole = min(r, int(want // size + 1e-9))
        left = int(round(want - whole * size))
        if whole == r or left <= 0:
            out.append(Quota(s, whole, 0, 0))
            continue
        cut = 0
        while cut < len(blocks[s]) and left >= blocks[s][cut]:
            left -= blocks[s][cut]
            cut += 1
        out.append(Quota(s, whole, cut, left if cut < len(blocks[s]) else 0))
    return total, out


def _left(have: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """What a node of the tree, the shards lo to hi, gives to its left half: a multivariate hypergeometric draw of its
    blocks, in the halves' proportion. The node tells the draw."""
    n, mid = int(have.sum()), (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    return rng.multivariate_hypergeometric(have, n * (mid - lo) // (hi - lo), method="marginals") if n else have * 0


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts of blocks per source dealt to `shards` leaves of near equal size; rows are shards, columns sources."""
    out = np.zeros((shards, len(counts)), np.int64)
    open_ = [(0, shards, counts.astype(np.int64))]
    while open_:
        lo, hi, have = open_.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        left = _left(have, lo, hi, seed)
        open_ += [(lo, (lo + hi) // 2, left), ((lo + hi) // 2, hi, have - left)]
    return out


class Descent:
    """Leads blocks to their shards: the block at a place of its source goes left if the left half has so many."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int, width: int = 1):
        self.counts, self.shards, self.seed, self.width = counts.astype(np.int64), shards, seed, width
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def lead(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """First shard of the subtree of at most `width` shards that each block ends in. Only nodes that a block passes
        are drawn."""
        out, place = np.zeros(len(source), np.int64), place.astype(np.int64).copy()
        open_ = [(0, self.shards, self.counts, np.arange(len(source)))]
        while open_:
            lo, hi, have, rows = open_.pop()
            if not len(rows):
                continue
            if hi - lo <= self.width:
                out[rows] = lo
                continue
            if (left := self.drawn.get((lo, hi))) is None:
                if len(self.drawn) > 200_000:
                    self.drawn.clear()
                left = self.drawn[(lo, hi)] = _left(have, lo, hi, self.seed)
            goes = place[rows] < left[source[rows]]
            right = rows[~goes]
            place[right] -= left[source[right]]
            mid = (lo + hi) // 2
            open_ += [(lo, mid, left, rows[goes]), (mid, hi, have - left, right)]
        return out


@dataclass(frozen=True)
class Use:
    """A source in the mixture: whole copies, and one more of all places below `upto` and, up to `rest` tokens, of those
    from there below `end`."""

    source: str
    whole: int
    upto: int
    end: int
    rest: int
    size: int


def _find_cuts(one: DataFrame, sizes: dict[str, list[int]], quotas: list[Quota], range_tokens: int) -> list[Use]:
    """Narrows the range in which each source's last copy ends, a round for all sources at once, until it is small."""
    spark, width = one.sparkSession, 1 << (PLACE_BITS - BUCKET_BITS)
    uses, held = [], {}
    for q in quotas:
        uses.append(Use(q.source, q.whole, q.cut * width, (q.cut + (q.rest > 0)) * width, q.rest, sum(sizes[q.source])))
        held[q.source] = sizes[q.source][q.cut] if q.rest else 0
    while width >= BUCKETS and (wide := [u for u in uses if held[u.source] > range_tokens]):
        width >>= BUCKET_BITS
        ranges = spark.createDataFrame([(u.source, u.upto, u.end) for u in wide], "source string, upto bigint, end bigint")
        part = ((F.col("o") - F.col("upto")) / width).cast("int")
        inside = one.join(F.broadcast(ranges), "source").where((F.col("o") >= F.col("upto")) & (F.col("o") < F.col("end")))
        got: dict[str, dict[int, int]] = {}
        for r in inside.groupBy("source", part.alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
            got.setdefault(r["source"], {})[r["b"]] = int(r["n"])
        for k, u in enumerate(uses):
            if u.source in got:
                rest, b, mine = u.rest, 0, got[u.source]
                while b < BUCKETS and rest >= mine.get(b, 0):
                    rest -= mine.get(b, 0)
                    b += 1
                held[u.source] = mine.get(b, 0)
                uses[k] = Use(u.source, u.whole, u.upto + b * width, u.upto + (b + 1) * width, rest, u.size)
    return uses


def mix(
    docs: DataFrame,
    targets: DataFrame,
    seed: int = 20,
    shard_tokens: int = 2_000_000,
    total: int | None = None,
    vocabulary: str = DEFAULT_VOCABULARY,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    range_tokens: int = RANGE_TOKENS,
    groups: int = GROUPS,
) -> DataFrame:
    """shard, position, doc, source, copy_no, n_tokens of the mixture.

    No document is used more than max_repeats times; sources are matched by name; documents without an id, a source or a
    target, and texts of no token, are left out. Documents with the same id are one document (the longest counts).
    Equal texts of different ids are different documents. The driver gets at most BUCKETS sizes per source and round.
    """
    goals = [(r["source"], r["target_share"], r["max_repeats"] or 1) for r in targets.select("source", "target_share", "max_repeats").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(goals) > MAX_SOURCES or len({g[0] for g in goals}) < len(goals):
        raise ValueError(f"targets must name each source once, and at most {MAX_SOURCES}")
    names = [g[0] for g in goals if g[0] is not None]
    base = docs.where(F.col(doc).isNotNull() & F.col(source).isin(names)).select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = count_tokens(base, "text", "n_tokens", vocabulary).where(F.col("n_tokens") > 0)
    one = sized.groupBy("doc").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("n_tokens", "source")).alias("s")).select("doc", "s.*")
    one = stage(one.withColumn("o", F.xxhash64(F.lit(seed), "doc").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))), "mix-sizes")
    sizes: dict[str, list[int]] = {s: [0] * BUCKETS for s in names}
    bucket = F.shiftright("o", PLACE_BITS - BUCKET_BITS).cast("int")
    for r in one.groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
        sizes[r["source"]][r["b"]] = int(r["n"])
    used, quotas = plan_quotas(sizes, goals, total)
    uses = _find_cuts(one, sizes, quotas, range_tokens)
    return _deal(one, uses, max(1, math.ceil(used / shard_tokens)), shard_tokens, seed, doc, groups)


def _block(place, blocks):
    """The block of a place, without leaving 64 bits."""
    return F.shiftright(F.shiftright(place, 31) * blocks, 31)


def _deal(one: DataFrame, uses: list[Use], shards: int, shard_tokens: int, seed: int, doc: str, groups: int) -> DataFrame:
    spark, rows, counts = one.sparkSession, [], []
    for k, u in enumerate(uses):
        blocks = max(1, math.ceil(u.size * BLOCKS_PER_SHARD / shard_tokens))
        last = u.end if u.rest else u.upto
        touched = (((last - 1) >> 31) * blocks >> 31) + 1 if last > 0 else 0
        n = u.whole * blocks + touched
        rng = np.random.default_rng([seed, 7, k])
        step = next(x for x in iter(lambda: int(rng.integers(1, max(2, n))), None) if math.gcd(x, max(1, n)) == 1)
        rows.append((u.source, k, u.whole, u.upto, u.end, u.rest, blocks, n, step, int(rng.integers(0, max(1, n)))))
        counts.append(n)
    plan = spark.createDataFrame(rows, "source string, s int, whole int, upto bigint, end bigint, rest bigint, blocks bigint, n bigint, step bigint, first bigint")
    j = one.join(F.broadcast(plan), "source")  # at most MAX_SOURCES rows
    whole = j.where("whole > 0").withColumn("copy_no", F.explode(F.expr("sequence(0, whole - 1)")))
    sure = j.where("o < upto").withColumn("copy_no", F.col("whole"))
    # where the last copy ends documents are taken in their order while they fit; the range is bounded in tokens
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("o", "doc"))
    rest = j.where("rest > 0 AND o >= upto AND o < end").withColumn("copy_no", F.col("whole")).withColumn("__t", upto)
    rest = rest.where(F.col("__t") - F.col("n_tokens") / 2 <= F.col("rest")).drop("__t")
    chosen = whole.unionByName(sure).unionByName(rest)
    index = F.col("copy_no") * F.col("blocks") + _block(F.col("o"), F.col("blocks"))
    chosen = chosen.select("doc", "source", "copy_no", "n_tokens", "s", F.pmod(F.col("step") * index + F.col("first"), F.col("n")).alias("place"))
    kind = one.schema["doc"].dataType.simpleString()
    total = np.array(counts or [0])

    def lead(width: int):
        def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d = Descent(total, shards, seed, width)
            for pdf in it:
                yield pdf.assign(shard=d.lead(pdf["s"].to_numpy(), pdf["place"].to_numpy()))

        return work

    schema = f"doc {kind}, source string, copy_no int, n_tokens bigint, s int, place bigint, shard bigint"
    if shards > groups:
        # subtrees first, so that a task draws only the nodes of a few of them
        chosen = chosen.mapInPandas(lead(-(-shards // groups)), schema).repartition("shard").sortWithinPartitions("shard").drop("shard")
    placed = chosen.mapInPandas(lead(1), schema)
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc", "copy_no"), "doc", "copy_no")
    return placed.select(F.col("shard").cast("int").alias("shard"), (F.row_number().over(local) - 1).alias("position"), F.col("doc").alias(doc), "source", "copy_no", "n_tokens")


def mix_report(mixture: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per source: tokens and documents used, the share reached, the target, and the most copies of a document."""
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("copy_no") + 1).alias("most_copies")
    )
    # one row per source is left here, so the window over all of them is small
    got = targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return got.select(
        "source",
        "target_share",
        "max_repeats",
        tokens.alias("tokens"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (tokens / F.nullif(F.sum(tokens).over(Window.partitionBy(F.lit(1))), F.lit(0))).alias("share"),
    )


def shard_report(mixture: DataFrame) -> DataFrame:
    """shard, tokens, uses, sources: how large each output shard is."""
    return mixture.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.count_distinct("source").alias("sources"))
