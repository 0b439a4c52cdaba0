"""Sharding by minimax contiguous partition.

Rows with equal texts form one atomic group. Groups stand in the order of their text digest; the
shards are contiguous runs of that order. The smallest capacity for which a greedy fill needs no more
than the given number of shards is found by binary search, and the order is cut under it, each cut at
the group boundary next to an even share among those that leave the rest feasible. A group that
alone reaches an even share of what is left (a text with very many copies) stands before the others
and has a shard of its own, so it cannot starve the rest.

The driver never holds all groups: it works on a histogram of digest prefixes, and only the ranges
in which a cut can fall are refined, level by level, down to single groups.

Defined cases: a null text counts as an empty one (no bytes, crc32 0) and shares its group;
repeated rows are rows of one group; a null doc_id keeps its row; with fewer groups than shards some
shards stay empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.llm.common import stored

#: Bytes that each row takes besides its text.
ROW_BYTES = 8
#: Digest bits of the first histogram and of each refinement, and single groups that the driver may hold.
FIRST_BITS, MORE_BITS, EXACT_GROUPS = 14, 8, 400_000
#: Bits of the first order key, 15 hexadecimal digits.
KEY_BITS = 60
#: Numbering blocks in each shard: rows of a block, and the bounds of their number.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 50_000, 256, 4_096


def _greedy(ends: np.ndarray, start: int, capacity: int, shards: int) -> bool:
    """Whether the pieces after start, whose running totals are ends, fit into so many shards."""
    at = start
    for _ in range(shards):
        if at >= ends[-1]:
            return True
        at = int(ends[np.searchsorted(ends, at + capacity, side="right") - 1])
    return at >= ends[-1]


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which a greedy fill of the ordered sizes needs no more than so many shards."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, 0, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """How many pieces lie before each of the shards - 1 cuts, every shard within the smallest capacity."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    capacity, cuts, at = smallest_capacity(sizes, shards), [], 0
    for left in range(shards, 1, -1):
        start, most = int(ends[at]), int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        target = start + (int(ends[-1]) - start) / left
        above = min(int(np.searchsorted(ends, target, side="left")), most)
        near = sorted({max(at, above - 1), above}, key=lambda i: (abs(int(ends[i]) - target), i))
        at = next((i for i in near if _greedy(ends, int(ends[i]), capacity, left - 1)), most)
        cuts.append(at)
    return cuts


def _refined(groups: DataFrame, shards: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Piece sizes in order, and each piece's last key; pieces are single groups wherever a cut can fall."""
    width = KEY_BITS - FIRST_BITS
    found = groups.groupBy(F.shiftright("k1", width).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")).orderBy("p").collect()
    # (first key, bits of the key below the prefix or -1 for a single group, bytes, groups, last key)
    pieces = [(r.p << width, width, r.b, r.n, (((r.p + 1) << width) - 1, 2**KEY_BITS)) for r in found]
    largest = max((r.m for r in found), default=0)
    while pieces:
        sizes = np.array([p[2] for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        low = max(-(-total // shards), largest)
        high = smallest_capacity(sizes, shards)
        need = np.zeros(len(pieces), dtype=bool)
        under = over = 0
        bounds = np.concatenate([[0], ends])
        for _ in range(shards - 1):
            under = int(bounds[np.searchsorted(bounds, under + low, side="right") - 1])
            over = min(total, over + high)
            need[np.searchsorted(ends, under, side="left") : np.searchsorted(ends, over, side="left") + 2] = True
        for i in range(1, shards):  # even shares
            need[max(0, int(np.searchsorted(ends, total * i / shards)) - 1) : int(np.searchsorted(ends, total * i / shards)) + 2] = True
        split = [i for i in np.flatnonzero(need) if pieces[i][1] >= 0 and pieces[i][3] > 1]
        if not split:
            break
        w = pieces[split[0]][1] if len({pieces[i][1] for i in split}) == 1 else max(pieces[i][1] for i in split)
        split = [i for i in split if pieces[i][1] == w]
        wanted = groups.where(F.shiftright("k1", w).isin([pieces[i][0] >> w for i in split]))
        made: dict[int, list] = {i: [] for i in split}
        index = {pieces[i][0] >> w: i for i in split}
        if sum(pieces[i][3] for i in split) <= EXACT_GROUPS or w == 0:
            for r in wanted.select("k1", "k2", "bytes").orderBy("k1", "k2").collect():
                made[index[r.k1 >> w]].append((r.k1, -1, r.bytes, 1, (r.k1, r.k2)))
        else:
            v = max(0, w - MORE_BITS)
            for r in wanted.groupBy(F.shiftright("k1", v).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).orderBy("p").collect():
                made[index[(r.p << v) >> w]].append((r.p << v, v, r.b, r.n, (((r.p + 1) << v) - 1, 2**KEY_BITS)))
        pieces = [x for i, p in enumerate(pieces) for x in (made[i] if i in made else [p])]
    return np.array([p[2] for p in pieces], dtype=np.int64), [p[4] for p in pieces]


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(text, 256)
    part = lambda start: F.conv(F.substring(digest, start, KEY_BITS // 4), 16, 10).cast("long")
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), part(1).alias("k1"), part(17).alias("k2")),
        "shard-rows",
    )
    groups = stored(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    own: list[tuple[int, int]] = []
    shard = F.lit(0)
    if total:
        for r in groups.where(F.col("bytes") >= -(-total // shards)).orderBy(F.desc("bytes"), "k1", "k2").collect():  # so many as shards at most
            if r.bytes * (shards - len(own)) < total or len(own) == shards - 1:
                break
            own.append((r.k1, r.k2))
            total -= r.bytes
        alone = lambda k1, k2: (F.col("k1") == k1) & (F.col("k2") == k2)
        rest = groups
        for key in own:
            rest = rest.where(~alone(*key))
        sizes, last = _refined(rest, shards - len(own))
        shard = F.lit(len(own))
        if len(sizes):
            cuts = [last[c - 1] if c else (-1, 0) for c in even_cuts(sizes, shards - len(own))]
            for n, (k1, k2) in reversed(list(enumerate(cuts))):
                here = (F.col("k1") < k1) | ((F.col("k1") == k1) & (F.col("k2") <= k2))
                shard = F.when(here, F.lit(len(own) + n)).otherwise(shard if n < len(cuts) - 1 else F.lit(shards - 1))
        for n, key in enumerate(own):
            shard = F.when(alone(*key), F.lit(n)).otherwise(shard)
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, (count or 0) // BLOCK_ROWS))
    dealt = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return dealt.join(F.broadcast(offsets), ["shard", "block"]).select(  # shards x MOST_BLOCKS rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
