"""MinHash near-dedup by a multi-index Hamming join.

Each text becomes the set of its five-word shingles and a signature of PLACES b-bit minhash symbols.
Texts with equal sets are one class at once. Two sets whose similarity reaches the threshold differ in few
places; signatures that differ in at most so many places agree, by the pigeonhole principle, in
at least one of the chunks but for floor(places / chunks) places, so every chunk is entered in
the index once for each choice of that many omitted places, and every pair under the distance meets
under some key. The distance and the chunks follow from the similarity, see distance_of().

Under each key the distances are taken in blocks and only a spanning forest of the pairs under the threshold is
emitted, so a key's output is linear in its members. The forests' components are families;
links differ from family links only inside a family. There the full shingle sets are compared with exact counts: first
every member with the family's first, which settles those that are linked with it, as they are of one component;
then every member that is not settled with all others, in blocks, and again only spanning forests of the confirmed links go on.
A family of copies of one text thus costs its members, not their pairs.
Very large keys and families are cut into blocks, and every pair of blocks is a task's work of
bounded size: nothing is capped or sampled.

Defined cases: a null text has no words; texts without words have an empty set and no links; a text
of fewer than five words is one shingle, its whole word sequence; repeated rows are equal sets and
fall into one class, and rows that share a doc_id are one document; a null doc_id takes its class's component; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import claim, discard, group_starts, hand_back, partitions, slices, spread_join, stored, whole_groups
from kymo.llm.components import components

#: Words of a shingle; similarity in percent from which sets are linked: where no contract says otherwise, and by op10's.
SHINGLE, STANDARD, PERCENT = 5, 80, 85
#: Places and bits of a signature; of op10's similarity the chunks, and the distance up to which pairs are guaranteed to meet.
PLACES, BITS, CHUNKS, MOST_ERRORS = 48, 16, 9, 17
#: Members of a block under one key, and shingles and members of a block of a family.
KEY_BLOCK, FAMILY_SHINGLES, FAMILY_BLOCK = 1_024, 400_000, 512
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000

_rng = np.random.default_rng(20240229)
_WORD_FACTORS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_FACTORS = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_FACTORS = _rng.integers(1, 2**63, (PLACES, PLACES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _WORD_FACTORS[0]
    for k in range(1, SHINGLE):
        s += h[k : n + k] * _WORD_FACTORS[k]
    return np.unique(_mixed(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """PLACES symbols of BITS bits."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = _PLACE_FACTORS[:, None] * shingles[None, start : start + 4096]
        part ^= part >> np.uint64(29)
        np.minimum(least, part.min(axis=1), out=least)
    return (_mixed(least) & np.uint64(2**BITS - 1)).astype(np.uint16)


def distance_of(percent: int) -> tuple[int, int]:
    """(chunks, distance) for a similarity: four standard deviations above the mean of differing places, as an odd number, so that one omitted place a chunk suffices."""
    differ = 1 - percent / 100
    most = min(PLACES - 1, math.floor(PLACES * differ + 4 * math.sqrt(PLACES * differ * (1 - differ))))
    most += 1 - most % 2
    return (most + 1) // 2, most


def _omissions(chunks: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(chunk, places that count) of every key: chunks without each choice of so many places as may differ in them."""
    out = []
    for number, chunk in enumerate(np.array_split(np.arange(PLACES), chunks)):
        for left_out in combinations(range(len(chunk)), most // chunks):
            out.append((number, np.delete(chunk, left_out)))
    return out


def signature_keys(signatures: np.ndarray, chunks: int = CHUNKS, most: int = MOST_ERRORS) -> np.ndarray:
    """The index keys, one column for each omission, of rows of signatures."""
    wide = signatures.astype(np.uint64) + np.uint64(1)
    keys = [_mixed((wide[:, at] * _KEY_FACTORS[number, at]).sum(axis=1, dtype=np.uint64) + np.uint64(k)) for k, (number, at) in enumerate(_omissions(chunks, most))]
    return np.stack(keys, axis=1)


def _sketch(batches):
    claim("near", _hashes.clear)
    for batch in slices(batches):
        n, first, second, signs = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            raw = s.tobytes()
            first.append(xxhash.xxh64_intdigest(raw, seed=1))
            second.append(xxhash.xxh64_intdigest(raw, seed=2))
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(d, dtype=np.uint64).view(np.int64)) for d in (first, second)), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "signature"]
        )
    _hashes.clear()  # an idle worker holds little
    hand_back()


def _postings(batches, chunks: int, most: int):
    claim("near", _hashes.clear)
    width = len(_omissions(chunks, most))
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, PLACES)
        keys = signature_keys(signs, chunks, most).astype(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), width))], ["key", "id"])
    hand_back()


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(linked: np.ndarray, forest: Forest, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, col) of the boolean matrix that join what the forest has apart; it is read by whole rows."""
    out = []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        a = int(rows[i])
        for j in np.flatnonzero(linked[i]).tolist():
            b = int(cols[j])
            if a != b and forest.join(a, b):
                out.append((a, b))
    return out


def _cells(df: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks (bi <= bj) that its own block is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("other")
    cells = df.select("*", other)
    return cells.select(
        *df.columns, F.least("block", "other").cast("int").alias("bi"), F.greatest("block", "other").cast("int").alias("bj")
    )


def _near_by_signature(batches, percent: int, most: int):
    """Groups of (key, bi, bj), sorted: a spanning forest of the pairs under the distance."""
    claim("near-pairs")
    for table in whole_groups(batches, ["key", "bi", "bj"]):
        cols = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "bi", "bj", "block", "id", "n")}
        signs = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(-1, PLACES)
        starts = group_starts([cols["key"], cols["bi"], cols["bj"]])
        ends = np.append(starts[1:], len(cols["key"]))
        found_a, found_b = [], []
        two = starts[ends - starts == 2]
        if len(two):
            ok = (signs[two] != signs[two + 1]).sum(axis=1) <= most
            x, y = cols["n"][two], cols["n"][two + 1]
            ok &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            found_a.append(cols["id"][two[ok]])
            found_b.append(cols["id"][two[ok] + 1])
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            m = np.arange(s, e)
            rows = m[cols["block"][s:e] == cols["bi"][s]]
            others = m[cols["block"][s:e] == cols["bj"][s]]
            forest = Forest(e - s)
            for k in range(0, len(rows), 128):
                part = rows[k : k + 128]
                if len(part) * len(others) <= 4_096:
                    far = (signs[part][:, None] != signs[others][None]).sum(axis=2)
                else:
                    far = np.zeros((len(part), len(others)), dtype=np.uint8)
                    for p in range(PLACES):
                        far += signs[part, p][:, None] != signs[others, p][None, :]
                x, y = cols["n"][part][:, None], cols["n"][others][None, :]
                near = (far <= most) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                links = spanning(near, forest, part - s, others - s)
                if links:
                    at = np.array(links) + s
                    found_a.append(cols["id"][at[:, 0]])
                    found_b.append(cols["id"][at[:, 1]])
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])
    hand_back()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set on the left with every set on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    values = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i, x in enumerate(left):
        lo, hi = np.searchsorted(values, x, side="left"), np.searchsorted(values, x, side="right")
        n = hi - lo
        total = int(n.sum())
        if total:
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def _is_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * n >= percent * (len(x) + len(y) - n)


def _settled(batches, percent: int):
    """Rows (family, block, kind, id, shingles), sorted: a family's first member (kind 0) in each of its blocks, then the others. Each other one and whether it is linked with the first."""
    claim("near-pairs")
    first, first_id = None, None
    for batch in batches:
        family, ids, linked = [], [], []
        for f, kind, i, raw in zip(*(batch.column(c) for c in ("family", "kind", "id", "shingles")), strict=True):
            shingles = np.frombuffer(raw.as_py(), dtype=np.uint64)
            if not kind.as_py():
                first, first_id = shingles, i.as_py()
                continue
            family.append(first_id)
            ids.append(i.as_py())
            linked.append(_is_linked(first, shingles, percent))
        yield pa.RecordBatch.from_arrays([pa.array(family, pa.int64()), pa.array(ids, pa.int64()), pa.array(linked, pa.bool_())], ["family", "id", "linked"])
    hand_back()


def _confirmed(batches, percent: int):
    """Groups of (family, bi, bj), sorted: a spanning forest of the links between the rows of side 0 and those of side 1 by their full sets."""
    claim("near-pairs")
    for table in whole_groups(batches, ["family", "bi", "bj"]):
        cols = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("family", "bi", "bj", "side", "id")}
        raw = table["shingles"]
        starts = group_starts([cols["family"], cols["bi"], cols["bj"]])
        ends = np.append(starts[1:], len(cols["id"]))
        a, b = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            rows, others = np.flatnonzero(cols["side"][s:e] == 0), np.flatnonzero(cols["side"][s:e] == 1)
            if not len(rows) or not len(others):
                continue
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in raw.slice(s, e - s)]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            names, own = np.unique(cols["id"][s:e], return_inverse=True)  # a row may stand on both sides
            forest = Forest(e - s)
            for k in range(0, len(rows), 64):
                part = rows[k : k + 64]
                n = overlaps([sets[i] for i in part], [sets[i] for i in others]).astype(np.int64)
                linked = 100 * n >= percent * (size[part][:, None] + size[others][None, :] - n)
                for i, j in spanning(linked, forest, own[part], own[others]):
                    a.append(int(names[i]))
                    b.append(int(names[j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    hand_back()


def _sets(batches):
    claim("near", _hashes.clear)
    for batch in slices(batches):
        raw = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("family"), pa.array(raw, pa.binary())], ["id", "family", "shingles"])
    _hashes.clear()  # an idle worker holds little
    hand_back()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; sets whose similarity is at least percent are linked."""
    if not 50 <= percent <= 99:
        raise ValueError("the similarity must be between 50 and 99 percent")
    spark = docs.sparkSession
    chunks, most = distance_of(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = stored(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "near-sketch")
    # a class is a set; small sets (at 85 percent, of fewer than six shingles) only equal sets can match
    classes = stored(sketch.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "near-classes")
    open_classes = classes.where((F.col("n") * (100 - percent) >= percent) & F.col("id").isNotNull()).select("id", "n", "signature")
    postings = stored(open_classes.mapInArrow(partial(_postings, chunks=chunks, most=most), "key long, id long"), "near-postings")
    crowded = stored(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / KEY_BLOCK).cast("int")), "near-crowded")
    total = crowded.agg(F.sum("n")).first()[0] or 0
    # the rows of a key are spread over its blocks, so only the lookup of its block count meets a hot key
    members = spread_join(postings, crowded, ["key"], total).join(open_classes, "id")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    order = ["key", "bi", "bj"]
    cells = _cells(members, "blocks").select(*order, "block", "id", "n", "signature")
    pairs = cells.repartition(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(partial(_near_by_signature, percent=percent, most=most), "a long, b long")
    families = components(pairs, "near-family")
    discard(postings)
    discard(crowded)

    # the full sets of the families' members
    wanted = families.select("id", F.col("component").alias("family"))
    found = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("id", "family", "text")
    sets = stored(found.mapInArrow(_sets, "id long, family long, shingles binary"), "near-sets")
    blocks_of = lambda n, total: F.greatest(F.ceil(n / FAMILY_BLOCK), F.ceil(total / FAMILY_SHINGLES)).cast("int")
    width = F.octet_length("shingles") / 8
    size = sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(width).alias("total"))
    size = stored(size.select("family", "n", blocks_of(F.col("n"), F.col("total")).alias("blocks")), "near-sizes")
    total = size.agg(F.sum("n")).first()[0] or 0
    blocked = spread_join(sets, size, ["family"], total)  # a family's name is its first member's id
    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    order = ["family", "block"]
    shape = ["family", "block", "kind", "id", "shingles"]
    first = blocked.where("id = family").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "id", "shingles")
    rest = blocked.where("id <> family").select("family", own_block.alias("block"), F.lit(1).alias("kind"), "id", "shingles")
    dealt = first.unionByName(rest).select(*shape).repartition(partitions(spark), *order).sortWithinPartitions(*order, "kind")
    settled = stored(dealt.mapInArrow(partial(_settled, percent=percent), "family long, id long, linked boolean"), "near-settled")
    links = settled.where("linked").select(F.col("family").alias("a"), F.col("id").alias("b"))
    # members that are not settled, against all members of their family
    left = settled.where("not linked").select("id", F.lit(True).alias("open"))
    of_left = settled.where("not linked").groupBy("family").agg(F.count("*").alias("left"))
    wide = size.join(of_left, "family").where("n > 2").select("family", "n", F.ceil(F.col("left") * F.col("blocks") / F.col("n")).cast("int").alias("open_blocks"), "blocks")
    again = spread_join(sets, wide, ["family"], total).join(left, "id", "left")
    open_block = F.pmod(F.xxhash64("id", F.lit(5)), F.col("open_blocks")).cast("int")
    rows = again.where("open").select("family", open_block.alias("bi"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bj"), F.lit(0).alias("side"), "id", "shingles")
    others = again.select("family", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)).alias("bi"), own_block.alias("bj"), F.lit(1).alias("side"), "id", "shingles")
    order = ["family", "bi", "bj"]
    cells = rows.unionByName(others)
    more = cells.repartition(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(partial(_confirmed, percent=percent), "a long, b long")
    links = links.unionByName(more)
    linked = components(links, "near-copy")
    discard(sets)
    discard(size)
    discard(settled)

    of_class = classes.join(linked, "id", "left").select("d1", "d2", F.col("copies").alias("n"), F.coalesce("component", "id").alias("component_id"))
    joined = spread_join(sketch.select("doc_id", "n_shingles", "d1", "d2").where("n_shingles > 0"), of_class, ["d1", "d2"], sketch.count())
    empty = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", "d1", "d2", F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
