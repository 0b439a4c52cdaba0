"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors form one class. The classes are dealt to overlapping cluster shards (each to its OVERLAP
nearest of the centres that spherical k-means finds on a bounded sample; shards that are still too large are dealt again to centres of their own). Each shard builds a graph: every vector's
nearest neighbours, pruned robustly so that edges point in different directions. The adjacency
lists that a vector has in its shards are united. Then every vector is searched for, from the medoids of its PROBES nearest shards, as a
guest in those that it was not built into, by a
greedy beam, and from what is found in range the search expands along in-range nodes until none is
new. Links found are computed in double precision, so none lies below the threshold. Shards that overlap or share guests join
links into components; as a component holds all links of its members, the members are
at last verified against each other in blocks of bounded size, which makes the counts exact within it.

The audit compares a bounded sample with all vectors, whatever their shards, and counts how many of its links lie inside a component. While that
share is below LEAST_RECALL and there are shards left, the search is repeated from twice as many.

Pairs are never written out: shards emit a forest, blocks and the audit emit counts. Shards and components larger than a
block are cut into pairs of blocks; nothing is capped or sampled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths never link; rows that repeat a
vec_id are one vector (of different ones the smallest); a null vec_id is a vector of its own that
links with nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import discard, group_starts, partitions, spread_join, stored, whole_groups
from kymo.llm.components import components

#: Cosine from which vectors are linked.
COSINE = 0.95
#: Vectors of the k-means sample, a shard's intended size, centres at most, shards that each vector joins.
SAMPLE, SHARD, MOST_CENTRES, OVERLAP = 8_192, 1_000, 2_048, 2
#: Vectors of a block; a cell holds two blocks at most.
BLOCK = 1_024
#: Nearest neighbours that pruning looks at, edges that it leaves, and its slack; width of the beam and its longest walk.
NEAREST, DEGREE, ALPHA, BEAM, STEPS = 64, 32, 1.3, 24, 64
#: Shards that a vector is searched for in at first.
PROBES = 6
#: A shard of more vectors is dealt again; vectors of its sample for each new centre, and new centres at most.
SPLIT, SAMPLED, MOST_SUB_CENTRES = 8_192, 16, 256
#: Vectors of the audit's sample, and the share of their links that components must hold.
AUDITED, LEAST_RECALL = 256, 0.995


def _units(batches):
    for batch in batches:
        ok, first, second, units, dims = [], [], [], [], []
        for x in batch.column("v"):
            v = np.array([np.nan if c is None else c for c in x.as_py()], dtype=np.float64) if x.is_valid else np.zeros(0)
            good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v))
            if good:
                v = v / np.abs(v).max()
                v = v / np.sqrt((v * v).sum())
            raw = v.tobytes() if good else None
            ok.append(good)
            dims.append(len(v) if good else 0)
            units.append(raw)
            first.append(xxhash.xxh64_intdigest(raw or b"", seed=1))
            second.append(xxhash.xxh64_intdigest(raw or b"", seed=2))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(ok), pa.array(dims, pa.int32()), *(pa.array(np.array(d, dtype=np.uint64).view(np.int64)) for d in (first, second)), pa.array(units, pa.binary())],
            ["vec_id", "ok", "dim", "d1", "d2", "unit"],
        )


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means."""
    if count >= len(sample):
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(8):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def pruned_graph(x: np.ndarray) -> np.ndarray:
    """DEGREE neighbours of each row, -1 where there are fewer: nearest first, each unless a kept one is much nearer to it."""
    n, k = len(x), min(NEAREST, len(x) - 1)
    out = np.full((n, DEGREE), -1, dtype=np.int32)
    if k < 1:
        return out
    for s in range(0, n, 256):
        rows = np.arange(s, min(n, s + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = np.einsum("nkd,njd->nkj", x[near], x[near])
        apart = np.sqrt(np.maximum(0, 2 - 2 * own))
        alive, count = np.ones((len(rows), k), dtype=bool), np.zeros(len(rows), dtype=int)
        for j in range(k):
            take = alive[:, j] & (count < DEGREE)
            at = np.flatnonzero(take)
            out[rows[at], count[at]] = near[at, j]
            count[at] += 1
            alive[at] &= ~(ALPHA * np.sqrt(np.maximum(0, 2 - 2 * between[at, j])) <= apart[at])
    return out


def in_range(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, cosine: float, members: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) rows of x whose cosine reaches the threshold, found by greedy search from the medoid of the first rows, the members, and expansion."""
    n = len(x)
    own = x[:members]
    medoid = int(np.argmax(own @ own.mean(axis=0)))
    found_q, found_v = [], []
    for s in range(0, len(queries), 256):
        q = queries[s : s + 256]
        m = len(q)
        xq = x[q]
        visited = np.zeros((m, n), dtype=bool)
        beam = np.full((m, BEAM), -1, dtype=np.int64)
        sims = np.full((m, BEAM), -np.inf)
        spent = np.zeros((m, BEAM), dtype=bool)
        beam[:, 0], sims[:, 0] = medoid, xq @ x[medoid]
        visited[:, medoid] = True
        hit_q, hit_v = [], []
        active = np.arange(m)
        for _ in range(STEPS):
            score = np.where(spent[active] | (beam[active] < 0), -np.inf, sims[active])
            best = np.argmax(score, axis=1)
            go = score[np.arange(len(active)), best] > -np.inf
            active, best = active[go], best[go]
            if not len(active):
                break
            spent[active, best] = True
            near = graph[beam[active, best]].astype(np.int64)
            new = (near >= 0) & ~visited[active[:, None], near]
            r, c = np.nonzero(new)
            visited[active[r], near[r, c]] = True
            value = np.full(near.shape, -np.inf)
            value[r, c] = np.einsum("pd,pd->p", x[near[r, c]], xq[active[r]])
            all_ids = np.concatenate([beam[active], np.where(new, near, -1)], axis=1)
            all_sims = np.concatenate([sims[active], value], axis=1)
            all_spent = np.concatenate([spent[active], np.zeros(near.shape, dtype=bool)], axis=1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            beam[active], sims[active], spent[active] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_spent))
            close = value >= cosine
            hr, hc = np.nonzero(close)
            hit_q.append(active[hr])
            hit_v.append(near[hr, hc])
        start = np.flatnonzero(xq @ x[medoid] >= cosine)
        hit_q.append(start)
        hit_v.append(np.full(len(start), medoid))
        # a query is a node itself: what the walk did not reach is reached from there
        own = np.flatnonzero(~visited[np.arange(m), q])
        visited[own, q[own]] = True
        hit_q.append(own)
        hit_v.append(q[own])
        fq, fv = np.concatenate(hit_q), np.concatenate(hit_v)
        while len(fq):
            found_q.append(q[fq])
            found_v.append(fv)
            near = graph[fv].astype(np.int64)
            pq, pv = np.repeat(fq, near.shape[1]), near.ravel()
            new = (pv >= 0) & ~visited[pq, pv]
            code = np.unique(pq[new] * n + pv[new])
            pq, pv = code // n, code % n
            visited[pq, pv] = True
            close = np.zeros(len(pq), dtype=bool)
            for k in range(0, len(pq), 65_536):
                close[k : k + 65_536] = np.einsum("pd,pd->p", x[pv[k : k + 65_536]], xq[pq[k : k + 65_536]]) >= cosine
            fq, fv = pq[close], pv[close]
    return np.concatenate(found_q), np.concatenate(found_v)


def _groups(batches, keys: list[str]):
    """(table, start, end) of each group of equal keys."""
    for table in whole_groups(batches, keys):
        starts = group_starts([table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            yield table, s, e


def _matrix(table: pa.Table, s: int, e: int) -> np.ndarray:
    raw = b"".join(table["unit"].slice(s, e - s).to_pylist())
    return np.frombuffer(raw, dtype=np.float64).reshape(e - s, -1)


_CELL = ["dim", "shard", "bi", "bj"]


def _build(batches):
    """Adjacency lists of each cell's graph."""
    for table, s, e in _groups(batches, _CELL):
        graph = pruned_graph(_matrix(table, s, e))
        ids = table["id"].slice(s, e - s).combine_chunks().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[g[g >= 0]] for g in graph], pa.list_(pa.int64()))], ["id", "near"])


def _search(cosine: float):
    def run(batches):
        """Each cell's forest of links."""
        for table, s, e in _groups(batches, _CELL):
            guest = table["guest"].slice(s, e - s).combine_chunks().to_numpy(zero_copy_only=False)
            rows = np.argsort(guest, kind="stable")  # members first
            members = int(len(rows) - guest.sum())
            if not members:
                continue
            x = _matrix(table, s, e)[rows]
            ids = table["id"].slice(s, e - s).combine_chunks().to_numpy(zero_copy_only=False)[rows]
            order = np.argsort(ids[:members], kind="stable")
            near = table["near"].slice(s, e - s).combine_chunks().take(pa.array(rows[:members]))
            lists = [np.asarray(v.values) for v in near]
            flat = np.concatenate(lists)
            at = np.minimum(np.searchsorted(ids[order], flat), members - 1)
            local = np.where(ids[order][at] == flat, order[at], -1)
            graph = np.full((len(ids), max([1, *map(len, lists)])), -1, dtype=np.int32)
            row = np.repeat(np.arange(members), [len(v) for v in lists])
            place = np.arange(len(flat)) - np.repeat(np.cumsum([0, *map(len, lists)])[:-1], [len(v) for v in lists])
            graph[row, place] = local
            q, v = in_range(x, graph, np.arange(len(ids)), cosine, members)
            label = np.arange(len(ids))
            while True:
                new = label.copy()
                np.minimum.at(new, q, label[v])
                np.minimum.at(new, v, label[q])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            linked = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked].astype(np.int64)), pa.array(ids[label[linked]].astype(np.int64))], ["a", "b"])

    return run


def _deal(batches, centres_at, probes: int):
    """Rows (dim, shard, id, guest, unit): each vector in the shards of its OVERLAP nearest centres, and as a guest in more. centres_at: the centres of each length that has several."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            units = [batch.column("unit")[i].as_py() for i in rows.tolist()]
            own = centres_at.get(int(d))
            k = 1 if own is None else min(max(probes, OVERLAP), len(own))
            near = np.zeros((len(rows), 1), dtype=np.int64)  # few vectors are one shard
            if own is not None:
                sims = np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(rows), -1) @ own.T
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(near.size, d, dtype=np.int32)), pa.array(near.ravel().astype(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False)[rows], k)), pa.array(np.tile(np.arange(k) >= OVERLAP, len(rows))), pa.array([u for u in units for _ in range(k)], pa.binary())],
                ["dim", "shard", "id", "guest", "unit"],
            )


def _sub_centres(key, table):
    """One row with the centres of a sample of a shard."""
    units = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
    wanted = int(table["wanted"][0].as_py())
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "centres": pa.array([centres_of(units, wanted).tobytes()], pa.binary())})


def _runs(batch, keys, held):
    """Pieces of a batch by shard, dealt to the centres that came first in the shard."""
    starts = group_starts([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        piece = batch.slice(s, e - s)
        if piece.column("kind")[0].as_py() == 0:
            d = piece.column("dim")[0].as_py()
            held["centres"] = np.frombuffer(piece.column("unit")[0].as_py(), dtype=np.float64).reshape(-1, d)
            piece = piece.slice(1)
        if not piece.num_rows:
            continue
        own = held["centres"]
        k = min(OVERLAP, len(own))
        x = np.frombuffer(b"".join(piece.column("unit").to_pylist()), dtype=np.float64).reshape(piece.num_rows, -1)
        near = np.argpartition(-(x @ own.T), k - 1, axis=1)[:, :k]
        shard = piece.column("shard").to_numpy(zero_copy_only=False)
        number = (shard[:, None] * (MOST_SUB_CENTRES + 1) + 1 + near).ravel()
        take = pa.array(np.repeat(np.arange(piece.num_rows), k))
        yield pa.RecordBatch.from_arrays([piece.column("dim").take(take), pa.array(number), *(piece.column(c).take(take) for c in ("id", "guest", "unit"))], ["dim", "shard", "id", "guest", "unit"])


def _dealt_again(dealt: DataFrame, n_parts: int) -> DataFrame:
    """dealt with its shards of more than SPLIT members dealt to centres of their own, until there is none that this makes smaller."""
    shape = "dim int, shard long, id long, guest boolean, unit binary"
    last = None
    while True:
        size = dealt.where("not guest").groupBy("dim", "shard").count().where(F.col("count") > SPLIT)
        size = stored(size.withColumn("wanted", F.least(F.lit(MOST_SUB_CENTRES), F.ceil(F.col("count") * OVERLAP / SHARD)).cast("long")), "vec-large")
        total = size.agg(F.count("*"), F.sum("count")).first()
        if not total[0] or (last is not None and total[1] >= 0.95 * last):  # vectors all alike; blocks take them
            return dealt
        last = total[1]
        large = F.broadcast(size)  # a row for each SPLIT vectors
        rows = dealt.join(large, ["dim", "shard"])
        rate = F.greatest(F.lit(1), F.floor(F.col("count") / (F.col("wanted") * SAMPLED))).cast("long")
        sample = rows.where(~F.col("guest") & (F.pmod(F.xxhash64("id", F.lit(7)), rate) == 0)).select("dim", "shard", "wanted", "unit")  # near wanted x SAMPLED of each
        centres = stored(sample.groupBy("dim", "shard").applyInArrow(_sub_centres, "dim int, shard long, centres binary"), "vec-centres")
        salts = F.ceil(F.col("count") / SPLIT).cast("int")
        ahead = centres.join(large, ["dim", "shard"]).select("dim", "shard", F.explode(F.sequence(F.lit(0), salts)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("guest"), F.col("centres").alias("unit"))
        moved = rows.select("dim", "shard", F.pmod(F.xxhash64("id"), salts + 1).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "guest", "unit").unionByName(ahead)
        order = ["dim", "shard", "salt"]
        moved = moved.repartition(n_parts, *order).sortWithinPartitions(*order, "kind")

        def again(batches):
            held = {}
            for batch in batches:
                yield from _runs(batch, ["dim", "shard", "salt"], held)

        rest = dealt.join(large.select("dim", "shard"), ["dim", "shard"], "left_anti")
        dealt = stored(rest.unionByName(moved.mapInArrow(again, shape).dropDuplicates(["dim", "shard", "id"])), "vec-dealt")


def _audit(sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float):
    def run(batches):
        """Links of the sample's vectors with the batch, and those inside a component."""
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            found = true = 0
            for d in np.unique(dims):
                if int(d) not in sample:
                    continue
                ids, components_, units = sample[int(d)]
                rows = pa.array(np.flatnonzero(dims == d))
                part = batch.take(rows)
                x = np.frombuffer(b"".join(part.column("unit").to_pylist()), dtype=np.float64).reshape(len(rows), -1)
                near = x @ units.T >= cosine
                near &= part.column("id").to_numpy(zero_copy_only=False)[:, None] != ids[None, :]
                true += int(near.sum())
                found += int((near & (part.column("component").to_numpy(zero_copy_only=False)[:, None] == components_[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64()), pa.array([true], pa.int64())], ["found", "true"])

    return run


def _counts(cosine: float):
    def run(batches):
        """Each cell's verified links: rows of block bi against block bj and back."""
        for table, s, e in _groups(batches, ["component", "bi", "bj"]):
            x = _matrix(table, s, e)
            cols = {c: table[c].slice(s, e - s).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "block", "bi", "bj", "weight")}
            links = np.zeros(len(x), dtype=np.int64)
            rows, others = np.flatnonzero(cols["block"] == cols["bi"][0]), np.flatnonzero(cols["block"] == cols["bj"][0])
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                near = x[part] @ x[others].T >= cosine
                near &= cols["id"][part][:, None] != cols["id"][others][None, :]
                links[part] += near @ cols["weight"][others]
                if cols["bi"][0] != cols["bj"][0]:
                    links[others] += cols["weight"][part] @ near
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"]), pa.array(links)], ["id", "links"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) of every vector, and the audit (found, true): links of a sample with all vectors, and those that components hold."""
    spark, n_parts = table.sparkSession, partitions(table.sparkSession)
    given = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    one = given.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).unionByName(given.where("vec_id is null").select("vec_id", F.lit(None).cast("array<double>").alias("v")))
    base = stored(one.mapInArrow(_units, "vec_id long, ok boolean, dim int, d1 long, d2 long, unit binary"), "vec-base")
    classes = stored(base.where("ok and vec_id is not null").groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit")), "vec-classes")
    centres = {}
    for r in classes.groupBy("dim").count().where(F.col("count") * OVERLAP > SHARD).collect():  # lengths of vectors that need more than one shard
        sample = classes.where(F.col("dim") == r["dim"]).orderBy("d1").select("unit").limit(SAMPLE).collect()
        points = np.array([np.frombuffer(x.unit, dtype=np.float64) for x in sample])
        centres[r["dim"]] = centres_of(points, min(MOST_CENTRES, -(-r["count"] * OVERLAP // SHARD)))
    given_centres = spark.sparkContext.broadcast(centres)  # MOST_CENTRES vectors for each length
    shape = "dim int, shard long, id long, guest boolean, unit binary"

    def dealt_to(probes: int) -> DataFrame:
        def deal(batches):
            return _deal(batches, given_centres.value, probes)

        return _dealt_again(stored(classes.select("dim", "id", "unit").mapInArrow(deal, shape), "vec-dealt"), n_parts)

    def cells_of(dealt: DataFrame) -> DataFrame:
        size = dealt.where("not guest").groupBy("dim", "shard").count().select("dim", "shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        placed = dealt.join(size, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        # every pair of different blocks is a cell; a shard of one block is one cell; guests meet every block once or twice
        last = F.col("blocks") - 1
        pairs = F.transform(F.array_remove(F.sequence(F.lit(0), last), F.col("block")), lambda o: F.struct(F.least("block", o).alias("bi"), F.greatest("block", o).alias("bj")))
        visits = F.transform(F.sequence(F.lit(0), last, F.lit(2)), lambda b: F.struct(F.least(b, last - 1).alias("bi"), (F.least(b, last - 1) + 1).alias("bj")))
        alone = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))
        cell = F.explode(F.when(last == 0, alone).when(F.col("guest"), visits).otherwise(pairs))
        return placed.select("dim", "shard", "id", "guest", "unit", cell.alias("cell")).select("dim", "shard", "cell.bi", "cell.bj", "id", "guest", "unit")

    probes, united = PROBES, None
    while True:
        dealt = dealt_to(probes)
        cells = cells_of(dealt)
        if united is None:
            graph = cells.where("not guest").repartition(n_parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_build, "id long, near array<long>")
            united = stored(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vec-graph")  # OVERLAP lists, or one for each block
        searched = cells.join(united, "id").repartition(n_parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_search(cosine), "a long, b long")
        found = components(searched, "vec")
        # the audit: a bounded sample against all vectors
        belongs = classes.join(found, "id", "left").select("dim", "id", "unit", F.coalesce("component", "id").alias("component"))
        drawn: dict[int, list] = {}
        for r in belongs.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(AUDITED).collect():
            drawn.setdefault(r.dim, []).append(r)
        sample = {d: (np.array([r.id for r in rows]), np.array([r.component for r in rows]), np.array([np.frombuffer(r.unit, dtype=np.float64) for r in rows])) for d, rows in drawn.items()}
        audit = stored(belongs.mapInArrow(_audit(sample, cosine), "found long, true long").agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("true"), F.lit(0)).alias("true")), "vec-audit")
        seen = audit.first()
        discard(dealt)
        if seen.found >= LEAST_RECALL * seen.true or probes >= max(map(len, centres.values()), default=0):
            break
        discard(found)
        probes *= 2
    discard(united)

    size = stored(found.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "vec-sizes")
    total = size.agg(F.sum("n")).first()[0] or 0
    members = spread_join(found.join(classes.select("id", "weight", "unit"), "id"), size, ["component"], total).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("component", F.least("block", "other").cast("int").alias("bi"), F.greatest("block", "other").cast("int").alias("bj"), "block", "id", "weight", "unit")
    order = ["component", "bi", "bj"]
    links = pairs.repartition(n_parts, *order).sortWithinPartitions(*order).mapInArrow(_counts(cosine), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(found, "id", "left").join(links, "id", "left").select("dim", "d1", "d2", F.col("weight").alias("n"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_class = stored(of_class, "vec-of-class")
    discard(size)
    linkable = base.where("ok and vec_id is not null")
    result = spread_join(linkable, of_class, ["dim", "d1", "d2"], linkable.count()).select("vec_id", "n_links", "component_id")
    alone = base.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = result.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return result, audit
