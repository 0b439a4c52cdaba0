"""Line dedup over range-partitioned hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lowered. Keys of at least
min_chars code points found in at least min_docs documents lose all their lines but those of the
largest doc_id that holds them. (key hash, doc_id descending, position) is range-partitioned and
sorted, so the first document of a run of equal hashes is the one that keeps its lines and the rest
is streamed. As the range bounds use the whole triple, a very common line is spread over many
partitions; what a partition cannot decide alone, its first and its last run, it marks as open,
and a summary of two rows a partition settles those.

The result is one compressed bitmap for each document that loses lines, not text; bit i is
set if line i stays. apply() joins the bitmaps with the texts.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document, below
all others; rows that repeat a doc_id are one document, and each row's lines are judged; an
empty table gives no rows; other columns pass through apply() and never clash, as only the named
ones are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import claim, group_starts, partitions, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)

_MARKS = "open boolean, doc bigint, content bigint, pos int, h1 bigint, h2 bigint, docs array<bigint>"


def line_keys(line):
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _mark(min_docs: int):
    """Streams the sorted rows of one partition: rows to drop, open rows, and summaries (rows with docs)."""

    def batch_of(is_open, doc, content, pos, h1, h2, docs):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, is_open)), pa.array(doc), pa.array(content), pa.array(pos), pa.array(h1), pa.array(h2), pa.array(docs if docs is not None else [None] * n, pa.list_(pa.int64()))],
            ["open", "doc", "content", "pos", "h1", "h2", "docs"],
        )

    def run(batches):
        claim("lines")
        hash_now = None  # the run that goes on
        first_run, seen, waiting = True, [], []

        def summary():
            return batch_of(True, np.array([seen[0]]), np.zeros(1, np.int64), np.zeros(1, np.int32), np.array([hash_now[0]]), np.array([hash_now[1]]), [seen])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, pos, content = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc", "pos", "content"))
            starts = group_starts([h1, h2])
            ends = np.append(starts[1:], len(h1))
            # runs that lie inside the batch and are neither the partition's first nor a continued one
            step = np.ones(len(h1), dtype=np.int64)
            step[1:] = (doc[1:] != doc[:-1]).astype(np.int64)
            step[starts] = 0
            total = np.cumsum(step)
            rank = total - np.repeat(total[starts], ends - starts)  # documents of the run before this row's
            inner = np.zeros(len(h1), dtype=bool)
            head = 0 if hash_now is None or (h1[0], h2[0]) != hash_now else 1
            if hash_now is None:
                hash_now, first_run, seen = (int(h1[0]), int(h2[0])), True, []
                head = 1
            elif not head:
                if first_run:
                    yield summary()
                hash_now = None  # the earlier run ended with its batch; what waits had too few documents
                waiting = []
                first_run = False
            for s, e in [(int(starts[0]), int(ends[0]))] if head else []:
                yield from go_on(h1, h2, doc, pos, content, s, e, (state := {"first": first_run, "seen": seen, "waiting": waiting}))
                seen, waiting = state["seen"], state["waiting"]
            tail = len(starts) - 1
            if tail >= head:
                last_rank = rank[ends[head:tail] - 1] if tail > head else np.zeros(0, dtype=np.int64)
                for s, e in zip(starts[head:tail][last_rank + 1 >= min_docs], ends[head:tail][last_rank + 1 >= min_docs], strict=True):
                    inner[s:e] = True
                drop = inner & (rank >= 1)
                if head and tail >= head:  # the run that came in has ended
                    if first_run:
                        yield summary()
                    first_run, waiting = False, []
                if drop.any():
                    yield batch_of(False, doc[drop], content[drop], pos[drop], h1[drop], h2[drop], None)
                s, e = int(starts[tail]), int(ends[tail])
                hash_now, seen, waiting = (int(h1[s]), int(h2[s])), [], []
                yield from go_on(h1, h2, doc, pos, content, s, e, (state := {"first": False, "seen": seen, "waiting": waiting}))
                seen, waiting = state["seen"], state["waiting"]
        if hash_now is not None:
            for rows in waiting:
                yield batch_of(True, *rows, None)
            yield summary()

    def go_on(h1, h2, doc, pos, content, s, e, state):
        """Rows s to e of the run that may go on: of the first run all are open, else they wait for min_docs documents."""
        cut = slice(s, e)
        rows = (doc[cut], content[cut], pos[cut], h1[cut], h2[cut])
        seen, waiting = state["seen"], state["waiting"]
        top = seen[0] if seen else int(doc[s])
        if len(seen) < min_docs:
            for d in doc[cut][group_starts([doc[cut]])].tolist():
                if d not in seen and len(seen) < min_docs:
                    seen.append(d)
        if state["first"]:
            yield batch_of(True, *rows, None)
            return
        other = rows[0] != top
        rows = tuple(x[other] for x in rows)
        if len(seen) >= min_docs:
            for w in [*waiting, rows]:
                if len(w[0]):
                    yield batch_of(False, *w, None)
            state["waiting"] = []
        elif len(rows[0]):
            waiting.append(rows)

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Bitmaps (doc, content, n_lines, n_dropped, keep) of the documents that lose lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("content"), F.split(text, "\n", -1).alias("lines"))
    keyed = base.select("doc", "content", F.posexplode("lines").alias("pos", "line")).select("doc", "content", "pos", line_keys(F.col("line")).alias("key"))
    keyed = stored(keyed.where(F.char_length("key") >= min_chars).select("doc", "content", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("content"), F.col("pos")]
    marks = stored(keyed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_mark(min_docs), _MARKS), "line-marks")
    # two summaries a partition at most
    common = marks.where("docs is not null").groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs")).where(F.size("docs") >= min_docs).select("h1", "h2", F.array_max("docs").alias("top"))
    rows = marks.where("docs is null").select("open", "doc", "content", "pos", "h1", "h2")
    drops = rows.where("not open").unionByName(rows.where("open").join(F.broadcast(common), ["h1", "h2"]).where("doc <> top").select("open", "doc", "content", "pos", "h1", "h2"))
    return drops.groupBy("doc", "content").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).mapInArrow(_bitmaps, "doc bigint, content bigint, n_dropped long, keep binary")


def _bitmaps(batches):
    claim("lines")
    for batch in batches:
        keep = []
        for dropped in batch.column("dropped"):
            at = np.asarray(dropped.values)
            bits = np.ones((int(at[-1]) // 8 + 1) * 8, dtype=bool)  # whole bytes, so that padding keeps
            bits[at] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        n = pa.array([len(x) for x in batch.column("dropped")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("content"), n, pa.array(keep, pa.binary())], ["doc", "content", "n_dropped", "keep"])


def kept_lines(lines: list[str], keep: bytes | None) -> list[str]:
    """The lines whose bit is set; lines after the bitmap's end stay."""
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))
    dropped = {i for i in np.flatnonzero(bits == 0).tolist() if i < len(lines)}
    return [x for i, x in enumerate(lines) if i not in dropped]


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A struct column row with the columns of docs, and kept (n_lines, n_dropped, text): the bitmaps joined in and applied."""
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.withColumns({"doc": F.coalesce(F.col(f"row.{id_col}").cast("long"), F.lit(NO_ID)), "content": F.xxhash64(text)})
    joined = packed.join(bitmaps.select("doc", "content", "keep"), ["doc", "content"], "left")

    @F.arrow_udf("n_lines long, n_dropped long, text string")
    def applied(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        claim("lines")
        n_lines, dropped, kept = [], [], []
        for t, keep in zip(texts, keeps, strict=True):
            lines = t.as_py().split("\n")
            stay = kept_lines(lines, keep.as_py())
            n_lines.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "text"])

    return joined.select("row", applied(text, F.col("keep")).alias("kept"))
