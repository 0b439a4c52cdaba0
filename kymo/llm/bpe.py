"""Byte-level BPE encoding and decoding by merge replay.

The words of a block of documents are laid out as one sequence of byte tokens. An inverted index
maps each mergeable token pair, by its rank, to the positions where it stands. Ranks are taken
in ascending order; each applies its merge at all of its positions and touches only the two
neighbours, whose new pairs enter the index. Every distinct word is replayed once per block and
remembered by the worker within a bound, so a block costs its new words and a lookup for the rest.

The outcome equals the usual rule, "merge the lowest rank, leftmost first, until none is left". The
one case in which a replay over all words could differ, a merge that creates a pair of a lower
rank than its own, is detected, and the word is encoded alone by a heap of (rank, position).

Defined cases: a null text is an empty text; an empty text has no tokens and decodes to nothing;
repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_right
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import claim, hand_back, slices

#: Words in each of the two generations that a worker remembers between blocks: when the younger is full, the older goes.
REMEMBERED = 260_000
#: Words whose merges are replayed together.
REPLAYED = 2_000
#: Longest word, in characters, that is remembered.
REMEMBERED_CHARS = 48
#: Characters of text, and words of one long text, that are handled at once.
BLOCK_CHARS, BLOCK_WORDS = 2_000_000, 200_000


class _PairRanks(dict):
    """(left << 20 | right) -> rank of the joined bytes or None, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes], wall: int):
        super().__init__()
        self.ranks, self.tokens, self.wall = ranks, tokens, wall

    def __missing__(self, key: int):
        left, right = key >> 20, key & 0xFFFFF
        found = None if left >= self.wall or right >= self.wall else self.ranks.get(self.tokens[left] + self.tokens[right])
        if len(self) > 3_000_000:
            self.clear()
        self[key] = found
        return found


class Codec:
    """The rank file's contents and the split pattern; encodes words and decodes ids."""

    def __init__(self, rank_lines: bytes, pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = _PairRanks(self.ranks, self.tokens, size)
        # \s of the pattern is the White_Space property, without the control separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        gc.disable()  # these lists of integers hold no cycles
        try:
            return self._replay(words)
        finally:
            gc.enable()

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        wall, pairs, single = len(self.tokens), self.pairs, self.single
        gone = wall + 1
        tokens, starts = [wall], []
        for word in words:
            starts.append(len(tokens))
            tokens.extend([single[b] for b in word])
            tokens.append(wall)
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        places: dict[int, list[int]] = {}
        for i in range(len(tokens) - 1):
            rank = pairs[tokens[i] << 20 | tokens[i + 1]]
            if rank is not None:
                places.setdefault(rank, []).append(i)
        order = list(places)
        heapify(order)
        odd: set[int] = set()
        while order:
            rank = heappop(order)
            at = places.pop(rank)
            if len(at) > 1:
                at.sort()
            for i in at:
                left = tokens[i]
                if left == gone:
                    continue
                j = after[i]
                if pairs[left << 20 | tokens[j]] != rank:
                    continue
                k, h = after[j], before[i]
                tokens[i], tokens[j] = rank, gone
                after[i], before[k] = k, i
                for p, key in ((h, tokens[h] << 20 | rank), (i, rank << 20 | tokens[k])):
                    made = pairs[key]
                    if made is not None:
                        if made < rank:
                            odd.add(bisect_right(starts, i) - 1)
                        if made in places:
                            places[made].append(p)
                        else:
                            places[made] = [p]
                            heappush(order, made)
        out = []
        for n, start in enumerate(starts):
            if n in odd:
                out.append(self.alone(words[n]))
                continue
            ids, i = [], start
            while tokens[i] != wall:
                ids.append(tokens[i])
                i = after[i]
            out.append(ids)
        return out

    def alone(self, word: bytes) -> list[int]:
        """One word by a heap of (rank, position): the lowest rank first, leftmost of equal ones."""
        tokens = [self.single[b] for b in word]
        n, gone, pairs = len(tokens), len(self.tokens) + 1, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs[tokens[i] << 20 | tokens[i + 1]]) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if tokens[i] == gone or j >= n or pairs[tokens[i] << 20 | tokens[j]] != rank:
                continue
            tokens[i], tokens[j], after[i] = rank, gone, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (made := pairs[rank << 20 | tokens[after[j]]]) is not None:
                    heappush(heap, (made, i))
            if before[i] >= 0 and (made := pairs[tokens[before[i]] << 20 | rank]) is not None:
                heappush(heap, (made, before[i]))
        return [t for t in tokens if t != gone]

    def _table(self, words: set[str]) -> dict[str, bytes]:
        """The packed ids of words, replayed or remembered."""
        young, old, table, raw = self.young, self.old, {}, []
        for word in words:
            packed = young.get(word)
            if packed is None:
                packed = old.get(word)
                if packed is None:
                    as_bytes = word.encode()
                    whole = self.ranks.get(as_bytes)
                    if whole is None:
                        raw.append((word, as_bytes))
                        continue
                    packed = whole.to_bytes(4, "little")
                young[word] = packed
            table[word] = packed
        for start in range(0, len(raw), REPLAYED):
            part = raw[start : start + REPLAYED]
            for (word, _), ids in zip(part, self.replay([x for _, x in part]), strict=True):
                packed = table[word] = np.array(ids, dtype="<u4").tobytes()
                if len(word) <= REMEMBERED_CHARS:
                    young[word] = packed
        if len(young) > self.remembered:
            self.young, self.old = {}, young
        return table

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as packed little-endian 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= BLOCK_CHARS):
                size += len(texts[end] or "")
                end += 1
            if size > BLOCK_CHARS:  # one long text
                found = (m.group() for m in self.pattern.finditer(texts[start]))
                packed = []
                while words := list(islice(found, BLOCK_WORDS)):
                    packed.append(self._block([words])[0])
                out.append(b"".join(packed))
            else:
                out += self._block([self.pattern.findall(t) if t else [] for t in texts[start:end]])
            start = end
        return out

    def _block(self, parts: list[list[str]]) -> list[bytes]:
        table = self._table(set().union(*parts))
        return [b"".join(map(table.__getitem__, words)) for words in parts]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec_of(rank_lines: bytes, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """A codec that lives as long as the worker process."""
    claim("bpe", _codecs.clear)
    key = (hashlib.sha256(rank_lines).hexdigest(), pattern, remembered)
    if key not in _codecs:
        _codecs[key] = Codec(rank_lines, pattern, remembered)
    return _codecs[key]


def _vocabulary(df: DataFrame, ranks_path: str):
    """The rank file, under a megabyte, read by the driver so that executors need no copy of it."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every text."""
    lines = _vocabulary(docs, ranks_path)

    def run(batches):
        codec = codec_of(lines.value, pattern)
        for batch in slices(batches):
            packed = codec.encode(batch.column(1).to_pylist())
            ids = pa.array([np.frombuffer(p, dtype="<i4") for p in packed], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data binary, the bytes of the ids; null ids are none."""
    lines = _vocabulary(encoded, ranks_path)

    def run(batches):
        codec = codec_of(lines.value, pattern)
        for batch in slices(batches):
            data = [codec.decode(np.asarray(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Encode, decode and digest in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle.

    remembered: words that a worker keeps in each generation, about 250 bytes a word; fewer take less memory and more time.
    """
    lines = _vocabulary(docs, ranks_path)

    def run(batches):
        codec = codec_of(lines.value, pattern, remembered)
        for batch in slices(batches):
            n, ids, decoded = [], [], []
            for packed in codec.encode(batch.column(1).to_pylist()):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            hand_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
