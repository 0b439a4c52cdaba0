"""Chat formatting: transcripts are parsed by a hidden Markov model before their turns are rendered.

A conversation is the sequence of its rows' lines. Each line has features: a speaker marker at its start
("User:", "### Assistant", "<|system|>"), its length, a question mark at its end, and on a row's first line the row's number of lines and length. The hidden states are the
roles. Emissions and two transition tables, one within a row and one from row to row, are estimated
on a bounded sample of rows that name their role; markers speak for their role by a fixed weight.
Viterbi recovers the most likely roles of a whole conversation: a row that names its role is observed, so only the others are
recovered, in the light of those around them. Runs of lines of one role are
rendered as canonical turns. A marker is cut off only where its line is given the role that it names, and never from a row with a named role; names that
ordinary lines begin with as well ("context:", "a:") are markers only in a row whose markers name two roles. Otherwise text stays as it is, white space included.

Rows are range-partitioned by conversation and turn, so a conversation of any length spreads over
partitions. A partition decodes the conversations that lie wholly inside it at once. Its first and last ones are
summarised by max-plus matrices, from
which the driver (two small matrices a partition) derives exact scores at every partition border; their rows
are then decoded as if the whole conversation were there. Only those are shuffled again.

Defined cases: a null or empty text is one empty line; a null conversation id is one conversation of its own,
a null turn comes first; equal turns are ordered by their text's hash; repeated rows are
repeated turns; a row of unknown role counts as one without; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import partitions, stored

ROLES = ("system", "user", "assistant")
# What transcripts call the speakers.
SPEAKERS = {
    "system": "system|sys|instruction|instructions|context",
    "user": "user|human|you|me|customer|student|q|question|prompt|client",
    "assistant": "assistant|ai|bot|chatbot|agent|model|a|answer|response|gpt|helper",
}
#: Those that ordinary lines begin with as well.
ORDINARY = frozenset("instruction instructions context you me customer student q question prompt client a agent model answer response helper".split())
_NAMES = "(?:" + "|".join(f"(?P<{r}>{names})" for r, names in SPEAKERS.items()) + ")"
#: "User:", "**Assistant 2:**", "[system]:"; "<|user|>", "<|im_start|>user", "<system>"; "### Assistant".
MARKERS = [
    re.compile(rf"^\s*(?:[#>*\-\[(]+\s*)?{_NAMES}\s*\d{{0,3}}\s*[\])*]*\s*[:：]\s*\**\s*", re.I),
    re.compile(rf"^\s*<\|?(?:im_start\|>)?\s*{_NAMES}\s*(?:\|?>|$)\s*", re.I),
    re.compile(rf"^\s*#{{1,6}}\s*{_NAMES}\s*$", re.I),
]
#: Rows of the training sample, conversations that it draws on, and rows of each at most; log-weight of a marker for its role; smoothing of the counts; bounds of line lengths.
SAMPLE_ROWS, SAMPLE_CONVERSATIONS, CONVERSATION_ROWS = 20_000, 4_000, 1_000
MARKER_WEIGHT, SMOOTHING, LENGTHS = 8.0, 0.5, (0, 20, 40, 60, 80, 120, 200, 300, 500, 700)
#: Bounds of a row's number of lines and of its length; log-weight against a role that a row does not name.
ROW_LINES, ROW_LENGTHS, IMPOSSIBLE = (1, 2, 3, 5, 8), (30, 60, 90, 120, 160, 200, 300, 500, 800, 1500), 1e6
NO_ID = -(2**63)


def marker_of(line: str) -> tuple[int, int]:
    """(role number or -1, characters of the marker)."""
    for pattern in MARKERS:
        m = pattern.match(line)
        if m:
            return next(k for k, r in enumerate(ROLES) if m.group(r)), m.end()
    return -1, 0


def _ordinary(marker: str) -> bool:
    return bool(ORDINARY & set(re.findall("[a-z]+", marker.lower())))


def features(line: str) -> tuple[int, int]:
    """(length class, question)."""
    return sum(len(line) > x for x in LENGTHS), int(line.rstrip().endswith(("?", "？")))


def row_class(lines: list[str]) -> int:
    """The class of a row by its number of lines and its length."""
    return sum(len(lines) > x for x in ROW_LINES) * (len(ROW_LENGTHS) + 1) + sum(sum(map(len, lines)) > x for x in ROW_LENGTHS)


class Model:
    """Log-probabilities of the start, of both transitions, and of the features."""

    def __init__(self, sample: list[tuple]):
        """sample: (conversation, turn, role, text), in order."""
        k = len(ROLES)
        start, across, within = (np.full(s, SMOOTHING) for s in ((k,), (k, k), (k, k)))
        length, question = np.full((k, len(LENGTHS) + 1), SMOOTHING), np.full((k, 2), SMOOTHING)
        row = np.full((k, (len(ROW_LINES) + 1) * (len(ROW_LENGTHS) + 1)), SMOOTHING)
        before = None
        for conversation, _, role, text in sample:
            if role not in ROLES:
                before = None
                continue
            r = ROLES.index(role)
            if before is None or before[0] != conversation:
                start[r] += 1
            else:
                across[before[1], r] += 1
            lines = (text or "").split("\n")
            within[r, r] += len(lines) - 1
            row[r, row_class(lines)] += 1
            for line in lines:
                a, b = features(line)
                length[r, a] += 1
                question[r, b] += 1
            before = conversation, r
        within += np.eye(k) * 50  # a row rarely changes its speaker without a marker
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.start, self.across, self.within, self.length, self.question, self.row = map(norm, (start, across, within, length, question, row))

    def emission(self, line: str, marker: int, known: int = -1, row: int = -1) -> np.ndarray:
        """Log-probabilities by role. known: the role that the row names; row: its class, on its first line."""
        a, b = features(line)
        out = self.length[:, a] + self.question[:, b]
        if row >= 0:  # the row's class stands for its lines' lengths as well
            out = self.row[:, row].copy()
        if marker >= 0:
            out[marker] += MARKER_WEIGHT
        if known >= 0:
            out -= IMPOSSIBLE
            out[known] += IMPOSSIBLE
        return out

    def transition(self, first_of_row: bool, marker: int) -> np.ndarray:
        """Within a row, a marker opens a turn as a new row does."""
        return self.across if first_of_row or marker >= 0 else self.within


class _Line:
    """raw is the whole line, text what follows its marker; known is the role that its row names; row_class is set on a row's first line."""

    __slots__ = ("row", "raw", "text", "marker", "first", "known", "row_class")

    def __init__(self, row, raw, size, marker, first, known, row_class):
        self.row, self.raw, self.text, self.marker, self.first, self.known, self.row_class = row, raw, raw[size:], marker, first, known, row_class

    def emission(self, model: Model) -> np.ndarray:
        return model.emission(self.text, self.marker, self.known, self.row_class)


def lines_of(texts: list[str | None], known: list[int] | None = None) -> list[_Line]:
    """The lines of rows; known: the number of the role that each names, or -1."""
    out = []
    for n, text in enumerate(texts):
        role = known[n] if known else -1
        lines = (text or "").split("\n")
        found = [(-1, 0)] * len(lines) if role >= 0 else [marker_of(line) for line in lines]
        if len({m for m, _ in found if m >= 0}) < 2:
            found = [(-1, 0) if m >= 0 and _ordinary(line[:size]) else (m, size) for line, (m, size) in zip(lines, found, strict=True)]
        marked = any(m >= 0 for m, _ in found)  # a row of several speakers is of no class
        for k, (line, (marker, size)) in enumerate(zip(lines, found, strict=True)):
            out.append(_Line(n, line, size, marker, k == 0, role, -1 if k or marked else row_class(lines)))
    return out


def summary(model: Model, lines: list[_Line]) -> np.ndarray:
    """Max-plus matrix: best score from the state before the lines to the state of the last one."""
    m = np.full((len(ROLES), len(ROLES)), -np.inf)
    np.fill_diagonal(m, 0.0)
    for x in lines:
        m = (m[:, :, None] + model.transition(x.first, x.marker)[None]).max(axis=1) + x.emission(model)[None]
    return m


def viterbi(model: Model, lines: list[_Line], before: np.ndarray | None = None, after: np.ndarray | None = None) -> list[int]:
    """The best states. before: scores of the states ahead of the lines; after: best scores of what follows, by last state."""
    score, back = None, []
    for x in lines:
        if score is None and before is None:
            score = model.start + x.emission(model)
            back.append(None)
            continue
        step = (before if score is None else score)[:, None] + model.transition(x.first, x.marker)
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + x.emission(model)
    state = int((score if after is None else score + after).argmax())
    out = [state]
    for b in reversed(back[1:]):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def _sections(batches):
    """(part, conversation, turns, texts, roles) of each conversation's rows in a part, in order."""
    key, held = None, ([], [], [])
    for batch in batches:
        for part, c, *row in zip(*(batch.column(k).to_pylist() for k in ("part", "conv", "turn", "text", "role")), strict=True):
            if (part, c) != key:
                if key is not None:
                    yield *key, *held
                key, held = (part, c), ([], [], [])
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if key is not None:
        yield *key, *held


#: Rows of the first pass: decoded turns (kind 0), rows of a part's first and last conversation (1), and their matrices (2).
_PASS = "kind int, part int, place long, conv long, turn long, piece int, role string, text string, rendered string, known int, matrix array<double>, opening array<double>"
_NAMES_OF_PASS = [x.split()[0] for x in _PASS.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "part": pa.int32(), "place": pa.int64(), "conv": pa.int64(), "turn": pa.int64(), "piece": pa.int32(), "known": pa.int32(), "matrix": pa.list_(pa.float64()), "opening": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds.get(c, pa.string())) for c in _NAMES_OF_PASS], _NAMES_OF_PASS)


def _first_pass(model: Model):
    def run(batches):
        """A part's rows, sorted: its inner conversations decoded, the first and the last as they are with their matrices."""
        part = TaskContext.get().partitionId()

        def numbered():
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32()))

        place = 0

        def edge(section):
            nonlocal place
            _, conversation, turns, texts, known = section
            n = len(turns)
            lines = lines_of(texts, known)
            head = model.start + lines[0].emission(model)
            opening = (head[:, None] + summary(model, lines[1:])).max(axis=0).tolist()
            yield _rows(1, kind=[2], part=[part], conv=[conversation], matrix=[summary(model, lines).ravel().tolist()], opening=[opening])
            yield _rows(n, kind=[1] * n, part=[part] * n, place=list(range(place, place + n)), conv=[conversation] * n, turn=turns, text=texts, known=known)
            place += n

        held, first = None, True
        for section in _sections(numbered()):
            if held is not None:
                if first:
                    yield from edge(held)
                else:
                    yield _decoded(model, held, None, None)
                first = False
            held = section
        if held is not None:
            yield from edge(held)

    return run


def _decoded(model: Model, section: tuple, before, after) -> pa.RecordBatch:
    """The turns of one conversation's rows."""
    _, conversation, turns, texts, known = section
    lines = lines_of(texts, known)
    states = viterbi(model, lines, before, after)
    out: list[list] = []  # row, place in the row, role, lines
    for x, state in zip(lines, states, strict=True):
        opens = x.marker >= 0 and x.marker == state
        body = x.text if opens else x.raw
        if out and out[-1][0] == x.row and out[-1][2] == state and not opens:
            out[-1][3].append(body)
        else:
            out.append([x.row, out[-1][1] + 1 if out and out[-1][0] == x.row else 0, state, [body]])
    bodies = ["\n".join(o[3]) for o in out]
    roles = [ROLES[o[2]] for o in out]
    n = len(out)
    return _rows(n, kind=[0] * n, conv=[conversation] * n, turn=[turns[o[0]] for o in out], piece=[o[1] for o in out], role=roles, text=bodies, rendered=list(map(render, roles, bodies)))


def _borders(edges: list) -> dict[tuple[int, int], tuple]:
    """(part, conversation) -> (scores before it or None, best scores after it or None), for conversations of several parts."""
    chains: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e["conv"], e["part"])):
        chains.setdefault(e["conv"], []).append(e)
    out = {}
    k = len(ROLES)
    for conversation, chain in chains.items():
        if len(chain) < 2:
            continue
        matrices = [np.array(e["matrix"]).reshape(k, k) for e in chain]
        forward = [np.array(chain[0]["opening"])]
        for m in matrices[1:]:
            forward.append((forward[-1][:, None] + m).max(axis=0))
        after = [np.zeros(k)]
        for m in reversed(matrices[1:]):
            after.append((m + after[-1][None, :]).max(axis=1))
        after.reverse()
        for n, e in enumerate(chain):
            out[e["part"], conversation] = (forward[n - 1] if n else None, after[n])
    return out


def _decode(model: Model, borders):
    def run(batches):
        renamed = (b.rename_columns(["part", "conv", "turn", "text", "role"]) for b in batches)
        for section in _sections(renamed):
            yield _decoded(model, section, *borders.value.get(section[:2], (None, None))).select(["conv", "turn", "piece", "role", "text", "rendered"])

    return run


def model_of(given: DataFrame) -> Model:
    """The model of a bounded sample of the rows (conv, turn, text, role) that name their role."""
    named = given.where(F.col("role").isin(*ROLES))
    drawn = named.groupBy("conv").count().where(F.col("count") <= CONVERSATION_ROWS).orderBy(F.xxhash64("conv"), "conv").limit(SAMPLE_CONVERSATIONS).select("conv")
    sample = named.join(F.broadcast(drawn), "conv").orderBy(F.xxhash64("conv"), "conv", "turn", F.xxhash64("text")).limit(SAMPLE_ROWS)  # SAMPLE_CONVERSATIONS ids
    return Model([(r.conv, r.turn, r.role, r.text) for r in sample.select("conv", "turn", "role", "text").collect()])


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """conv_id, turn, piece, role, text and rendered of every turn. role_col: named roles, which train the model and stay."""
    spark = rows.sparkSession
    role = F.lower(F.trim(F.col(role_col).cast("string"))) if role_col else F.lit(None).cast("string")
    given = rows.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"), role.alias("role"))
    model = model_of(given)
    known = F.coalesce(*[F.when(F.col("role") == r, F.lit(k)) for k, r in enumerate(ROLES)], F.lit(-1))
    order = [F.col("conv"), F.col("turn"), F.xxhash64("text"), F.col("role")]
    n = partitions(spark)
    ordered = given.select("conv", "turn", "text", known.alias("role")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    done = stored(ordered.mapInArrow(_first_pass(model), _PASS), "chat-pass")
    borders = spark.sparkContext.broadcast(_borders(done.where("kind = 2").select("part", "conv", "matrix", "opening").collect()))  # two rows a part
    edges = done.where("kind = 1").select("part", "conv", "turn", "text", "known", "place")
    edges = edges.repartition(4 * n, "part", "conv").sortWithinPartitions("part", "conv", "place").drop("place")
    turns = done.where("kind = 0").select("conv", "turn", "piece", "role", "text", "rendered")
    late = edges.mapInArrow(_decode(model, borders), "conv long, turn long, piece int, role string, text string, rendered string")
    return turns.unionByName(late).select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "turn", "piece", "role", "text", "rendered")
