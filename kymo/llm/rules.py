"""Quality rules as learned decision lists.

Each text is measured once (counts of words, symbols, repeated lines and words, letter cases). On a
bounded sample of labelled rows that the base rules let through, sequential covering learns an ordered list of rules: each grows a
conjunction of ratio thresholds by information gain on two thirds of the rows, is pruned on the
remaining third, and is accepted only if nearly all that it covers is labelled poor; the rows it covers
are set aside and the next rule grows on the rest. The list becomes one ordered Spark conditional
expression over the measured columns, which judges every row of the corpus.

Defined cases: a null text has no words; an empty text has one line without a word; labels
without a value are left out, and of several labels of one document the poorest counts; without
labels of both kinds the list is empty and nothing is rejected beyond the base rules; repeated rows
are judged each; columns of the input stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import claim

#: Labelled rows that the driver may hold for training, taken in the order of a hash of their id.
LABELLED_ROWS = 10_000
#: A document is rejected outright below so many words, or above so many percent of repeated words.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS, MARKS = b"#*$%&|<>", b"!?;:.,"
#: Longest conjunction, rules in the list, least share of poor rows among those a rule covers, least rows it covers.
MOST_CONDITIONS, MOST_RULES, LEAST_PRECISION, LEAST_COVER = 3, 12, 0.97, 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_top_word"]
#: Ratio features: counted column over counted column.
FEATURES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeat_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "line_length": ("n_words", "n_lines"),
    "top_word": ("n_top_word", "n_words"),
}
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BLANK = b" \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; words are runs of anything but ASCII white space."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    repeated = top = 0
    if n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        top = int(np.bincount(ids).max())
        if n > 3:
            pairs = ids[:-1] * len(number) + ids[1:]
            if len(number) > 1_500_000:  # three numbers no longer fit into 63 bits
                pairs = np.unique(pairs, return_inverse=True)[1]
                codes = pairs[:-1] * len(number) + ids[2:]
            else:
                codes = pairs[:-1] * len(number) + ids[2:]
            ordered = np.sort(codes)
            again = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(again):
                found = np.isin(codes, again)
                covered = np.zeros(n, dtype=bool)
                for k in range(3):
                    covered[k : n - 2 + k] |= found
                repeated = int(covered.sum())
    return n, len(text) - without(_BLANK), without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(_UPPER), without(_DIGITS), without(MARKS), top


def _measure_all(texts: pa.Array) -> pa.Array:
    claim("rules")
    rows = [measure(t.as_py()) for t in texts]
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS)).T
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], COUNTS)


def measured(text: Column | str) -> Column:
    """A struct of the COUNTS of each text."""
    return F.arrow_udf(_measure_all, ", ".join(f"{c} long" for c in COUNTS))(text)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def ratios(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Feature values of rows of COUNTS."""
    at = {c: counts[:, i].astype(np.float64) for i, c in enumerate(COUNTS)}
    return {f: at[a] / np.maximum(at[b], 1.0) for f, (a, b) in FEATURES.items()}


def _covers(rule: tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= (x[c.feature] > c.threshold) == c.above
    return out


def _best_condition(x: dict[str, np.ndarray], poor: np.ndarray, rows: np.ndarray, barred: set[tuple[str, bool]]) -> tuple[float, Condition] | None:
    """The condition of the most information gain on rows; of equal ones that in the widest gap between values. barred: features and directions left out."""
    p0, n0 = int(poor[rows].sum()), int((~poor[rows]).sum())
    if not p0 or not n0:
        return None
    base, best = math.log2(p0 / (p0 + n0)), None
    for feature, values in x.items():
        v = values[rows]
        order = np.argsort(v, kind="stable")
        v, y = v[order], poor[rows][order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        below_p, below_n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
        spread = max(float(v[-1] - v[0]), 1e-12)
        gap = (v[ends + 1] - v[ends]) / spread
        for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            if (feature, above) in barred:
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -np.inf)
            k = max(np.flatnonzero(gain >= gain.max() * (1 - 1e-9)), key=lambda i: gap[i]) if gain.max() > 0 else None
            if k is not None and (best is None or (float(gain[k]), float(gap[k])) > best[0]):
                best = (float(gain[k]), float(gap[k])), Condition(feature, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return (best[0][0], best[1]) if best else None


def learn(counts: np.ndarray, poor: np.ndarray) -> list[Rule]:
    """An ordered list of rules that cover poor rows. counts: rows of COUNTS; poor: booleans."""
    x, n = ratios(counts), len(poor)
    grow, prune = np.arange(n) % 3 != 2, np.arange(n) % 3 == 2
    left, rules = np.ones(n, dtype=bool), []
    barred: set[tuple[str, bool]] = set()  # first conditions that led to no rule on the rows that are left
    while len(rules) < MOST_RULES and (poor & left & grow).any():
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            found = _best_condition(x, poor, np.flatnonzero(left & grow & _covers(tuple(rule), x, n)), set() if rule else barred)
            if found is None:
                break
            rule.append(found[1])
        if not rule:
            break

        def worth(k: int, rule: list[Condition] = rule) -> tuple[float, int]:
            c = _covers(tuple(rule[:k]), x, n) & left & prune
            p, m = int((c & poor).sum()), int((c & ~poor).sum())
            return ((p - m) / (p + m) if p + m else -1.0), p

        k = max(range(1, len(rule) + 1), key=worth)
        covered = _covers(tuple(rule[:k]), x, n) & left
        p, m = int((covered & poor).sum()), int((covered & ~poor).sum())
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + m):
            barred.add((rule[0].feature, rule[0].above))
            continue
        barred.clear()
        rules.append(Rule(tuple(rule[:k])))
        left &= ~covered
    return rules


def as_column(rules: list[Rule], counts: Column | str = "counts") -> Column:
    """The number, from 1, of the first rule that rejects a row of COUNTS, else 0."""
    at = lambda c: F.col(f"{counts}.{c}").cast("double")
    ratio = lambda f: at(FEATURES[f][0]) / F.greatest(at(FEATURES[f][1]), F.lit(1.0))
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule.conditions:
            holds = holds & ((ratio(c.feature) > c.threshold) if c.above else (ratio(c.feature) <= c.threshold))
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def base_failed(counts: str) -> Column:
    """Whether a row of COUNTS has too few words, or too many repeated ones."""
    return (F.col(f"{counts}.n_words") < LEAST_WORDS) | (100 * F.col(f"{counts}.n_repeat_words") > MOST_REPEATED_PERCENT * F.col(f"{counts}.n_words"))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED_ROWS) -> list[Rule]:
    """Rules learned on at most bound labelled documents; those that the base rules reject anyway teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "label_id").select("label_id", "quality", measured("text").alias("counts"))  # bound rows at most
    rows = rows.groupBy("label_id").agg(F.min("quality").alias("quality"), F.min("counts").alias("counts")).where(~base_failed("counts")).orderBy("label_id").select("quality", "counts.*").collect()
    if not rows:
        return []
    table = np.array([list(r) for r in rows], dtype=np.int64)
    return learn(table[:, 1:], table[:, 0] == 0)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """A struct column row with the columns of docs, and counts, base_failed, rule and kept."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", measured(F.col(f"row.{text_col}").cast("string")).alias("counts"))
    return rows.select("row", "counts", base_failed("counts").alias("base_failed"), as_column(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
