"""Soft-membership mixing of a corpus to target weights, with DataFrame operations only.

A classifier learned from the table of labels gives every document posteriors of the domains clean, poor and
toxic. Words, and the beginnings of longer words, are hashed into bins, and a document counts as the set of its
bins. Bins whose shares differ between domains far beyond chance have the logarithm of the ratio as their weight,
the rest share one weight for what is left of the domains' mass, so that a long document without evidence counts
as its ordinary bins do. That a document has none of the bins that speak for a domain is evidence of its own. A document's integer weights add up and the softmax is kept to 1/256. Non-negative rates
r minimise

    sum over domains of (sum of r n p - target)^2 / (sum of n p)

(n tokens, p posteriors), of all such rates those nearest to 1, by gradient steps from r = 1 with lazy projection: the steps
add up, and their sum is projected to non-negative rates before the next gradient is taken. A step is scaled by the
domains' Gram matrix over the documents whose rates are positive and shortened until it helps. A
document's rate depends on its posteriors alone: the steps run over the distinct posteriors (at most
33,153 cells), each an aggregate over the cells, and the fitted steps then give every document its rate.

A target is relative to the tokens of the clean domain, which keep their amount. A domain that has less than its target is
repeated, one that has none stays without. A fit that ends short of its targets or of the optimum warns.
Whole copies are drawn by a hash of the document. So that the drawn totals match the expected ones, a document's
fractional rate is drawn against a threshold common to its likeliest domain and size class, set from the classes' sums:
what a class of longer documents draws too much or too little, the next one makes up for.

Texts are scored once; the scores are stored with the columns that the caller keeps.

Defined cases: a null or empty text has no tokens and the prior posteriors; labels without values are
left out, and without labels every document is clean; repeated rows are judged alike; a null
doc_id is judged by its text; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import stored

DOMAINS = ("clean", "poor", "toxic")
#: Tokens of each domain in the mix, for each token of the clean one.
TARGETS = {"clean": 1.0, "poor": 0.02, "toxic": 0.01}
#: Labelled documents of the training sample, in the order of a hash of their id; bins of words.
LABELLED_ROWS, BINS = 10_000, 65_536
#: Characters of a longer word's beginning that is a bin of its own.
BEGINNING = 4
#: Deviations from chance, documents and log-ratio that a bin's weight needs; its largest value; units of a weight.
LEAST_DEVIATION, LEAST_DOCUMENTS, LEAST_RATIO, MOST_WEIGHT, UNIT = 7.5, 8, 0.5, 5.0, 10_000
#: Added to the weight of each bin that speaks for a domain, so that a sum of weights tells their number too.
SPEAKS = 2**40
#: Posteriors are multiples of 1 / LEVELS.
LEVELS = 256
#: Steps at most, and the residual, relative to a domain's tokens, that ends them; lengths that are tried for a step; how much a rate near 1 counts against the targets.
MOST_STEPS, TOLERANCE, LENGTHS, PULL = 60, 1e-6, (1.0, 0.5, 0.125, 0.02), 1e-7
#: Steps of a draw's threshold for each unit, and the highest threshold.
FINE, HIGHEST = 256, 4


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lowered."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "), " "), lambda w: w != "")


def bin_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BINS)).cast("int")


def bins_of(words: Column) -> Column:
    """The distinct bins of an array of words and of the beginnings of the longer ones."""
    long = F.filter(words, lambda w: F.char_length(w) > BEGINNING)
    begun = F.array_distinct(F.transform(long, lambda w: F.substring(w, 1, BEGINNING)))
    return F.array_distinct(F.concat(F.transform(words, bin_of), F.transform(begun, lambda w: F.pmod(F.xxhash64(w, F.lit(1)), F.lit(BINS)).cast("int"))))


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("poor")).when(quality == 1, F.lit("clean"))


def weights_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> dict[str, list[int]]:
    """Integer weights of the bins, of the prior, and of having no bin that speaks for the domain, for each domain but the first."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("label_id is not null and domain is not null")
    known = known.groupBy("label_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(known), "label_id").select("domain", bins_of(F.array_distinct(words_of(F.col("text")))).alias("bins")), "mix-sample")  # LABELLED_ROWS rows at most
    total = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    counts: dict[str, dict[int, int]] = {d: {} for d in DOMAINS}
    for r in sample.select("domain", F.explode("bins").alias("bin")).groupBy("domain", "bin").count().collect():  # domains x BINS rows at most
        counts[r["domain"]][r["bin"]] = r["count"]
    base, out = DOMAINS[0], {}
    mass = {d: sum(counts[d].values()) for d in DOMAINS}
    for domain in DOMAINS[1:]:
        if not mass[domain] or not mass[base]:
            out[domain] = [0] * BINS + [round(UNIT * (-20 if mass[base] or not mass[domain] else 20)), 0]
            continue
        ratios, rest, speak = {}, [mass[domain], mass[base]], set()
        for b in counts[domain].keys() | counts[base].keys():
            x, y = counts[domain].get(b, 0), counts[base].get(b, 0)
            part = mass[domain] / (mass[domain] + mass[base])
            deviation = abs(x - (x + y) * part) / math.sqrt((x + y) * part * (1 - part))
            ratio = math.log((x + 0.5) / mass[domain]) - math.log((y + 0.5) / mass[base])
            if x + y >= LEAST_DOCUMENTS and abs(ratio) >= LEAST_RATIO and deviation >= LEAST_DEVIATION:
                ratios[b] = max(-MOST_WEIGHT, min(MOST_WEIGHT, ratio))
                if ratio > 0:
                    speak.add(b)
                rest[0] -= x
                rest[1] -= y
        other = math.log(max(rest[0], 1) / mass[domain]) - math.log(max(rest[1], 1) / mass[base])
        prior = math.log((total[domain] + 0.5) / (total[base] + 0.5))
        out[domain] = [*(round(UNIT * ratios.get(b, other)) + SPEAKS * (b in speak) for b in range(BINS)), round(UNIT * prior), 0]
        silent = {r["domain"]: r["count"] for r in sample.where(_spoken(_total(out[domain])) == 0).groupBy("domain").count().collect()}
        shares = [(silent.get(d, 0) + 0.5) / (total[d] + 1) for d in (domain, base)]
        out[domain][-1] = round(UNIT * math.log(shares[0] / shares[1])) if speak else 0
    return out


def _total(weights: list[int]) -> Column:
    """The sum of the weights of a document's bins, and of the prior."""
    table = F.split(F.lit(",".join(map(str, weights[:BINS]))), ",").cast("array<long>")
    return F.aggregate("bins", F.lit(weights[BINS]).cast("long"), lambda a, b: a + F.get(table, b))


def _spoken(total: Column) -> Column:
    """How many of the bins in a sum of weights speak for the domain."""
    return F.shiftright(total + F.lit(SPEAKS // 2), SPEAKS.bit_length() - 1)


def posteriors(docs: DataFrame, weights: dict[str, list[int]], text_col: str, id_col: str, keep: list[str]) -> DataFrame:
    """A struct column row with the kept columns of docs, n_tokens, a draw in [0, 1), and the posteriors as whole numbers of LEVELS."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    text = F.col(f"`{text_col}`").cast("string")
    chance = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text)), F.lit(1_000_003)) / 1_000_003
    worded = docs.select(row.alias("row"), chance.alias("chance"), words_of(text).alias("words"))
    binned = worded.select("row", "chance", F.size("words").cast("long").alias("n_tokens"), bins_of(F.array_distinct("words")).alias("bins"))

    def score(domain: str) -> Column:
        spoken = _spoken(F.col(f"t_{domain}"))
        total = F.col(f"t_{domain}") - spoken * F.lit(SPEAKS) + F.when(spoken == 0, F.lit(weights[domain][-1])).otherwise(F.lit(0))
        return F.least(F.greatest(total, F.lit(-30 * UNIT)), F.lit(30 * UNIT)).alias(f"s_{domain}")

    summed = binned.select("row", "chance", "n_tokens", *[_total(weights[d]).alias(f"t_{d}") for d in DOMAINS[1:]])
    scored = summed.select("row", "chance", "n_tokens", *[score(d) for d in DOMAINS[1:]])
    odds = {d: F.exp(F.col(f"s_{d}") / UNIT) for d in DOMAINS[1:]}
    whole = sum(odds.values(), F.lit(1.0))
    level = [F.floor(LEVELS * odds[d] / whole).cast("int").alias(f"q_{d}") for d in DOMAINS[1:]]
    return scored.select("row", "chance", "n_tokens", *level).withColumn(f"q_{DOMAINS[0]}", LEVELS - sum((F.col(f"q_{d}") for d in DOMAINS[1:]), F.lit(0)))


def share(domain: str) -> Column:
    return F.col(f"q_{domain}") / F.lit(float(LEVELS))


def rate_after(steps: list[tuple[float, ...]]) -> Column:
    """A document's rate after the steps: from 1, their sum projected to non-negative rates."""
    moved = [sum(x) for x in zip(*steps, strict=True)] if steps else [0.0] * len(DOMAINS)
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((share(d) * F.lit(float(x)) for d, x in zip(DOMAINS, moved, strict=True)), F.lit(0.0)))


def _states(cells: DataFrame, moves: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each sum of steps the halved square of the rates, the expected tokens, and the Gram matrix of the cells with positive rates; one aggregate for all."""
    k = len(DOMAINS)
    rows = cells.select("tokens", *[share(d).alias(d) for d in DOMAINS], *[rate_after([tuple(m)]).alias(f"r{i}") for i, m in enumerate(moves)])
    found = []
    for i in range(len(moves)):
        r, t = F.col(f"r{i}"), F.col("tokens")
        found += [F.sum(t * r * r / 2), *[F.sum(t * r * F.col(d)) for d in DOMAINS], *[F.sum(t * (r > 0).cast("int") * F.col(a) * F.col(b)) for a in DOMAINS for b in DOMAINS]]
    row = np.array([x or 0.0 for x in rows.agg(*found).first()]).reshape(len(moves), -1)
    return [(float(x[0]), x[1 : k + 1], x[k + 1 :].reshape(k, k)) for x in row]


def fitted_steps(cells: DataFrame, targets: dict[str, float]) -> list[tuple[float, ...]]:
    """Gradient steps over cells (q_ columns, tokens) until the expected tokens match the targets, or come as near to them as non-negative rates can."""
    k = len(DOMAINS)
    at = np.zeros(k)
    square, now, gram = _states(cells, [at])[0]
    have = now
    some = have > 0
    scale = np.where(some, have, 1.0)
    aim = np.array([targets[d] / targets[DOMAINS[0]] * have[0] for d in DOMAINS])
    as_told = lambda x: dict(zip(DOMAINS, x.round().tolist(), strict=True))
    steps: list[tuple[float, ...]] = []
    while some.any():
        # the gradient of the multipliers' objective; the pull keeps them finite where no rates reach the targets
        slope = np.where(some, now - aim - PULL * scale * at, 0.0)
        if np.abs(slope / scale).max() <= TOLERANCE:
            if np.abs((now - aim) / scale)[some].max() > 100 * TOLERANCE:
                warnings.warn(f"non-negative rates reach {as_told(now)} tokens of {as_told(aim)}", stacklevel=2)
            break
        if len(steps) == MOST_STEPS:
            warnings.warn(f"the mix ends after {MOST_STEPS} steps at {as_told(now)} tokens of {as_told(aim)}", stacklevel=2)
            break
        step = np.zeros(k)
        step[some] = np.linalg.solve((gram + PULL * np.diag(scale))[np.ix_(some, some)], slope[some])
        value = lambda square, x: square + float(aim @ x) + PULL / 2 * float(scale @ (x * x))
        tried = [at + length * step for length in LENGTHS]
        states = _states(cells, tried)
        best = next((i for i, length in enumerate(LENGTHS) if value(states[i][0], tried[i]) <= value(square, at) - 1e-4 * length * float(slope @ step)), None)
        if best is None:
            best = min(range(len(LENGTHS)), key=lambda i: value(states[i][0], tried[i]))
        steps.append(tuple((tried[best] - at).tolist()))
        at, (square, now, gram) = tried[best], states[best]
    return steps


def thresholds(drawn: DataFrame) -> list[tuple[int, int, float]]:
    """(domain number, size class, threshold) under which the drawn tokens of every domain equal the expected ones.

    drawn: domain, size, n_tokens, q_ of each domain, rate, chance. The classes of the first domain, nearly all tokens, are
    drawn first; what they draw of the others' tokens counts there.
    """
    k, bins = len(DOMAINS), HIGHEST * FINE
    part = F.col("rate") - F.floor("rate")
    at = F.when(F.col("chance") < HIGHEST * part, F.floor(F.col("chance") / part * FINE)).otherwise(bins).cast("int")
    mass = [F.col("n_tokens") * F.col(f"q_{d}") for d in DOMAINS]
    # at most domains x 63 x (bins + 1) rows
    sums = drawn.groupBy("domain", "size", at.alias("at")).agg(*[F.sum(m).alias(f"m{i}") for i, m in enumerate(mass)], *[F.sum(m * part).alias(f"w{i}") for i, m in enumerate(mass)]).collect()
    masses: dict[tuple[int, int], np.ndarray] = {}
    owed = np.zeros(k)
    for r in sorted(sums, key=lambda r: (r.domain, r.size, r.at)):
        table = masses.setdefault((r.domain, r.size), np.zeros((bins + 1, k)))
        owed += r.w0, r.w1, r.w2
        if r.at < bins:
            table[r.at + 1] += r.m0, r.m1, r.m2
    # each class aims at what is owed to its domain less what the smaller classes are expected to bring
    expected = {key: np.zeros(k) for key in masses}
    for r in sums:
        expected[r.domain, r.size] += r.w0, r.w1, r.w2
    order = sorted(masses, key=lambda x: (x[0], -x[1]))
    later = np.sum([expected[key] for key in order], axis=0) if order else owed
    out = []
    for domain, size in order:
        later = later - expected[domain, size]
        aim = owed[domain] - later[domain]
        total = np.cumsum(masses[domain, size], axis=0)
        off = np.abs(total[:, domain] - aim)
        near = np.flatnonzero(off <= off.min() + 1e-9)
        best = int(near[np.argmin(np.abs(near - FINE))])  # of equally good ones that nearest to 1
        owed = owed - total[best]
        out.append((domain, size, best / FINE))
    return out


def rated(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, keep: list[str] | None = None) -> DataFrame:
    """A struct column row with the columns of docs, or those named in keep, n_tokens, p_ of each domain, rate, and copies."""
    scored = stored(posteriors(docs, weights_from(docs, labels, id_col, text_col), text_col, id_col, docs.columns if keep is None else keep), "mix-scored")
    keys = [f"q_{d}" for d in DOMAINS]
    cells = stored(scored.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    rates = stored(cells.select(*keys, rate_after(fitted_steps(cells, targets)).alias("rate")), "mix-rates")
    # at most (LEVELS + 1) (LEVELS + 2) / 2 cells
    done = scored.join(F.broadcast(rates.drop(keys[0])), keys[1:])
    most = F.greatest(*keys)
    domain = F.coalesce(*[F.when(F.col(x) == most, F.lit(i)) for i, x in enumerate(keys)])
    done = done.withColumn("domain", domain).withColumn("size", F.floor(F.log2(F.col("n_tokens") + 1)).cast("int"))
    found = thresholds(done.select("domain", "size", "n_tokens", *keys, "rate", "chance"))
    limits = docs.sparkSession.createDataFrame(found, "domain int, size int, threshold double")
    done = done.join(F.broadcast(limits), ["domain", "size"])  # a row for each domain and size class
    part = F.col("rate") - F.floor("rate")
    at = F.when(F.col("chance") < HIGHEST * part, F.floor(F.col("chance") / part * FINE))
    copies = F.floor("rate") + F.coalesce(at < F.col("threshold") * FINE, F.lit(False)).cast("int")
    return done.select("row", "n_tokens", *[share(d).alias(f"p_{d}") for d in DOMAINS], "rate", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    done = rated(docs, labels, id_col, text_col, targets).where("copies > 0")
    return done.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
