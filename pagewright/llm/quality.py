"""Quality classification from positive and unlabelled text by non-negative risk minimisation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table, written

#: At most so many trusted positives are fitted on, those with the smallest seeded hashes; the first guess is made
#: with so many unlabelled rows, while the passes that follow, the prior and the scale take all of them.
MAX_POSITIVE, FIRST_UNLABELLED, PASSES = 4_000, 6_000, 8
#: Bins of the margins of all unlabelled rows; their outermost bins hold what lies beyond.
BINS, REACH = 4_096, 32.0
THRESHOLD = 0.3

_MARK = re.compile(rb"[^\x20\x09-\x0D]+")
#: Classes of bytes: control, blank, line end, digit, lower, upper, ASCII marks in eight groups, beyond ASCII.
_CLASS = np.full(256, 15, dtype=np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c in " \t" else 2 if _c in "\n\r" else 3 if _c.isdigit() else 4 if _c.islower() else 5 if _c.isupper() else 0 if _i < 32 else 6 if _c in ".,;:" else 7 if _c in "!?" else 8 if _c in "'\"()" else 9 if _c in "-_/\\" else 10 if _c in "#*+=" else 11 if _c in "$%&@" else 12 if _c in "<>[]{}" else 13 if _c in "|~^`" else 14
N_FEATURES = 256 + 16 + 12


def features(text: str | None) -> np.ndarray:
    """Rates of pairs of byte classes, of classes, and of repetition in words and lines, over the whole text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        out[-1] = 1
        return out
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    pairs = np.bincount(kinds[:-1].astype(np.int32) * 16 + kinds[1:], minlength=256)
    out[:256] = np.sqrt(pairs / len(raw))
    out[256:272] = np.sqrt(np.bincount(kinds, minlength=16) / len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    counts, line_counts = Counter(words), Counter(lines)
    most = max(counts.values(), default=0)
    runs = sum(a == b for a, b in zip(words, words[1:]))
    shingles = len(set(zip(words, words[1:], words[2:])))
    tail = out[272:]
    tail[0] = len(counts) / n
    tail[1] = most / n
    tail[2] = runs / n
    tail[3] = shingles / max(1, len(words) - 2)
    tail[4] = np.log1p(n) / 10
    tail[5] = min(len(raw) / n, 40) / 10
    tail[6] = len(line_counts) / max(1, len(lines))
    tail[7] = sum(v for v in line_counts.values() if v > 1) / max(1, len(lines))
    tail[8] = np.log1p(n / max(1, len(lines))) / 5
    tail[9] = sum(len(x) <= 2 for x in words) / n
    tail[10] = sum(len(x) > 20 for x in words) / n
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float
    scale: float = 1.0

    def normed(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _net(self.layers, self.normed(x))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.margin(x))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def _net(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ w[0] + w[1], 0)
    return hidden, hidden @ w[2] + w[3]


def negative_loss(w: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The sum over rows of the sigmoid loss of calling them negative, and its gradient. Calling them positive costs 1 less that."""
    hidden, f = _net(w, x)
    s = _sigmoid(f)
    slope = s * (1 - s)
    back = np.outer(slope, w[2]) * (hidden > 0)
    return float(s.sum()), [x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum()]


def nn_risk(p: tuple[float, list[np.ndarray]], u: tuple[float, list[np.ndarray]], prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) and the gradient to follow.

    p and u are means of negative_loss over positives and unlabelled rows. Where the negative part falls below
    zero, its own gradient is followed the other way instead.
    """
    negative = u[0] - prior * p[0]
    if negative < 0:
        return prior * (1 - p[0]), [prior * gp - gu for gp, gu in zip(p[1], u[1])]
    return prior * (1 - p[0]) + negative, [gu - 2 * prior * gp for gp, gu in zip(p[1], u[1])]


class _Adam:
    def __init__(self, w: list[np.ndarray], rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for k, g in enumerate(grads):
            g = g + 1e-4 * self.w[k] if k == 0 else g
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] = self.w[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _mean(part: tuple[float, list[np.ndarray]], n: int) -> tuple[float, list[np.ndarray]]:
    return part[0] / n, [g / n for g in part[1]]


def first_guess(p: np.ndarray, u: np.ndarray, prior: float, seed: int = 5, hidden: int = 24, epochs: int = 60, rate: float = 2e-3, batch: int = 512) -> _Adam:
    """Minimises the non-negative risk over batches of normed rows; the optimiser's state, for passes that go on from there."""
    rng, d = np.random.default_rng(seed), p.shape[1]
    at = _Adam([rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(())], rate)
    for _ in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(max(1, len(u) // batch)):
            here = range(s * batch, (s + 1) * batch)
            xp, xu = p[np.take(pi, here, mode="wrap")], u[np.take(ui, here, mode="wrap")]
            at.step(nn_risk(_mean(negative_loss(at.w, xp), len(xp)), _mean(negative_loss(at.w, xu), len(xu)), prior)[1])
    return at


def prior_of(pos: np.ndarray, bins: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from the margins of positives and a histogram of those of unlabelled rows.

    Above any bar the unlabelled rows hold at least the prior's share of what positives hold; the least such ratio,
    with the width that chance allows for at each bar, is the estimate (the best bin).
    """
    at = np.sort(_bin(pos))
    bars = np.unique(at)
    above_p = 1 - np.searchsorted(at, bars) / len(at)
    above_u = (bins.sum() - np.concatenate([[0], np.cumsum(bins)])[bars]) / max(1, bins.sum())
    width = np.sqrt(np.log(40) / 2 / max(1, bins.sum())) + np.sqrt(np.log(40) / 2 / len(at))
    best = int(np.argmin((above_u + 1.01 * width) / above_p))
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def scale_of(pos: np.ndarray, bins: np.ndarray, prior: float) -> float:
    """The scale of margins that makes them log odds, from positives and unlabelled rows alone.

    It minimises the unbiased logistic risk mean_u(log(1 + exp(a * f))) - prior * a * mean_p(f), which is convex, a
    little ridged towards 1, by halving.
    """
    f = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    share, gain = bins / max(1, bins.sum()), prior * float(np.clip(pos, -REACH, REACH).mean())
    slope = lambda a: float((share * _sigmoid(a * f) * f).sum()) - gain + 1e-3 * (a - 1)
    low, high = 0.05, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if slope(mid) > 0 else (mid, high)
    return (low + high) / 2


def _bin(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + REACH) / (2 * REACH) * BINS).astype(np.int64), 0, BINS - 1)


def _summed(rows: DataFrame, part) -> np.ndarray:
    """The sum over all rows of what part makes of a block of feature vectors: an array of fixed length, for each partition and then in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                got = part(_matrix(b.column(0).slice(at, 4096)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    got = rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # a row for each place
    out = np.zeros(len(got))
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, N_FEATURES).astype(np.float64)


def vectors(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep, without the text) with vector, the features of each whole text as 16-bit floats."""
    own = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() != "vector"]
    plain = docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float16).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], names=[*b.schema.names[:-1], "vector"])

    made = plain.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in plain.dtypes[:-1]), "vector binary"]))
    return made.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "vector")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str | None = "text", label: str = "quality", seed: int = 5) -> Model | None:
    """A model from the rows of docs: those labelled 1 are trusted positives, those without a label are unlabelled.

    Rows labelled otherwise are not used. The first guess is made on MAX_POSITIVE positives and FIRST_UNLABELLED
    unlabelled rows, chosen by a seeded hash of the key. The means of all features, the class prior, the PASSES
    steps that follow (the last of the least risk counts) and the scale of the scores take every unlabelled row,
    in sums of fixed size for each partition. text is None where docs holds the vectors already.

    A key labelled more than once counts as positive if any of its labels is 1; null labels and keys are none.
    Without positives there is no model (None); an empty table has none. Where every row is labelled, all rows
    count as unlabelled too. Null and empty texts have the features of an empty text; repeated rows count each.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    rows = docs.select(F.col(key).alias("_key"), "vector") if text is None else vectors(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")))
    kind = F.when(F.col("_label").isNull(), 0).when(F.col("_label") > 0, 1).otherwise(-1)
    hashed = F.xxhash64(F.lit(seed), F.col("_key").cast("string"))
    rows = written(rows.join(known, "_key", "left").select(hashed.alias("h"), kind.alias("kind"), "vector"), "vectors")
    n = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not n.get(1):
        return None
    unlabelled = rows.where("kind = 0") if n.get(0) else rows
    n_u = n.get(0) or sum(n.values())

    def some(from_: DataFrame, n: int, most: int) -> np.ndarray:
        cut = int(-(2**63) + min(1.0, 2 * most / max(1, n)) * (2**64 - 1)) if n > 2 * most else 2**63 - 1
        return _matrix(pa.array([bytes(r["vector"]) for r in from_.where(F.col("h") <= F.lit(cut)).orderBy("h", "vector").limit(most).collect()], pa.binary()))

    pos, unl = some(rows.where("kind = 1"), n[1], MAX_POSITIVE), some(unlabelled, n_u, FIRST_UNLABELLED)
    every = unlabelled.select("vector")
    sums = _summed(every, lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])).reshape(2, -1) / n_u
    mean = (sums[0] + pos.mean(axis=0)) / 2
    spread = np.sqrt(np.maximum(0, (sums[1] + (pos * pos).mean(axis=0)) / 2 - mean**2)) + 1e-3
    model = Model(mean, spread, [], 0.5)
    p, u = model.normed(pos), model.normed(unl)

    def margins(w: list[np.ndarray]) -> np.ndarray:
        return _summed(every, lambda x: np.bincount(_bin(_net(w, np.clip((x - mean) / spread, -8, 8))[1]), minlength=BINS).astype(np.float64))

    half = max(1, len(p) // 2)
    apart = first_guess(p[:half], u, 0.5, seed, epochs=10).w
    model.prior = prior_of(_net(apart, p[half:] if len(p) > half else p)[1], margins(apart))
    at, best = first_guess(p, u, model.prior, seed), None
    for _ in range(PASSES):
        w = [x.copy() for x in at.w]

        def part(x: np.ndarray, w=w) -> np.ndarray:
            value, grads = negative_loss(w, np.clip((x - mean) / spread, -8, 8))
            return np.concatenate([[value], *(np.ravel(g) for g in grads)])

        total, grads, k = _summed(every, part) / n_u, [], 1
        for x in w:
            grads.append(total[k : k + x.size].reshape(x.shape))
            k += x.size
        risk, follow = nn_risk(_mean(negative_loss(w, p), len(p)), (float(total[0]), grads), model.prior)
        if best is None or risk <= best[0]:
            best = risk, w
        at.step(follow)
    model.layers = best[1]
    model.scale = scale_of(model.margin(pos), margins(best[1]), model.prior)
    return model


def score(docs: DataFrame, model: Model | None, text: str | None = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score, likelier 1 the higher, one row per input row; a column named score is replaced.

    Null and empty texts are scored by the features of an empty text; without a model every score is 0.5. Whole
    texts count, however long. Scores follow from the text alone, so repeated rows have equal ones. An empty table
    gives an empty result; other columns are kept whatever their names. text is None where docs holds the vectors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    plain = docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col("vector" if text is None else text).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                given = part.column(part.num_columns - 1)
                got = np.full(part.num_rows, 0.5)
                if m:
                    got = m.score(_matrix(given) if text is None else np.array([features(t).astype(np.float16) for t in given.to_pylist()], dtype=np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], names=[*part.schema.names[:-1], "score"])

    done = plain.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in plain.dtypes[:-1]), "score double"]))
    return done.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = written(vectors(table(spark, sf_dir, "documents").select("doc_id", "text")), "vectors")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(rows.where(~held), table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held), text=None)
    scored = score(rows, model, text=None, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
