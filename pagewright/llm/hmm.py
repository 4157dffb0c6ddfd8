"""A hidden Markov language model: Baum-Welch counts added up over partitions, likelihoods by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, fold, most_frequent, table, written

#: Latent states; words with an emission of their own; classes, by their last bytes, of all other words; words
#: whose counts are broadcast (the rest are joined); documents that the first guess is made from; full passes.
STATES, OWN, CLASSES, HEAD, FIRST_DOCS, FIRST_ROUNDS, PASSES = 8, 24_000, 2_048, 200_000, 1_200, 12, 2
SYMBOLS = 1 + OWN + CLASSES
END = b" "  # no word is a blank
FLUSH, CELLS, SLICE = 400_000, 262_144, 4_096
#: Tokens of a text that the first guess takes whole texts up to; steps of a long text whose states are held at once.
FIRST_LENGTH, PIECE = 8_192, 65_536


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(words_of(text))
        counts[END] += b.num_rows
        if len(counts) > FLUSH:
            yield rows()
            counts = Counter()
    yield rows()


class _Head(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Counts of the most frequent words, totals of all, and for each class what its words without own symbols add up to."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_log: np.ndarray  # log10(count + distinct + 1) of each class
    end: int
    at: dict = field(default_factory=dict, repr=False)

    def prepared(self) -> Vocabulary:
        if not self.at:
            self.at = _Head({w: i for i, w in enumerate(self.words)})
            own = np.arange(len(self.words)) < OWN
            self.symbol = np.where(own, 1 + np.arange(len(self.words)), [1 + OWN + class_of(w) for w in self.words] if self.words else 0).astype(np.int64)
            self.log = np.log10(self.counts + 1.0)
            self.within = np.where(own, 0.0, self.log - self.class_log[np.maximum(self.symbol - 1 - OWN, 0)])
        return self

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("words", "counts", "total", "distinct", "class_log", "end")} | {"at": {}}


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of all rows of a text column, and all counts as a table (word, n)."""
    counts = written(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    plain = counts.where(F.col("word") != F.lit(END))
    head = sorted(most_frequent(plain, HEAD).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    end = counts.where(F.col("word") == F.lit(END)).first()
    by_class = np.zeros((CLASSES, 2))
    for r in plain.groupBy(F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(CLASSES)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        by_class[r["c"]] = r["n"], r["v"]
    words, n = [bytes(r["word"]) for r in head], np.array([r["n"] for r in head], dtype=np.float64)
    for w, c in zip(words[:OWN], n):
        by_class[class_of(w)] -= c, 1
    return Vocabulary(words, n, int(total[0] or 0), int(total[1]), np.log10(by_class.sum(axis=1) + 1), int(end["n"]) if end else 0), counts


def _encode(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary.value.prepared()
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            part = b.slice(start, 1024)
            symbols, n, known, base, model, rest = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                at = np.array(list(map(v.at.__getitem__, words)), dtype=np.int64)
                out = np.zeros(len(words) + 1, dtype="<u2")  # the last is the end
                hit = at >= 0
                out[:-1][hit] = v.symbol[at[hit]]
                miss, inside, tail = np.flatnonzero(~hit), float(v.within[at[hit]].sum()), {}
                for i in miss:
                    c = class_of(words[i])
                    out[i] = 1 + OWN + c
                    inside -= v.class_log[c]
                if len(miss):
                    tail = Counter(words[i] for i in miss)
                symbols.append(out.tobytes())
                n.append(len(words) + 1)
                known.append(int(hit.sum()) + (v.end > 0))
                base.append(float(v.log[at[hit]].sum() + np.log10(v.end + 1.0)))
                model.append(inside)
                rest.append([{"word": w, "tf": k} for w, k in tail.items()])
            own = [i for i, c in enumerate(part.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in own), pa.array(symbols, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()),
                 pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))],
                names=[*(part.schema.names[i] for i in own), "symbols", "n", "known", "base", "inside", "rest"],
            )


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def _bundles(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Sequences of about the same length together, so that few cells stay empty."""
    order, now = sorted(range(len(seqs)), key=lambda i: len(seqs[i])), []
    for i in order:
        if now and (len(now) + 1) * len(seqs[i]) > CELLS:
            yield now
            now = []
        now.append(i)
    if now:
        yield now


def _steps(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, sequence) of symbols, right-aligned: every sequence ends in the last row, and those that run at t come last."""
    longest = len(seqs[-1])
    out = np.zeros((longest, len(seqs)), dtype=np.int64)
    for j, s in enumerate(seqs):
        out[longest - len(s) :, j] = s
    first = np.searchsorted(np.array([longest - len(s) for s in seqs][::-1]), np.arange(longest), side="right")
    return out, len(seqs) - first  # at t, the columns from there on run


def forward(seqs: list[np.ndarray], m: Model, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Natural log likelihoods of sequences in ascending length; with keep also the scaled forward variables."""
    sym, lo = _steps(seqs)
    t_max, n = sym.shape
    scale_log, a = np.zeros(n), np.tile(m.start, (n, 1))
    kept = np.zeros((t_max, n, len(m.start))) if keep else None
    scales = np.ones((t_max, n)) if keep else None
    began = n
    for t in range(t_max):
        c = lo[t]
        x = a[c:] @ m.move
        if c < began:
            x[: began - c] = m.start
            began = c
        x *= m.emit[sym[t, c:]]
        s = x.sum(axis=1)
        x /= s[:, None]
        a[c:] = x
        scale_log[c:] += np.log(s)
        if keep:
            kept[t, c:], scales[t, c:] = x, s
    return scale_log, (sym, lo, kept, scales) if keep else None


def expected(seqs: list[np.ndarray], m: Model, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> float:
    """Adds the expected counts of sequences in ascending length; returns their log likelihood."""
    logs, (sym, lo, a, s) = forward(seqs, m, keep=True)
    t_max, n, k = a.shape
    b = np.ones((n, k))
    gamma = np.empty_like(a)
    acc = np.zeros((k, k))
    for t in range(t_max - 1, -1, -1):
        c = lo[t]
        gamma[t, :c], gamma[t, c:] = 0, a[t, c:] * b[c:]
        if t:
            d = lo[t - 1]  # those that ran before
            w = m.emit[sym[t, d:]] * b[d:] / s[t, d:, None]
            acc += a[t - 1, d:].T @ w
            b[d:] = w @ m.move.T
            starts += gamma[t, c:d].sum(axis=0)
        else:
            starts += gamma[t, c:].sum(axis=0)
    moves += acc * m.move
    flat, g = sym.ravel(), gamma.reshape(-1, k)
    for i in range(k):
        counts[:, i] += np.bincount(flat, weights=g[:, i], minlength=len(counts))
    return float(logs.sum())


def expected_long(seq: np.ndarray, m: Model, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, piece: int = PIECE) -> float:
    """The same for one long sequence: only the states at the ends of pieces are kept, and each piece is run through again on the way back."""

    def onward(part: np.ndarray, a: np.ndarray | None, keep: bool) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        rows, scales, log = np.empty((len(part) if keep else 1, len(m.start))), np.ones(len(part) if keep else 1), 0.0
        for t, s in enumerate(part):
            x = (m.start if a is None else a @ m.move) * m.emit[s]
            c = x.sum()
            a, log = x / c, log + np.log(c)
            if keep:
                rows[t], scales[t] = a, c
        return a, log, rows, scales

    parts, entry, total = [seq[x : x + piece] for x in range(0, len(seq), piece)], [None], 0.0
    for part in parts:
        a, log, *_ = onward(part, entry[-1], False)
        entry.append(a)
        total += log
    b, acc = np.ones(len(m.start)), np.zeros_like(m.move)
    for part, before in zip(parts[::-1], entry[-2::-1]):
        _, _, rows, scales = onward(part, before, True)
        gamma = np.empty_like(rows)
        for t in range(len(part) - 1, -1, -1):
            gamma[t] = rows[t] * b
            last = rows[t - 1] if t else before
            if last is None:
                starts += gamma[t]
                continue
            w = m.emit[part[t]] * b / scales[t]
            acc += np.outer(last, w)
            b = m.move @ w
        for i in range(len(b)):
            counts[:, i] += np.bincount(part, weights=gamma[:, i], minlength=len(counts))
    moves += acc * m.move
    return total


def _add_expected(seqs: list[np.ndarray], m: Model, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
    for part in _bundles(seqs):
        if len(part) == 1 and len(seqs[part[0]]) > PIECE:
            expected_long(seqs[part[0]], m, counts, moves, starts)
        else:
            expected([seqs[i] for i in part], m, counts, moves, starts)


def maximise(counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, prior: float = 1.0) -> Model:
    """The model of expected counts; every state also gets a little of what all states emit, of every symbol at least something."""
    whole = counts.sum(axis=1) + 0.5
    whole /= whole.sum()
    mass = prior * 200
    emit = (counts + mass * whole[:, None]) / (counts.sum(axis=0) + mass)
    k = len(starts)
    return Model((starts + 1) / (starts.sum() + k), (moves + 0.5) / (moves.sum(axis=1, keepdims=True) + 0.5 * k), emit)


def first_guess(seqs: list[np.ndarray], states: int = STATES, rounds: int = FIRST_ROUNDS, seed: int = 3) -> Model:
    """Baum-Welch on a few documents: each starts in a state of its own, found by splitting the documents by what they share."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((SYMBOLS, states))
    if seqs:
        total = np.bincount(np.concatenate(seqs), minlength=SYMBOLS)
        common = np.argsort(-total, kind="stable")[:2000]
        place = np.full(SYMBOLS, -1)
        place[common] = np.arange(len(common))
        x = np.zeros((len(seqs), len(common)), dtype=np.float32)
        for i, s in enumerate(seqs):
            at = place[s]
            x[i] = np.sqrt(np.bincount(at[at >= 0], minlength=len(common)) / max(1, len(s)))
        centre = [x[int(rng.integers(len(x)))]]
        for _ in range(states - 1):  # each next centre far from those before
            far = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
            centre.append(x[int(rng.choice(len(x), p=far / far.sum()))] if far.sum() > 0 else x[0])
        c = np.array(centre)
        for _ in range(10):
            near = np.argmin((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(states)])
        for i, s in enumerate(seqs):
            counts[:, near[i]] += np.bincount(s, minlength=SYMBOLS)
    counts += 0.05 * counts.sum(axis=1, keepdims=True) * rng.uniform(0.5, 1.5, counts.shape) / states
    model = maximise(counts, np.eye(states) * 50 + 1, np.ones(states))
    for _ in range(rounds if seqs else 0):
        model = _em(seqs, model)
    return model


def _em(seqs: list[np.ndarray], model: Model) -> Model:
    k = len(model.start)
    counts, moves, starts = np.zeros((SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)
    _add_expected(seqs, model, counts, moves, starts)
    return maximise(counts, moves, starts)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in column.to_pylist()]


def baum_welch(encoded: DataFrame, model: Model) -> Model:
    """One full pass: every partition adds up its expected counts, and their sums by symbol make the next model."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts, moves, starts = np.zeros((SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                _add_expected(_sequences(b.column(0).slice(at, SLICE)), m, counts, moves, starts)
        used = np.flatnonzero(counts.sum(axis=1) > 0)
        key = np.concatenate([used, -1 - np.arange(k + 1)])  # after the symbols the moves from each state, then the starts
        value = np.concatenate([counts[used], moves, starts[None]])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(value[:, i]) for i in range(k))], names=["key", *(f"c{i}" for i in range(k))])

    parts = encoded.where("learned").select("symbols").mapInArrow(run, "key long, " + ", ".join(f"c{i} double" for i in range(k)))
    summed = parts.groupBy("key").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).collect()  # a row for each symbol at most
    counts, moves, starts = np.zeros((SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)
    for r in summed:
        value = np.array(r[1:])
        if r[0] >= 0:
            counts[r[0]] = value
        elif r[0] >= -k:
            moves[-1 - r[0]] = value
        else:
            starts[:] = value
    return maximise(counts, moves, starts)


def score(docs: DataFrame, learned: Column, text: str = "text", seed: int = 3) -> DataFrame:
    """docs, without its text, with n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    The model learns from the rows where `learned` holds. score is the log10 probability of the text and its end:
    the exact likelihood of its symbols, times the add-one share of each word within its class where it has no
    symbol of its own, so all texts' probabilities add up to at most 1. Null and empty texts are an end alone;
    whole texts count, however long; repeated rows count and are scored each; without rows to learn from, states
    emit every symbol alike. An empty table gives an empty result. Counts of all words are exact: the most frequent
    are broadcast, all others joined by word. The first guess is made on FIRST_DOCS texts of FIRST_LENGTH tokens at
    most, chosen by the seeded hashes of their symbols. Columns of docs with the names above, in any case, are
    replaced, others kept whatever their names.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = [c for c in docs.columns if c != text and c.lower() not in new]
    flat = docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"), F.monotonically_increasing_id().alias("row"))
    vocab, counts = vocabulary(flat.where("learned").select("text"))
    shared = spark.sparkContext.broadcast(vocab)
    carried = ", ".join(f"{c} {t}" for c, t in flat.dtypes if c not in ("text", "learned"))
    shape = f"{carried}, learned boolean, symbols binary, n long, known long, base double, inside double, rest array<struct<word: binary, tf: long>>"
    plain = flat.select(*(c for c in flat.columns if c not in ("text", "learned")), "learned", "text")
    encoded = written(plain.mapInArrow(lambda x: _encode(shared, x), shape), "encoded")
    model = first_guess(_first(encoded, seed))
    for _ in range(PASSES):
        model = baum_welch(encoded, model)
    told = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                seqs, out = _sequences(part.column("symbols")), np.zeros(part.num_rows)
                for own_rows in _bundles(seqs):
                    out[own_rows] = forward([seqs[i] for i in own_rows], m)[0] / np.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out)], names=[*part.schema.names[1:], "likelihood"])

    kept = [c for c in encoded.columns if c not in ("learned", "symbols", "rest")]
    scored = encoded.select("symbols", *kept).mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in encoded.select(*kept).dtypes), "likelihood double"]))
    rare = encoded.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.tf")
    sums = (
        rare.join(counts, "word").groupBy("row")
        .agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"))
    )
    whole = F.lit(float(np.log10(vocab.total + vocab.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return (
        scored.join(sums, "row", "left")
        .select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
                (F.col("base") + more - F.col("n") * whole).alias("base_score"), (F.col("likelihood") + F.col("inside") + more).alias("score"))
    )


def _first(encoded: DataFrame, seed: int) -> list[np.ndarray]:
    """Symbols of the documents to learn from that have the smallest seeded hashes, for the first guess alone."""
    h = F.xxhash64(F.lit(seed), "symbols")
    of = encoded.where("learned").where(F.col("n") <= FIRST_LENGTH).select("row", "symbols", h.alias("h"))
    n = of.count()
    near = of.where(F.col("h") <= F.lit(int(-(2**63) + min(1.0, 2 * FIRST_DOCS / max(1, n)) * (2**64 - 1)))) if n > 2 * FIRST_DOCS else of
    rows = near.orderBy("h", "symbols").limit(FIRST_DOCS).select("symbols").collect()
    return [np.frombuffer(bytes(r[0]), dtype="<u2").astype(np.int64) for r in rows]


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 7) == 2
    return score(docs.select("doc_id", held.alias("held_out"), "text"), ~held)
