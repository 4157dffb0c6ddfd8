"""BPE encoding and decoding with a lexicon of frequent words and exact merging of all others."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, table, written
from .lexicon import Lexicon, compile_lexicon

#: Words in the lexicon, pieces and words whose ids a worker keeps at hand, pieces that it counts at once.
MAX_LEXICON, MAX_KEPT, FLUSH = 65_536, 200_000, 400_000
#: Texts and characters that are encoded together; words merged together, up to that many bytes each (longer ones alone).
SLICE, SLICE_CHARS, ABREAST, SHORT = 1024, 2_000_000, 16_384, 32
#: The end of a word, and the white space of Unicode.
END = "</w>"
SPACE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: What str.split() takes for white space besides.
ODD = re.compile("[\x1c-\x1f]")


def _class(kind: str) -> str:
    """The code points of a general category as the inside of a character class."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        hit = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == kind
        if hit and start is None:
            start = i
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def pre_token() -> re.Pattern:
    letters, digits = _class("L"), _class("N")
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{SPACE}{letters}{digits}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and added tokens of a tokenizer file of the kind word_bpe."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank_of = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for x, i in [*self.vocab.items(), *self.added.items()]:
            self.names[i] = x
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        chars = byte_chars()
        self.one = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + END) for c in chars]

        keys = np.array(list(self.rank_of), dtype=np.int64)
        by_key = np.argsort(keys)
        self._keys, self._ranks = keys[by_key], np.array(list(self.rank_of.values()), dtype=np.int64)[by_key]
        self._made = np.array([*self.made, 0], dtype=np.int64)
        whole = None not in self.one and None not in self.last
        self._one, self._last = (np.array(x, dtype=np.int64) for x in (self.one, self.last)) if whole else (None, None)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids (-1: no id), len(made) where they don't merge."""
        key = np.where(right >= 0, left << 20 | right, -1)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], len(self.made))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words in bytes: short ones abreast, each taking its next merge at every step, the others one by one."""
        out: list[bytes] = [b""] * len(words)
        abreast = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT] if self._one is not None and len(self._keys) else []
        abreast.sort(key=lambda i: len(words[i]))
        for k in range(0, len(abreast), ABREAST):
            some = abreast[k : k + ABREAST]
            for i, ids in zip(some, self._merge_abreast([words[i] for i in some])):
                out[i] = ids
        for i in set(range(len(words))).difference(abreast):
            out[i] = _bytes(self.merge(words[i])) if words[i] else b""
        return out

    def _merge_abreast(self, words: list[bytes]) -> list[bytes]:
        size, never = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), len(self.made)
        width = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        place = np.arange(width)
        ids = np.where(place < size[:, None] - 1, self._one[raw], np.where(place == size[:, None] - 1, self._last[raw], -1))
        done = np.full_like(ids, -1)
        rows, ranks = np.arange(len(words)), self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), never)
            over = best == never
            done[rows[over], : ids.shape[1]] = ids[over]
            go = ~over
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not len(rows):
                break
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = self._made[best]
            after = np.arange(width - 1)  # what stands right of the merged pair moves up
            ids = np.take_along_axis(ids, after + (after > at[:, None]), axis=1)
            pairs = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, pairs + (pairs >= at[:, None]), axis=1)
            for shift in (-1, 0):  # the pairs that the new id makes
                here = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
                left = at[here] + shift
                ranks[here, left] = self._rank(ids[here, left], ids[here, left + 1])
        n = (done >= 0).sum(axis=1)
        flat, ends = done[done >= 0].astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by its merges: the lowest rank first, from the left."""
        ids = [self.one[b] for b in word[:-1]] + [self.last[word[-1]]]
        ids = [i for i in ids if i is not None]
        return self._merge_long(ids) if len(ids) > 100 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, never = self.rank_of.get, len(self.made)
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            ids[i] = self.made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], never)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank_of.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := left[i]) >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x != -1]

    def pieces(self, text: str) -> list[str]:
        """What white space parts in a stretch of text without added tokens, normalised; words never reach beyond it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # else lower() would look at its place
        text = text.lower()
        return re.split(f"[{SPACE}]+", text) if ODD.search(text) else text.split()

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text and added tokens in turn."""
        if "<|" in text or self.split_added is None or not all("<|" in x for x in self.added):
            for i, x in enumerate(self.split_added.split(text) if self.split_added else [text]):
                yield x, bool(i % 2)
        else:
            yield text, False


class Ids(dict):
    """Pieces of text to the ids of their words, in bytes: each word from the lexicon, or else merged.

    What it lacks is learned for many texts at once; it starts anew when it has grown to its bound.
    """

    def __init__(self, tok: Tokenizer, lexicon: Lexicon):
        super().__init__()
        self.tok, self.lexicon, self.pattern, self.words = tok, lexicon, pre_token(), {}

    def learn(self, pieces: set[str]) -> None:
        lack = pieces.difference(self)
        if len(self) + len(lack) > MAX_KEPT:
            self.clear()
            lack = pieces
        if 2 * len(self.words) > MAX_KEPT:
            self.words.clear()
        parts = {p: self.pattern.findall(p) for p in lack}
        new = list({w for ws in parts.values() for w in ws}.difference(self.words))
        raw = [w.encode("utf-8", "replace") for w in new]
        found = self.lexicon.find(raw).tolist()
        rest = [i for i, r in enumerate(found) if r < 0]
        for i, ids in zip(rest, self.tok.merge_all([raw[i] for i in rest])):
            self.words[new[i]] = ids
        for i, r in enumerate(found):
            if r >= 0:
                self.words[new[i]] = self.lexicon.ids(r)
        get = self.words.__getitem__
        self.update((p, b"".join(map(get, ws))) for p, ws in parts.items())


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_worker: dict[str, Ids] = {}


def _ids_here(tok: Tokenizer, data: bytes) -> Ids:
    """One table for all tasks that a worker runs with the same tokenizer and lexicon."""
    key = f"{hashlib.sha256(data).hexdigest()} {tok.digest}"
    if key not in _worker:
        _worker.clear()
        _worker[key] = Ids(tok, Lexicon(data))
    return _worker[key]


def encode_texts(texts: list[str | None], ids: Ids) -> list[bytes]:
    tok, taken, lack = ids.tok, [], set()
    for text in texts:
        taken.append([part if added else tok.pieces(part) for part, added in tok.stretches(text or "")])
        for x in taken[-1]:
            if isinstance(x, list):
                lack.update(x)
    ids.learn(lack)
    get = ids.__getitem__
    return [b"".join([tok.added[x].to_bytes(4, "little") if isinstance(x, str) else b"".join(map(get, x)) for x in parts]) for parts in taken]


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded number and length; a text is never cut."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= SLICE or chars + len(t or "") > SLICE_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(t or "")
    if texts:
        yield start, len(texts)


def decode_ids(ids: bytes, names: list[str]) -> str:
    return " ".join(map(names.__getitem__, memoryview(ids).cast("I")))


def frequent(docs: DataFrame, tok: Tokenizer, text: str = "text", most: int = MAX_LEXICON) -> list[str]:
    """The words that occur most often in all texts, `most` at most."""
    shared = docs.sparkSession.sparkContext.broadcast(tok)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pieces = shared.value, Counter()

        def rows() -> pa.RecordBatch:
            counts: Counter = Counter()
            for piece, n in pieces.items():
                for w in pre_token().findall(piece):
                    counts[w] += n
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                for part, added in t.stretches(x):
                    if not added:
                        pieces.update(t.pieces(part))
                if len(pieces) > FLUSH:
                    yield rows()
                    pieces = Counter()
        yield rows()

    counts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(count, "word string, n long")
    best = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where("length(word) <= 64"), "words")
    return [r["word"] for r in most_frequent(best, most).collect()]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", lexicon: list[str] | None = None, decode: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with ids, the token ids as little-endian unsigned 32-bit integers, and decoded.

    tokenizer is the path of the file on the driver; lexicon the words to compile, by default the most frequent
    of docs, ties beyond the bound left out. Null and empty texts have no ids; strings of added tokens in a text
    become those tokens, as the library has it; whole texts are encoded, however long; every row gets its own
    result, repeated or not; an empty table gives an empty result. Columns of docs named ids or decoded, in any
    case, are replaced, others kept whatever their names. What is broadcast is the file and the lexicon, both of
    bounded size.
    """
    with open(tokenizer, encoding="utf-8") as f:
        tok = Tokenizer(f.read())
    words = frequent(docs, tok, text) if lexicon is None else lexicon
    raws = sorted({w.encode("utf-8", "replace") for w in words} - {b""})
    entries = zip(raws, [memoryview(x).cast("I").tolist() for x in tok.merge_all(raws)])
    shared = docs.sparkSession.sparkContext.broadcast((tok, compile_lexicon(entries)))
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, data = shared.value
        ids = _ids_here(t, data)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for x, y in _together(texts):
                got = encode_texts(texts[x:y], ids)
                more = [pa.array([decode_ids(x, t.names) for x in got], pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([*b.slice(x, y - x).columns[:-1], pa.array(got, pa.binary()), *more], names=names)

    plain = docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"))
    names = [*(f"in_{i}" for i in range(len(own))), "ids", *["decoded"] * decode]
    done = plain.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in plain.dtypes[:-1]), "ids binary", *["decoded string"] * decode]))
    return done.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), *names[len(own) :])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, default_tokenizer(), keep=["doc_id"])
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
