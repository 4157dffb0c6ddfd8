"""The layout of layout.py for a batch of documents at once, in Arrow and numpy columns: no word leaves its document's row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .layout import CELL, HEIGHT, LEFT, LINES_PER_PAGE, PITCH, TOP, WORDS_PER_LINE

#: Bytes of text that are laid out at once; a longer text is laid out alone.
BYTES = 1 << 20


class Words:
    """Words in reading order: row (of the batch) and doc_id, ls, page, line, word, left, top, right, bottom, conf as arrays, text as an Arrow array.

    Rows whose doc_id is null are not known: they have words, but meet none.
    """

    NAMES = ("row", "known", "doc", "ls", "page", "line", "word", "left", "top", "right", "bottom", "conf")

    def __init__(self, text: pa.Array, **columns: np.ndarray):
        self.text = text
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.text)

    def where(self, keep: np.ndarray, **changed) -> Words:
        """The words that are kept, with changed columns (of all words)."""
        now = self.but(**changed)
        return Words(now.text.filter(pa.array(keep)), **{k: getattr(now, k)[keep] for k in self.NAMES})

    def but(self, **changed) -> Words:
        return Words(changed.pop("text", self.text), **({k: getattr(self, k) for k in self.NAMES} | changed))

    def moduli(self, doc: int, ls: int, word: int, m: int) -> np.ndarray:
        """The remainder as SQL has it, with the sign of the dividend."""
        return np.fmod(doc * self.doc + ls * self.ls + word * self.word, m)

    def next(self, k: int = 1) -> np.ndarray:
        """The index of the k-th next word of the same line, -1 where there is none."""
        n = len(self)
        at = np.arange(n) + k
        to = np.minimum(at, max(0, n - 1))
        same = (at < n) & (self.row[to] == self.row) & (self.ls[to] == self.ls) if n else np.zeros(0, dtype=bool)
        return np.where(same, at, -1)


def words(ids: pa.Array, texts: pa.Array) -> Words:
    """Of the doc_id and text of documents: what layout.words() has."""
    paragraphs = pc.split_pattern(texts, "\n")
    each = pc.split_pattern(paragraphs.flatten(), " ")
    text, par = each.flatten(), pc.list_parent_indices(each).to_numpy()
    full = pc.greater(pc.binary_length(text), 0)
    text, par = text.filter(full), par[full.to_numpy(zero_copy_only=False)]
    n = len(text)
    row = pc.list_parent_indices(paragraphs).to_numpy()[par].astype(np.int64)
    start = lambda x: np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)  # noqa: E731  of the run that each belongs to
    word = (np.arange(n) - start(par)) % WORDS_PER_LINE
    line_no = np.cumsum(word == 0)
    ls = line_no - line_no[start(row)]
    size = pc.utf8_length(text).to_numpy().astype(np.int64)
    sums = np.cumsum(size + 1)
    before = sums - size - 1
    left = LEFT + CELL * (before - before[np.arange(n) - word])
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[row]
    doc = pc.fill_null(ids, 0).to_numpy().astype(np.int64)[row]
    line = ls % LINES_PER_PAGE
    return Words(
        text, row=row, known=known, doc=doc, ls=ls, page=ls // LINES_PER_PAGE, line=line, word=word, left=left, top=TOP + PITCH * line, right=left + CELL * size, bottom=TOP + PITCH * line + HEIGHT,
        conf=np.fmod(31 * doc + 17 * ls + 7 * word, 101),
    )


def words_b(a: Words) -> Words:
    """layout.words_b() of layout.words()."""
    off = a.moduli(1, 0, 1, 3) - 1
    text = pc.if_else(pa.array(a.moduli(1, 1, 1, 7) == 0), pc.replace_substring(a.text, "e", "c"), a.text)
    return a.where(a.known & (a.moduli(1, 3, 5, 11) != 0), text=text, left=a.left + off, right=a.right + off)


def words_c(a: Words) -> Words:
    """layout.words_c() of layout.words()."""
    off = np.where(a.known & (a.moduli(1, 1, 1, 13) == 0), 5000, 0)
    return a.but(left=a.left + off, right=a.right + off)


def words_d(a: Words) -> Words:
    """layout.words_d() of layout.words()."""
    joined, after = np.fmod(a.doc + a.ls + a.word // 2, 5) == 0, a.next()
    first = joined & (a.word % 2 == 0) & (after >= 0)
    at = np.flatnonzero(first)
    text = pc.replace_with_mask(a.text, pa.array(first), pc.binary_join_element_wise(a.text.take(pa.array(at)), a.text.take(pa.array(at + 1)), ""))
    of = np.where(first, after, np.arange(len(a)))
    return a.where(a.known & ~(joined & (a.word % 2 == 1)), text=text, right=a.right[of], conf=np.minimum(a.conf, a.conf[of]))


def words_e(a: Words) -> Words:
    """layout.words_e() of layout.words()."""
    d = words_d(a)
    length = pc.utf8_length(d.text).to_numpy().astype(np.int64)
    n = np.where((length >= 8) & (d.moduli(1, 1, 1, 3) == 0), 2 + d.moduli(1, 0, 1, 3), 1)
    size = -(-length // n)
    of = np.repeat(np.arange(len(d)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    last, left = i == n[of] - 1, d.left[of] + CELL * i * size[of]
    cut = np.flatnonzero(n[of] > 1)
    part = lambda x, k, s, e: x[k * s :] if e else x[k * s : k * s + s]
    pieces = [part(*x) for x in zip(d.text.take(pa.array(of[cut])).to_pylist(), i[cut].tolist(), size[of[cut]].tolist(), last[cut].tolist())]
    text = pc.replace_with_mask(d.text.take(pa.array(of)), pa.array(n[of] > 1), pa.array(pieces, d.text.type))
    every = Words(text, **{k: getattr(d, k)[of] for k in d.NAMES})
    return every.but(left=left, right=np.where(last, d.right[of], left + CELL * size[of]), word=4 * d.word[of] + i)


def laid_out(docs: DataFrame, work: Callable[[pa.Array, Words], Iterator[dict]], schema: str) -> DataFrame:
    """What work makes of documents (doc_id, text) a bounded part at a time: it gets their doc_id and words, and gives columns by name. Nothing is shuffled."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
                part = b.slice(at, to - at)
                at = to
                for out in work(part.column(0), words(part.column(0), part.column(1))):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_WORD = {"word_ix": "word", "text": "text", "left": "left", "top": "top", "right": "right", "bottom": "bottom", "conf": "conf"}


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, pages) of documents (doc_id, text) that have words: pages of lines of words, all in order, in the document's row."""

    def work(ids: pa.Array, a: Words) -> Iterator[dict]:
        starts = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])[: len(a)]) if len(a) else np.zeros(0, dtype=np.int64)
        nested = lambda outer, inner, of: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(inner, outer), len(of)), pa.int32()), of)
        row, page, line = starts(a.row), starts(a.row, a.page), starts(a.row, a.ls)
        each = pa.StructArray.from_arrays([x if isinstance(x := getattr(a, k), pa.Array) else pa.array(x) for k in _WORD.values()], names=list(_WORD))
        lines = pa.StructArray.from_arrays([pa.array(a.line[line]), nested(line, np.arange(len(a)), each)], names=["line_ix", "words"])
        whole = pa.StructArray.from_arrays([pa.array(a.page[page]), nested(page, line, lines)], names=["page", "lines"])
        yield {"doc_id": ids.take(pa.array(a.row[row])), "pages": nested(row, page, whole)}

    word = ", ".join(f"{c}: {'string' if c == 'text' else 'long'}" for c in _WORD)
    return laid_out(docs, work, f"doc_id long, pages array<struct<page: long, lines: array<struct<line_ix: long, words: array<struct<{word}>>>>>>")
