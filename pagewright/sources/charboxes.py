"""XML whose characters have boxes of their own (charParams l, t, r, b), written and read a run of pages at a time in numpy and Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .columns import Words
from .layout import CELL

#: Characters that are written at once, bytes of XML that are read at once; a larger page is taken alone.
CHARS, BYTES = 1 << 13, 1 << 19
_PAD = 32
_NUMBER = re.compile(rb'-?[0-9.]+(?=")')
_NAMED, _WORD = np.full(256, -1), np.zeros(256, dtype=bool)
_NAMED[[*b"ltrb"]] = range(4)
#: By the number of digits: bits that move them to the end of eight bytes, and the zeros before.
_SHIFT = np.array([0, *range(56, -1, -8), 0], np.uint64)
_ZEROS = np.array([0, *(0x3030303030303030 >> 8 * n for n in range(1, 8)), 0, 0], np.uint64)
_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of so much in all, or of one that is larger."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])[: len(keys[0])])


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of large strings."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


_CHAR, _END = '<charParams l="', "</charParams>"
_BLANK, _LINE = '<charParams l="0" t="0" r="0" b="0"> </charParams>', '<line baseline="1" l="1">'
#: What goes before a character: within a word, before a word, before a line, before a page's further line.
_BEFORE = pa.array([_CHAR, _BLANK + _CHAR, _LINE + _CHAR, "\n" + _LINE + _CHAR], pa.large_string())
_AFTER = pa.array([_END, _END + "</line>"], pa.large_string())


def written(a: Words) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, page and XML of words' pages, some pages at a time: cells of ten pixels, blanks between words; an x stands for <, > and &."""
    if not len(a):
        return
    first = _changes(a.row, a.page)
    ends = np.append(first, len(a))
    sizes = np.add.reduceat((a.right - a.left) // CELL, first)
    for at, to in _runs(sizes, CHARS):
        own = slice(int(ends[at]), int(ends[to]))
        data, offsets = _parts(a.text[own].cast(pa.large_string()))
        data = np.where((data == 60) | (data == 62) | (data == 38), np.uint8(120), data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        begin = np.searchsorted(starts, offsets)  # of each word, in characters
        n = np.diff(begin)
        w = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(w)) - begin[w]
        row, page, line = a.row[own], a.page[own], a.line[own]
        of_line, of_page = np.zeros((2, len(n)), dtype=np.int64)
        lines, pages = _changes(row, page, line), _changes(row, page)
        of_line[lines], of_page[pages] = 1, 1
        before = np.where(i == 0, 1 + of_line[w] * 2 - of_page[w], 0)
        after = np.zeros(len(w), dtype=np.int64)
        after[np.append(begin[lines[1:]], len(w)) - 1] = 1
        left = a.left[own][w] + CELL * i
        number = lambda x: pa.array(x).cast(pa.large_string())
        literal = lambda x: pa.scalar(x, pa.large_string())
        of_word = lambda a, x, b: pc.binary_join_element_wise(literal(a), number(x[own]), literal(b), literal("")).take(pa.array(w))
        chars = pc.binary_join_element_wise(
            _BEFORE.take(pa.array(before)), number(left), of_word('" t="', a.top, '" r="'), number(left + CELL), of_word('" b="', a.bottom, '">'),
            _strings(data, np.append(starts, len(data))), _AFTER.take(pa.array(after)), literal(""),
        )
        data, offsets = _parts(chars)
        yield row[pages], page[pages], _strings(data, offsets[np.append(begin[pages], len(w))])


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first lowest."""
    return np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf.data, strides=(1,))


def _stands(eights: np.ndarray, at: np.ndarray, what: bytes) -> np.ndarray:
    """Whether this stands at each of the places."""
    ok = np.ones(len(at), dtype=bool)
    for k in range(0, len(what), 8):
        part = what[k : k + 8]
        ok &= eights[at + k] & np.uint64((1 << 8 * len(part)) - 1) == np.uint64(int.from_bytes(part, "little"))
    return ok


def _digits(eights: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of n digits, one to eight, from each place on, and whether these are digits."""
    u = np.uint64
    size = np.minimum(n, 9)
    x = eights[at] << _SHIFT[size] | _ZEROS[size]
    ok = (size > 0) & (size < 9)
    ok &= ((x & u(0xF0F0F0F0F0F0F0F0)) | (((x + u(0x0606060606060606)) & u(0xF0F0F0F0F0F0F0F0)) >> u(4))) == u(0x3333333333333333)
    x = (x & u(0x0F0F0F0F0F0F0F0F)) * u(2561) >> u(8)
    x = (x & u(0x00FF00FF00FF00FF)) * u(6553601) >> u(16)
    return ((x & u(0x0000FFFF0000FFFF)) * u(42949672960001) >> u(32)).astype(np.float64), ok


def read(xml: pa.Array) -> Iterator[dict]:
    """Words of pages: row (of the array), line_ix, word_ix, left, top, right, bottom (not a number where it is missing), doubtful as arrays, text as an Arrow array.

    A line goes from its tag to the next end of a line; of an attribute that occurs twice the first counts, also if it stands in the text.
    """
    xml = pc.fill_null(xml.cast(pa.large_binary()), b"")
    for at, to in _runs(pc.binary_length(xml).to_numpy(), BYTES):
        if out := _read(xml[at:to].to_pylist()):
            yield out | {"row": out["row"] + at}


def _read(pages: list[bytes]) -> dict | None:
    raw = b"\0" * _PAD + b"\0".join(pages) + b"\0" * _PAD
    buf = np.frombuffer(raw, np.uint8)
    row_ends = _PAD + np.cumsum([len(p) + 1 for p in pages])
    eights, last = _eights(buf), len(buf) - _PAD
    row_of = lambda at: np.searchsorted(row_ends, at, "right")
    marks = np.flatnonzero((buf == 60) | (buf == 62) | (buf == 34))
    kind = buf[marks]
    opens_at = np.flatnonzero(kind == 60)
    opens, ends = marks[opens_at], np.full(16, last)
    second = buf[opens + 1]
    found = lambda what: (x := np.flatnonzero(second == what[1]))[_stands(eights, opens[x], what)]
    tags = lambda what: opens[found(what)]

    begin, end = tags(b"<line "), tags(b"</line>")
    upto = np.searchsorted(end, begin)
    begin, upto = begin[upto < len(end)], upto[upto < len(end)]
    same = row_of(begin) == row_of(end[upto])
    begin, upto = begin[same], upto[same]
    if not len(begin):
        return None
    whole = _changes(upto)  # what begins before the same end is one line, from the first
    begin, end = begin[whole], end[upto[whole]]
    line_row = row_of(begin)
    line_ix = np.arange(len(begin)) - np.searchsorted(line_row, line_row)

    mark = found(b"<charParams")
    tag, mark = opens[mark], opens_at[mark]
    marks, kind = np.append(marks, ends), np.append(kind, np.zeros(16, np.uint8))
    # Usually eight quotes, the end of the tag and the next one follow; then attributes need not be sought.
    neat = (_eights(kind)[mark + 1] == np.uint64(0x2222222222222222)) & (kind[mark + 9] == 62) & (kind[mark + 10] == 60)
    to, over = marks[mark + 9], marks[mark + 10]
    if not neat.all():
        odd = np.flatnonzero(~neat)
        closes = np.append(marks[kind == 62], last)
        to[odd] = closes[np.searchsorted(closes[:-1], tag[odd])]
        over[odd] = np.append(opens, last)[np.searchsorted(opens, to[odd])]
    line = np.searchsorted(begin, tag, "right") - 1
    ok = (line >= 0) & (over < end[line]) & _stands(eights, over, b"</charParams>")
    ok[1:] &= over[1:] != over[:-1]
    tag, to, over, line, mark, neat = (x[ok] for x in (tag, to, over, line, mark, neat))
    if not len(tag):
        return None

    box, doubt = np.empty((4, len(tag))), np.zeros(len(tag), dtype=bool)
    for k, name in enumerate((b' l="', b' t="', b' r="', b' b="')):
        at = marks[mark + 1 + 2 * k]
        box[k], ok = _digits(eights, at + 1, marks[mark + 2 + 2 * k] - at - 1)
        neat &= ok & _stands(eights, at - 3, name)
    odd = np.flatnonzero(~neat)
    box[:, odd] = np.nan
    quotes = np.append(marks[kind == 34], last) if len(odd) else ends[:1]
    first = np.searchsorted(quotes[:-1], tag[odd])
    n = np.searchsorted(quotes[:-1], over[odd]) - first
    of, at = np.repeat(odd, n), np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    at, until = quotes[at], quotes[at + 1]
    value = buf[at - 1] == 61
    of, at, until = of[value], at[value], until[value]
    name = _NAMED[buf[at - 2]]
    flag = np.flatnonzero(buf[at - 2] == ord("s"))
    flag = flag[_stands(eights, at[flag] - 11, b'suspicious="1"') | _stands(eights, at[flag] - 11, b'suspicious="true"')]
    doubt[of[flag]] = True
    found = (name >= 0) & ~_WORD[buf[at - 3]]
    at, until, of, name = at[found], until[found], of[found], name[found]
    number, keep = _digits(eights, at + 1, until - at - 1)
    for k in np.flatnonzero(~keep).tolist():
        if m := _NUMBER.match(raw, int(at[k]) + 1):
            keep[k] = True
            try:
                number[k] = float(m[0])
            except ValueError:
                number[k] = np.nan
    keep = np.flatnonzero(keep)[::-1]
    box[name[keep], of[keep]] = number[keep]  # the first is put last

    n, head = over - to - 1, buf[to + 1] == 32
    blank = (n == 0) | head & (n == 1)
    for k in np.flatnonzero(head & (n > 1)).tolist():
        blank[k] = not raw[to[k] + 1 : over[k]].strip(b" ")
    blanks = np.cumsum(blank)
    word_ix = blanks - (blanks - blank)[np.searchsorted(line, line)]
    full = np.flatnonzero(~blank)
    if not len(full):
        return None
    line, word_ix, n, to = line[full], word_ix[full], n[full], to[full]
    first = _changes(line, word_ix)
    upto = np.cumsum(n)
    data = buf[np.arange(int(upto[-1])) + np.repeat(to + 1 - (upto - n), n)]
    low, high = (lambda x: np.fmin.reduceat(box[x][full], first)), (lambda x: np.fmax.reduceat(box[x][full], first))
    return {
        "row": line_row[line[first]], "line_ix": line_ix[line[first]], "word_ix": word_ix[first], "text": _strings(data, np.append((upto - n)[first], upto[-1])).cast(pa.string()),
        "left": low(0), "top": low(1), "right": high(2), "bottom": high(3), "doubtful": np.logical_or.reduceat(doubt[full], first),
    }
