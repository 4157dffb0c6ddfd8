"""Markdown, Word and vendor XML taken apart into paragraphs or words, a file in a row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charboxes

PARAGRAPH = "doc_id long, par_ix int, type string, level int, par_num string, text string"
_MARKS = re.compile(r"(\*\*\*|\*\*|\*|__|_|~~|`)(\S(?:.*?\S)?)\1")
_LINK = re.compile(r"!?\[([^\]]*)\]\((?:[^()\s]+)(?:\s+\"[^\"]*\")?\)")


def _inline(text: str) -> str:
    text, before = _LINK.sub(r"\1", text), None
    while text != before:
        before, text = text, _MARKS.sub(r"\2", text)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!-])", r"\1", text)


def markdown_blocks(text: str) -> list[tuple[str, int | None, str | None, str]]:
    """(type, level, number, text) of a Markdown text: title, body, list, quote, code or footnote."""
    lines = re.sub(r"\A---\n.*?\n---\n", "", text.replace("\r\n", "\n"), flags=re.S).split("\n")
    out: list[tuple[str, int | None, str | None, str]] = []
    run: list[str] = []

    def flush(kind: str = "body") -> None:
        if run:
            out.append((kind, None, None, _inline(" ".join(x.strip() for x in run))))
            run.clear()

    i = 0
    while i < len(lines):
        x = lines[i]
        if m := re.match(r"\s{0,3}(```+|~~~+)", x):
            flush()
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append(("code", None, None, "\n".join(lines[i + 1 : end])))
            i = end
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", x):
            flush()
            out.append(("title", len(m[1]), None, _inline(m[2])))
        elif run and (m := re.match(r"\s{0,3}(=+|-+)\s*$", x)):
            title = _inline(" ".join(y.strip() for y in run))
            run.clear()
            out.append(("title", 1 if m[1][0] == "=" else 2, None, title))
        elif m := re.match(r"\[\^([^\]]+)\]:\s*(.*)$", x):
            flush()
            out.append(("footnote", None, m[1], _inline(m[2])))
        elif m := re.match(r"(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$", x):
            flush()
            out.append(("list", len(m[1]) // 2 + 1, m[2], _inline(m[3])))
        elif m := re.match(r"\s{0,3}>\s?(.*)$", x):
            flush()
            out.append(("quote", None, None, _inline(m[1])))
        elif not x.strip():
            flush()
        else:
            run.append(x)
        i += 1
    flush()
    return out


def markdown(files: DataFrame) -> DataFrame:
    """Paragraphs of (doc_id, text) in Markdown."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, i, *b) for d, t in zip(p["doc_id"], p["text"]) for i, b in enumerate(markdown_blocks(t or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAGRAPH.split(", ")])

    return files.select("doc_id", "text").mapInPandas(run, PARAGRAPH)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[tuple[str, int | None, str | None, str]]:
    """(type, level, None, text) of a Word file; nothing if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for p in body.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = int(m[1]) if (m := re.fullmatch(r"Heading(\d)", name)) else None
        item = p.find(f"{_W}pPr/{_W}numPr") is not None
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        if text.strip():
            out.append(("title" if level or name == "Title" else "list" if item else "body", level, None, text))
    return out


def docx(files: DataFrame) -> DataFrame:
    """Paragraphs of (doc_id, content) in Word's format."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, i, *b) for d, c in zip(p["doc_id"], p["content"]) for i, b in enumerate(docx_paragraphs(c or b""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAGRAPH.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, PARAGRAPH)


# Words after which a full stop ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "rev", "sr", "jr", "etc", "vs", "vol", "no", "eg", "ie", "al", "cf", "p", "pp", "pg", "sec", "ch", "art", "cl", "fig", "tab", "ex", "us", "uk")


def ends_sentence(word: Column) -> Column:
    """Whether a word ends a sentence: by its mark, before closing brackets and quotes; not by a full stop after dots, an initial, a digit or an abbreviation."""
    found = F.regexp_extract(word, r"""^(.+[.!?])["')\]}>]*$""", 1)
    core = F.when(found != "", found).otherwise(word)
    short = F.lower(F.substr(core, F.lit(1), F.length(core) - 1)).isin(*ABBREVIATIONS) | F.lower(F.replace(core, F.lit("."), F.lit(""))).isin(*ABBREVIATIONS)
    return core.rlike("[!?]$") | (core.rlike(r"\.$") & ~core.rlike(r"\.{2,}$|^[A-Z]\.$|[0-9]\.$") & ~short)


def char_words(pages: DataFrame) -> DataFrame:
    """Words of (doc_id, page, xml) whose characters have boxes (charParams l, t, r, b), parted at blanks: (doc_id, page, line_ix, word_ix, text, left, top, right, bottom, doubtful); rows apart."""
    keys = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("doc_id", "page"))
    schema = keys + ", line_ix int, word_ix int, text string, left double, top double, right double, bottom double, doubtful boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in charboxes.read(b.column(2)):
                row = pa.array(w["row"])
                ix = (pa.array(w[c].astype("int32")) for c in ("line_ix", "word_ix"))
                sides = (pa.array(w[c], from_pandas=True) for c in ("left", "top", "right", "bottom"))
                columns = [b.column(0).take(row), b.column(1).take(row), *ix, w["text"], *sides, pa.array(w["doubtful"])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "line_ix", "word_ix", "text", "left", "top", "right", "bottom", "doubtful"])

    return pages.select("doc_id", "page", "xml").mapInArrow(run, schema)
