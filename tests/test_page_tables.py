"""Tables, rows and joined layers against plain loops over small pages."""

import random

from pagewright.operators import compare, layers, tables

BOX = "left long, top long, right long, bottom long"


def test_row_groups_take_the_first_row_near_enough(spark):
    rng = random.Random(1)
    lines = [(d, 0, i, rng.randrange(120)) for d in range(30) for i in range(rng.randrange(1, 14))]
    want = set()
    for d in range(30):
        rows = []
        for top, i in sorted((t, i) for x, _, i, t in lines if x == d):
            at = next((k for k, r in enumerate(rows) if abs(top - sum(r) / len(r)) <= 10), len(rows))
            rows[at : at + 1] = [[*(rows[at] if at < len(rows) else []), top]]
            want.add((d, 0, i, at))
    got = tables.row_groups(spark.createDataFrame(lines, "doc_id long, page long, line_ix long, top long"))
    assert {tuple(r) for r in got.collect()} == want


def test_placed_lines_one_after_the_other(spark):
    rng, width = random.Random(2), 400

    def box():
        left, top = rng.randrange(300), rng.randrange(90)
        return left, top, left + rng.randrange(1, 120), top + rng.randrange(1, 25)

    base = {d: [(i, *box()) for i in range(rng.randrange(0, 6))] for d in range(60)}
    new = {d: [(i, *box()) for i in range(rng.randrange(0, 5))] for d in range(60)}
    want = set()
    for d, lines in new.items():
        held = [list(b[1:]) for b in base[d]]
        for i, left, top, right, bottom in lines:
            best, shared, aside, above = None, 0, 1e6, 1e6
            for k, (x0, y0, x1, y1) in enumerate(held):
                wide = max(0, min(right, x1) - max(left, x0)) / (right - left)
                high = max(0, min(bottom, y1) - max(top, y0)) / (bottom - top)
                off = min(abs(x1 - left), abs(x0 - right))
                if high >= 0.5:
                    if wide > shared:
                        best, shared = k, wide
                    elif wide == 0 == shared and off < aside:
                        best, aside = k, off
                elif best is None:
                    above = min(above, 0 if high > 0 else min(abs(y1 - top), abs(y0 - bottom)))
            if best is not None and shared == 0 and aside > 2 * above and aside > width * 0.05:
                best = None
            if best is None:
                want.add((d, 0, i, len(held), True))
                held.append([left, top, right, bottom])
            else:
                want.add((d, 0, i, best, False))
                o = held[best]
                held[best] = [min(o[0], left), min(o[1], top), max(o[2], right), max(o[3], bottom)]
    frame = lambda x: spark.createDataFrame([(d, 0, *b) for d, lines in x.items() for b in lines], f"doc_id long, page long, line_ix long, {BOX}")
    assert {tuple(r) for r in layers.placed_lines(frame(base), frame(new), width).collect()} == want
    assert any(a for *_, a in want) and not all(a for *_, a in want)


def test_kept_apart_goes_by_the_smaller_box(spark):
    boxes = [(1, 0, 0, 0, 0, 10, 10), (1, 0, 1, 7, 0, 17, 10), (1, 0, 2, 6, 0, 12, 10), (1, 0, 3, 1, 1, 3, 3), (1, 0, 4, 40, 0, 50, 10), (1, 1, 5, 0, 0, 10, 10), (1, 0, 6, 50, 0, 60, 10)]
    got = tables.kept_apart(spark.createDataFrame(boxes, f"doc_id long, page long, box_ix long, {BOX}"))
    assert sorted(r["box_ix"] for r in got.collect()) == [0, 1, 4, 5, 6]


def row(*cells):
    """A row of one segment for each (left, right, numbers)."""
    return [(a, b, [(a + 4 * k, a + 4 * k + 3, True) for k in range(n)] or [(a, b, False)]) for a, b, n in cells]


def test_runs_of_rows():
    four, text = row((0, 10, 1), (20, 30, 1), (40, 50, 1), (60, 70, 1)), row((0, 70, 0))
    head = row((0, 10, 0), (20, 30, 0), (40, 50, 0))
    assert tables.runs_of_rows([]) == [] and tables.runs_of_rows([four] * 3) == []
    assert tables.runs_of_rows([head] * 3 + [four] * 4) == [[3, 4, 5, 6]]  # it goes on to the end: no heads
    assert tables.runs_of_rows([head] * 3 + [four] * 4 + [text]) == [[2, 1, 3, 4, 5, 6]]
    assert tables.runs_of_rows([four] * 2 + [text] + [four] * 2 + [text] * 2) == [[0, 1, 2, 3, 4]]  # one row between
    assert tables.runs_of_rows([four] * 2 + [text] * 2 + [four] * 2) == []
    wide = row((0, 70, 12))  # a word of it meets no two words, but its segment lies beside four
    assert tables.runs_of_rows([four] * 4 + [row((0, 70, 0))] * 3 + [wide] * 4) == [[0, 1, 2, 3], [7, 8, 9, 10]]
    across = [(0, 70, [(0, 33, True), (34, 70, True), (0, 1, True), (2, 3, True)])]
    assert tables.runs_of_rows([four] * 4 + [across] * 4) == [[0, 1, 2, 3], [4, 5, 6, 7]]  # a word that meets two others parts them


def test_conflicts_keep_abbreviations(spark):
    key = "doc_id long, page long, line_ix long, word_ix long, text string, conf long, " + BOX
    at = lambda i, text, left, right: (1, 0, 0, i, text, 50, left, 0, right, 20)
    a = spark.createDataFrame([at(0, "teh", 0, 100), at(1, "e.g.", 200, 300), at(2, "same", 400, 500), at(3, "far", 600, 700)], key)
    b = spark.createDataFrame([at(0, "the", 1, 101), at(1, "egg", 200, 300), at(2, "same", 400, 500), at(3, "fat", 640, 740)], key)
    got = {r["word_ix"]: (r["text"], r["replaced"]) for r in compare.conflicts_resolved(a, b).collect()}
    assert got == {0: ("the", True), 1: ("e.g.", False), 2: ("same", False), 3: ("far", False)}
