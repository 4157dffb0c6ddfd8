"""Queries over tables found on pages, lines joined from two layers, conflicts between layers, running heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, document, layers, render, structure, tables
from ..sources import layout
from ..sources.layout import SQL as W
from .catalog import _HEADS, _LINES, PAIRS, SQL, _docs, _heads, _words, plan, table_cells

WORD = ["doc_id", "page", "line_ix", "word_ix"]


@plan("conflicts_resolved", W + PAIRS.format(other="words_b") + """, said as (
  select doc_id, page, a_line as line_ix, a_word as word_ix, arg_max(b_text, b_line * 1000 + b_word) as said from pairs where abs(a_left - b_left) + abs(a_right - b_right) < 0.1 * (a_right - a_left) group by all),
t as (select doc_id, page, line_ix, word_ix, text as old, case when said is null or regexp_replace(text, '[^A-Za-z0-9_]', '', 'g') in ('eg', 'ie') then text else said end as text from words left join said using (doc_id, page, line_ix, word_ix))
select doc_id, page, line_ix, word_ix, text, text <> old as replaced from t""")
def conflicts_resolved(s, d):
    docs = _docs(s, d)
    return compare.conflicts_resolved(layout.words(docs), layout.words_b(docs))


@plan("word_penalties", W + """, o as (select doc_id, page, line_ix, word_ix, text, case when word_ix % 4 = 0 then replace(replace(text, 'i', 'ii'), 'o', '0') when text = 'a' then 'm' else text end as odd from words)
select doc_id, page, line_ix, word_ix, round(0.05 * (regexp_matches(odd, '[^0-9]%')::int + contains(odd, 'ii')::int + (odd = 'm')::int + regexp_matches(lower(odd), '[a-z][0-9][a-z]')::int + regexp_matches(odd, '^\\].')::int), 2)::double as penalty,
  (regexp_matches(lower(odd), '[a-z][0-9][a-z]') and not regexp_matches(lower(text), '[a-z][0-9][a-z]')) or (regexp_matches(lower(odd), '[a-hj-z]ii[a-hj-z]') and not regexp_matches(lower(text), '[a-hj-z]ii[a-hj-z]')) as rejected from o""")
def word_penalties(s, d):
    odd = F.when(F.col("word_ix") % 4 == 0, F.replace(F.replace("text", F.lit("i"), F.lit("ii")), F.lit("o"), F.lit("0"))).when(F.col("text") == "a", "m").otherwise(F.col("text"))
    w = _words(s, d).withColumn("odd", odd)
    return w.select(*WORD, F.round(compare.penalty(F.col("odd")).cast("double"), 2).alias("penalty"), compare.implausible(F.col("odd"), F.col("text")).alias("rejected"))


# Of every three lines the base has the first's left half and the second's; the new layer the first's right half and the whole third.


def _halves(s, d):
    w, third = _words(s, d), F.col("line_ix") % 3
    return w.where((third != 2) & (F.col("word_ix") < 6)), w.where((third == 2) | ((third == 0) & (F.col("word_ix") >= 6)))


_HALVES = W + """, base as (select doc_id, page, count(distinct line_ix) as n from words where line_ix % 3 <> 2 group by all),
new as (select words.*, line_ix % 3 = 2 as added, case when line_ix % 3 = 2 then n + line_ix // 3 else line_ix // 3 * 2 end as place from words join base using (doc_id, page) where line_ix % 3 = 2 or (line_ix % 3 = 0 and word_ix >= 6))
"""


@plan("placed_lines", _HALVES + "select distinct doc_id, page, line_ix, place, added from new")
def placed_lines(s, d):
    base, new = _halves(s, d)
    return layers.placed_lines(render.lines(base), render.lines(new), 1400)


@plan("joined_layers", _HALVES + """select doc_id, page, place as line_ix, word_ix, text, "left", top, "right", bottom from new
union all select doc_id, page, line_ix // 3 * 2 + line_ix % 3, word_ix, text, "left", top, "right", bottom from words where line_ix % 3 <> 2 and word_ix < 6""")
def joined_layers(s, d):
    base, new = _halves(s, d)
    return layers.joined_words(base, new, layers.placed_lines(render.lines(base), render.lines(new), 1400))


# Tables.


@plan("row_groups", W + _LINES + "select doc_id, page, line_ix * 3 + k as line_ix, line_ix as row from ln, (select unnest(range(3)) as k)")
def row_groups(s, d):
    three = render.lines(_words(s, d)).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    return tables.row_groups(three.select("doc_id", "page", (F.col("line_ix") * 3 + F.col("k")).alias("line_ix"), (F.col("top") + 4 * F.col("k")).alias("top")))


@plan("table_runs", W + """, l as (select doc_id, page, line_ix, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom from words group by doc_id, page, line_ix having count(*) >= 4),
r as (select *, row_number() over (partition by doc_id, page order by line_ix) as n, line_ix between 10 and 19 as inside from l),
t as (select doc_id, page, count(*) filter (inside) as size, min(n) filter (inside) as first, max(n) filter (inside) as last, max(n) as rows from r group by all)
select doc_id, page, 0 as table_ix, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom from r join t using (doc_id, page)
where size >= 4 and n between case when last < rows then first - 2 else first end and last group by doc_id, page""")
def table_runs(s, d):
    w = _words(s, d)
    text = F.when(F.col("line_ix").between(10, 19), F.concat(F.lit("n"), "word_ix")).otherwise(F.lit("word"))
    long = render.lines(w).where("n_words >= 4").select("doc_id", "page", "line_ix")
    return tables.table_runs(structure.split_at_gaps(w.withColumn("text", text).join(long, ["doc_id", "page", "line_ix"], "left_semi")))


@plan("column_spans", SQL["column_bounds"].rsplit("select doc_id", 1)[0] + """, c as (select doc_id, page, line_ix, col_ix, min("left") as "left", max("right") as "right" from g group by all)
select doc_id, page, line_ix, col_ix::bigint as col_ix, coalesce((lag("right") over l + "left") / 2.0, "left")::double as "left", coalesce(("right" + lead("left") over l) / 2.0, "right")::double as "right" from c window l as (partition by doc_id, page, line_ix order by col_ix)""")
def column_spans(s, d):
    by = ["doc_id", "page", "line_ix"]
    return tables.spread(document.column_bounds(_words(s, d), by), by)


CELLS = [["the", "of the"], ["", "la"], ["der", "de la", "and"]]
_CELLS = W + """, w as (select *, lower(text) as said, lead(lower(text)) over p as said2, lead("left") over p as left2, lead(top) over p as top2, lead("right") over p as right2, lead(bottom) over p as bottom2 from words window p as (partition by doc_id, page order by line_ix, word_ix)),
cells as (select * from (values (0, 0, 'the'), (1, 1, 'la'), (2, 0, 'der'), (2, 2, 'and')) c(row_ix, col_ix, cell)), two as (select * from (values (0, 1, 'of', 'the'), (2, 1, 'de', 'la')) c(row_ix, col_ix, a, b)),
hits as (select doc_id, page, row_ix, col_ix, "left", top, "right", bottom from w join cells on contains(said, cell)
  union all select doc_id, page, row_ix, col_ix, least("left", left2), least(top, top2), greatest("right", right2), greatest(bottom, bottom2) from w join two on contains(said, a) and contains(said || ' ' || said2, a || ' ' || b))
"""


@plan("cell_hits", _CELLS + 'select doc_id, page, row_ix::bigint as row_ix, col_ix::bigint as col_ix, "left", top, "right", bottom from hits')
def cell_hits(s, d):
    return tables.cell_hits(_words(s, d), CELLS)


@plan("tables_from_spec", _CELLS + """, c as (select doc_id, page, col_ix, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom from hits group by doc_id, page, col_ix)
select a.doc_id, a.page, a.col_ix::bigint as col_ix, coalesce(floor((b."right" + a."left") / 2.0 + 0.5), a."left")::bigint as "left", min(a.top) over (partition by a.doc_id, a.page) as top,
  coalesce(floor((a."right" + n."left") / 2.0 + 0.5), a."right")::bigint as "right", max(a.bottom) over (partition by a.doc_id, a.page) as bottom
from c a left join c b on a.doc_id = b.doc_id and a.page = b.page and b.col_ix = a.col_ix - 1 left join c n on a.doc_id = n.doc_id and a.page = n.page and n.col_ix = a.col_ix + 1""")
def tables_from_spec(s, d):
    return tables.columns_from_cells(_words(s, d), CELLS)


@plan("row_bounds_from_spec", _CELLS + """, p as (select distinct doc_id, page from hits)
select p.doc_id, p.page, r.row_ix, coalesce(max(bottom), 0)::bigint as bottom from p cross join (select unnest(range(3)) as row_ix) r left join hits h on h.doc_id = p.doc_id and h.page = p.page and h.row_ix = r.row_ix group by p.doc_id, p.page, r.row_ix""")
def row_bounds_from_spec(s, d):
    return tables.row_bounds_from_cells(_words(s, d), CELLS)


@plan("tables_apart", W + _LINES + 'select doc_id, page, line_ix as box_ix, "left", top, "right", top + 30 as bottom from ln where line_ix % 2 = 0')
def tables_apart(s, d):
    ln = render.lines(_words(s, d))
    boxes = ln.select("doc_id", "page", F.col("line_ix").alias("box_ix"), "left", "top", "right", (F.col("top") + 30).alias("bottom")).where("box_ix % 2 = 0")
    copies = boxes.select("doc_id", "page", (F.col("box_ix") + 1000).alias("box_ix"), "left", (F.col("top") + 5).alias("top"), "right", "bottom")
    return tables.kept_apart(boxes.unionByName(copies))


@plan("table_rows_pivot", SQL["table_cells"].rsplit("select doc_id, page, table_ix, line_ix", 1)[0] + """, g as (select doc_id, page, table_ix, line_ix % 10 // 2 as row_ix, col_ix, string_agg(text, ' ' order by line_ix, "left", word_ix) as text from cell group by all)
select doc_id, page, table_ix, row_ix, coalesce(max(text) filter (col_ix = 0), '') as c0, coalesce(max(text) filter (col_ix = 1), '') as c1, coalesce(max(text) filter (col_ix = 2), '') as c2, coalesce(max(text) filter (col_ix = 3), '') as c3 from g group by all""")
def table_rows_pivot(s, d):
    return tables.rows_of_cells(table_cells(s, d), 4)


# Outlines and running heads.


@plan("outline_located", _HEADS + """, said as (select doc_id, page, line_ix, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[.,:;]+$', '') as said from ln),
f as (select doc_id, said, min(page * 50 + line_ix) as spot from said group by all), h as (select doc_id, node, regexp_replace(lower(trim(regexp_replace('  ' || title || '.:', '\\s+', ' ', 'g'))), '[.,:;]+$', '') as said from heads)
select doc_id, node, spot // 50 as page, spot % 50 as line_ix from h left join f using (doc_id, said)""")
def outline_located(s, d):
    return document.located(_heads(s, d).withColumn("title", F.concat(F.lit("  "), "title", F.lit(".:"))), render.lines(_words(s, d)))


# Pages of five lines, so that there are many; some begin with a number that goes along, others with one and the same line.
_MARGINS = """, five as (select doc_id, page * 10 + line_ix // 5 as page, line_ix % 5 as line_ix, line from ln),
m as (select doc_id, page, line_ix, case when line_ix = 0 and page between 2 and 4 then case when doc_id % 2 = 0 then 'Page ' || (page + 1) else 'Part One' end else line end as line from five)"""


@plan("furniture_rules", W + _LINES + _MARGINS + """, e as (select doc_id, page, line, trim(regexp_replace(lower(line), '\\d+', '#', 'g')) as key from m where line_ix = 0),
n as (select doc_id, count(distinct page) as of from m group by doc_id), v as (select distinct doc_id, key, page, unnest(regexp_extract_all(line, '\\d+'))::hugeint - page as off from e where not regexp_matches(line, '\\d{19}')),
t as (select doc_id, key, max(n) as tracks from (select doc_id, key, off, run, count(*) as n from (select *, page - row_number() over (partition by doc_id, key, off order by page) as run from v) group by all) group by all),
r as (select doc_id, key, max(n) as row from (select doc_id, key, run, count(*) as n from (select *, page - row_number() over (partition by doc_id, key order by page) as run from (select distinct doc_id, key, page from e)) group by all) group by all),
k as (select doc_id, key, count(distinct page) as pages, max(length(line)) as longest from e group by all)
select * from (select doc_id, key, pages, case when pages >= 3 and pages * 4 >= of then 'recurs' when tracks >= 3 then 'tracks' when row >= 3 and longest <= 60 then 'run' end as reason
from k join r using (doc_id, key) left join t using (doc_id, key) join n using (doc_id)) where reason is not null""")
def furniture_rules(s, d):
    ln = render.lines(_words(s, d)).select("doc_id", (F.col("page") * 10 + F.floor(F.col("line_ix") / 5)).alias("page"), (F.col("line_ix") % 5).alias("line_ix"), "line")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Page "), F.col("page") + 1)).otherwise("Part One")
    return structure.furniture(ln.withColumn("line", F.when((F.col("line_ix") == 0) & F.col("page").between(2, 4), head).otherwise(F.col("line"))), band=1, last=5)
