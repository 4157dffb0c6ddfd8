"""Further queries over the laid out tables: text functions, edits and marks, lines, a library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from ..operators import beside, document, edits, library, linefacts, render
from ..sources import columns, layout
from ..sources.layout import SQL as W
from ..sources.layout import table
from .catalog import _HEADS, _LINES, METRICS, PAIRS, _docs, _heads, _numbered, _NUMBERED, _pg, _words, plan

WORD = ["doc_id", "page", "line_ix", "word_ix"]


def _lines(s, d):
    return render.lines(_words(s, d))


# Text functions.


@plan("enumerators", W + _LINES + _NUMBERED + r""", e as (select doc_id, page, line_ix, split_part(line, ' ', 1) as w0 from num)
select doc_id, page, line_ix, case when regexp_matches(w0, '^\(\d{1,3}\)$') then 'paren-num' when regexp_matches(w0, '^\d{1,3}[.)]$') then 'num-dot' when regexp_matches(w0, '^[a-z]\)$') then 'alpha-paren' end as scheme,
  case when regexp_matches(w0, '^\(?\d{1,3}[.)]$') then regexp_extract(w0, '\d+')::int when regexp_matches(w0, '^[a-z]\)$') then unicode(w0) - 96 end as value from e""")
def enumerators(s, d):
    return _numbered(s, d).select("doc_id", "page", "line_ix", T.enumerated(F.col("line")).alias("e")).select("doc_id", "page", "line_ix", "e.scheme", "e.value")


@plan("word_enumerators", W + r""", r as (select *, lower(regexp_extract(text, '^([ivxlcdmIVXLCDM]{2,})\.$', 1)) as rom from words)
select doc_id, page, line_ix, word_ix, case when rom <> '' then 'roman-dot' when regexp_matches(text, '^[a-zA-Z]\.$') then 'alpha-dot' when regexp_matches(text, '^\d{1,3}[.)]$') then 'num-dot' when regexp_matches(text, '^[–—-]$') then 'bullet' end as scheme,
  case when rom <> '' then list_sum(list_transform(range(1, length(rom) + 1), lambda i: case when i < length(rom) and [1, 5, 10, 50, 100, 500, 1000][instr('ivxlcdm', rom[i])] < [1, 5, 10, 50, 100, 500, 1000][instr('ivxlcdm', rom[i + 1])] then -1 else 1 end * [1, 5, 10, 50, 100, 500, 1000][instr('ivxlcdm', rom[i])]))::int
    when regexp_matches(text, '^[a-zA-Z]\.$') then unicode(lower(text)) - 96 when regexp_matches(text, '^\d{1,3}[.)]$') then regexp_extract(text, '\d+')::int end as value
from r where rom <> '' or regexp_matches(text, '^[a-zA-Z]\.$|^\d{1,3}[.)]$|^[–—-]$')""")
def word_enumerators(s, d):
    e = _words(s, d).select(*WORD, T.enumerated(F.col("text")).alias("e")).select(*WORD, "e.scheme", "e.value")
    return e.where(F.col("scheme").isin("roman-dot", "alpha-dot", "num-dot", "bullet"))


@plan("roman_numerals", """with n as (select doc_id, 1 + doc_id % 3999 as n from documents)
select doc_id, repeat('M', (n // 1000)::int) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as numeral, n::int as value from n""")
def roman_numerals(s, d):
    return _docs(s, d).select("doc_id", T.to_roman(1 + F.col("doc_id") % 3999).alias("numeral")).withColumn("value", T.roman(F.col("numeral")))


@plan("ligatures", "select doc_id, text as plain, case doc_id % 4 when 0 then 'ﬃ' when 1 then 'ﬁ' when 2 then 'ﬅ' end as of_letters from documents")
def ligatures(s, d):
    joined = F.replace(F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ")), F.lit("ſt"), F.lit("ﬅ"))
    letters = F.element_at(F.array(*map(F.lit, ("ffi", "ﬁ", "ſt", "xy"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(s, d).select("doc_id", T.without_ligatures(joined).alias("plain"), T.ligature_of(letters).alias("of_letters"))


@plan("unescaped_text", "select doc_id, 'A€' || replace(text, chr(173), '-') as text from documents")
def unescaped_text(s, d):
    return _docs(s, d).select("doc_id", T.unescape_xml(F.concat(F.lit("&#x41;&#x20ac;"), T.escape_xml(F.col("text")))).alias("text"))


@plan("font_family_class", """with n as (select doc_id, ['Times New Roman', 'Century Gothic', 'My Sans', 'Wing_dings 2', 'GlyphLessFont', 'Roman', 'Sanserif', 'Old Serif', 'Unknown', 'Gothic', 'default'][doc_id % 11 + 1] as font from documents)
select doc_id, font, ['SerifDefault', 'SerifDefault', 'SansDefault', 'SymbolDefault', 'Default', 'SerifDefault', 'SansDefault', 'SerifDefault', 'Default', 'SansDefault', 'Default'][doc_id % 11 + 1] as class from n""")
def font_family_class(s, d):
    names = ("Times New Roman", "Century Gothic", "My Sans", "Wing_dings 2", "GlyphLessFont", "Roman", "Sanserif", "Old Serif", "Unknown", "Gothic", "default")
    font = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 11 + 1).cast("int"))
    return _docs(s, d).select("doc_id", font.alias("font"), T.font_class(font).alias("class"))


@plan("iso_languages", "select doc_id, case lang when 'en' then 'en-US' when 'de' then 'de-DE' when 'fr' then 'fr-FR' when 'es' then 'es-ES' else 'xyz' end as iso from documents")
def iso_languages(s, d):
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "deu").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "es", "spa").otherwise("xyz")
    return table(s, d, "documents").select("doc_id", T.iso_language(code).alias("iso"))


@plan("model_options", """with o as (select doc_id, case doc_id % 6 when 0 then 'key = a=b' when 1 then 'n=-12.5' when 2 then 'list=a, true,3' when 3 then 'x=null' when 4 then 'no value' else ' =empty key' end as t from documents)
select doc_id, case doc_id % 6 when 0 then 'key' when 1 then 'n' when 2 then 'list' when 3 then 'x' end as key, case doc_id % 6 when 0 then 'text' when 1 then 'number' when 2 then 'text,boolean,number' when 3 then 'null' end as kinds,
  case when doc_id % 6 < 4 then regexp_replace(substr(t, instr(t, '=') + 1), ', ', ',', 'g') end as vals from o""")
def model_options(s, d):
    forms = ("key = a=b", "n=-12.5", "list=a, true,3", "x=null", "no value", " =empty key")
    o = T.option(F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 6 + 1).cast("int")))
    return _docs(s, d).select("doc_id", o.alias("o")).select("doc_id", "o.key", F.array_join("o.kinds", ",").alias("kinds"), F.array_join("o.values", ",").alias("vals"))


@plan("page_ranges", """with r as (select doc_id, doc_id % 5 as a, doc_id % 3 as n from documents)
select doc_id, case when doc_id % 7 <> 6 then array_to_string(list_sort(list_distinct(list_concat(range(a, a + n + 1), [2, 9]))), ',') end as pages from r""")
def page_ranges(s, d):
    a, n = F.col("doc_id") % 5, F.col("doc_id") % 3
    given = F.when(F.col("doc_id") % 7 == 6, "1,x").otherwise(F.concat(a, F.lit("-"), a + n, F.lit(",9,2")))
    return _docs(s, d).select("doc_id", F.array_join(T.page_range(given), ",").alias("pages"))


@plan("folder_problems", """select doc_id, [null, 'slash', 'dot', 'mark', 'end', 'empty', null][doc_id % 7 + 1] as problem from documents""")
def folder_problems(s, d):
    names = ("Fine name", "a/b", ".hidden", "what?", "ends. ", "", "x.y")
    return _docs(s, d).select("doc_id", T.folder_problem(F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 7 + 1).cast("int"))).alias("problem"))


@plan("content_hashes", "select doc_id, left(sha256(text), 16) as hash from documents")
def content_hashes(s, d):
    return _docs(s, d).select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"))


@plan("file_dates", "select doc_id, case when doc_id % 3 = 0 then make_date(2000 + doc_id % 30, 1 + doc_id % 12, 1 + doc_id % 28)::varchar end as day from documents")
def file_dates(s, d):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.format_string("%d-%02d-%02d_scan.pdf", 2000 + i % 30, 1 + i % 12, 1 + i % 28)).when(i % 3 == 1, F.concat(F.lit("scan 2001-01-01 "), i)).otherwise("2001-13-01 x.pdf")
    return _docs(s, d).select("doc_id", F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})[ _]", 1).try_cast("date").cast("string").alias("day"))


@plan("superscripts_apart", W + """, x as (select doc_id, page, line_ix, word_ix, "left", "right", length(text) + 3 as n, length(text) as t, text from words where word_ix % 4 = 0)
select doc_id, page, line_ix, word_ix, unnest([0, 1, 2]) as piece, unnest([text, '12', 'x']) as text, unnest([false, true, false]) as sup,
  unnest([floor("left" + ("right" - "left") / n * 0 + 0.5), floor("left" + ("right" - "left") / n * t + 0.5), floor("left" + ("right" - "left") / n * (t + 2) + 0.5)])::bigint as "left",
  unnest([floor("left" + ("right" - "left") / n * t + 0.5), floor("left" + ("right" - "left") / n * (t + 2) + 0.5), floor("left" + ("right" - "left") / n * (t + 3) + 0.5)])::bigint as "right" from x""")
def superscripts_apart(s, d):
    return edits.superscripts_apart(_words(s, d).where("word_ix % 4 = 0").withColumn("text", F.concat(F.translate("text", T.SUPERSCRIPTS, T.PLAIN), F.lit("¹²x"))))


# Lines and pages.


@plan("line_neighbours", W + _LINES + "select doc_id, page, line_ix, lag(line) over w as previous, lead(line) over w as next from ln window w as (partition by doc_id, page order by line_ix)")
def line_neighbours(s, d):
    return linefacts.neighbours(_lines(s, d))


@plan("leading_numbers", W + _LINES + """, x as (select doc_id, page, line_ix, (line_ix + 1) % 20 as v from ln where line_ix % 3 < 2)
select doc_id, page, line_ix, v::int as value, line_ix % 3 = 1 as standalone from x""")
def leading_numbers(s, d):
    i = F.col("line_ix")
    text = F.when(i % 3 == 0, F.concat(F.lit("·· "), (i + 1) % 20, F.lit("· "), "line")).when(i % 3 == 1, F.concat((i + 1) % 20, F.lit(" ••"))).otherwise(F.concat(F.lit("x"), "line"))
    return _lines(s, d).select("doc_id", "page", "line_ix", linefacts.line_number(text).alias("n")).where("n is not null").select("doc_id", "page", "line_ix", "n.value", "n.standalone")


@plan("numeric_rows", W + _LINES + """, x as (select doc_id, page, line_ix, (doc_id + line_ix) % 5 as k from ln) select doc_id, page, line_ix, k in (0, 4) as numeric_row from x""")
def numeric_rows(s, d):
    forms = ("Total 1,200 $35 (4)", "12 34 apples 56", "1 2 3", "a b c d 1 -x", "Row - 5.0% 7 - 9")
    return _lines(s, d).select("doc_id", "page", "line_ix", linefacts.right_clustered(F.element_at(F.array(*map(F.lit, forms)), ((F.col("doc_id") + F.col("line_ix")) % 5 + 1).cast("int"))).alias("numeric_row"))


@plan("body_sizes", W + """, z as (select doc_id, 8 + (par_id + line_ix) % 4 as size, length(text) as chars from words), b as (select doc_id, size, sum(chars) as chars from z group by all)
select doc_id, coalesce(max(case when chars >= 0.3 * whole then size end), arg_max(size, (chars, -size))) as body_size from (select *, sum(chars) over (partition by doc_id) as whole from b) group by doc_id""")
def body_sizes(s, d):
    return linefacts.body_size(_words(s, d).select("doc_id", (8 + (F.col("par_id") + F.col("line_ix")) % 4).alias("size"), F.length("text").alias("chars")))


@plan("left_clusters", W + """, v as (select doc_id, page, "left" as v, count(*) as n from words group by all), c as (select *, (coalesce(v - lag(v) over w > 25, false))::int as new from v window w as (partition by doc_id, page order by v)),
k as (select *, (sum(new) over (partition by doc_id, page order by v))::bigint as cluster from c) select doc_id, page, cluster, sum(v * n) / sum(n) as centre, sum(n)::bigint as n from k group by all""")
def left_clusters(s, d):
    return linefacts.clusters(_words(s, d), ["doc_id", "page"], "left", 25)


@plan("width_quantiles", W + """, v as (select doc_id, page, list_sort(list("right" - "left")) as w from words group by all) select doc_id, page, w[len(w) // 4 + 1] as quarter, w[len(w) * 3 // 4 + 1] as three_quarters, w[len(w) + 1] as beyond from v""")
def width_quantiles(s, d):
    v = _words(s, d).groupBy("doc_id", "page").agg(F.collect_list(F.col("right") - F.col("left")).alias("w"))
    return v.select("doc_id", "page", *(T.quantile(F.col("w"), q).alias(n) for q, n in ((0.25, "quarter"), (0.75, "three_quarters"), (1.0, "beyond"))))


@plan("page_angles", W + _LINES + """, s as (select doc_id, page, list_sort(list(((line_ix * 7 + doc_id) % 11 - 5) / 1000) filter ("right" - "left" >= 200)) as s from ln group by doc_id, page)
select doc_id, page, round(case when s is null or len(s) = 0 then 0 else degrees(asin(case when len(s) < 4 then list_max(s) else list_avg(s[len(s) // 4 - 1 + 1 : least(len(s), ceil(len(s) * 3 / 4)::bigint + 1)]) end)) end, 6) as angle from s""")
def page_angles(s, d):
    slope = ((F.col("line_ix") * 7 + F.col("doc_id")) % 11 - 5) / F.lit(1000.0)
    angle = linefacts.page_angle(_lines(s, d).select("doc_id", "page", (F.col("right") - F.col("left")).alias("width"), slope.alias("slope")))
    return angle.withColumn("angle", F.round("angle", 6))


@plan("line_heights", W + """, c as (select doc_id, page, line_ix, word_ix, unnest(string_split(text, '')) as ch from words), h as (select *, 16 - case when unicode(ch) < 128 then unicode(ch) % 5 else unicode(ch) % 5 end as h from c),
g as (select doc_id, page, line_ix, list_sort(list(h) filter (instr('ABCDEFGHIKLMNOPRSTUVWXYZbdhklt0123456789', ch) > 0)) as a, list_sort(list(h) filter (instr('acemnorsuvwxz', ch) > 0)) as x from h group by all)
select doc_id, page, line_ix, a[len(a) // 2 + 1]::bigint as ascender, x[len(x) // 2 + 1]::bigint as x_height from g""")
def line_heights(s, d):
    return linefacts.letter_heights(layout.chars(_docs(s, d)))


@plan("monospaced", W + """, c as (select doc_id, word_ix, unnest(range(len(string_split(text, '')))) as i, unnest(string_split(text, '')) as ch from words),
k as (select doc_id, ch, avg(10 - (i * 3 + word_ix) % 3) as width, count(*) as obs from c group by doc_id, ch)
select doc_id, coalesce(avg(width) filter (ch in ('i', 'l') and obs >= 5) / avg(width) filter (ch in ('m', 'w') and obs >= 5) > 0.7, false) as monospaced from k group by doc_id""")
def monospaced(s, d):
    c = layout.chars(_docs(s, d)).groupBy("doc_id", "ch").agg(F.avg(F.col("right") - F.col("left")).alias("width"), F.count("*").alias("obs"))
    return linefacts.monospaced(c)


@plan("sampled_pages", W + """, p as (select doc_id, page, count(*) as n_words from words group by all), c as (select *, coalesce(sum(n_words) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0)::bigint as seen from p)
select doc_id, page, n_words, seen from c where seen <= 500""")
def sampled_pages(s, d):
    return linefacts.sampled_pages(_words(s, d).groupBy("doc_id", "page").agg(F.count("*").alias("n_words")))


@plan("overview", W + _LINES + "select doc_id, count(distinct page) as pages, count(*) as lines, sum(n_words)::bigint as words, count_if(n_words <= 3) as short_lines from ln group by doc_id")
def overview(s, d):
    l = _lines(s, d).select("doc_id", "page", F.size(F.split("line", " ")).alias("n"))  # noqa: E741
    by_page = l.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum("n").alias("words"), F.count_if(F.col("n") <= 3).alias("short"))
    return by_page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.sum("short").alias("short_lines"))


@plan("word_languages", W + """, l as (select distinct doc_id, case when regexp_extract(text, '([\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{0400}-\\x{052F}])', 1) = '' then 'eng' when regexp_matches(regexp_extract(text, '([\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{0400}-\\x{052F}])', 1), '[\\x{0400}-\\x{052F}]') then 'rus' else 'chi_sim' end as lang from words)
select doc_id, string_agg(lang, ',' order by lang) as langs from l group by doc_id""")
def word_languages(s, d):
    return _words(s, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(T.language(F.col("text")))), ",").alias("langs"))


@plan("word_geometry", W + """select doc_id, page, line_ix, word_ix, floor("left" * 1.5 * 1000 + 0.5) / 1000 as scaled_left, least("right", 400) - greatest("left", 100) as shared,
  case when least("right", 400) > greatest("left", 100) then (least("right", 400) - greatest("left", 100)) / ("right" - "left") else 0 end::double as horizontal,
  case when least("right", 400) > greatest("left", 100) and least(bottom, 200) > top then (least("right", 400) - greatest("left", 100)) * (least(bottom, 200) - greatest(top, 60))::double / least(("right" - "left") * 16, 42000) else 0 end::double as smaller,
  case word_ix % 4 when 1 then 1200 - bottom when 2 then 1200 - "right" when 3 then top else "left" end as page_left, case word_ix % 4 when 1 then "left" when 2 then 1050 - bottom when 3 then 1050 - "right" else top end as page_top
from words where top >= 60""")
def word_geometry(s, d):
    w = _words(s, d).where("top >= 60").select(*WORD, *(F.col(c).alias(f"x_{c}") for c in edits.BOX), F.struct(*edits.BOX).alias("a"), F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(edits.BOX, (100, 60, 400, 200)))).alias("b"))
    box = G.to_page(F.col("word_ix") % 4, *(F.col(f"x_{c}") for c in edits.BOX), F.lit(1200), F.lit(1050))
    return w.select(
        *WORD, G.rounded(F.col("x_left") * 1.5, 3).alias("scaled_left"), (F.least("a.right", "b.right") - F.greatest("a.left", "b.left")).alias("shared"), G.horizontal_overlap("a", "b").alias("horizontal"),
        G.overlap_of_smaller("a", "b").cast("double").alias("smaller"), box["left"].alias("page_left"), box["top"].alias("page_top"),
    )


# Words: edits, marks, quotes.

_MARKS = """, marks as (select distinct doc_id, page, 'g' || page % 2 as grp from words)"""


def _marks(s, d):
    return _pg(s, d).select("doc_id", "page", F.concat(F.lit("g"), F.col("page") % 2).alias("group"), *(F.lit(v).cast("long").alias(c) for c, v in zip(edits.BOX, (95, 45, 420, 130))))


@plan("words_deleted", W + """select doc_id, page, line_ix, count(*) as n_words, string_agg(text, ' ' order by word_ix) as line, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom
from words where (doc_id + line_ix + word_ix) % 3 <> 0 group by doc_id, page, line_ix""")
def words_deleted(s, d):
    w = _words(s, d)
    return edits.line_boxes(edits.without_words(w, w.where((F.col("doc_id") + F.col("line_ix") + F.col("word_ix")) % 3 == 0)))


@plan("words_by_id", W + "select doc_id, page, line_ix, word_ix, text from words where line_ix = doc_id % 7 and word_ix = page % 5")
def words_by_id(s, d):
    w = _words(s, d)
    ids = _pg(s, d).select("doc_id", "page", (F.col("doc_id") % 7).alias("line_ix"), (F.col("page") % 5).alias("word_ix"))
    return w.join(ids, WORD, "left_semi").select(*WORD, "text")


@plan("lines_edited", W + _LINES + """select doc_id, page, line_ix, case when line_ix % 5 = 3 then 'line ' || line_ix || ' anew' else line end as line from ln where line_ix % 5 <> 2""")
def lines_edited(s, d):
    l = _lines(s, d).select("doc_id", "page", "line_ix", "line")  # noqa: E741
    changes = l.where("line_ix % 5 in (2, 3)").select("doc_id", "page", "line_ix", F.when(F.col("line_ix") % 5 == 3, F.concat(F.lit("line "), "line_ix", F.lit(" anew"))).alias("text"))
    return edits.edited_lines(l, changes)


@plan("region_text", W + """, r as (select * from words where "left" < 400 and "right" > 100 and top < 200 and bottom > 60), l as (select doc_id, page, line_ix, string_agg(text, ' ' order by word_ix) as line from r group by all)
select doc_id, page, string_agg(line, chr(10) order by line_ix) as text from l group by all""")
def region_text(s, d):
    boxes = _pg(s, d).select("doc_id", "page", *(F.lit(v).cast("long").alias(c) for c, v in zip(edits.BOX, (100, 60, 400, 200))))
    return edits.touched_text(_words(s, d), boxes, ["doc_id", "page"])


@plan("highlight_words", W + """select doc_id, page, line_ix, word_ix, 'g' || page % 2 as "group", text from words where "left" >= 95 and "right" <= 420 and top >= 45 and bottom <= 130""")
def highlight_words(s, d):
    return edits.marked_words(_words(s, d), _marks(s, d))


@plan("highlight_sheet", W + """, m as (select * from words where "left" >= 95 and "right" <= 420 and top >= 45 and bottom <= 130), l as (select doc_id, page, line_ix, string_agg(text, ' ' order by word_ix) as line from m group by all)
select doc_id, page, 'g' || page % 2 as "group", string_agg(line, chr(10) order by line_ix) as text from l group by all""")
def highlight_sheet(s, d):
    return edits.joined_text(edits.marked_words(_words(s, d), _marks(s, d)), ["doc_id", "page", "group"])


_QUOTE = W + """, q as (select *, lead(text) over w as t2, lead(line_ix) over w as l2, lead(word_ix) over w as w2, lead("left") over w as left2, lead("right") over w as right2 from words window w as (partition by doc_id, page order by line_ix, word_ix)),
hit as (select * from q where text = 'of' and t2 = 'the')"""


@plan("exact_quotes", _QUOTE + "select doc_id, page, count(*) as found, case when count(*) = 1 then min(line_ix) end as start_line from hit group by all")
def exact_quotes(s, d):
    return edits.resolved_quotes(edits.apart(edits.runs_of(_words(s, d), "of the"), 2))


@plan("repeated_quotes", W + """, x as (select doc_id, page, line_ix, word_ix, case when conf % 2 = 0 then 'same' else text end as text from words), r as (select *, row_number() over w as ix from x window w as (partition by doc_id, page order by line_ix, word_ix)),
h as (select *, ix - row_number() over (partition by doc_id, page order by ix) as run from r where text = 'same'), c as (select doc_id, page, run, count(*) // 2 as n from h group by all) select doc_id, page, sum(n)::bigint as found from c group by all having sum(n) > 0""")
def repeated_quotes(s, d):
    w = _words(s, d).withColumn("text", F.when(F.col("conf") % 2 == 0, "same").otherwise(F.col("text")))
    return edits.resolved_quotes(edits.apart(edits.runs_of(w, "same same"), 2)).select("doc_id", "page", "found")


@plan("match_cursors", _QUOTE + """, c as (select doc_id, page, line_ix, word_ix, row_number() over (partition by doc_id order by page, line_ix, word_ix) - 1 as "at", count(*) over (partition by doc_id) as n from hit)
select doc_id, page, line_ix, word_ix, "at", ("at" + 1) % n as next, ("at" - 1 + n) % n as previous from c""")
def match_cursors(s, d):
    return edits.cursors(edits.runs_of(_words(s, d), "of the"))


@plan("redaction_groups", _QUOTE + """, g as (select *, row_number() over (partition by doc_id, page order by line_ix, word_ix) - 1 as grp from hit),
p as (select doc_id, page, grp, line_ix, "left", "right" from g union all select doc_id, page, grp, l2, left2, right2 from g)
select doc_id, page, grp as "group", line_ix, min("left") as "left", 30 + 20 * line_ix as top, max("right") as "right", 46 + 20 * line_ix as bottom from p group by all""")
def redaction_groups(s, d):
    return edits.redaction_groups(edits.runs_of(_words(s, d), "of the"))


@plan("query_mark_rects", W + """, t as (select *, regexp_replace(lower(text), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') as said from words), k as (select * from t where said <> ''),
q as (select *, lead(said) over w as s2, lead(line_ix) over w as l2, lead(word_ix) over w as w2 from k window w as (partition by doc_id, page order by line_ix, word_ix))
select doc_id, page, line_ix, word_ix, l2 as end_line, w2 as end_word, round("left" / 1200, 6) as x, round(top / 1050, 6) as y from q where said = 'of' and starts_with(s2, 't')""")
def query_mark_rects(s, d):
    runs = edits.runs_of(_words(s, d), "of t", loose=True)
    first = F.get("parts", 0)
    return runs.select(*WORD, "end_line", "end_word", F.round(first["left"] / F.lit(1200.0), 6).alias("x"), F.round(first["top"] / F.lit(1050.0), 6).alias("y"))


@plan("verified_ranges", W + """, a as (select doc_id, page, regexp_replace(string_agg(text, ' ' order by line_ix, word_ix), '\\s+', ' ', 'g') as t from words where line_ix between 2 and 4 group by all),
b as (select doc_id, page, regexp_replace(string_agg(text, ' ' order by line_ix, word_ix), '\\s+', ' ', 'g') as t from words_b where line_ix between 2 and 4 group by all)
select doc_id, page, coalesce(a.t = b.t, false) as verified from a left join b using (doc_id, page)""")
def verified_ranges(s, d):
    said = lambda w: edits.joined_text(w.where("line_ix between 2 and 4"), ["doc_id", "page"]).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    docs = _docs(s, d)
    return said(layout.words(docs)).join(said(layout.words_b(docs)).withColumnRenamed("text", "quote"), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(F.col("text") == F.col("quote"), F.lit(False)).alias("verified"))


_LOOSE = r"lower(regexp_replace({}, '(^|[^0-9])[^A-Za-z0-9]($|[^0-9])', '\1\2', 'g'))"


@plan("eval_doc_loose", W + PAIRS.format(other="words_b").replace("a.text = b.text as same", f"{_LOOSE.format('a.text')} = {_LOOSE.format('b.text')} as same") + METRICS.format(other="words_b", by="doc_id,", group="group by doc_id"))
def eval_doc_loose(s, d):
    return beside.evaluate(_docs(s, d), columns.words_b, ["doc_id"], T.loose_text)


# Pages and outlines.

_PG = W + ", pg as (select distinct doc_id, page from words)"


@plan("pages_duplicated", _PG + """, b as (select *, page + coalesce(count_if(page % 3 = 1) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as place from pg)
select doc_id, page as old, place as new from b union all select doc_id, page, place + 1 from b where page % 3 = 1""")
def pages_duplicated(s, d):
    return edits.duplication(_pg(s, d), F.col("page") % 3 == 1)


@plan("pages_picked", _PG + """, o as (select unnest([0, 1, 2, 3]) as place, unnest([3, 0, 0, 1]) as page) select doc_id, page as old, row_number() over (partition by doc_id order by place) - 1 as new from pg join o using (page)""")
def pages_picked(s, d):
    return edits.picked(_pg(s, d), [3, 0, 0, 1])


@plan("pages_rotated", _PG + "select doc_id, page, (90 * (page % 4) + 270) % 360 as rotation from pg")
def pages_rotated(s, d):
    return _pg(s, d).select("doc_id", "page", ((90 * (F.col("page") % 4) + 270) % 360).alias("rotation"))


_MERGED = """, pc as (select doc_id, max(page) + 1 as page_count from words group by doc_id), off as (select doc_id // 10 as into_file, doc_id, coalesce(sum(page_count) over (partition by doc_id // 10 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as off from pc)"""


def _offsets(s, d):
    counts = _pg(s, d).groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))
    return edits.merged(counts, F.floor(F.col("doc_id") / 10))


@plan("merged_documents", W + _MERGED + "select into_file as \"into\", doc_id, off as \"offset\" from off")
def merged_documents(s, d):
    return _offsets(s, d)


@plan("joined_outlines", _HEADS + _MERGED + """select into_file as "into", doc_id, node, level + 1 as level, title, page + off as page from heads join off using (doc_id)
union all select into_file, doc_id, -1, 1, 'Document ' || doc_id, off from off""")
def joined_outlines(s, d):
    return edits.joined_outlines(_heads(s, d), _offsets(s, d))


@plan("links_remapped", _PG + """, pm as (select doc_id, page as old, row_number() over (partition by doc_id order by page) - 1 as new from pg where page % 3 <> 1)
select p.doc_id, a.new as page, b.new as dest from pg p join pm a on a.doc_id = p.doc_id and a.old = p.page join pm b on b.doc_id = p.doc_id and b.old = (p.page * 5 + 2) % 4""")
def links_remapped(s, d):
    links = _pg(s, d).select("doc_id", "page", ((F.col("page") * 5 + 2) % 4).alias("dest"))
    return edits.remapped_links(links, document.deletion(_pg(s, d), F.col("page") % 3 == 1))


@plan("bookmarks_curated", _HEADS + """, h as (select doc_id, row_number() over (partition by doc_id order by node) - 1 as ix, level, title from heads),
k as (select doc_id, unnest(range(6)) as place, (unnest(range(6)) * 7 + doc_id) % 9 as ix from (select distinct doc_id from heads)),
f as (select doc_id, ix, min(place) as place from k group by all)
select doc_id, ix, case when place * 3 between 1 and 9 then place * 3 else level end as level, case when place % 2 = 0 then 'kept ' || place else title end as title from h join f using (doc_id, ix)""")
def bookmarks_curated(s, d):
    heads = _heads(s, d)
    h = heads.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1).cast("long").alias("ix"), "level", "title")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("place")
    keep = heads.select("doc_id").distinct().select("doc_id", place).select(
        "doc_id", "place", ((F.col("place") * 7 + F.col("doc_id")) % 9).alias("ix"), (F.col("place") * 3).alias("level"), F.when(F.col("place") % 2 == 0, F.concat(F.lit("kept "), "place")).otherwise("").alias("title")
    )
    return edits.curated(h, keep)


# A library.

_LIB = """with lib as (select doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/Doc ' || (doc_id * 7) % 50 || case when doc_id % 4 = 0 then '.PDF' else '.pdf' end as rel_path, (doc_id * 37) % 101 as added, case when doc_id % 5 = 0 then 0 else (doc_id * 13) % 97 end as last_opened,
  case when doc_id % 3 <> 0 then (doc_id * 11) % 20 end as ord, left(sha256(text), 16) as hash from documents),
e as (select *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) as folder, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '(?i)\\.pdf$', '') as title from lib)"""


def _library(s, d):
    i = F.col("doc_id")
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")), F.concat(F.lit("Doc "), i * 7 % 50, F.when(i % 4 == 0, ".PDF").otherwise(".pdf")))
    return table(s, d, "documents").select(
        "doc_id", name.alias("rel_path"), (i * 37 % 101).alias("added"), F.when(i % 5 == 0, 0).otherwise(i * 13 % 97).alias("last_opened"), F.when(i % 3 != 0, i * 11 % 20).alias("ord"), F.left(F.sha2("text", 256), F.lit(16)).alias("hash")
    )


for _mode, _key, _down, _sql in (
    ("name", lambda: T.title_of(F.col("rel_path")), False, "title asc nulls last"), ("added", lambda: F.col("added"), True, "added desc nulls first"),
    ("opened", lambda: F.col("last_opened"), True, "last_opened desc nulls first"), ("custom", lambda: F.col("ord"), False, "ord asc nulls last"),
):
    plan(f"library_by_{_mode}", _LIB + f"select folder, doc_id, title, row_number() over (partition by folder order by {_sql}, title, rel_path, doc_id) as place from e")(
        lambda s, d, k=_key, down=_down: library.listed(_library(s, d), k(), down).select("folder", "doc_id", T.title_of(F.col("rel_path")).alias("title"), "place")
    )


@plan("library_filter", _LIB + "select doc_id, rel_path from e where contains(lower(rel_path), 'doc 1')")
def library_filter(s, d):
    return library.filtered(_library(s, d), " DOC 1").select("doc_id", "rel_path")


@plan("recent_files", _LIB + "select doc_id, last_opened from e where last_opened > 0 order by last_opened desc, doc_id limit 5")
def recent_files(s, d):
    return library.recent(_library(s, d)).select("doc_id", "last_opened")


_HITS = W + """, hits as (select doc_id, page, count_if(regexp_replace(lower(text), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') = 'the') as n from words group by all)"""


def _hits(s, d):
    return _words(s, d).groupBy("doc_id", "page").agg(F.count_if(T.trimmed_edges(F.col("text")) == "the").alias("n"))


@plan("library_ranked_hits", _HITS + """, best as (select doc_id, sum(n)::bigint as total from hits where n > 0 group by doc_id order by total desc, doc_id limit 20)
select doc_id, total, page, n from hits join best using (doc_id) where n > 0 qualify row_number() over (partition by doc_id order by page) <= 4""")
def library_ranked_hits(s, d):
    return library.ranked_hits(_hits(s, d))


@plan("library_totals", _HITS + "select sum(n)::bigint as matches, count(distinct doc_id) as documents from hits where n > 0")
def library_totals(s, d):
    by_doc = _hits(s, d).where("n > 0").groupBy("doc_id").agg(F.sum("n").alias("n"))
    return by_doc.agg(F.sum("n").alias("matches"), F.count("*").alias("documents"))


_INDEX = W + """, p as (select distinct doc_id, page, lower(text) as token from words where length(text) >= 2), q as (select distinct doc_id, page, lower(text) as token from words_b where length(text) >= 2 and doc_id % 7 = 0),
r as (select * from p where doc_id % 7 not in (0, 3) union all select * from q)"""


def _replaced(s, d):
    docs = _docs(s, d)
    token = lambda w: w.where(F.length("text") >= 2).select(T.lower_each(F.col("text")).alias("token"), "doc_id", "page").distinct()
    return library.replaced(token(layout.words(docs)), token(layout.words_b(docs).where("doc_id % 7 = 0")), docs.where("doc_id % 7 in (0, 3)"))


@plan("index_replaced", _INDEX + "select token, doc_id, page from r")
def index_replaced(s, d):
    return _replaced(s, d)


@plan("index_compacted", _INDEX + """, d as (select doc_id, row_number() over (order by doc_id % 7 = 0, doc_id) - 1 as slot from (select distinct doc_id from documents where doc_id % 7 <> 3)),
e as (select token, slot // 65536 as block, slot, page from r join d using (doc_id))
select 'docs' as part, '' as token, slot // 65536 as block, count(*) as n_docs, null::bigint as n_pages, '[' || string_agg(doc_id::varchar, ',' order by slot) || ']' as entries from d group by all
union all select 'vocab', token, block, count(distinct slot), count(*), '[' || string_agg('[' || slot || ',' || page || ']', ',' order by slot, page) || ']' from e group by token, block""")
def index_compacted(s, d):
    left = _docs(s, d).where("doc_id % 7 <> 3").select("doc_id", (F.col("doc_id") % 7 == 0).alias("later"), "text")
    return library.compacted(left, columns.words_b)


@plan("artifact_sweep", _LIB + "select distinct hash from e where hash not in (select hash from e where doc_id % 3 <> 0)")
def artifact_sweep(s, d):
    lib = _library(s, d)
    return library.unreferenced(lib.select("hash").distinct(), lib.where("doc_id % 3 <> 0"))


@plan("free_names", _LIB + """, n as (select *, regexp_extract(rel_path, '([^/]*)$', 1) as name, row_number() over (partition by folder, regexp_extract(rel_path, '([^/]*)$', 1) order by doc_id) as nth from e)
select doc_id, folder, case when nth = 1 then name else left(name, -4) || ' (' || nth || ')' || right(name, 4) end as free from n""")
def free_names(s, d):
    names = _library(s, d).select("doc_id", library.folder_of(F.col("rel_path")).alias("folder"), F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"), F.col("doc_id").alias("ord"))
    return library.free_names(names).select("doc_id", "folder", "free")


@plan("batch_extract", """with f as (select doc_id, case when doc_id % 9 = 0 then 'sameAsInput' when doc_id % 4 = 0 then 'exists' when n_chars < 300 then 'imageBased' else 'extracted' end as status from documents)
select status, count(*) as n from f group by status""")
def batch_extract(s, d):
    i = F.col("doc_id")
    files = table(s, d, "documents").select("doc_id", F.concat(i, F.when(i % 9 == 0, ".txt").otherwise(".pdf")).alias("path"), F.concat(i, F.lit(".txt")).alias("output"), (F.col("n_chars") >= 300).alias("text_like"))
    return library.batch_status(files, files.where("doc_id % 4 = 0")).groupBy("status").agg(F.count("*").alias("n"))
