"""The queries of the document engine over the laid out tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import beside, classify, compare, document, layers, render, search, structure
from ..operators.stats import kernings, weighted_upper_median
from ..sources import columns, formats, layout, markup
from ..sources.layout import SQL as W
from ..sources.layout import table
from ..streaming import results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return layout.words(_docs(spark, d))


KEY = "doc_id, page, line_ix, word_ix"

# Layers and their comparison.

for _n, _f in (("doc_words", layout.words), ("doc_words_b", layout.words_b), ("doc_words_c", layout.words_c), ("doc_words_d", layout.words_d)):
    _cols = 'doc_id, page, line_ix, word_ix, text, "left", top, "right", bottom, conf'
    plan(_n, W + f"select {_cols} from {_n.replace('doc_', '')}")(lambda s, d, f=_f: f(_docs(s, d)).select("doc_id", "page", "line_ix", "word_ix", "text", "left", "top", "right", "bottom", "conf"))

PAIRS = """, a_bands as (select *, unnest(range((top + 2) // 64, (bottom - 2) // 64 + 1)) as band from words), b_bands as (select *, unnest(range((top + 2) // 64, (bottom - 2) // 64 + 1)) as band from {other}),
pairs as (
  select a.doc_id, a.page, a.line_ix as a_line, a.word_ix as a_word, b.line_ix as b_line, b.word_ix as b_word, a.text = b.text as same, a.text as a_text, b.text as b_text, a.conf as a_conf,
    a."left" as a_left, a."right" as a_right, b."left" as b_left, b."right" as b_right
  from a_bands a join b_bands b on a.doc_id = b.doc_id and a.page = b.page and a.band = b.band and a.band = greatest((a.top + 2) // 64, (b.top + 2) // 64)
    and a."left" <= b."right" and b."left" <= a."right" and a.top + 2 <= b.bottom - 2 and b.top + 2 <= a.bottom - 2)
"""
METRICS = """, of_b as (select doc_id, page, b_line, b_word, bool_or(same) as ok, bool_or(a_conf <= 75) as low, bool_or(a_conf > 85) as high from pairs group by all),
of_a as (select doc_id, page, a_line, a_word from pairs group by all),
m as (
  select doc_id, page, 1 as total, 0 as words, 0 as met, 0 as ok, 0 as low, 0 as high, 0 as used from {other}
  union all select doc_id, page, 0, 1, 0, 0, 0, 0, 0 from words
  union all select doc_id, page, 0, 0, 1, ok::int, (ok and low)::int, (not ok and high)::int, 0 from of_b
  union all select doc_id, page, 0, 0, 0, 0, 0, 0, 1 from of_a)
select {by} sum(total)::bigint as total, sum(ok)::bigint as correct, (sum(met) - sum(ok))::bigint as incorrect, (sum(total) - sum(met))::bigint as missed, (sum(words) - sum(used))::bigint as extra,
  sum(low)::bigint as correct_low_conf, sum(high)::bigint as incorrect_high_conf from m {group}"""


def _layers(s, d, other):
    docs = _docs(s, d)
    return layout.words(docs), other(docs)


for _n, _other, _sql in (("", columns.words_b, "words_b"), ("_c", columns.words_c, "words_c"), ("_d", columns.words_d, "words_d")):
    for _level, _by in (("doc", ["doc_id"]), ("page", ["doc_id", "page"])):
        plan(f"eval_{_level}{_n}", W + PAIRS.format(other=_sql) + METRICS.format(other=_sql, by=", ".join(_by) + ",", group="group by " + ", ".join(_by)))(
            lambda s, d, o=_other, by=_by: beside.evaluate(_docs(s, d), o, by)
        )


@plan("eval_corpus", W + PAIRS.format(other="words_b") + METRICS.format(other="words_b", by="", group=""))
def eval_corpus(s, d):
    return beside.evaluate(_docs(s, d), columns.words_b, [])


@plan("overlap_pairs", W + PAIRS.format(other="words_b") + "select doc_id, page, a_line, a_word, b_line, b_word, same from pairs")
def overlap_pairs(s, d):
    return compare.pairs(*_layers(s, d, layout.words_b)).select("doc_id", "page", "a_line", "a_word", "b_line", "b_word", "same")


@plan("match_flags", W + PAIRS.format(other="words_b") + f""", f as (select doc_id, page, a_line, a_word, bool_or(same) as m from pairs group by all)
select w.doc_id, w.page, w.line_ix, w.word_ix, m is not null as compared, coalesce(m, false) as matched, case when coalesce(m, false) then 100 else 0 end as new_conf
from words w left join f on w.doc_id = f.doc_id and w.page = f.page and w.line_ix = a_line and w.word_ix = a_word""")
def match_flags(s, d):
    return compare.match_flags(*_layers(s, d, layout.words_b))


@plan("one_to_one_pairs", W + PAIRS.format(other="words_d") + "select doc_id, page, a_line, a_word, b_line, b_word from pairs where abs(a_left - b_left) + abs(a_right - b_right) < 0.1 * (a_right - a_left)")
def one_to_one_pairs(s, d):
    p = compare.pairs(*_layers(s, d, layout.words_d))
    return p.where(compare.one_to_one(p)).select("doc_id", "page", "a_line", "a_word", "b_line", "b_word")


@plan("k_to_one_pairs", W + """, two as (
  select * from (select doc_id, page, line_ix, word_ix, text || lead(text) over l as text, "left", lead("right") over l as "right", top, bottom from words window l as (partition by doc_id, page, line_ix order by word_ix)) where "right" is not null)
select a.doc_id, a.page, a.line_ix as a_line, a.word_ix as a_word, b.line_ix as b_line, b.word_ix as b_word, a.text as a_text, b.text as b_text, a.text = b.text as same
from two a join words_d b on a.doc_id = b.doc_id and a.page = b.page and a."left" <= b."right" and b."left" <= a."right" and a.top + 2 <= b.bottom - 2 and b.top + 2 <= a.bottom - 2
where abs(a."left" - b."left") + abs(a."right" - b."right") < 0.1 * (a."right" - a."left")""")
def k_to_one_pairs(s, d):
    return compare.several_to_one(*_layers(s, d, layout.words_d))


@plan("k_to_one_pairs_all")
def k_to_one_pairs_all(s, d):
    return beside.k_to_one(_docs(s, d), columns.words_e)


_ASSIGNED = """, cover as (
  select '{o}' as layer, b.doc_id, b.page, b.line_ix as o_line, b.word_ix as o_word, b.text as o_text, b."left" as o_left, a.line_ix, a.word_ix,
    greatest(0, least(a."right", b."right") - greatest(a."left", b."left")) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) / ((b."right" - b."left") * (b.bottom - b.top))::double as c
  from words a join {o} b on a.doc_id = b.doc_id and a.page = b.page and a."left" <= b."right" and b."left" <= a."right" and a.top <= b.bottom and b.top <= a.bottom),
assigned as (select * from cover where c >= 0.5 qualify row_number() over (partition by doc_id, page, o_line, o_word order by c desc, line_ix, word_ix) = 1)"""


@plan("assigned_words", W + _ASSIGNED.format(o="words_d") + "select doc_id, page, o_line, o_word, line_ix, word_ix, o_text, o_left from assigned")
def assigned_words(s, d):
    return beside.assigned(_docs(s, d), columns.words_d)


_VOTES = W + "".join(_ASSIGNED.format(o=o).replace("cover as", f"cover_{o} as").replace("from cover ", f"from cover_{o} ").replace("assigned as", f"assigned_{o} as") for o in ("words_b", "words_c", "words_d")) + """,
votes as (select layer, doc_id, page, line_ix, word_ix, string_agg(o_text, '' order by o_left, o_line, o_word) as vote
  from (select * from assigned_words_b union all select * from assigned_words_c union all select * from assigned_words_d) group by layer, doc_id, page, line_ix, word_ix),
counts as (select doc_id, page, line_ix, word_ix, vote, count(*) as n from votes group by all),
top as (select doc_id, page, line_ix, word_ix, max(n) as most, count_if(n = m) as ties, arg_max(vote, (n, vote)) as vote from (select *, max(n) over (partition by doc_id, page, line_ix, word_ix) as m from counts) group by all),
voted as (
  select w.doc_id, w.page, w.line_ix, w.word_ix, case when coalesce(c.n, 0) = 0 and most >= 2 and ties = 1 then t.vote else w.text end as text,
    case when coalesce(c.n, 0) = 3 then 100 when coalesce(c.n, 0) > 0 then 80 else 50 end as conf, w.text as old
  from words w left join top t using (doc_id, page, line_ix, word_ix)
  left join counts c on c.doc_id = w.doc_id and c.page = w.page and c.line_ix = w.line_ix and c.word_ix = w.word_ix and c.vote = w.text)
"""


_OTHERS = [columns.words_b, columns.words_c, columns.words_d]


@plan("consensus_words", _VOTES + "select doc_id, page, line_ix, word_ix, text, conf, text <> old as replaced from voted")
def consensus_words(s, d):
    return beside.consensus(_docs(s, d), _OTHERS)


@plan("consensus_stats", _VOTES + "select doc_id, count(*) as total, count_if(conf = 100) as high, count_if(conf = 80) as medium, count_if(conf = 50) as low, count_if(text <> old) as replaced from voted group by doc_id")
def consensus_stats(s, d):
    return beside.consensus_stats(_docs(s, d), _OTHERS)


# Confidence, characters, types.


@plan("conf_summary", W + "select doc_id, count(*) as total, count_if(conf > 85) as high_conf from words group by doc_id")
def conf_summary(s, d):
    return _words(s, d).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("conf") > 85).alias("high_conf"))


@plan("conf_bands", W + "select doc_id, case when conf > 85 then 'high' when conf > 75 then 'medium' else 'low' end as band, count(*) as n from words group by all")
def conf_bands(s, d):
    band = F.when(F.col("conf") > 85, "high").when(F.col("conf") > 75, "medium").otherwise("low")
    return _words(s, d).groupBy("doc_id", band.alias("band")).agg(F.count("*").alias("n"))


@plan("page_char_stats", W + """, c as (select doc_id, page, unicode(unnest(string_split(text, ''))) as code from words)
select doc_id, page, count_if(code between 33 and 127 or (code >= 161 and not code between 57344 and 63743 and code <> 65533)) as printable, count_if(code between 57344 and 63743) as private, count_if(code < 32 or code = 65533) as control, count(*) as chars from c group by doc_id, page""")
def page_char_stats(s, d):
    return classify.char_kinds(_words(s, d), ["doc_id", "page"])


def _stats(s, d):
    return classify.page_stats(_words(s, d))


def _types(s, d):
    st = _stats(s, d)
    return st, classify.document_type(st, st.groupBy("doc_id").agg(F.count("*").alias("page_count")))


_S = W + classify.STATS_SQL


@plan("page_stats", _S + "select * from page_stats")
def page_stats(s, d):
    return _stats(s, d)


@plan("doc_type", _S + "select doc_id, page_count, type from types")
def doc_type(s, d):
    return _types(s, d)[1]


_FULL, _SCAN, _LAYER, _BROKEN = "largest_image_frac >= 0.95", "(largest_image_frac >= 0.95 and visible_readable_chars < 100)", "(largest_image_frac >= 0.95 and invisible_text_chars >= 100)", "longest_broken_run >= 3"
_BAKED = "(largest_image_frac >= 0.1 or path_text_candidates >= 8 or image_text_candidates >= 8)"


@plan("page_predicates", _S + f"""select doc_id, page, {_FULL} as full_page_image, visible_readable_chars >= 100 as readable, {_SCAN} as scan, {_LAYER} as has_ocr_layer, {_BROKEN} as broken_run, {_BAKED} as baked_text,
largest_image_frac < 0.02 and visible_chars = 0 and invisible_text_chars = 0 as empty, body_readable_chars >= 100 as real_text, {_SCAN} or longest_broken_run >= 100 as scan_or_unreadable from page_stats""")
def page_predicates(s, d):
    return _stats(s, d).select("doc_id", "page", *(c.alias(n) for n, c in classify.predicates().items()))


@plan("ocr_page_mask_deep", _S + f"select doc_id, page, type <> 'text' or {_BROKEN} or case when {_SCAN} then true else {_BAKED} end as recognise from page_stats join types using (doc_id)")
def ocr_page_mask_deep(s, d):
    return classify.select_pages(*_types(s, d), "autoDeep")


@plan("ocr_page_mask_shallow", _S + f"select doc_id, page, type = 'image' or (({_SCAN} or longest_broken_run >= 100) and not {_LAYER}) as recognise from page_stats join types using (doc_id)")
def ocr_page_mask_shallow(s, d):
    return classify.select_pages(*_types(s, d), "autoShallow", trust=True)


@plan("requires_ocr", _S + f"select doc_id, bool_or({_BAKED} or {_BROKEN} or {_SCAN}) as requires_ocr from page_stats group by doc_id")
def requires_ocr(s, d):
    return classify.needs_recognition(_stats(s, d))


# Text functions.


@plan("lang_detect", """select doc_id, case when f = '' then 'eng' when regexp_matches(f, '[\\x{0400}-\\x{052F}]') then 'rus' else 'chi_sim' end as lang
from (select doc_id, regexp_extract(text, '([\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{0400}-\\x{052F}])', 1) as f from documents)""")
def lang_detect(s, d):
    return _docs(s, d).select("doc_id", T.language(F.col("text")).alias("lang"))


@plan("script_counts", "select doc_id, len(regexp_extract_all(text, '\\p{Han}'))::bigint as han, len(regexp_extract_all(text, '\\p{Latin}'))::bigint as latin from documents")
def script_counts(s, d):
    return _docs(s, d).select("doc_id", F.regexp_count("text", F.lit(r"\p{IsHan}")).cast("long").alias("han"), F.regexp_count("text", F.lit(r"\p{IsLatin}")).cast("long").alias("latin"))


@plan("distinct_chars", W + "select distinct doc_id, unnest(string_split(text, '')) as ch from words")
def distinct_chars(s, d):
    return _words(s, d).select("doc_id", F.explode(F.split("text", "")).alias("ch")).distinct()


@plan("heading_norm", W + ", l as (select doc_id, page, line_ix, string_agg(text, ' ' order by word_ix) as line from words group by all) select doc_id, page, line_ix, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[.,:;]+$', '') as heading from l")
def heading_norm(s, d):
    return render.lines(_words(s, d)).select("doc_id", "page", "line_ix", T.heading(F.col("line")).alias("heading"))


@plan("substring_counts", "select doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::bigint as apart, len(regexp_extract_all(lower(text), 'an')) ::bigint as an from documents")
def substring_counts(s, d):
    return _docs(s, d).select("doc_id", T.occurrences(F.col("text"), "the").alias("apart"), T.occurrences(F.col("text"), "an", overlapping=True).cast("long").alias("an"))


@plan("escaped_text", "select doc_id, regexp_replace(text, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g') as markdown, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as xml from documents")
def escaped_text(s, d):
    return _docs(s, d).select("doc_id", T.escape_markdown(F.col("text")).alias("markdown"), T.escape_xml(F.col("text")).alias("xml"))


@plan("line_medians", W + """, v as (select doc_id, page, list_sort(list("right" - "left")) as w from words group by doc_id, page)
select doc_id, page, w[len(w) // 2 + 1] as median_width, case when len(w) < 4 then list_max(w)::double else list_avg(w[len(w) // 4 - 1 + 1 : least(len(w), ceil(len(w) * 3 / 4)::bigint + 1)]) end as middle_mean from v""")
def line_medians(s, d):
    v = _words(s, d).groupBy("doc_id", "page").agg(F.collect_list(F.col("right") - F.col("left")).alias("w"))
    return v.select("doc_id", "page", T.upper_median(F.col("w")).alias("median_width"), T.middle_mean(F.col("w").cast("array<double>")).alias("middle_mean"))


@plan("char_metrics_width", W + """, c as (select doc_id, page, word_ix, unnest(range(len(string_split(text, '')))) as i, unnest(string_split(text, '')) as ch from words)
select ch, list_sort(list(10 - (i * 3 + word_ix) % 3))[count(*) // 2 + 1] as width, count(*) as obs from c group by ch""")
def char_metrics_width(s, d):
    c = layout.chars(_docs(s, d)).groupBy("ch", (F.col("right") - F.col("left")).alias("w")).agg(F.count("*").alias("n"))
    return weighted_upper_median(c, ["ch"], "w", "n", "width", "obs")


@plan("char_metrics_kerning", W + """, c as (select doc_id, page, line_ix, word_ix, unnest(range(len(string_split(text, '')))) as i, unnest(string_split(text, '')) as ch from words),
k as (select ch || ',' || lead(ch) over w as pair, lead((i * 3 + word_ix) % 3) over w as gap from c window w as (partition by doc_id, page, line_ix, word_ix order by i))
select pair, list_sort(list(gap))[count(*) // 2 + 1] as kerning, count(*) as obs from k where gap > 0 group by pair""")
def char_metrics_kerning(s, d):
    k = kernings(_words(s, d)).groupBy("pair", "gap").agg(F.count("*").alias("n"))
    return weighted_upper_median(k, ["pair"], "gap", "n", "kerning", "obs")


# Search.

PHRASE, TERM = "of the", "the"
_RUN = W + f""", run as (select *, lower(text) || ' ' || lower(lead(text) over w) as two, row_number() over w - 1 as ix from words window w as (partition by doc_id, page order by line_ix, word_ix)),
hit as (select * from run where two is not null and contains(lower(text), 'of') and contains(two, '{PHRASE}'))"""


@plan("phrase_matches", _RUN + f"select {KEY} from hit")
def phrase_matches(s, d):
    return search.phrase_starts(_words(s, d), PHRASE).select("doc_id", "page", "line_ix", "word_ix")


@plan("phrase_occurrences", _RUN + """, g as (select *, ix - row_number() over (partition by doc_id, page order by ix) as run from hit),
c as (select doc_id, page, run, count(*) as n from g group by all) select doc_id, page, sum((n + 1) // 2)::bigint as occurrences from c group by doc_id, page""")
def phrase_occurrences(s, d):
    return search.phrase_occurrences(_words(s, d), PHRASE)


@plan("whole_word_occurrences", W + f"select {KEY}, text from words where regexp_replace(lower(text), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') = '{TERM}'")
def whole_word_occurrences(s, d):
    return search.whole_words(_words(s, d), TERM).select("doc_id", "page", "line_ix", "word_ix", "text")


_POST = W + """, pages_text as (select doc_id, page, string_agg(line, chr(10) order by line_ix) as text from (select doc_id, page, line_ix, string_agg(text, ' ' order by word_ix) as line from words group by all) group by all),
postings as (select distinct doc_id, page, token from (select doc_id, page, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as token from pages_text) where length(token) >= 2)"""


def _postings(s, d):
    return search.postings(search.page_texts(_words(s, d)))


@plan("postings", _POST + "select token, doc_id, page from postings")
def postings(s, d):
    return _postings(s, d)


@plan("library_query", _POST + """, p as (select doc_id, page from postings where token in ('the', 'of') group by doc_id, page having count(*) = 2)
select doc_id, list_sort(list(page))::varchar as pages, count(*) as n_pages from p group by doc_id""")
def library_query(s, d):
    q = search.query(_postings(s, d), "The of")
    return q.select("doc_id", F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]")).alias("pages"), "n_pages")


@plan("snippets", """select doc_id, case when p > 0 then (case when a > 1 then '…' else '' end) || substring(text, a, e - a + 1) || (case when e < length(text) then '…' else '' end) else substring(text, 1, 140) end as snippet
from (select *, greatest(1, p - 70) as a, least(length(text), p + 3 - 1 + 70) as e from (select doc_id, text, instr(lower(text), 'the') as p from documents))""")
def snippets(s, d):
    return _docs(s, d).select("doc_id", search.snippet(F.col("text"), "the").alias("snippet"))


@plan("search_document_top50", _RUN + f""", l as (select doc_id, page, line_ix, string_agg(text, ' ' order by word_ix) as line from words group by all), n as (select count(*) as total from hit)
select {KEY}, line, total, total > 50 as truncated from (select {KEY} from hit order by {KEY} limit 50) join l using (doc_id, page, line_ix) cross join n""")
def search_document_top50(s, d):
    w = _words(s, d)
    return search.top_matches(search.phrase_starts(w, PHRASE), render.lines(w).select("doc_id", "page", "line_ix", "line"))


# Regions, redactions, pages, tables.

RECTS = """, rects as (select distinct doc_id, page, 'r' || page as box_id, page % 3 as ord, case when page % 2 = 0 then 'order' else 'exclude' end as kind, 100 as "left", 50 + 10 * (doc_id % 7) as top, 420 as "right", 330 as bottom from words)"""


def _rects(words: DataFrame) -> DataFrame:
    p = words.select("doc_id", "page").distinct()
    return p.select("doc_id", "page", F.concat(F.lit("r"), "page").alias("box_id"), (F.col("page") % 3).alias("ord"), F.when(F.col("page") % 2 == 0, "order").otherwise("exclude").alias("kind"), F.lit(100).alias("left"), (50 + 10 * (F.col("doc_id") % 7)).alias("top"), F.lit(420).alias("right"), F.lit(330).alias("bottom"))


_REACH = 'w."left" < r."right" and r."left" < w."right" and w.top < r.bottom and r.top < w.bottom'


@plan("redacted_words", W + RECTS + f"select {KEY}, text from words w where not exists (select 1 from rects r where r.doc_id = w.doc_id and r.page = w.page and {_REACH})")
def redacted_words(s, d):
    w = _words(s, d)
    return document.redacted(w, _rects(w)).select("doc_id", "page", "line_ix", "word_ix", "text")


@plan("region_words", W + RECTS + f"select w.doc_id, w.page, line_ix, word_ix, box_id from words w join rects r on r.doc_id = w.doc_id and r.page = w.page and {_REACH}")
def region_words(s, d):
    w = _words(s, d)
    return document.inside(w, _rects(w)).select("doc_id", "page", "line_ix", "word_ix", "box_id")


_LINES = """, ln as (select doc_id, page, line_ix, min(par_id) as par_id, string_agg(text, ' ' order by word_ix) as line, count(*) as n_words, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom from words group by doc_id, page, line_ix)"""


@plan("reorder_exclude", W + RECTS + _LINES + """, hit as (
  select w.doc_id, w.page, w.line_ix, arg_max(case when kind = 'exclude' then 101 else ord end, box_id) as priority from ln w join rects r on r.doc_id = w.doc_id and r.page = w.page
  where greatest(0, least(w."right", r."right") - greatest(w."left", r."left")) * greatest(0, least(w.bottom, r.bottom) - greatest(w.top, r.top)) > 0.5 * (w."right" - w."left") * (w.bottom - w.top) group by all)
select doc_id, page, line_ix, priority, row_number() over (partition by doc_id, page order by priority, line_ix) - 1 as new_ix
from (select ln.doc_id, ln.page, ln.line_ix, coalesce(priority, 100) as priority from ln left join hit using (doc_id, page, line_ix)) where priority <= 100""")
def reorder_exclude(s, d):
    w = _words(s, d)
    return document.reordered(render.lines(w), _rects(w))


@plan("redaction_marks", _RUN.replace("and contains(two, 'of the')", "") + """, g as (select *, word_ix - row_number() over (partition by doc_id, page, line_ix order by word_ix) as run from hit)
select doc_id, page, line_ix, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom, count(*) as n from g group by doc_id, page, line_ix, run""")
def redaction_marks(s, d):
    return document.marks(_of_two(s, d))


def _of_two(s, d):
    w = Window.partitionBy("doc_id", "page").orderBy("line_ix", "word_ix")
    return _words(s, d).withColumn("_next", F.lead("text").over(w)).where(F.col("_next").isNotNull() & F.lower("text").contains("of")).drop("_next")


_PAGES = W + ", pg as (select distinct doc_id, page from words)"


def _pg(s, d):
    return _words(s, d).select("doc_id", "page").distinct()


@plan("page_delete", _PAGES + ", m as (select doc_id, page as old, row_number() over (partition by doc_id order by page) - 1 as new from pg where page % 3 <> 1) select doc_id, new as page, line_ix, word_ix, text from words join m using (doc_id) where page = old")
def page_delete(s, d):
    w = _words(s, d)
    return document.remapped(w.select("doc_id", "page", "line_ix", "word_ix", "text"), document.deletion(w.select("doc_id", "page").distinct(), F.col("page") % 3 == 1))


@plan("page_move", _PAGES + """, r as (select *, page = 2 as moved, sum((page <> 2)::int) over (partition by doc_id order by page) - 1 as rest from pg)
select doc_id, page as old, row_number() over (partition by doc_id order by case when moved then -0.5 else rest end, page) - 1 as new from r""")
def page_move(s, d):
    return document.move(_pg(s, d), F.col("page") == 2, 0)


@plan("page_insert", _PAGES + "select doc_id, page as old, case when page >= 1 then page + 2 else page end as new from pg")
def page_insert(s, d):
    return document.insertion(_pg(s, d), 1, 2)


_HEADS = W + _LINES + ", heads as (select doc_id, page * 50 + line_ix as node, 1 + (doc_id + line_ix) % 3 as level, line as title, page from ln where n_words <= 3)"


def _heads(s, d):
    return render.lines(_words(s, d)).where("n_words <= 3").select("doc_id", (F.col("page") * 50 + F.col("line_ix")).alias("node"), (1 + (F.col("doc_id") + F.col("line_ix")) % 3).alias("level"), F.col("line").alias("title"), "page")


@plan("outline_nested", _HEADS + "select doc_id, node, level, (select max(q.node) from heads q where q.doc_id = h.doc_id and q.node < h.node and q.level < h.level) as parent from heads h")
def outline_nested(s, d):
    return document.nested(_heads(s, d)).select("doc_id", "node", "level", "parent")


@plan("outline_split_segments", _HEADS + """, n as (select doc_id, max(page) + 1 as page_count from words group by doc_id),
f as (select doc_id, page, arg_min(title, node) as title from heads where level = 1 group by doc_id, page union all select doc_id, 0, 'Front matter' from n where doc_id not in (select doc_id from heads where level = 1 and page = 0))
select doc_id, row_number() over w - 1 as segment, title, page as first, coalesce(lead(page) over w, page_count) - 1 as last from f join n using (doc_id) window w as (partition by doc_id order by page)""")
def outline_split_segments(s, d):
    n = _words(s, d).groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))
    return document.split_segments(_heads(s, d).where("level = 1"), n)


@plan("table_cells", W + """, cell as (
  select w.doc_id, w.page, case when line_ix < 10 then 0 else 1 end as table_ix, line_ix, word_ix, text, "left", bottom, min(c.ix) as col_ix
  from words w join (select unnest(range(4)) as ix) c on least(w."right", 300 * c.ix + 300) - greatest(w."left", 300 * c.ix) > 0.5 * (w."right" - w."left") where line_ix < 20 group by all)
select doc_id, page, table_ix, line_ix % 10 // 2 as row_ix, col_ix, string_agg(text, ' ' order by line_ix, "left", word_ix) as text from cell group by doc_id, page, table_ix, line_ix % 10 // 2, col_ix""")
def table_cells(s, d):
    w = _words(s, d)
    p = w.select("doc_id", "page").distinct()
    box = p.withColumn("table_ix", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("col_ix", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cols = box.select("doc_id", "page", "table_ix", "col_ix", (300 * F.col("col_ix")).alias("left"), (300 * F.col("col_ix") + 300).alias("right"), (20 + 200 * F.col("table_ix")).alias("top"), (229 + 200 * F.col("table_ix")).alias("bottom"))
    rows = p.withColumn("table_ix", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("row_ix", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("doc_id", "page", "table_ix", "row_ix", (26 + 200 * F.col("table_ix") + 40 * F.col("row_ix")).alias("above"), (66 + 200 * F.col("table_ix") + 40 * F.col("row_ix")).alias("below"))
    return document.table_cells(w, cols, rows)


@plan("column_bounds", W + """, o as (select *, max("right") over (partition by doc_id, page, line_ix order by "left", "right" rows between unbounded preceding and 1 preceding) as reach from words),
g as (select *, sum((reach is null or "left" - 5 > reach + 5)::int) over (partition by doc_id, page, line_ix order by "left", "right") - 1 as col_ix from o)
select doc_id, page, line_ix, col_ix::bigint as col_ix, min("left") as "left", max("right") as "right" from g group by all""")
def column_bounds(s, d):
    return document.column_bounds(_words(s, d), ["doc_id", "page", "line_ix"])


@plan("paged_read", W + _LINES + """, p as (select doc_id, page, sum(length(line) + 1) as n from ln group by all), u as (select *, sum(n) over (partition by doc_id order by page) as upto from p)
select doc_id, page, upto::bigint as upto from u where upto <= 8000 or upto = n""")
def paged_read(s, d):
    return document.paged(render.lines(_words(s, d)), 8000)


# Text and markup.


@plan("line_text", W + _LINES + 'select doc_id, page, line_ix, line, n_words, "left", top, "right", bottom from ln')
def line_text(s, d):
    return render.lines(_words(s, d)).drop("par_id")


@plan("page_text", _POST + "select doc_id, page, text from pages_text")
def page_text(s, d):
    return search.page_texts(_words(s, d))


@plan("text_plain", W + _LINES + "select doc_id, string_agg(chr(10) || line, '' order by page, line_ix) as text from ln group by doc_id")
def text_plain(s, d):
    return render.plain_text(_words(s, d))


@plan("text_reflow", W + _LINES + """, p as (select *, case when lag(par_id) over w is null then '' when lag(page) over w <> page or lag(par_id) over w <> par_id then chr(10) else ' ' end as sep from ln window w as (partition by doc_id order by page, line_ix))
select doc_id, string_agg(sep || line, '' order by page, line_ix) as text from p group by doc_id""")
def text_reflow(s, d):
    return render.reflowed(_words(s, d))


@plan("text_line_numbers", W + _LINES + "select doc_id, string_agg(page || ':' || line_ix || '  ' || line, chr(10) order by page, line_ix) as text from ln group by doc_id")
def text_line_numbers(s, d):
    return render.numbered(_words(s, d))


@plan("text_preserve_spacing")
def text_preserve_spacing(s, d):
    return render.spaced(_words(s, d))


@plan("markdown_text")
def markdown_text(s, d):
    return render.markdown(_words(s, d).withColumn("bold", F.col("conf") % 5 == 0))


@plan("csv_words", W + f"""select {KEY}, concat_ws(',', page, line_ix, word_ix, '"' || replace(text, '"', '""') || '"', "left", top, "right", bottom, conf) as row from words""")
def csv_words(s, d):
    return render.csv_rows(_words(s, d))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@plan("hocr_page", W + f""", h as (select doc_id, page, line_ix, string_agg('<span class=''ocrx_word'' id=''word_' || page || '_' || line_ix || '_' || word_ix || ''' title=''bbox ' || "left" || ' ' || top || ' ' || "right" || ' ' || bottom || ';x_wconf ' || conf || '''>' || {_ESC} || '</span>', ' ' order by word_ix) as w,
  min("left") as l, min(top) as t, max("right") as r, max(bottom) as b from words group by all)
select doc_id, page, '<div class=''ocr_page'' title=''bbox 0 0 2000 1050''>' || chr(10) || string_agg('<span class=''ocr_line'' title="bbox ' || l || ' ' || t || ' ' || r || ' ' || b || '; baseline 0 0">' || w || '</span>', chr(10) order by line_ix) || chr(10) || '</div>' as xml from h group by doc_id, page""")
def hocr_page(s, d):
    return render.hocr(_words(s, d), 2000, 1050)


@plan("alto_page")
def alto_page(s, d):
    return render.alto(_words(s, d), 2000, 1050)


@plan("session_ndjson")
def session_ndjson(s, d):
    return render.session(_words(s, d))


# Formats: what is written and read again equals what was laid out.

_PLACED = W + 'select doc_id, page, line_ix, word_ix, text, "left", top, "right", bottom, conf from words'
_PLACED_COLS = ["doc_id", "page", "line_ix", "word_ix", "text", "left", "top", "right", "bottom", "conf"]


@plan("hocr_round_trip", _PLACED)
def hocr_round_trip(s, d):
    return formats.hocr_words(render.hocr(_words(s, d), 2000, 1050)).select(_PLACED_COLS)


@plan("alto_round_trip", W + """, p as (select doc_id, page, par_id, min(line_ix) as first from words group by all), o as (select distinct w.doc_id, w.page, w.par_id, w.line_ix, first from words w join p using (doc_id, page, par_id)),
n as (select *, row_number() over (partition by doc_id, page order by first, line_ix) - 1 as ix from o)
select w.doc_id, w.page, ix as line_ix, word_ix, text, "left", top, "right", bottom, conf from words w join n using (doc_id, page, par_id, line_ix)""")
def alto_round_trip(s, d):
    return formats.alto_words(render.alto(_words(s, d), 2000, 1050)).select(_PLACED_COLS)


@plan("session_round_trip", _PLACED)
def session_round_trip(s, d):
    return formats.session_words(render.session(_words(s, d))).select(_PLACED_COLS)


@plan("sniffed_formats", """select page_id, case when html like '%<alto%' and html like '%loc.gov%' then 'alto' when html like '%<document name%' then 'stext'
when regexp_matches(html, 'class=[''"]ocr_page') or html like '%<?xml version%' then 'hocr' end as format from pages""")
def sniffed_formats(s, d):
    return table(s, d, "pages").select("page_id", formats.sniff(F.col("html"), F.lit("html")).alias("format"))


@plan("routed_files", "select page_id, case when regexp_matches(lower(url), '\\.(hocr|xml|html|gz|stext|json|txt|docx|md)$') then 'ocr' when regexp_matches(lower(url), '\\.(png|jpg|jpeg)$') then 'image' when regexp_matches(lower(url), '\\.pdf$') then 'pdf' else 'other' end as kind from pages")
def routed_files(s, d):
    return table(s, d, "pages").select("page_id", formats.route(F.col("url")).alias("kind"))


# Structure.


@plan("par_breaks_stateless", W + _LINES + """, f as (select *, lag(line_ix) over w as pl, top - lag(bottom) over w as gap, bottom - top as h, lag(line) over w as before, "left" - lag("left") over w as shift, lag("right") over w as pr, max("right") over (partition by doc_id, page) as far from ln window w as (partition by doc_id, page order by line_ix)),
r as (select *, case when pl is null then 'first' when gap < -h then 'column' when regexp_matches(line, '^([•◦▪*–-]|\\(?\\d{1,3}[.)])\\s') and regexp_matches(before, '[.!?:]\\s*$') then 'list' when gap > 3 * h then 'space' when shift > 50 then 'indent'
  when pr < 0.7 * far and regexp_matches(before, '[.!?:]\\s*$') then 'early' end as reason from f)
select doc_id, page, line_ix, (sum((reason is not null)::int) over (partition by doc_id, page order by line_ix) - 1)::bigint as par_ix, reason from r""")
def par_breaks_stateless(s, d):
    return structure.paragraph_breaks(render.lines(_words(s, d)))


@plan("style_runs", W + """, b as (select *, conf % 5 = 0 as bold from words), n as (select *, case when lag(bold) over w = bold then 0 else 1 end as new from b window w as (partition by doc_id, page, line_ix order by word_ix)),
r as (select *, sum(new) over (partition by doc_id, page, line_ix order by word_ix) - 1 as run from n)
select doc_id, page, line_ix, run::bigint as run, bold, string_agg(text, ' ' order by word_ix) as text from r group by all""")
def style_runs(s, d):
    return structure.style_runs(_words(s, d).withColumn("bold", F.col("conf") % 5 == 0))


@plan("split_lines", W + """, g as (select *, (coalesce("left" - lag("right") over w > bottom - top, false))::int as new from words_c window w as (partition by doc_id, page, line_ix order by word_ix))
select doc_id, page, line_ix, word_ix, (sum(new) over (partition by doc_id, page, line_ix order by word_ix))::bigint as segment from g""")
def split_lines(s, d):
    return structure.split_at_gaps(layout.words_c(_docs(s, d))).select("doc_id", "page", "line_ix", "word_ix", "segment")


@plan("running_furniture", W + _LINES + """, e as (select doc_id, page, trim(regexp_replace(lower(line), '\\d+', '#', 'g')) as key from ln where line_ix < 3 or line_ix > 46), n as (select doc_id, count(distinct page) as of from ln group by doc_id)
select doc_id, key, pages from (select doc_id, key, count(distinct page) as pages from e group by all) join n using (doc_id) where pages >= 3 and pages * 4 >= of""")
def running_furniture(s, d):
    return structure.running_furniture(render.lines(_words(s, d)))


@plan("line_number_column")
def line_number_column(s, d):
    return structure.line_number_runs(render.lines(_words(s, d)).withColumn("line", F.concat_ws(" ", F.col("line_ix") + 1, "line")))


_NUMBERED = """, num as (select doc_id, page, line_ix, case line_ix % 3 when 0 then '(' || (line_ix // 3 + 1) || ')' when 1 then (page * 50 + line_ix) || '.' else chr((97 + line_ix // 3)::int) || ')' end || ' ' || line as line from ln)"""


def _numbered(s, d):
    i = F.col("line_ix")
    mark = F.when(i % 3 == 0, F.concat(F.lit("("), F.floor(i / 3) + 1, F.lit(")"))).when(i % 3 == 1, F.concat(F.col("page") * 50 + i, F.lit("."))).otherwise(F.concat(F.char(97 + F.floor(i / 3)), F.lit(")")))
    return render.lines(_words(s, d)).withColumn("line", F.concat_ws(" ", mark, "line"))


@plan("numbering_schemes", W + _LINES + _NUMBERED + """, e as (select distinct doc_id, regexp_extract(line, '^\\(?(\\d{1,3}|[a-z])[.)]', 1) as v, case line_ix % 3 when 0 then 'paren-num' when 1 then 'num-dot' else 'alpha-paren' end as scheme from num where regexp_matches(line, '^\\(?(\\d{1,3}|[a-z])[.)] ')),
n as (select distinct doc_id, scheme, case when scheme = 'alpha-paren' then unicode(v) - 96 else v::bigint end as value from e),
k as (select *, value - row_number() over w as run, coalesce(lag(value) over w = value - 1, false) or coalesce(lead(value) over w = value + 1, false) as near from n window w as (partition by doc_id, scheme order by value)),
r as (select doc_id, scheme, run, count(*) as n, count_if(near) as near from k group by all)
select doc_id, scheme, max(n) as longest, sum(near)::bigint as neighbours, max(n) >= case when scheme = 'num-dot' then 3 else 2 end as active from r group by doc_id, scheme""")
def numbering_schemes(s, d):
    return structure.numbering(_numbered(s, d))


# A library.

_MANIFEST = """with known as (select 'f' || doc_id || '.txt' as path, md5(text) as hash, n_chars as size, 100 as mtime, case when doc_id % 17 = 0 then 'missing' when doc_id % 5 = 0 then 'error' else 'indexed' end as status,
  case when doc_id % 5 = 0 then 'interrupted' end as error, doc_id % 10 = 0 as retried from documents where doc_id % 4 <> 0),
seen as (select case when doc_id % 4 = 0 and doc_id % 8 = 0 then 'new' else 'f' end || doc_id || '.txt' as path, md5(text) as hash, n_chars as size, case when doc_id % 7 = 0 then 101 else 100 end as mtime from documents where doc_id % 3 <> 0),
diff as (select coalesce(k.path, s.path) as path, coalesce(s.hash, k.hash) as hash, case when k.path is null then 'pending' when s.path is null then 'missing' when k.status = 'missing' then 'returned'
  when k.size <> s.size or k.mtime <> s.mtime then 'changed' when k.error = 'interrupted' and not k.retried then 'pending' else k.status end as status from known k full join seen s on k.path = s.path)
"""


def _library(s, d):
    docs = table(s, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.col("n_chars").alias("size"))
    i = F.col("doc_id")
    known = docs.where(i % 4 != 0).select(
        F.concat(F.lit("f"), i, F.lit(".txt")).alias("path"), "hash", "size", F.lit(100).alias("mtime"), F.when(i % 17 == 0, "missing").when(i % 5 == 0, "error").otherwise("indexed").alias("status"),
        F.when(i % 5 == 0, "interrupted").alias("error"), (i % 10 == 0).alias("retried"),
    )
    seen = docs.where(i % 3 != 0).select(F.concat(F.when(i % 8 == 0, "new").otherwise("f"), i, F.lit(".txt")).alias("path"), "hash", "size", F.when(i % 7 == 0, 101).otherwise(100).alias("mtime"))
    return document.manifest_diff(known, seen)


@plan("manifest_diff", _MANIFEST + "select path, hash, status from diff")
def manifest_diff(s, d):
    return _library(s, d)


@plan("manifest_moves", _MANIFEST + "select p.path, m.moved_from from diff p join (select hash, min(path) as moved_from from diff where status = 'missing' group by hash) m on p.hash = m.hash where p.status = 'pending'")
def manifest_moves(s, d):
    return document.moves(_library(s, d))


@plan("lru_evict", """with f as (select doc_id::varchar as path, (doc_id * 7919) % 10007 as last_used, n_chars as size from documents), r as (select *, sum(size) over (order by last_used desc, path) as upto from f)
select path, last_used, size from r where upto > 300000""")
def lru_evict(s, d):
    f = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), ((F.col("doc_id") * 7919) % 10007).alias("last_used"), F.col("n_chars").alias("size"))
    return document.evicted(f, 300_000)


# Streams, in their batch form.


@plan("page_results", W + """, x as (select distinct doc_id, page from words),
r as (select doc_id, page, case when (doc_id + page) % 5 = 0 then 'error' when (doc_id + page) % 3 = 0 then 'progress' else 'done' end as kind from x)
select x.doc_id, x.page, case when kind = 'done' then 'page ' || x.page else '' end as text, case kind when 'done' then 'done' when 'error' then 'failed' else 'missing' end as status from x join r using (doc_id, page)""")
def page_results(s, d):
    x = _pg(s, d)
    n = F.col("doc_id") + F.col("page")
    r = x.select("doc_id", "page", F.when(n % 5 == 0, "error").when(n % 3 == 0, "progress").otherwise("done").alias("kind"), F.concat(F.lit("page "), "page").alias("text"))
    return results.settled(x, r)


@plan("events_tumbling", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, sum(value) as total from events group by all")
def events_tumbling(s, d):
    return results.tumbling(table(s, d, "events"))


@plan("events_session", """with e as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from g group by user_id, k""")
def events_session(s, d):
    return results.sessions(table(s, d, "events"))


@plan("events_dedupe", "select user_id, event_type, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by all")
def events_dedupe(s, d):
    return results.first_of_each(table(s, d, "events"), ["user_id", "event_type"])


# Layers of a page, outlines, sheets, markup.

_GATE = W + """, st as (select doc_id, page, string_agg(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '' order by line_ix, word_ix) as stream from words where conf % 2 = 0 group by all),
f as (select b.*, stream, regexp_replace(lower(b.text), '[^a-z0-9]', '', 'g') as p from words_b b left join st on b.doc_id = st.doc_id and b.page = st.page),
n as (select *, coalesce(length(p) >= 2 and conf >= 85 and not contains(stream, p), false) as new from f),
m as (select *, new and regexp_matches(p, '^[a-z]{3,}$') and regexp_matches(p, '[aeiouy]') as word from n),
l as (select doc_id, page, line_ix, bool_or(stream is null) as bare, count_if(word) as words, sum(case when word then length(p) else 0 end) as chars, count_if(new and regexp_matches(p, '^[0-9]{2,}$')) as numbers from m group by all),
gate as (select doc_id, page, bool_or(bare) or count_if(words >= 3) >= 2 or sum(numbers) >= 10 or sum(chars) >= 100 as keep from l group by all)
"""


def _gate(s, d):
    docs = _docs(s, d)
    native = layout.words(docs).where("conf % 2 = 0")
    found = layout.words_b(docs)
    return native, found, layers.adds_new_text(native, found)


@plan("ocr_keep_gate", _GATE + "select doc_id, page, keep from gate")
def ocr_keep_gate(s, d):
    return _gate(s, d)[2]


@plan("combined_layer", _GATE + """, a as (select distinct doc_id, page from words where conf % 2 = 0), b as (select distinct doc_id, page from words_b)
select doc_id, page, case when (doc_id + page) % 2 = 0 and coalesce(keep, false) and b.doc_id is not null then 'found' when a.doc_id is not null then 'native' else 'blank' end as layer
from a full join b using (doc_id, page) left join gate using (doc_id, page)""")
def combined_layer(s, d):
    native, found, gate = _gate(s, d)
    mask = found.select("doc_id", "page").distinct().withColumn("recognise", (F.col("doc_id") + F.col("page")) % 2 == 0)
    return layers.combined(native, found, mask, gate)


@plan("outline_remap", _HEADS + """, nest as (select doc_id, node, level, title, page, (select max(q.node) from heads q where q.doc_id = h.doc_id and q.node < h.node and q.level < h.level) as parent from heads h),
pm as (select doc_id, page as old, row_number() over (partition by doc_id order by page) - 1 as new from (select distinct doc_id, page from words) where page % 2 = 0),
k as (select nest.*, new from nest left join pm on nest.doc_id = pm.doc_id and page = old)
select k.doc_id, k.node, case when k.parent is null then null when p1.new is not null then p1.node when p1.parent is null then null when p2.new is not null then p2.node else p2.parent end as parent, k.title, k.new as page
from k left join k p1 on p1.doc_id = k.doc_id and p1.node = k.parent left join k p2 on p2.doc_id = k.doc_id and p2.node = p1.parent where k.new is not null""")
def outline_remap(s, d):
    heads = document.nested(_heads(s, d))
    return document.outline_remap(heads, document.deletion(_pg(s, d), F.col("page") % 2 == 1))


@plan("heading_bookmarks", _HEADS + "select doc_id, node, page, trim(title) as title, least(1, greatest(0, (30 + 20 * (node % 50)) / 1050))::double as y_frac from heads where length(trim(title)) between 1 and 150")
def heading_bookmarks(s, d):
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (30 + 20 * (F.col("node") % 50)) / F.lit(1050.0)))
    return _heads(s, d).where(F.length(F.trim("title")).between(1, 150)).select("doc_id", "node", "page", F.trim("title").alias("title"), y.alias("y_frac"))


@plan("sheet_cells", SQL["table_cells"].rsplit("select doc_id, page, table_ix, line_ix", 1)[0] + """, g as (select doc_id, page, table_ix, line_ix % 10 // 2 as row_ix, col_ix, string_agg(text, ' ' order by line_ix, "left", word_ix) as text from cell group by all)
select doc_id, dense_rank() over (partition by doc_id order by page, table_ix, row_ix) as row, chr((65 + col_ix)::int) || dense_rank() over (partition by doc_id order by page, table_ix, row_ix) as ref, text from g""")
def sheet_cells(s, d):
    return document.sheet_cells(table_cells(s, d))


@plan("companion_files", """with d as (select 'f' || doc_id || '.pdf' as path, 'f' || doc_id as stem from documents), f as (select 'F' || doc_id || '.hocr' as file from documents)
select path, array_to_string(list_sort(list(file)), '|') as companions from d join f on starts_with(lower(file), stem) group by path""")
def companion_files(s, d):
    docs = _docs(s, d)
    got = document.companions(docs.select(F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("path")), docs.select(F.concat(F.lit("F"), "doc_id", F.lit(".hocr")).alias("path")))
    return got.select("path", F.array_join("companions", "|").alias("companions"))


@plan("markdown_paragraphs")
def markdown_paragraphs(s, d):
    return markup.markdown(_docs(s, d))


@plan("sentence_ends", W + r""", c as (select doc_id, page, line_ix, word_ix, case when regexp_matches(text, '^.+[.!?]["'')\]}>]*$') then regexp_extract(text, '^(.+[.!?])["'')\]}>]*$', 1) else text end as core from words)
select doc_id, page, line_ix, word_ix, regexp_matches(core, '[!?]$') or (regexp_matches(core, '\.$') and not regexp_matches(core, '\.{2,}$|^[A-Z]\.$|[0-9]\.$')
  and not lower(left(core, -1)) in ('mr', 'mrs', 'ms', 'dr', 'prof', 'rev', 'sr', 'jr', 'etc', 'vs', 'vol', 'no', 'eg', 'ie', 'al', 'cf', 'p', 'pp', 'pg', 'sec', 'ch', 'art', 'cl', 'fig', 'tab', 'ex', 'us', 'uk')
  and not lower(replace(core, '.', '')) in ('mr', 'mrs', 'ms', 'dr', 'prof', 'rev', 'sr', 'jr', 'etc', 'vs', 'vol', 'no', 'eg', 'ie', 'al', 'cf', 'p', 'pp', 'pg', 'sec', 'ch', 'art', 'cl', 'fig', 'tab', 'ex', 'us', 'uk')) as ends from c""")
def sentence_ends(s, d):
    return _words(s, d).select("doc_id", "page", "line_ix", "word_ix", markup.ends_sentence(F.col("text")).alias("ends"))


from . import further, page_tables, written_formats  # noqa: E402, F401  more queries, which build on those above
