"""Scalar functions on text, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and digraphs with their letters, superscripts with their digits and signs.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "0123456789+-=()"
_SPELT_OUT, _LOWER = str.maketrans(LIGATURES), str.maketrans("Σİ", "σi")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two characters at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: F.length(t) >= 2)


def without_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ligature_of(text: Column) -> Column:
    """The ligature that a text is or spells, or null."""
    pairs = [F.lit(x) for lig, letters in LIGATURES.items() for x in (letters, lig)]
    return F.when(text.isin(*LIGATURES), text).otherwise(F.try_element_at(F.create_map(*pairs), text))


def without_superscripts(text: Column) -> Column:
    return F.translate(text, SUPERSCRIPTS, PLAIN)


def curly_quotes(text: Column) -> Column:
    """Straight quotes at a word's edges and in contractions at its end made curly, the first of each kind."""
    opening = lambda x, a, b: F.when(x.rlike(f"^(?s:.*?)(?:^|[-–—]){a}"), F.regexp_replace(x, f"^((?s:.*?)(?:(?<![\\s\\S])|[-–—])){a}", f"$1{b}")).otherwise(x)
    closing = lambda x, a, b: F.regexp_replace(x, f"^((?s:.*?)){a}(?=$|[-–—])", f"$1{b}")
    x = closing(closing(opening(opening(text, "'", "‘"), '"', "“"), "'", "’"), '"', "”")
    return F.regexp_replace(x, "(?i)([a-z])'(?=[a-z]$)", "$1’")


def lower_each(text: Column) -> Column:
    """Each character in lower case, whatever stands beside it: a capital sigma at a word's end is no final one, a dotted I becomes a plain i."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def lower_word(text: str) -> str:
    """lower_each for one text in Python, by its tables of Unicode."""
    return text.translate(_LOWER).lower()


def heading(text: Column) -> Column:
    """Text as headings are compared: single blanks, lower case, no end mark."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"[.,:;]+$", "")


def language(text: Column) -> Column:
    """chi_sim or rus by the first character of either script, eng without any."""
    first = F.regexp_extract(text, r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{0400}-\x{052F}])", 1)
    return F.when(first == "", "eng").when(first.rlike(r"[\x{0400}-\x{052F}]"), "rus").otherwise("chi_sim")


def occurrences(text: Column, part: str, overlapping: bool = False, match_case: bool = False) -> Column:
    """How often a part occurs; an empty part once more than there are characters."""
    if not part:
        return F.length(text) + 1
    x, p = (text, part) if match_case else (F.lower(text), part.lower())
    if overlapping:
        return F.regexp_count(x, F.lit("(?=" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in p) + ")"))  # one pass; a character's place costs one of its own
    return ((F.length(x) - F.length(F.replace(x, F.lit(p), F.lit("")))) / len(p)).cast("long")


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_xml(text: Column) -> Column:
    """Entities by name and number as characters; soft hyphens become hyphens. An ampersand's entity comes first, so what it makes of others counts."""
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#34;", '"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    code = r"&#x([0-9a-f]+);"
    char = lambda c: F.decode(F.unhex(F.right(F.lpad(c, 4, "0"), F.lit(4))), "UTF-16BE")
    parts, codes = F.split(text, code, -1), F.regexp_extract_all(text, F.lit(code), F.lit(1))
    return F.replace(F.array_join(F.zip_with(parts, codes, lambda a, c: F.concat(a, F.coalesce(char(c), F.lit("")))), ""), F.lit("\u00ad"), F.lit("-"))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]])", r"\\$1")


def trimmed_edges(text: Column) -> Column:
    """Lower case, without what is neither letter nor digit at the edges."""
    return F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def roman(text: Column) -> Column:
    """The value of a roman numeral in either case; null if another letter is in it."""
    letters = F.split(F.lower(text), "")
    worth = lambda c: F.element_at(F.array(*map(F.lit, (1, 5, 10, 50, 100, 500, 1000))), F.nullif(F.position(c, F.lit("ivxlcdm")), F.lit(0)))
    values = F.transform(letters, worth)
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(text.rlike("(?i)^[ivxlcdm]+$"), F.nullif(F.aggregate(signed, F.lit(0), lambda acc, v: acc + v), F.lit(0)))


def to_roman(n: Column) -> Column:
    """A number from 1 on as a roman numeral."""
    out = F.repeat(F.lit("M"), F.floor(n / F.lit(1000)).cast("int"))
    for unit, (one, five, ten) in ((100, "CDM"), (10, "XLC"), (1, "IVX")):
        digits = ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)
        out = F.concat(out, F.get(F.array(*map(F.lit, digits)), (F.floor(n / F.lit(unit)) % 10).cast("int")))
    return out


# The forms of numbered lines, the first that fits counts, with what their number is; the first two are
# of the first two words, the others of the first; a section's name without a number is none.
_SECTION = r"(?:Sec\.?|SEC\.?|Section|SECTION|Article|ARTICLE|§)"
ENUMERATORS = (
    ("section", rf"^{_SECTION}\x20(\d{{1,4}})", "number"), ("section", rf"^{_SECTION}\x20([ivxlcdmIVXLCDM]+)[.)]?$", "roman"), ("", rf"^{_SECTION}$", ""), ("sup-ref", r"^FN(\d{1,3})[.)]?$", "number"),
    ("paren-num", r"^\((\d{1,3})\)$", "number"), ("paren-roman", r"^\(([ivxlcdmIVXLCDM]{2,})\)$", "roman"), ("paren-alpha", r"^\(([a-zA-Z])\)$", "letter"), ("paren-alpha", r"^\([a-zA-Z]{2,3}\)$", ""),
    ("bracket-num", r"^\[(\d{1,3})\]$", "number"), ("num-dot", r"^(\d{1,3})[.)]$", "number"), ("roman-paren", r"^([ivxlcdmIVXLCDM]{2,})\)$", "roman"), ("roman-dot", r"^([ivxlcdmIVXLCDM]{2,})\.$", "roman"),
    ("alpha-paren", r"^([a-zA-Z])\)$", "letter"), ("alpha-dot", r"^([a-zA-Z])\.$", "letter"), ("bullet", r"^[•◦▪▫●○◼◻➢»■□◾◽▶▸‣➤➔–—-]$", ""), ("bullet", r"^[\p{S}\p{C}&&[^\x00-\x7F]]$", ""),
)


def enumerated(line: Column) -> Column:
    """(scheme, value) of the numbering that a line of words with single blanks begins with; both null without one."""
    first, two = F.substring_index(line, " ", 1), F.substring_index(line, " ", 2)
    kind = "struct<scheme:string,value:int>"
    out = F.lit(None).cast(kind)
    for i, (scheme, pattern, what) in reversed(list(enumerate(ENUMERATORS))):
        of = two if i < 2 else first
        got = F.regexp_extract(of, pattern, 1) if what else F.lit(None).cast("string")
        value = {"number": got.try_cast("int"), "roman": roman(got), "letter": F.ascii(F.lower(got)) - 96}.get(what, F.lit(None).cast("int"))
        out = F.when(of.rlike(pattern), F.struct(F.lit(scheme).alias("scheme"), value.cast("int").alias("value")).cast(kind)).otherwise(out)
    return F.when(out["scheme"] != "", out)


def enumerator(line: Column) -> Column:
    """The numbering scheme that a line begins with, or null."""
    return enumerated(line)["scheme"]


# Parts of the names of fonts of each class.
SERIF = ("SerifDefault", "Archer", "Baskerville", "Bembo", "Bodoni", "Bookman", "C059", "Calibri", "Cambria", "Century", "Cheltenham", "Courier", "Garamond", "Georgia", "LucidaBright", "Minion", "NimbusMono", "Optima", "P052", "Palatino", "Times")
SANS = ("SansDefault", "Amplitude", "Avenir", "Arial", "Calibri", "Candara", "Carlito", "Clarika", "Comic", "Franklin", "Frutiger", "Futura", "Gotham", "Gothic", "Halvorsen", "Helvetica", "Impact", "Interstate", "Kievit", "Lato", "Myriad", "Segoe", "Tahoma", "Trebuchet", "Univers", "Verdana")
SYMBOL = ("SymbolDefault", "Dingbats", "Wingdings", "Webdings", "ZapfDingbats", "Symbol", "SymbolMT", "Quivira")
#: Patterns of names without blanks and underscores with the class they tell; the first that is found counts.
FONT_CLASSES = (
    (r"^(?:Default|GlyphLessFont|HiddenHorzOCR)?$", "Default"), (f"(?i){'|'.join(SYMBOL)}", "SymbolDefault"), (r"(?i)\bsans\b", "SansDefault"), (r"(?i)\bserif\b", "SerifDefault"),
    (f"(?i){'|'.join(SERIF)}", "SerifDefault"), (f"(?i){'|'.join(SANS)}", "SansDefault"), ("(?i)^(?!.*sans).*(?:serif|rom)", "SerifDefault"), ("(?i)san", "SansDefault"),
)


def font_class(name: Column) -> Column:
    """SansDefault, SerifDefault, SymbolDefault or Default by the name of a font."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[_\s]", "")
    hits = F.array(*(F.when(bare.rlike(p), F.lit(c)) for p, c in FONT_CLASSES))
    return F.coalesce(F.get(F.array_compact(hits), 0), F.lit("Default"))


def loose(text: Column, punctuation: bool = True, case: bool = True) -> Column:
    """A word as it is compared: ligatures spelt out, marks that no digit is next to left out, lower case."""
    x = without_ligatures(text)
    x = F.regexp_replace(x, r"(^|[^0-9])[^A-Za-z0-9]($|[^0-9])", "$1$2") if punctuation else x
    return F.lower(x) if case else x


def loose_text(text: str) -> str:
    """loose() of a Python string, in lower case by character."""
    x = text.translate(_SPELT_OUT)
    return re.sub(r"(^|[^0-9])[^A-Za-z0-9](\Z|[^0-9])", r"\1\2", x).translate(_LOWER).lower()


# Codes of languages and those that take their place in ALTO.
ISO_LANGUAGES = {
    "eng": "en-US", "fra": "fr-FR", "deu": "de-DE", "spa": "es-ES", "ita": "it-IT", "por": "pt-PT", "nld": "nl-NL", "rus": "ru-RU", "pol": "pl-PL", "ces": "cs-CZ", "slk": "sk-SK", "ukr": "uk-UA",
    "hun": "hu-HU", "ron": "ro-RO", "hrv": "hr-HR", "srp": "sr-RS", "bul": "bg-BG", "slv": "sl-SI", "cat": "ca-ES", "dan": "da-DK", "fin": "fi-FI", "nor": "no-NO", "swe": "sv-SE", "tur": "tr-TR",
    "ell": "el-GR", "ara": "ar-SA", "heb": "he-IL", "hin": "hi-IN", "jpn": "ja-JP", "kor": "ko-KR", "chi_sim": "zh-CN", "chi_tra": "zh-TW", "tha": "th-TH", "vie": "vi-VN",
}


def iso_language(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ISO_LANGUAGES.items() for x in kv)), code), code)


def title_of(path: Column) -> Column:
    """A file's name without its folders and the ending of a PDF file."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.pdf$", "")


def folder_problem(name: Column) -> Column:
    """What keeps a name from being a folder's, or null."""
    rules = (("empty", "^$"), ("slash", r"[/\\]"), ("dot", r"^\."), ("mark", r"[<>:\"|?*\x00-\x1f]"), ("end", r"[.\x20]$"))
    return F.get(F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(k)) for k, p in rules))), 0)


def option(text: Column) -> Column:
    """(key, kinds, values) of key=value; null without an equals sign or a key. A value with commas is a list of trimmed ones."""
    raw = F.substr(text, F.locate("=", text) + 1)
    parts = F.when(raw.contains(","), F.transform(F.split(raw, ",", -1), lambda v: F.trim(v))).otherwise(F.array(raw))
    kind = lambda v: F.when(v.isin("true", "false"), "boolean").when(v == "null", "null").when(v.rlike(r"^-?\d+(\.\d+)?$"), "number").otherwise("text")
    key = F.trim(F.substring_index(text, "=", 1))
    return F.when(text.contains("=") & (key != ""), F.struct(key.alias("key"), F.transform(parts, kind).alias("kinds"), parts.alias("values")))


def page_range(text: Column) -> Column:
    """The sorted distinct pages of a list like 0-4,7; null if a part is no number."""
    part = F.transform(F.split(text, ","), lambda t: F.struct(F.regexp_extract(t, r"^\s*(\d+)", 1).try_cast("int").alias("a"), F.when(t.contains("-"), F.regexp_extract(t, r"-\s*(\d+)", 1).try_cast("int")).otherwise(F.regexp_extract(t, r"^\s*(\d+)", 1).try_cast("int")).alias("b")))
    run = lambda x: F.when(x["a"] <= x["b"], F.sequence(x["a"], x["b"])).otherwise(F.array().cast("array<int>"))
    return F.when(~F.exists(part, lambda x: x["a"].isNull() | x["b"].isNull()), F.array_sort(F.array_distinct(F.flatten(F.transform(part, run)))))


def upper_median(values: Column) -> Column:
    """The value at half of the length of the sorted values, rounded down; the upper one of two."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / F.lit(2)) + 1).cast("int"))


def quantile(values: Column, q: float) -> Column:
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) * F.lit(q)) + 1).cast("int"))


def middle_mean(values: Column) -> Column:
    """The mean of the middle half, both ends included; of fewer than four values the largest."""
    s, n = F.sort_array(values), F.size(values)
    start = F.floor(n / F.lit(4)) - 1
    part = F.slice(s, (start + 1).cast("int"), (F.least(n, F.ceil(n * F.lit(3) / F.lit(4)) + 1) - start).cast("int"))
    return F.when(n < 4, F.array_max(values).cast("double")).otherwise(F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part))


def column_name(i: Column) -> Column:
    """The spreadsheet name of a column counted from 0: A, B, ... Z, AA."""
    letter = lambda x: F.char(F.lit(65) + x % 26)
    second = F.floor(i / F.lit(26)) - 1
    third = F.floor(second / F.lit(26)) - 1
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(i))
