"""Text functions as Column expressions: normalization, tokens, HTML, sections, dates, ids, times."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space, as a regex class body that Java and RE2 read alike.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Character references that are decoded without Python, ``&amp;`` last.
ENTITIES = (
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&nbsp;", " "),
    ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)
#: Function words, which carry no evidence and are left out of token pools.
STOPWORDS = (
    "the she they you his her their its our your this that these those who whom whose which what was are were been being have has had does did done will would can could should might must shall "
    "from for with into onto upon off out over under above below between among through during within without against about across after before behind and but because since until unless when where "
    "while although though than yet whether not never also then now just only even else still already ever again very too quite rather much more most less least some any all each every both either "
    "neither other another same such own here there"
).split()


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Every named and numbered character reference; for inputs beyond ENTITIES."""
    return text.map(lambda x: html.unescape(x) if x else x)


#: References that ENTITIES has, and what may be another.
_KNOWN_REFERENCE = "&(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + ");"
_REFERENCE = "&(?:#[0-9xX]|[A-Za-z])"


def native_entities(text: Column) -> Column:
    """The references of ENTITIES decoded; texts without an ampersand, the most, are not searched further."""
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def decode_entities(text: Column) -> Column:
    """All character references decoded. Only texts that hold one beyond ENTITIES go to Python, by Arrow; all others come to it as nulls."""
    other = F.when(F.contains(text, F.lit("&")) & F.regexp_replace(text, _KNOWN_REFERENCE, "").rlike(_REFERENCE), text)
    return F.coalesce(html_unescape(other), native_entities(text))


def mapped(text: Column, chars: str, to: str) -> Column:
    """Single characters replaced, in those texts that have any of them."""
    return F.when(text.rlike(f"[{chars}]"), F.translate(text, chars, to)).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def is_blank(text: Column) -> Column:
    """Nothing but white space, or null."""
    return F.coalesce(F.regexp_replace(text, f"[{WS}]+", "") == "", F.lit(True))


def normalize_for_compare(text: Column, entities: bool = True, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """The form in which a quote is looked for in its source: straight quotes, no ticks, quote marks or hyphens, single spaces. Case is kept."""
    text = decode(text) if entities else text
    text = F.translate(text, "“”‘’—– ", "\"\"''-- ")
    text = F.regexp_replace(text, r"\[[0-9]+:[0-9]+(?::[0-9]+)?\]", "")
    text = F.regexp_replace(text, f"(?md)^[{WS}]*>[{WS}]?", "")
    text = F.regexp_replace(text, f"-[{WS}]+", "-")
    return collapse(F.replace(text, F.lit("-"), F.lit("")))


def significant_tokens(text: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """The sorted distinct significant tokens of a text."""
    # each step names the one before once: what a condition names again is run again for each text
    text = F.translate(F.regexp_replace(decode(text), r"\[`/[^`]+`\]", ""), "*_`—–", "    -")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-']+"), F.lit(0)))
    words = F.transform(words, lambda w: F.rtrim(F.when(w.endswith("'s"), w.substr(F.lit(1), F.length(w) - 2)).otherwise(w), F.lit("'")))
    words = F.filter(words, lambda w: F.length(w) >= 3)
    return F.sort_array(F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS])))


#: Tags that stand inside words and leave no gap.
INLINE_TAGS = "span|b|i|em|strong|u|a|small|code|sub|sup|cite|q|mark|del|ins|abbr|dfn|samp|kbd|var|bdi|bdo|s|wbr|ruby|rt|rp|time|data|meter|progress|output|picture|tt|font"


def clean_html(raw: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """Plain text of a page: scripts and styles go, inline tags vanish, other tags are gaps, references are decoded (``native_entities``: those of ENTITIES alone)."""
    text = F.regexp_replace(raw, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{INLINE_TAGS})(?:\s[^>]*)?>", "")
    return decode(F.regexp_replace(text, r"<[^>]+>", " "))


def h2_titles(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^## ([^\n]+)"), F.lit(1)), lambda t: F.trim(t))


def section(text: Column, title: str) -> Column:
    """The body of the first second-level section of a title; null when there is none."""
    body = F.regexp_extract(text, rf"(?sd)(?:^|\n)## \Q{title}\E[ \t]*\n(.*?)(?:\n## |\z)", 1)
    return F.when(F.array_contains(h2_titles(text), title), body)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def links(text: Column) -> Column:
    """Distinct targets of links in the form [`/type/slug`], sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[`(/[^`]+)`\]"), F.lit(1))))


#: Date cells that stand for no date, and what parts a range.
PLACEHOLDERS = ("—", "-", "n/a", "undated", "tbd", "present", "ongoing", "")
RANGES = (" – ", " — ", " to ", " - ", "–", "—", "-to-")


def partial_date(text: Column) -> Column:
    """(y, m, d) with noughts for what is missing, comparable field by field; null for no date. Ranges count by their left end if it has one."""
    whole = F.trim(text)
    picked = whole
    for sep in reversed(RANGES):  # the first of the separators that occurs parts the range
        at = F.instr(whole, sep)
        left, right = F.trim(F.substring_index(whole, sep, 1)), F.trim(whole.substr(at + len(sep), F.length(whole)))
        picked = F.when(at > 0, F.when(left != "", left).otherwise(right)).otherwise(picked)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(picked, r"^([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?", k), F.lit("")).cast("int"), F.lit(0))
    ok = picked.rlike(r"^[0-9]{4}") & ~F.lower(whole).isin(*PLACEHOLDERS)
    return F.when(ok, F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")))


def natural_key(ident: Column) -> Column:
    """(prefix, number, suffix): q2 before q10, tl15 before tl15b; others last."""
    pattern = r"^([a-zA-Z]+)([0-9]+)([a-zA-Z]*)$"
    ok = ident.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(ident, pattern, 1)).otherwise("zzz").alias("prefix"),
        F.when(ok, F.regexp_extract(ident, pattern, 2).cast("long")).otherwise(F.lit(0).cast("long")).alias("number"),
        F.when(ok, F.regexp_extract(ident, pattern, 3)).otherwise(F.coalesce(ident, F.lit(""))).alias("suffix"),
    )


def classify_location(loc: Column) -> Column:
    """deprecated (bare line numbers), canonical (page, paragraph, time, or lines of the extract), or other."""
    s = F.trim(F.coalesce(loc, F.lit("")))
    return (
        F.when(s == "", "other")
        .when(s.rlike(r"(?i)\bof\s+the\s+extract\b"), "canonical")
        .when(s.rlike(r"(?i)^\s*lines\s+[0-9]+\s*-\s*[0-9]+\s*$|^\s*lines?\s+[0-9]+\s*$"), "deprecated")
        .when(s.rlike(r"(?i)\bp\.?\s*[0-9]+|¶\s*[0-9]+|\[[0-9]+:[0-9]+(:[0-9]+)?\]"), "canonical")
        .otherwise("other")
    )


def seconds_of(stamp: Column) -> Column:
    """[H:]MM:SS[.f] or plain seconds as a double."""
    parts = F.split(F.trim(stamp, F.lit(" []")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))


def clock(seconds: Column, rounded: bool = False) -> Column:
    """MM:SS, or H:MM:SS from an hour on; truncated, or rounded half to even."""
    n = (F.bround(seconds) if rounded else F.floor(seconds)).cast("long")
    h, m, s = F.floor(n / 3600).cast("long"), F.floor(n % 3600 / 60).cast("long"), n % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def long_clock(seconds: Column) -> Column:
    """HH:MM:SS, rounded half to even."""
    n = F.bround(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(n / 3600).cast("long"), F.floor(n % 3600 / 60).cast("long"), n % 60)


def short_clock(seconds: Column, rounded: bool = False) -> Column:
    """M:SS, or H:MM:SS from an hour on; truncated, or rounded half to even."""
    n = (F.bround(seconds) if rounded else F.floor(seconds)).cast("long")
    h, m, s = F.floor(n / 3600).cast("long"), F.floor(n % 3600 / 60).cast("long"), n % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def file_clock(seconds: Column) -> Column:
    """MM-SS, or H-MM-SS from an hour on, for names of files."""
    return F.translate(clock(seconds), ":", "-")


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def source_path(path: Column) -> Column:
    """A contributor's path below the folder of sources: no leading slashes or dots, no ``sources/``."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"^(?:\./|/)+", ""), r"^sources/+", "")


def kebab(name: Column) -> Column:
    """The lower-cased name where it is letters, digits and hyphens, a hyphen not first; null for others."""
    low = F.lower(F.trim(name))
    return F.when(low.rlike(r"^[a-z0-9][a-z0-9-]*$"), low)


def ticks(text: Column) -> Column:
    """The sorted distinct seconds of the marks [MM:SS] or [H:MM:SS] in a text."""
    marks = F.regexp_extract_all(text, F.lit(r"\[([0-9]+:[0-9]+(?::[0-9]+)?)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(marks, seconds_of)))


def page_of_line(text: Column, line: Column) -> Column:
    """The page of a line, one more than the form feeds before it; null in a text without any."""
    before = F.array_join(F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line - 1, F.lit(0))), "\n")
    return F.when(F.contains(text, F.lit("\f")), F.length(before) - F.length(F.replace(before, F.lit("\f"), F.lit(""))) + 1)


def mark_before(text: Column, line: Column) -> Column:
    """The last mark [MM:SS] or [H:MM:SS] at or before a line, the first one of its line; null where there is none."""
    lines = F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line, F.lit(1)))
    marks = F.filter(F.transform(lines, lambda l: F.regexp_extract(l, r"\[[0-9]+:[0-9]+(?::[0-9]+)?\]", 0)), lambda m: m != "")
    return F.try_element_at(marks, F.lit(-1))


def no_blank_runs(text: Column) -> Column:
    """Three or more line breaks become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def wrap_path(path: Column) -> Column:
    return F.when(path.startswith("/"), F.concat(F.lit("[`"), path, F.lit("`]"))).otherwise(path)


def escape_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(r"\|"))


def period(start: Column, end: Column) -> Column:
    a, b = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(" – "), b)).when(b != "", F.concat(F.lit("– "), b)).otherwise(a)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def humanize(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def snapshot_date(url: Column) -> Column:
    """The date in a web-archive address, YYYY-MM-DD."""
    stamp = F.regexp_extract(url, r"/web/([0-9]{8,14})", 1)
    return F.when(stamp != "", F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)))


#: The format of a file by its extension; all others are html.
FORMATS = {"pdf": "pdf", "txt": "txt", "md": "transcript"} | {e: "video" for e in ("mp4", "m4v", "mov", "webm", "avi", "mkv")} | {e: "audio" for e in ("mp3", "wav", "flac", "aac", "ogg", "m4a")} | {e: "image" for e in ("jpg", "jpeg", "png", "gif", "webp")}


def format_of(path: Column) -> Column:
    """The format by a path's extension, html for those unknown, null for no path."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.when(F.coalesce(path, F.lit("")) != "", F.coalesce(F.try_element_at(known, ext), F.lit("html")))
