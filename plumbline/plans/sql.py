"""Pieces of the oracle SQL that restate text functions in DuckDB's dialect."""

from __future__ import annotations

from ..functions.text import ENTITIES, INLINE_TAGS, STOPWORDS, WS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entities(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {quoted(name)}, {quoted(char)})"
    return x


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def normalized(x: str) -> str:
    x = f"translate({entities(x)}, '“”‘’—– ', '\"\"''''-- ')"
    x = rf"regexp_replace({x}, '\[[0-9]+:[0-9]+(?::[0-9]+)?\]', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^[{WS}]*>[{WS}]?', '', 'g')"
    return collapse(f"replace(regexp_replace({x}, '-[{WS}]+', '-', 'g'), '-', '')")


def tokens(x: str) -> str:
    x = rf"regexp_replace({entities(x)}, '\[`/[^`]+`\]', '', 'g')"
    x = f"lower(translate(regexp_replace({x}, '[*_`]', ' ', 'g'), '—–', ' -'))"
    x = f"list_transform(regexp_extract_all({x}, '[a-z0-9][a-z0-9\\-'']+'), lambda w: rtrim(regexp_replace(w, '''s$', ''), ''''))"
    stop = ", ".join(quoted(w) for w in STOPWORDS)
    return f"list_distinct(list_filter({x}, lambda w: length(w) >= 3 AND w NOT IN ({stop})))"


def clean_html(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(?:{INLINE_TAGS})(?:\s[^>]*)?>', '', 'g')"
    return entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def mean_bits(x: str) -> str:
    return f"array_to_string(list_transform({x}::DOUBLE[], lambda v: CASE WHEN v > list_avg({x}::DOUBLE[]) THEN '1' ELSE '0' END), '')"
