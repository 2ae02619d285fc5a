"""Templates of nodes: placeholders, blocks under a condition, addenda, and a node of header and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import no_blank_runs


def placeholders(text: Column, values: dict[str, Column]) -> Column:
    """Every ``{{key}}`` replaced by its value; unknown ones stay."""
    for key, value in values.items():
        text = F.replace(text, F.lit("{{" + key + "}}"), value)
    return text


def conditional_blocks(text: Column, chosen: dict[str, Column]) -> Column:
    """Of the blocks ``<!-- MARKER: value --> ... <!-- /MARKER -->`` those of the chosen value are kept without their marks, others go."""
    for marker, value in chosen.items():
        end = rf" -->\n?(.*?)<!-- /{marker} -->\n?"
        kept = F.regexp_replace(text, F.concat(F.lit(f"(?s)<!-- {marker}: "), value, F.lit(end)), F.lit("$1"))
        text = F.regexp_replace(kept, rf"(?s)<!-- {marker}: [\w-]+{end}", "")
    return text


def addendum(text: Column, corpus: Column, sections: Column) -> Column:
    """The mark of addenda replaced by empty sections of the corpus (sections: an array of titles), or taken out where there is no corpus."""
    one = lambda s: F.concat(F.lit("\n## "), s, F.lit("\n\n<!-- Per meta/topic/addenda/"), corpus, F.lit(".md rules. -->\n\n---\n"))
    block = F.when(F.coalesce(corpus, F.lit("")) == "", "").otherwise(F.array_join(F.transform(sections, one), ""))
    parts = F.split(text, r"<!-- CORPUS-ADDENDUM-INSERT:[^>]*-->\n?")
    return F.call_function("array_join", parts, block)


def filled(text: Column, values: dict[str, Column], chosen: dict[str, Column], corpus: Column, sections: Column) -> Column:
    """A node from its template."""
    return no_blank_runs(placeholders(addendum(conditional_blocks(text, chosen), corpus, sections), values))


def node(header: Column, body: Column) -> Column:
    """A node of its raw header and its body."""
    return F.concat(F.lit("---\n"), header, F.lit("\n---\n"), body)
