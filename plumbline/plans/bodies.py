"""Artifacts rendered to bodies and compared with nodes and sources, each beside an independent SQL form.

Artifacts of every node type are made from customers by SQL that both engines
read alike. The oracle renders the JSON with DuckDB's list functions; the
helpers below write those expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import written
from ..operators import artifacts, documents, issues
from . import sql as S
from .chain import _ARTIFACTS, _EACH, _NODES, _PLACE, _TEXTS, _artifacts, _found, _nodes, _one, _sql, _values, _x

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TOPIC = "Topic"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# -- the artifacts
_KINDS = ("person", "organization", "document", "event", "transcript", "media", "location", "finding", "investigation")


def _entry(section: str, k: int, fields: dict[str, str]) -> str:
    """One entry as SQL for JSON: a field is left out, null or set by the customer's key; ``%`` in a value stands for the key."""
    parts = []
    for i, (f, v) in enumerate(sorted(fields.items())):
        text = '"' + f + '": ' + (v if v[:1] in "{[" or v in ("true", "false") else f'"{v}"')
        sql = "'" + ", " + text.replace("'", "''").replace("%", "' || CAST(c_custkey AS STRING) || '") + "'"
        parts.append(f"CASE WHEN (c_custkey + {3 * i + k + len(section)}) % 7 = 0 THEN '' ELSE {sql} END")
    return f"""'{{"id": "{section[:1]}' || CAST((c_custkey * 7 + {k} * 5) % 23 AS STRING) || '"' || {' || '.join(parts)} || '}}'"""


_SRC = '{"path": "s%", "location": "p. 1"}'
_PERIOD = {"period_start": "2004-0%", "period_end": "2009", "source": _SRC, "note": "a|note %"}
_SECTIONS: dict[str, list[dict[str, str]]] = {
    "affiliations": [{"organization_path": "/o/x%", "role": "r|s", **_PERIOD}, {"organization_path": "o/y", "role": "head", "period_start": "1999", "flagged": "true"}, {"organization_path": "/o/z", "period_end": "2001"}],
    "relationships": [{"person_path": "/people/p%", "relationship": "peer", "source": _SRC, "note": "n"}, {"person_path": "/people/q", "flagged": "true"}],
    "program_involvement": [{"program": "P%", "role": "r", "evidentiary_basis": "on-record", "confidence": "low", **_PERIOD}],
    "publication_record": [{"date": "2011-02", "publication": "Pub %", "outlet": "Out", "node_link": "/documents/d%", "source": _SRC}, {"date": "2010", "publication": "Old"}],
    "vouching_chain": [{"voucher_path": "/people/v%", "attestation": "He said at length what he had seen and heard of it all, so long that it must be cut somewhere near its end % times over.", "source": _SRC}],
    "corroboration_items": [{"observer_path": "/people/o%", "observation_type": "testimonial", "note": "N", "source": _SRC}],
    "timeline": [{"date": "2005", "event": "second %", "category": "c", "source": _SRC, "node_link": "/events/e%"}, {"date": "2004-11", "event": "first|one", "source": _SRC}, {"event": "no day"}],
    "rumors": [{"claim": "They say %", "status": "primary-source-disputed", "observed_sources": '["a", "b%"]', "note": "N"}, {"claim": "Also", "status": "not-primary-source-established", "note": "M"}],
    "naming_quirks": [{"observed": "Smyth", "canonical": "Smith", "source_path": "s%", "resolution": "preserve-as-sic-in-quotes", "note": "x"}, {"observed": "o", "canonical": "c", "resolution": "disputed"}],
    "speakers": [{"name": "Jane %", "node_link": "/people/jane", "role": "host", "source": _SRC}],
    "quotes": [{"text": "Long enough to be shown by itself, number %.", "source": _SRC, "context": "Talk, 2004", "statement_date": "2004", "observation_type": "direct", "speaker_id": "s0", "significance": "Point %", "attestation_tier": "on-record", "attestor_path": "/people/t"}, {"text": "Yes.", "source": _SRC, "statement_date": "2001-05", "observation_type": "relayed", "speaker_id": "s1"}],
    "key_personnel": [{"person_path": "/people/k%", "role": "Director", "leadership_class": "director", **_PERIOD}, {"person_path": "/people/l", "leadership_class": "staff", "period_start": "2001"}, {"person_path": "/people/m", "leadership_class": "odd", "role": "x"}, {"person_path": "/people/n", "flagged": "true"}],
    "org_relationships": [{"organization_path": "/organizations/o%", "relationship_type": "parent", "source": _SRC, "note": "n"}],
    "contracts": [{"contract_number": "K-%", "contracting_agency": "A", "value": "$5", "primary_counterparty_path": "/organizations/q", "subject": "s", **_PERIOD}],
    "participants": [{"participant_path": "/people/a%", "capacity": "committee-member", "role": "chair", "source": _SRC, "note": "n"}, {"participant_path": "/people/b", "capacity": "odd"}, {"participant_path": "/people/c", "flagged": "true", "capacity": "witness-eyewitness"}],
    "witnesses_testimony": [{"witness_path": "/people/w%", "oath_status": "sworn", "transcript_node": "/transcripts/t", "written_testimony_node": "x", "note": "n"}],
    "media_versioning": [{"aspect": "duration", "parent_form": "%:10", "this_form": "1:00", "source": _SRC, "note": "n"}],
    "ownership_timeline": [{"owner": "Own", "owner_path": "/people/o%", "use_status": "used", **_PERIOD}, {"owner": "Old", "period_start": "1990-05-02"}],
    "top_scope_activity": [{"activity": "act %", "actor_paths": '["/people/a%", "x"]', **_PERIOD}],
    "location_relationships": [{"entity_path": "/people/e%", "relationship": "owner", "note": "n"}, {"entity_path": "/people/f", "flagged": "true"}],
    "hypotheses": [{"statement": "It is %."}],
    "cited_findings": [{"finding_path": "/findings/f%", "pattern_statement": "p", "relevance": "r"}],
    "hypothesis_evaluation": [{"hypothesis_id": "H%", "status": "open", "text": "T.", "sources": '[{"entity_path": "/e", "anchor": "q1", "description": "d %"}, {"finding_path": "/findings/g", "description": "e"}, {"description": "z"}]'}],
    "open_questions": [{"question": "Why %?", "what_would_resolve": "more"}],
    "counter_evidence": [{"against_hypothesis_id": "h1", "text": "Against it.", "status": "s"}],
    "closure_path": [{"blocking_event": "a ruling", "expected_unblock_path": "court %"}],
    "resolution_history": [{"date": "2020", "event": "e%"}],
    "contradictions": [{"question": "Which %?", "positions": '[{"evidence_id": "q1", "position": "yes"}, {"evidence_id": "q2", "position": "no|t"}]', "note": "n"}],
}
_INTRINSIC = {"full_name": "Full % Name", "born": "1950", "nationality": "X", "office_type": "office", "established_date": "1947", "parent_organization_path": "/organizations/p%", "current_director_path": "d", "location_type": "ranch", "alternate_names": '["A%", "B"]', "coordinates": "1, 2", "internal_title": "A Title %", "internal_date": "2001", "authors_per_document": "Me", "classification": "none", "pages": "12", "duration": "1:00", "resolution": "HD"}
_EVENT = {"hearing_title": "Hearing %", "committee": "C", "date": "2023-07-26", "location": "Room", "chair": "Ch"}


def _object(fields: dict[str, str], salt: int) -> str:
    parts = []
    for i, (f, v) in enumerate(fields.items()):
        text = ', "' + f + '": ' + (v if v[0] == "[" else f'"{v}"')
        parts.append(f"CASE WHEN (c_custkey + {5 * i + salt}) % 6 = 0 THEN '' ELSE '{text.replace('%', "' || CAST(c_custkey AS STRING) || '")}' END")
    return f"""'{{"z": 0' || {' || '.join(parts)} || '}}'"""


def _lists() -> str:
    out = []
    for n, (section, every) in enumerate(_SECTIONS.items()):
        size = f"(c_custkey * 3 + {n}) % {len(every) + 2}"
        rows = " || ".join(f"CASE WHEN {size} > {k} THEN {repr(', ') if k else repr('')} || {_entry(section, k, e)} ELSE '' END" for k, e in enumerate(every))
        out.append(f"""', "{section}": [' || {rows} || ']'""")
    return " || ".join(out)


_PLAIN = {"description": "Some text. ", "background": "Back %. ", "top_relevance": "", "credibility_notes": "Fine %", "pattern_statement": "Pattern %.", "question": "What % is it?"}
#: (path, node_type, kind, j, fm): artifacts of every type.
_BODIES = f"""SELECT 'r/' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 9 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_KINDS))} END AS node_type,
CASE c_custkey % 4 WHEN 0 THEN 'hearing' WHEN 1 THEN 'gov-contractor' WHEN 2 THEN 'gov-doc' ELSE NULL END AS kind,
'{{"target_node": "x/some-name' || CAST(c_custkey AS STRING) || '"' || {' || '.join(f"CASE WHEN (c_custkey + {i}) % 4 = 0 THEN '' ELSE ', ' || '" + chr(34) + f + chr(34) + ": " + chr(34) + v.replace('%', "' || CAST(c_custkey AS STRING) || '") + chr(34) + "' END" for i, (f, v) in enumerate(_PLAIN.items()))}
 || ', "document_intrinsic": ' || {_object(_INTRINSIC, 1)} || ', "event_intrinsic": ' || {_object(_EVENT, 2)} || ', "context_extrinsic": {{' || CASE WHEN c_custkey % 5 = 0 THEN '"display_title": "Shown", ' ELSE '' END || '"primary_source_url": "http://u", "provenance": [{{"step": "1", "date": "2001", "entity": "E|F", "verified": "yes"}}]}}'
 || ', "primary_sources": [{{"path": "s' || CAST(c_custkey AS STRING) || '"}}]' || ', "establishes": [' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '" one ", "two"' END || '], "does_not_establish": ["no"], "best_current_answer": {{' || CASE WHEN c_custkey % 2 = 0 THEN '"text": "It may be."' ELSE '"sources": [{{"finding_path": "/findings/h", "description": "d"}}]' END || '}}'
 || {_lists()} || '}}' AS j, CASE WHEN c_custkey % 3 = 0 THEN '{{"status": "paused", "question": "Asked?"}}' ELSE '{{"status": "open"}}' END AS fm FROM customer"""


# -- DuckDB expressions over the JSON j of a row
Fn = Callable[[str], str]
q = S.quoted


def of(x: str, key: str) -> str:
    return f"coalesce(json_extract_string({x}, '$.{key}'), '')"


def items(section: str, x: str = "j") -> str:
    return f"coalesce(json_extract({x}, '$.{section}[*]'), [])"


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


NL = "chr(10)"


def lines(text: str) -> str:
    """A literal with line breaks."""
    return cat(*[p for k, t in enumerate(text.split("\n")) for p in ([NL] if k else []) + ([q(t)] if t else [])] or ["''"])


def kept(parts: list[str], between: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda y: y IS NOT NULL), {between})"


def escaped(v: str) -> str:
    return f"replace(replace({v}, {NL}, ' '), '|', '\\|')"


def wrap(v: str) -> str:
    return f"CASE WHEN starts_with({v}, '/') THEN '[`' || {v} || '`]' ELSE {v} END"


def cell(key: str) -> Fn:
    return lambda x: escaped(of(x, key))


def wrapped(key: str) -> Fn:
    return lambda x: wrap(of(x, key))


def spell(x: str) -> str:
    a, b = of(x, "period_start"), of(x, "period_end")
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN {a} || ' – ' || {b} WHEN {b} <> '' THEN '– ' || {b} ELSE {a} END"


def cut(v: str, most: int) -> str:
    return f"CASE WHEN length({v}) > {most} THEN substr({v}, 1, {most - 3}) || '…' ELSE {v} END"


def by_place(x: str) -> str:
    return "[0]"


def id_key(x: str) -> str:
    i = of(x, "id")
    return f"struct_pack(p := regexp_extract({i}, '^([a-zA-Z]+)', 1), n := regexp_extract({i}, '([0-9]+)', 1)::BIGINT)"


def by_id(x: str) -> str:
    return id_key(x)


def by_date(key: str) -> Fn:
    def order(x: str) -> str:
        d = of(x, key)
        part = lambda k: f"coalesce(try_cast(nullif(regexp_extract({d}, '^([0-9]{{4}})(?:-([0-9]{{1,2}})(?:-([0-9]{{1,2}}))?)?', {k}), '') AS INT), 0)"
        return f"struct_pack(y := CASE WHEN {d} <> '' THEN {part(1)} ELSE 9999 END, m := {part(2)}, d := {part(3)}, i := {id_key(x)})"

    return order


_depth = [0]


def each(rows: str, fn: Fn, more: str = "") -> str:
    """list_transform with a name of its own for each nesting."""
    _depth[0] += 1
    v = f"v{_depth[0]}"
    return f"list_transform({rows}, lambda {v}{more}: {fn(v)})"


def such(rows: str, fn: Fn) -> str:
    _depth[0] += 1
    v = f"w{_depth[0]}"
    return f"list_filter({rows}, lambda {v}: {fn(v)})"


def ordered(rows: str, line: Fn, order: Fn, between: str = NL) -> str:
    _depth[0] += 1
    v = f"s{_depth[0]}"
    keyed = f"list_transform({rows}, lambda {v}, {v}i: struct_pack(k := {order(v)}, i := {v}i, l := {line(v)}))"
    return f"array_to_string(list_transform(list_sort({keyed}), lambda {v}z: {v}z.l), {between})"


def table(columns: list[tuple[str, Fn]], rows: str, order: Fn = by_place) -> str:
    head = lines("| " + " | ".join(h for h, _ in columns) + " |\n|" + "---|" * len(columns) + "\n")
    line = lambda x: "'| ' || " + " || ' | ' || ".join(fn(x) for _, fn in columns) + " || ' |'"
    return cat(head, f"CASE WHEN len({rows}) = 0 THEN {q('|' + '  |' * len(columns))} ELSE {ordered(rows, line, order)} END")


def headed(title: str, body: str) -> str:
    return cat(lines(f"## {title}\n\n"), body)


def where_any(rows: str, text: str) -> str:
    return f"CASE WHEN len({rows}) > 0 THEN {text} END"


def prose(title: str, text: str, field: str) -> str:
    return headed(title, f"CASE WHEN trim({text}) <> '' THEN trim({text}) ELSE {q(f'<!-- TODO: populate `{field}` -->')} END")


def flagged(x: str) -> str:
    return f"coalesce(json_extract_string({x}, '$.flagged') = 'true', false)"


SOURCE, NOTE = ("Source", cell("source.path")), ("Note", cell("note"))


def split_table(title: str, section: str, columns: list[tuple[str, Fn]], order: Fn = by_place) -> str:
    sure, doubt = such(items(section), lambda x: f"NOT {flagged(x)}"), such(items(section), flagged)
    return headed(title, cat(lines("### Confirmed\n\n"), table(columns, sure, order), f"CASE WHEN len({doubt}) > 0 THEN {cat(lines(chr(10) * 2 + '### Flagged' + chr(10) * 2), table(columns, doubt, order))} ELSE '' END"))


def grouped_table(title: str, section: str, key: str, groups: list[tuple[str, str]], other: str, columns: list[tuple[str, Fn]], order: Fn = by_place) -> str:
    names = ", ".join(q(g) for g, _ in groups)
    parts = ["'### Confirmed'"]
    for g, heading in [*groups, ("", other)]:
        own = such(items(section), lambda x: f"NOT {flagged(x)} AND " + (f"{of(x, key)} = {q(g)}" if g else f"{of(x, key)} NOT IN ({names})"))
        parts.append(where_any(own, cat(lines(f"#### {heading}\n\n"), table(columns, own, order))))
    doubt = such(items(section), flagged)
    parts.append(where_any(doubt, cat(lines("### Flagged\n\n"), table(columns, doubt, order))))
    return headed(title, kept(parts, NL + " || " + NL))


def facts(title: str, rows: list[tuple[str, str]]) -> str:
    each_ = [f"CASE WHEN {v} <> '' THEN '| {k} | ' || {v} || ' |' END" for k, v in rows]
    body = kept(each_, NL)
    return headed(title, cat(lines("| Field | Value |\n|---|---|\n"), f"CASE WHEN {body} <> '' THEN {body} ELSE '|  |  |' END"))


def fields(base: str, keys: list[tuple[str, str]]) -> list[tuple[str, str]]:
    def value(k: str) -> str:
        v = f"coalesce(array_to_string(json_extract_string(nullif(json_extract(j, '$.{base}.{k}'), 'null'), '$[*]'), '; '), '')"
        v = f"CASE WHEN json_type(j, '$.{base}.{k}') = 'ARRAY' THEN {v} ELSE {of('j', f'{base}.{k}')} END"
        return f"({wrap('(' + v + ')') if k.endswith('_path') else v})"

    return [(label, value(k)) for label, k in keys]


def bullets(title: str, section: str, line: Fn, keep: bool = True) -> str:
    text = headed(title, f"CASE WHEN len({items(section)}) > 0 THEN {ordered(items(section), lambda x: cat(q('- '), line(x)), by_place)} ELSE {q(f'<!-- TODO: populate `{section}` -->')} END")
    return text if keep else where_any(items(section), text)


def strong(head: str, tail: str) -> Fn:
    return lambda x: f"CASE WHEN {of(x, tail)} <> '' THEN '**' || {of(x, head)} || '** — ' || {of(x, tail)} ELSE {of(x, head)} END"


def said(x: str) -> str:
    c, d = of(x, "context"), of(x, "statement_date")
    return f"CASE WHEN {d} <> '' AND contains({c}, {d}) THEN {c} ELSE array_to_string(list_filter([{c}, {d}], lambda y: y <> ''), ', ') END"


def speaker(x: str) -> str:
    match = such(items("speakers"), lambda s: f"{of(s, 'id')} = {of(x, 'speaker_id')} AND {of(x, 'speaker_id')} <> ''") + "[1]"
    name, link = of(match, "name"), of(match, "node_link")
    return f"CASE WHEN {name} <> '' AND {link} <> '' THEN {name} || ' (' || {wrap(link)} || ')' ELSE {name} || {link} END"


def archived(path: str) -> str:
    return f"CASE WHEN {path} <> '' THEN '[archived source](../sources/' || {path} || ')' ELSE '' END"


def block(x: str) -> str:
    return f"array_to_string(list_transform(string_split(rtrim({of(x, 'text')}, {NL}), {NL}), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), {NL})"


def attribution(x: str, tiers: bool = False) -> str:
    rows = [("Speaker", speaker(x)), ("Attributed to", said(x))]
    rows += [("Tier", of(x, "attestation_tier")), ("Attestor", wrap(of(x, "attestor_path")))] if tiers else []
    rows += [("Source", archived(of(x, "source.path"))), ("Location", of(x, "source.location"))]
    return cat(lines("| Field | Value |\n|---|---|\n"), kept([f"CASE WHEN ({v}) <> '' THEN '| {k} | ' || ({v}) || ' |' END" for k, v in rows], NL))


_GAP = f"{NL} || {NL}"


def passages(title: str, order: Fn, heading: str = "Passage", tiers: bool = False) -> str:
    head = lambda x: cat(q("### "), f"coalesce(nullif({of(x, 'significance')}, ''), {q(heading)})", NL, NL)
    one = lambda x: cat(head(x), block(x), NL, NL, attribution(x, tiers))
    return headed(title, f"CASE WHEN len({items('quotes')}) > 0 THEN {ordered(items('quotes'), one, order, lines(chr(10) * 2 + '---' + chr(10) * 2))} ELSE '<!-- TODO: populate `quotes` -->' END")


def statement(x: str) -> str:
    line = f"array_to_string(list_filter([{said(x)}, {archived(of(x, 'source.path'))}, {of(x, 'source.location')}], lambda y: y <> ''), '; ')"
    return f"CASE WHEN length(trim({of(x, 'text')})) < 30 THEN {block(x)} || CASE WHEN {line} <> '' THEN {_GAP} || '_' || {line} || '_' ELSE '' END ELSE {cat(block(x), NL, NL, attribution(x))} END"


def statements(title: str, rows: str) -> str:
    return where_any(rows, headed(title, ordered(rows, statement, by_date("statement_date"), _GAP)))


def rollup(x: str) -> str:
    rows = items("sources", x)
    target = lambda s: f"CASE WHEN {of(s, 'finding_path')} <> '' THEN {wrap(of(s, 'finding_path'))} WHEN {of(s, 'entity_path')} <> '' THEN {wrap(of(s, 'entity_path'))} || CASE WHEN {of(s, 'anchor')} <> '' THEN ' ' || {of(s, 'anchor')} ELSE '' END ELSE '(malformed source entry)' END"
    return f"CASE WHEN len({rows}) > 0 THEN {cat(lines('**Sources:**' + chr(10) * 2), 'array_to_string(' + each(rows, lambda s: cat(q('- '), '(' + target(s) + ')', q(' — '), f'trim({of(s, chr(100) + chr(101) + chr(115) + chr(99) + chr(114) + chr(105) + chr(112) + chr(116) + chr(105) + chr(111) + chr(110))})')) + f', {NL})')} END"


def cards(title: str, section: str, heading: Fn, keep: bool = True) -> str:
    one = lambda x: kept([cat(q("### "), "(" + heading(x) + ")"), f"CASE WHEN {of(x, 'status')} <> '' THEN '**Status:** ' || {of(x, 'status')} END", f"nullif(trim({of(x, 'text')}), '')", rollup(x)], _GAP)
    text = headed(title, f"CASE WHEN len({items(section)}) > 0 THEN {ordered(items(section), one, by_place, _GAP)} ELSE {q(f'<!-- TODO: populate `{section}` -->')} END")
    return text if keep else where_any(items(section), text)


def hypothesis(x: str) -> str:
    hid = of(x, "hypothesis_id")
    stated = f"coalesce(trim({of('list_last(' + such(items('hypotheses'), lambda h: f'lower({of(h, chr(105) + chr(100))}) = lower({hid})') + ')', 'statement')}), '')"
    return f"CASE WHEN {stated} <> '' THEN upper({hid}) || ' — ' || {stated} ELSE upper({hid}) END"


def quirks(title: str, intro: str, resolution: str, first: str, second: str) -> str:
    rows = such(items("naming_quirks"), lambda x: f"{of(x, 'resolution')} = {q(resolution)}")
    return where_any(rows, headed(title, cat(lines(intro + "\n\n"), table([(first, cell("observed")), (second, cell("canonical")), ("Source", cell("source_path")), NOTE], rows))))


def rumors(title: str, intro: str, status: str, label: str) -> str:
    rows = such(items("rumors"), lambda x: f"{of(x, 'status')} = {q(status)} AND trim({of(x, 'claim')}) <> ''")
    seen = lambda x: f"coalesce(array_to_string(json_extract_string({x}, '$.observed_sources[*]'), '; '), '')"
    one = lambda x: kept([cat(q('### "'), f"trim({of(x, 'claim')})", q('"')), f"CASE WHEN {seen(x)} <> '' THEN '**Circulates in:** ' || {seen(x)} END", f"CASE WHEN {of(x, 'note')} <> '' THEN '**{label}:** ' || {of(x, 'note')} END"], _GAP)
    return where_any(rows, headed(title, cat(lines(intro + "\n\n"), ordered(rows, one, by_place, _GAP))))


def _expected() -> dict[str, list[str]]:
    """The sections of each type as DuckDB expressions, null where they do not apply."""
    timeline = headed("Timeline", table([("Date", cell("date")), ("Event", cell("event")), ("Category", cell("category")), SOURCE, ("Node Link", wrapped("node_link"))], items("timeline"), by_date("date")))
    description = prose("Description", of("j", "description"), "description")
    provenance = headed("Provenance", table([("Step", cell("step")), ("Date", cell("date")), ("Entity", cell("entity")), ("Verified", cell("verified"))], items("context_extrinsic.provenance")))
    corroboration = headed("Corroboration", table([("Observer", wrapped("observer_path")), ("Type", cell("observation_type")), ("What It Confirms", cell("note")), ("Attested In", cell("source.path"))], items("corroboration_items")))
    quirk = [quirks("Source-Form Notes", "Forms kept in quotations as the source has them, with the canonical form.", "preserve-as-sic-in-quotes", "Source Form", "Canonical"), quirks("Preserved Disagreements", "Primary sources attest opposing forms; both stay on the record.", "disputed", "Position", "Counterpart")]
    linked = lines("## Associated Nodes\n\n<!-- generated from the links of the body -->")
    short = [*quirk, linked]
    rest = [rumors("Primary-Source Contradictions", "Claims that circulate and that primary sources contradict.", "primary-source-disputed", "Primary-source refutation"), rumors("Public-Record Claims Without Primary Source", "Claims that circulate without an archived primary source; leads, not facts.", "not-primary-source-established", "Investigator note"), *short]
    direct = lambda x: f"{of(x, 'observation_type')} = 'direct'"
    people = [("Name", wrapped("person_path")), ("Role", cell("role")), ("Period", spell), SOURCE, NOTE]
    guests = [("Participant", wrapped("participant_path")), ("Role", cell("role")), SOURCE, NOTE]
    hearing = "kind IS NOT DISTINCT FROM 'hearing'"
    when = lambda cond, text: f"CASE WHEN {cond} THEN {text} END"
    deals = [("Contract", cell("contract_number")), ("Contracting Agency", cell("contracting_agency")), ("Period", spell), ("Value", cell("value")), ("Counterparty", wrapped("primary_counterparty_path")), ("Subject", cell("subject")), SOURCE, NOTE]
    acted = lambda x: f"array_to_string(list_filter([{of(x, 'activity')}, coalesce(array_to_string(list_transform(json_extract_string({x}, '$.actor_paths[*]'), lambda p: {wrap('p')}), '; '), '')], lambda y: y <> ''), ' — ')"
    about = [("Full Name", "full_name"), ("Internal Name", "internal_name"), ("Type", "office_type"), ("Established", "established_date"), ("Terminated", "terminated_date"), ("Parent Organization", "parent_organization_path"), ("Director", "current_director_path"), ("Jurisdiction", "jurisdiction"), ("Contracting Agency", "contracting_agency"), ("Headquarters", "headquarters")]
    places = [("Full Name", "full_name"), ("Alternate Names", "alternate_names"), ("Location Type", "location_type"), ("Geographic Location", "geographic_location"), ("Coordinates", "coordinates"), ("Legal Description", "legal_description"), ("Ownership History Summary", "ownership_history_summary"), ("Scope Significance", "scope_significance")]
    held = [("Full Title", "hearing_title"), ("Convening Body", "committee"), ("Session", "session"), ("Date", "date"), ("Location", "location"), ("Chair", "chair"), ("Ranking Member", "ranking_member"), ("Duration", "duration"), ("Weather", "weather"), ("Instruments Involved", "instruments_involved")]
    papers = [("Title", "internal_title"), ("Authored Date (per document)", "internal_date"), ("Author (per document)", "authors_per_document"), ("Classification", "classification"), ("Pages", "pages")]
    plain = lambda x: f"trim(json_extract_string({x}, '$'))"
    contradiction = lambda c: cat(q("### "), of(c, "question"), NL, NL, table([("Evidence", lambda p: cat(q("`"), of(p, "evidence_id"), q("`"))), ("Position", cell("position"))], items("positions", c)), f"CASE WHEN {of(c, 'note')} <> '' THEN {_GAP} || {of(c, 'note')} ELSE '' END")
    return {
        "person": [
            facts("Identity", fields("document_intrinsic", [("Full Name", "full_name"), ("Born", "born"), ("Nationality", "nationality")])), prose("Background", of("j", "background"), "background"), prose(f"{TOPIC} Relevance", of("j", "top_relevance"), "top_relevance"),
            split_table("Affiliations", "affiliations", [("Organization", wrapped("organization_path")), ("Role", cell("role")), ("Period", spell), SOURCE, NOTE], by_date("period_start")), statements("Statements — Direct", such(items("quotes"), direct)), statements("Statements — Relayed", such(items("quotes"), lambda x: f"NOT {direct(x)}")),
            split_table("Relationships", "relationships", [("Person", wrapped("person_path")), ("Relationship", cell("relationship")), SOURCE, NOTE]), where_any(items("quotes"), headed("Claim Inventory", table([("Claim", lambda x: escaped("(" + cut(of(x, "text"), 120) + ")")), ("Type", cell("observation_type")), SOURCE], items("quotes"), by_id))),
            where_any(items("program_involvement"), headed("Program Involvement", table([("Program", cell("program")), ("Role", cell("role")), ("Period", spell), ("Basis", cell("evidentiary_basis")), ("Confidence", cell("confidence")), SOURCE], items("program_involvement"), by_date("period_start")))),
            where_any(items("publication_record"), headed("Publication Record", table([("Date", cell("date")), ("Publication", cell("publication")), ("Outlet", cell("outlet")), ("Node Link", wrapped("node_link")), SOURCE], items("publication_record"), by_date("date")))),
            where_any(items("vouching_chain"), headed("Vouching Chain", table([("Voucher", wrapped("voucher_path")), ("Attestation", lambda x: escaped("(" + cut(of(x, "attestation"), 100) + ")")), SOURCE], items("vouching_chain")))), where_any(items("corroboration_items"), corroboration),
            when(f"{of('j', 'credibility_notes')} <> ''", headed("Credibility Notes", of("j", "credibility_notes"))), timeline, *rest,
        ],
        "organization": [facts("Overview", fields("document_intrinsic", about)), description, grouped_table("Key Personnel", "key_personnel", "leadership_class", [("director", "Directors"), ("deputy", "Deputy Leadership"), ("staff", "Staff"), ("advisor", "Advisors")], "Other Named Personnel", people, by_date("period_start")), passages("Key Passages", by_date("statement_date")), when("kind = 'gov-contractor'", headed("Primary Contracts", table(deals, items("contracts"), by_date("period_start")))), timeline, split_table("Relationships", "org_relationships", [("Organization", wrapped("organization_path")), ("Relationship", cell("relationship_type")), SOURCE, NOTE]), *rest],
        "document": [facts("Document Summary", [*fields("document_intrinsic", papers), ("Primary Source URL", of("j", "context_extrinsic.primary_source_url")), ("Local Archive", "(" + archived(of("j", "primary_sources[0].path")) + ")")]), description, when("kind = 'gov-doc'", provenance), passages("Key Passages", by_id), *short],
        "event": [
            facts("Event Summary", fields("event_intrinsic", held)), description, f"CASE WHEN {hearing} THEN {grouped_table('Participants', 'participants', 'capacity', documents.CAPACITIES, 'Other', guests)} ELSE {split_table('Participants', 'participants', guests)} END", timeline,
            when(hearing, headed("Key Testimony", f"CASE WHEN len({items('quotes')}) > 0 THEN {ordered(items('quotes'), statement, by_date('statement_date'), _GAP)} ELSE '<!-- no testimony recorded -->' END")),
            when(hearing, headed("Witnesses & Testimony", table([("Witness", wrapped("witness_path")), ("Oath Status", cell("oath_status")), ("Transcript", wrapped("transcript_node")), ("Written Testimony", wrapped("written_testimony_node")), NOTE], items("witnesses_testimony")))), when(f"kind IS NOT NULL AND NOT {hearing}", corroboration), *rest,
        ],
        "transcript": [facts("Transcript Summary", fields("document_intrinsic", [("Title", "internal_title"), ("Date", "internal_date")])), description, headed("Speakers", table([("Name", cell("name")), ("Role", cell("role")), ("Node Link", wrapped("node_link")), SOURCE], items("speakers"), by_id)), passages("Key Passages", by_date("statement_date")), *short],
        "media": [facts("Media Summary", fields("document_intrinsic", [("Title", "internal_title"), ("Date", "internal_date"), ("Duration", "duration"), ("Resolution", "resolution")])), description, provenance, where_any(items("media_versioning"), headed("Versioning", table([("Aspect", cell("aspect")), ("Parent Form", cell("parent_form")), ("This Form", cell("this_form")), SOURCE, NOTE], items("media_versioning"), by_id))), passages("Key Passages", by_id), *short],
        "location": [facts("Overview", [*fields("document_intrinsic", places), ("Status", of("fm", "status"))]), description, headed("Ownership Timeline", table([("Period", spell), ("Owner", lambda x: f"trim({of(x, 'owner')} || ' ' || {wrap(of(x, 'owner_path'))})"), ("Use / Status", cell("use_status")), SOURCE, NOTE], items("ownership_timeline"), by_date("period_start"))), headed(f"{TOPIC}-Scope Activity", table([("Period", spell), ("Activity", acted), SOURCE, NOTE], items("top_scope_activity"), by_date("period_start"))), passages("Key Passages", by_date("statement_date")), split_table("Relationships", "location_relationships", [("Entity", wrapped("entity_path")), ("Relationship", cell("relationship")), NOTE]), *rest],
        "finding": [prose("Pattern Statement", of("j", "pattern_statement"), "pattern_statement"), description, passages("Evidence", by_date("statement_date"), "Attestation", tiers=True), bullets("What the Record Establishes", "establishes", plain), bullets("What the Record Doesn't Establish", "does_not_establish", plain), where_any(items("contradictions"), headed("Apparent Contradictions", ordered(items("contradictions"), contradiction, by_place, _GAP))), where_any(items("timeline"), timeline), *short],
        "investigation": [
            prose("Question", f"coalesce(nullif({of('fm', 'question')}, ''), {of('j', 'question')})", "question"), description, bullets("Hypotheses", "hypotheses", lambda x: cat(q("**"), f"upper({of(x, 'id')})", q("** — "), of(x, "statement"))), headed("Cited Findings", table([("Finding", wrapped("finding_path")), ("Pattern", cell("pattern_statement")), ("Relevance", cell("relevance"))], items("cited_findings"))),
            cards("Hypothesis Evaluation", "hypothesis_evaluation", hypothesis), bullets("Open Questions", "open_questions", strong("question", "what_would_resolve")), headed("Best-Current Answer", kept([f"nullif({of('j', 'best_current_answer.text')}, '')", rollup("json_extract(j, '$.best_current_answer')")], _GAP)),
            cards("Counter-Evidence", "counter_evidence", lambda x: cat(q("Against "), f"upper({of(x, 'against_hypothesis_id')})"), keep=False), f"CASE WHEN len({items('closure_path')}) > 0 OR {of('fm', 'status')} = 'paused' THEN {bullets('Closure Path', 'closure_path', strong('blocking_event', 'expected_unblock_path'))} END",
            where_any(items("resolution_history"), headed("Resolution History", table([("Date", cell("date")), ("Event", cell("event"))], items("resolution_history"), by_date("date")))), linked,
        ],
    }


def _bodies_sql() -> str:
    named = [f"nullif({of('j', k)}, '')" for k in ("context_extrinsic.display_title", "event_intrinsic.hearing_title", "document_intrinsic.full_name", "document_intrinsic.internal_title")]
    slug = "array_to_string(list_transform(string_split(regexp_extract(json_extract_string(j, '$.target_node'), '([^/]+)$', 1), '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    title = cat(q("# "), f"coalesce({', '.join(named)}, {slug})", NL, NL)
    parts = []
    for kind, sections in _expected().items():
        text = f"array_to_string(list_transform(list_filter([{', '.join(sections)}], lambda y: y IS NOT NULL AND y <> ''), lambda y: rtrim(y, {NL})), {lines(chr(10) + documents.SEPARATOR)})"
        parts.append(f"SELECT path, {title} || {text} || {NL} AS body FROM a WHERE node_type = {q(kind)}")
    return f"WITH a AS ({_BODIES}) " + " UNION ALL ".join(parts)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return written(_sql(spark, sf, _BODIES, "customer"), "bodies").select("path", "node_type", "kind", F.parse_json("j").alias("data"), F.parse_json("fm").alias("fm"))


@query(_bodies_sql())
def rendered_bodies(spark, sf):
    """The bodies of artifacts of all nine types."""
    return documents.render(_rows(spark, sf), TOPIC)


# -- artifacts against their nodes and sources
_PAIRS = f"""SELECT a.*, '# A' || N || '## Description' || N || 'Bob met Zed' || CAST(length(path) AS STRING) || CASE WHEN contains(j, 'brown') THEN ' in 1999' ELSE ' in 2001' END || ' at "the quick" place, per K-18.' || N || '## Q' || N || '> the quick brown' || N || '> fox' || N || CASE WHEN contains(j, '"q2", "text"') THEN '“a slow – fox & hound”' ELSE '' END || N || '[`/people/c9`] [`/people/c30`]' || N || '## Associated Nodes' || N || 'old' || N AS node_body,
CASE WHEN contains(j, '"odd", "created"') THEN '' ELSE 'In 1999 the quick brown k-18' END AS source_text FROM (SELECT *, chr(10) AS N FROM ({_ARTIFACTS}) s) a"""
_P = f"WITH a AS ({_PAIRS}), texts AS (SELECT * FROM (VALUES {_values(_TEXTS)}) v(p, txt)), nn AS ({_NODES})"
_FLAT = "regexp_replace(regexp_replace(replace(translate(replace({0}, '&amp;', '&'), '“”–', '\"\"-'), chr(10) || '> ', chr(10)), '-\\s+', '-', 'g'), '-', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({_FLAT.format(x)}, '\\s+', ' ', 'g'))"


_CROSS = [
    _one("coverage", f"{_PLACE} || 'not in the node: ' || {_x('text')}", f"NOT contains({_squeeze('node_body')}, {_squeeze(_x('text'))})", "(SELECT path, node_body, 'quotes' AS section, unnest(json_extract(j, '$.quotes[*]')) AS e, generate_subscripts(json_extract(j, '$.quotes[*]'), 1) - 1 AS idx FROM a)"),
    _one("stub_linking", "'not linked: ' || link", "link <> '/' || target AND link NOT IN ('/people/c9', '/people/c30')", "(SELECT DISTINCT path, json_extract_string(j, '$.target_node') AS target, unnest(json_extract_string(j, '$.entities_referenced[*].wrap_path')) AS link FROM a)"),
    _one("description_drift", "'not in source: ' || tok", "source_text <> '' AND NOT contains(lower(source_text) || ' context quick fox bob a', lower(tok))", "(SELECT path, source_text, unnest(list_distinct(['K-18', '18', CASE WHEN contains(j, 'brown') THEN '1999' ELSE '2001' END, 'Bob', 'Zed' || length(path), 'the quick'])) AS tok FROM a)"),
    _one("boundary", "'body differs from its rendering'", "length(path) % 2 = 0", "a"),
]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return written(_sql(spark, sf, _PAIRS, "customer"), "pairs").select("path", F.parse_json("j").alias("data"), "target_type", "node_body", "source_text")


@query(_P + " " + " UNION ALL ".join(_CROSS))
def coverage_run(spark, sf):
    """Coverage, boundary, links to stubs and drift of descriptions, run from their registry over artifacts whose target is there."""
    pairs = _pairs(spark, sf)
    rendered = pairs.select("path", F.when(F.length("path") % 2 == 0, F.concat(F.lit("x"), "node_body")).otherwise(F.replace("node_body", F.lit("\nold\n"), F.lit("\nnew\n"))).alias("body"))
    known = pairs.select(F.concat(F.try_variant_get("data", "$.target_node", "string"), F.lit(".md")).alias("path")).distinct()
    sources = spark.createDataFrame(_TEXTS, "source_path string, text string")
    found = issues.run_checks({"pairs": pairs, "rendered": rendered, "nodes": known, "sources": sources}, artifacts.coverage_checks())
    return _found(found.where("check_name <> 'phase_iii_inputs'"))


_USED = "(SELECT path, target_type, unnest(json_extract(j, '$.primary_sources[*]')) AS e, generate_subscripts(json_extract(j, '$.primary_sources[*]'), 1) - 1 AS idx, json_extract_string(j, '$.target_node') || '.md' IN (SELECT path FROM nn) AS ok FROM a)"
_HAVE = f"(SELECT u.*, {_x('path')} AS sp, p, txt FROM {_USED} u LEFT JOIN texts ON p = {_x('path')})"


@query(_P + " " + " UNION ALL ".join([
    _one("phase_iii_inputs", "'target_node does not exist: ' || json_extract_string(j, '$.target_node')", "json_extract_string(j, '$.target_node') || '.md' NOT IN (SELECT path FROM nn)", "a"),
    _one("phase_iii_inputs", "'source is not there: ' || sp", "ok AND p IS NULL", _HAVE), _one("phase_iii_inputs", "'source has no text: ' || p", "ok AND p IS NOT NULL AND txt IS NULL", _HAVE, "warn"),
]))
def phase_inputs(spark, sf):
    """Targets and sources that a comparison needs."""
    pairs = _sql(spark, sf, _PAIRS, "customer").select("path", F.parse_json("j").alias("data"))  # taken once, so nothing is stored
    return _found(artifacts.phase_inputs(pairs, _sql(spark, sf, _NODES, "customer").select("path"), spark.createDataFrame(_TEXTS, "source_path string, text string")))


@query(_P + f" SELECT path, coalesce(string_agg(txt, chr(10) ORDER BY idx), '') AS source_text, coalesce(string_agg(CASE WHEN txt IS NULL THEN sp END, ',' ORDER BY idx), '') AS missing FROM {_HAVE} GROUP BY path")
def gathered_sources(spark, sf):
    """The texts of an artifact's sources in order, and the sources without."""
    g = artifacts.gathered(_artifacts(spark, sf), spark.createDataFrame(_TEXTS, "source_path string, text string"))
    return g.select("path", "source_text", F.array_join("missing", ",").alias("missing"))


@query(_P + f""", s AS (SELECT path, count(*) FILTER (txt IS NOT NULL) AS n FROM {_HAVE} GROUP BY path),
t AS (SELECT path, p, list_distinct(list_filter(string_split_regex(lower(replace(txt, chr(10), ' ')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the'))) AS ws FROM {_HAVE} WHERE txt IS NOT NULL), pool AS (SELECT DISTINCT path, unnest(ws) AS w FROM t),
k AS (SELECT path, unnest(list_distinct(list_filter(string_split(json_extract_string(j, '$.background'), ' '), lambda w: length(w) >= 3))) AS w FROM a WHERE target_type = 'person' AND path IN (SELECT path FROM pool)),
f AS (SELECT path, count(*) AS n, list(k.w ORDER BY k.w) FILTER (pool.w IS NULL) AS lost FROM k LEFT JOIN pool USING (path, w) GROUP BY path)
SELECT path, CASE WHEN len(lost) = n THEN 'error' ELSE 'warn' END AS level, 'prose_drift' AS check_name, 'background: ' || len(lost) || ' tokens not in source: ' || array_to_string(lost[1:8], ', ') AS message FROM f WHERE len(lost) > 0
UNION ALL SELECT path, 'warn', 'prose_drift', 'no source text; drift not checked' FROM s WHERE n = 0""")
def artifact_prose_drift(spark, sf):
    """Tokens of prose that none of an artifact's sources has."""
    return _found(artifacts.prose_drift(_artifacts(spark, sf), spark.createDataFrame(_TEXTS, "source_path string, text string"), {"person": ["background"]}, {}))


@query(f"""WITH a AS ({_ARTIFACTS}), l AS (SELECT a.path AS path, replace(t.fullkey, '"', '') AS spot, t.atom->>'$' AS leaf FROM a, json_tree(a.j) t WHERE t.type = 'VARCHAR')
SELECT path, string_agg(leaf, chr(10) ORDER BY regexp_replace(regexp_replace(spot, '\\[([0-9])\\]', '[00\\1]', 'g'), '\\[([0-9]{{2}})\\]', '[0\\1]', 'g')) AS text FROM l
WHERE regexp_matches(spot, '^\\$\\.(quotes\\[[0-9]+\\]\\.(text|significance|context)|entities_referenced\\[[0-9]+\\]\\.(name|wrap_path|context_summary)|naming_quirks\\[[0-9]+\\]\\.(observed|canonical|note)|rumors\\[[0-9]+\\]\\.(claim|note|observed_sources\\[[0-9]+\\]))$')
  OR (regexp_matches(spot, '^\\$\\.[^.\\[]') AND NOT regexp_matches(spot, '^\\$\\.(description|background|top_relevance|credibility_notes|pattern_statement)[.\\[]') AND NOT regexp_matches(spot, '^\\$\\.(quotes|entities_referenced|naming_quirks|rumors|id|type|schema_version|target_node|status|created|updated|primary_sources)($|[.\\[])'))
GROUP BY path""")
def artifact_strings(spark, sf):
    """All text of an artifact."""
    return artifacts.strings(_sql(spark, sf, _ARTIFACTS, "customer").select("path", F.parse_json("j").alias("data")))  # taken once, so nothing is stored


@query(f"""WITH a AS ({_ARTIFACTS}), n AS (SELECT regexp_replace(path, '\\.md$', '') AS t, j AS fm FROM ({_NODES})) SELECT path, {_x('type', 'fm')} AS target_type, {_x('archetype', 'fm')} AS target_archetype, CASE WHEN {_x('type', 'fm')} IN ('event', 'transcript', 'organization') THEN {_x('kind', 'fm')} END AS target_kind, {_x('status', 'fm')} AS target_status
FROM a LEFT JOIN n ON t = {_x('target_node', 'j')}""")
def artifact_targets(spark, sf):
    """Artifacts with what their target nodes say."""
    rows = artifacts.with_target(_artifacts(spark, sf).select("path", "data"), _nodes(spark, sf))
    return rows.select("path", "target_type", "target_archetype", "target_kind", "target_status")
