"""Research artifacts to node bodies, as one expression over the artifact's row.

Every list section of the VARIANT body becomes an array of variants; entries
are turned into lines, sorted by a key struct and joined, all inside the row,
so rendering any number of artifacts takes one pass and no shuffle. A body is
its sections in the order of its node type, the empty ones left out.

artifacts: path, data (VARIANT), node_type, kind, fm (VARIANT or null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .render import SEPARATOR

Fn = Callable[[Column], Column]
COMPACT = 30


def of(x: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit(""))


def data(key: str) -> Column:
    return of(F.col("data"), key)


def items(section: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("data"), f"$.{section}", "array<variant>"), F.array().cast("array<variant>"))


def many(x: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(x, f"$.{key}", "array<string>"), F.array().cast("array<string>"))


# -- orders
def by_place(x: Column) -> Column:
    return F.lit(0)


def by_id(x: Column) -> Column:
    return X.natural_key(F.nullif(of(x, "id"), F.lit("")))


def by_date(key: str) -> Fn:
    last = F.struct(F.lit(9999).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))
    return lambda x: F.struct(F.coalesce(X.partial_date(of(x, key)), last).alias("date"), by_id(x).alias("id"))


def ordered(rows: Column, line: Fn, order: Fn, separator: str = "\n") -> Column:
    """The lines of the entries in order; equal keys stay as they stand."""
    keyed = F.transform(rows, lambda x, i: F.struct(order(x).alias("k"), i.alias("i"), line(x).alias("l")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["l"]), separator)


# -- cells
def cell(key: str) -> Fn:
    return lambda x: X.escape_cell(of(x, key))


def wrapped(key: str) -> Fn:
    return lambda x: X.wrap_path(of(x, key))


def spell(x: Column) -> Column:
    return X.period(of(x, "period_start"), of(x, "period_end"))


SOURCE, NOTE = ("Source", cell("source.path")), ("Note", cell("note"))


def table(columns: list[tuple[str, Fn]], rows: Column, order: Fn = by_place) -> Column:
    """A table; one empty row where there are no entries."""
    head = "| " + " | ".join(h for h, _ in columns) + " |\n" + "|" + "---|" * len(columns) + "\n"
    line = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[fn(x) for _, fn in columns]), F.lit(" |"))
    return F.concat(F.lit(head), F.when(F.size(rows) == 0, F.lit("|" + "  |" * len(columns))).otherwise(ordered(rows, line, order)))


def headed(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), body)


def unless_empty(rows: Column, text: Column) -> Column:
    return F.when(F.size(rows) > 0, text)


def prose(title: str, text: Column, field: str) -> Column:
    return headed(title, F.when(F.trim(text) != "", F.trim(text)).otherwise(F.lit(f"<!-- TODO: populate `{field}` -->")))


def flagged(x: Column) -> Column:
    return F.coalesce(F.try_variant_get(x, "$.flagged", "boolean"), F.lit(False))


def split_table(title: str, section: str, columns: list[tuple[str, Fn]], order: Fn = by_place) -> Column:
    """Confirmed entries, and flagged ones below where there are any."""
    sure, doubtful = F.filter(items(section), lambda x: ~flagged(x)), F.filter(items(section), flagged)
    return headed(title, F.concat(F.lit("### Confirmed\n\n"), table(columns, sure, order), F.when(F.size(doubtful) > 0, F.concat(F.lit("\n\n### Flagged\n\n"), table(columns, doubtful, order))).otherwise("")))


def grouped_table(title: str, section: str, key: str, groups: list[tuple[str, str]], other: str, columns: list[tuple[str, Fn]], order: Fn = by_place) -> Column:
    """Entries in groups of a fixed order, unknown ones under the last heading, flagged ones at the end."""
    known = [g for g, _ in groups]
    parts = [F.lit("### Confirmed")]
    for g, heading in [*groups, ("", other)]:
        inside = (lambda g: lambda x: ~flagged(x) & ((of(x, key) == g) if g else ~of(x, key).isin(*known)))(g)
        own = F.filter(items(section), inside)
        parts.append(unless_empty(own, F.concat(F.lit(f"#### {heading}\n\n"), table(columns, own, order))))
    doubtful = F.filter(items(section), flagged)
    parts.append(unless_empty(doubtful, F.concat(F.lit("### Flagged\n\n"), table(columns, doubtful, order))))
    return headed(title, F.array_join(F.array_compact(F.array(*parts)), "\n\n"))


def facts(title: str, rows: list[tuple[str, Column]]) -> Column:
    """A table of the fields that are set."""
    lines = F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(f"| {k} | "), v, F.lit(" |"))) for k, v in rows]))
    return headed(title, F.concat(F.lit("| Field | Value |\n|---|---|\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("|  |  |")))


def fields(base: str, keys: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """(label, value) of keys under a map; lists are joined, paths wrapped."""
    value = lambda k: F.coalesce(F.array_join(F.try_variant_get(F.col("data"), f"$.{base}.{k}", "array<string>"), "; "), data(f"{base}.{k}"))
    return [(label, X.wrap_path(value(k)) if k.endswith("_path") else value(k)) for label, k in keys]


def bullets(title: str, section: str, line: Fn, keep: bool = True) -> Column:
    body = ordered(items(section), lambda x: F.concat(F.lit("- "), line(x)), by_place)
    text = headed(title, F.when(F.size(items(section)) > 0, body).otherwise(F.lit(f"<!-- TODO: populate `{section}` -->")))
    return text if keep else unless_empty(items(section), text)


def strong(head: str, tail: str) -> Fn:
    return lambda x: F.when(of(x, tail) != "", F.concat(F.lit("**"), of(x, head), F.lit("** — "), of(x, tail))).otherwise(of(x, head))


# -- quotes
def said(x: Column) -> Column:
    """Context and date, the date left out where the context has it."""
    c, d = of(x, "context"), of(x, "statement_date")
    return F.when((d != "") & F.contains(c, d), c).otherwise(F.array_join(F.filter(F.array(c, d), lambda p: p != ""), ", "))


def speaker(x: Column) -> Column:
    """The name of the first speaker of the quote's speaker id, with a link."""
    match = F.get(F.filter(items("speakers"), lambda s: (of(s, "id") == of(x, "speaker_id")) & (of(x, "speaker_id") != "")), F.lit(0))
    name, link = of(match, "name"), of(match, "node_link")
    return F.coalesce(F.when((name != "") & (link != ""), F.concat(name, F.lit(" ("), X.wrap_path(link), F.lit(")"))).otherwise(F.concat(name, link)), F.lit(""))


def archived(path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit("[archived source](../sources/"), path, F.lit(")"))).otherwise("")


def block(x: Column) -> Column:
    lines = F.split(F.rtrim(of(x, "text"), F.lit("\n")), "\n")
    return F.array_join(F.transform(lines, lambda l: F.when(l == "", ">").otherwise(F.concat(F.lit("> "), l))), "\n")


def attribution(x: Column, tiers: bool = False) -> Column:
    rows = [("Speaker", speaker(x)), ("Attributed to", said(x))]
    rows += [("Tier", of(x, "attestation_tier")), ("Attestor", X.wrap_path(of(x, "attestor_path")))] if tiers else []
    rows += [("Source", archived(of(x, "source.path"))), ("Location", of(x, "source.location"))]
    lines = F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(f"| {k} | "), v, F.lit(" |"))) for k, v in rows]))
    return F.concat(F.lit("| Field | Value |\n|---|---|\n"), F.array_join(lines, "\n"))


def passages(title: str, order: Fn, heading: str | None = "Passage", tiers: bool = False) -> Column:
    """Quotes under headings of what they signify."""
    head = lambda x: F.concat(F.lit("### "), F.coalesce(F.nullif(of(x, "significance"), F.lit("")), F.lit(heading)), F.lit("\n\n")) if heading else F.lit("")
    one = lambda x: F.concat(head(x), block(x), F.lit("\n\n"), attribution(x, tiers))
    return headed(title, F.when(F.size(items("quotes")) > 0, ordered(items("quotes"), one, order, "\n\n---\n\n")).otherwise("<!-- TODO: populate `quotes` -->"))


def statement(x: Column) -> Column:
    """A quote with its table, or in brief with an italic line."""
    line = F.array_join(F.filter(F.array(said(x), archived(of(x, "source.path")), of(x, "source.location")), lambda p: p != ""), "; ")
    brief = F.concat(block(x), F.when(line != "", F.concat(F.lit("\n\n_"), line, F.lit("_"))).otherwise(""))
    return F.when(F.length(F.trim(of(x, "text"))) < COMPACT, brief).otherwise(F.concat(block(x), F.lit("\n\n"), attribution(x)))


def statements(title: str, rows: Column) -> Column:
    return unless_empty(rows, headed(title, ordered(rows, statement, by_date("statement_date"), "\n\n")))


def rollup(x: Column) -> Column:
    """The sources a judgment rests on."""
    rows = F.coalesce(F.try_variant_get(x, "$.sources", "array<variant>"), F.array().cast("array<variant>"))
    anchor = lambda s: F.when(of(s, "anchor") != "", F.concat(F.lit(" "), of(s, "anchor"))).otherwise("")
    target = lambda s: F.when(of(s, "finding_path") != "", X.wrap_path(of(s, "finding_path"))).when(of(s, "entity_path") != "", F.concat(X.wrap_path(of(s, "entity_path")), anchor(s))).otherwise("(malformed source entry)")
    return F.when(F.size(rows) > 0, F.concat(F.lit("**Sources:**\n\n"), F.array_join(F.transform(rows, lambda s: F.concat(F.lit("- "), target(s), F.lit(" — "), F.trim(of(s, "description")))), "\n")))


def cards(title: str, section: str, heading: Fn, keep: bool = True) -> Column:
    """A heading, a status, text and sources for each entry."""
    status = lambda x: F.when(of(x, "status") != "", F.concat(F.lit("**Status:** "), of(x, "status")))
    one = lambda x: F.array_join(F.array_compact(F.array(F.concat(F.lit("### "), heading(x)), status(x), F.nullif(F.trim(of(x, "text")), F.lit("")), rollup(x))), "\n\n")
    text = headed(title, F.when(F.size(items(section)) > 0, ordered(items(section), one, by_place, "\n\n")).otherwise(f"<!-- TODO: populate `{section}` -->"))
    return text if keep else unless_empty(items(section), text)


def hypothesis(x: Column) -> Column:
    """The id in capitals and the statement of the last hypothesis of that id in any case."""
    hid = of(x, "hypothesis_id")
    match = F.filter(items("hypotheses"), lambda h: F.lower(of(h, "id")) == F.lower(hid))
    stated = F.coalesce(F.trim(of(F.get(match, F.size(match) - 1), "statement")), F.lit(""))
    return F.when(stated != "", F.concat(F.upper(hid), F.lit(" — "), stated)).otherwise(F.upper(hid))


# -- sections that many types share
def quirks(title: str, intro: str, resolution: str, first: str, second: str) -> Column:
    rows = F.filter(items("naming_quirks"), lambda x: of(x, "resolution") == resolution)
    columns = [(first, cell("observed")), (second, cell("canonical")), ("Source", cell("source_path")), NOTE]
    return unless_empty(rows, headed(title, F.concat(F.lit(intro + "\n\n"), table(columns, rows))))


def rumors(title: str, intro: str, status: str, label: str) -> Column:
    rows = F.filter(items("rumors"), lambda x: (of(x, "status") == status) & (F.trim(of(x, "claim")) != ""))
    seen = lambda x: F.coalesce(F.nullif(F.array_join(many(x, "observed_sources"), "; "), F.lit("")), of(x, "observed_sources"))
    one = lambda x: F.array_join(F.array_compact(F.array(F.concat(F.lit('### "'), F.trim(of(x, "claim")), F.lit('"')), F.when(seen(x) != "", F.concat(F.lit("**Circulates in:** "), seen(x))), F.when(of(x, "note") != "", F.concat(F.lit(f"**{label}:** "), of(x, "note"))))), "\n\n")
    return unless_empty(rows, headed(title, F.concat(F.lit(intro + "\n\n"), ordered(rows, one, by_place, "\n\n"))))


def shared() -> dict[str, Column]:
    timeline = [("Date", cell("date")), ("Event", cell("event")), ("Category", cell("category")), SOURCE, ("Node Link", wrapped("node_link"))]
    return {
        "description": prose("Description", data("description"), "description"),
        "timeline": headed("Timeline", table(timeline, items("timeline"), by_date("date"))),
        "provenance": headed("Provenance", table([("Step", cell("step")), ("Date", cell("date")), ("Entity", cell("entity")), ("Verified", cell("verified"))], items("context_extrinsic.provenance"))),
        "corroboration": headed("Corroboration", table([("Observer", wrapped("observer_path")), ("Type", cell("observation_type")), ("What It Confirms", cell("note")), ("Attested In", cell("source.path"))], items("corroboration_items"))),
        "refuted": rumors("Primary-Source Contradictions", "Claims that circulate and that primary sources contradict.", "primary-source-disputed", "Primary-source refutation"),
        "unsourced": rumors("Public-Record Claims Without Primary Source", "Claims that circulate without an archived primary source; leads, not facts.", "not-primary-source-established", "Investigator note"),
        "forms": quirks("Source-Form Notes", "Forms kept in quotations as the source has them, with the canonical form.", "preserve-as-sic-in-quotes", "Source Form", "Canonical"),
        "disagreements": quirks("Preserved Disagreements", "Primary sources attest opposing forms; both stay on the record.", "disputed", "Position", "Counterpart"),
        "associated": F.lit("## Associated Nodes\n\n<!-- generated from the links of the body -->"),
    }


#: The headings of hearings' participants and of organizations' people.
CAPACITIES = [("witness-eyewitness", "Witnesses — Eyewitness Testimony"), ("witness-whistleblower", "Witnesses — Whistleblower Testimony"), ("witness-institutional", "Witnesses — Institutional Testimony"), ("committee-member", "Committee Members")]
CLASSES = [("director", "Directors"), ("deputy", "Deputy Leadership"), ("staff", "Staff"), ("advisor", "Advisors")]


def bodies(topic: str) -> dict[str, list[Column]]:
    """The sections of each node type, in order; those that do not apply are null."""
    s, kind = shared(), F.col("kind")
    rest = [s["refuted"], s["unsourced"], s["forms"], s["disagreements"], s["associated"]]
    people = [("Name", wrapped("person_path")), ("Role", cell("role")), ("Period", spell), SOURCE, NOTE]
    guests = [("Participant", wrapped("participant_path")), ("Role", cell("role")), SOURCE, NOTE]
    direct = lambda x: of(x, "observation_type") == "direct"
    deals = [("Contract", cell("contract_number")), ("Contracting Agency", cell("contracting_agency")), ("Period", spell), ("Value", cell("value")), ("Counterparty", wrapped("primary_counterparty_path")), ("Subject", cell("subject")), SOURCE, NOTE]
    owner = lambda x: F.trim(F.concat(of(x, "owner"), F.lit(" "), X.wrap_path(of(x, "owner_path"))))
    acted = lambda x: F.array_join(F.filter(F.array(of(x, "activity"), F.array_join(F.transform(many(x, "actor_paths"), X.wrap_path), "; ")), lambda p: p != ""), " — ")
    claims = lambda x: X.truncate(of(x, "text"), 120)
    about = [("Full Name", "full_name"), ("Internal Name", "internal_name"), ("Type", "office_type"), ("Established", "established_date"), ("Terminated", "terminated_date"), ("Parent Organization", "parent_organization_path"), ("Director", "current_director_path"), ("Jurisdiction", "jurisdiction"), ("Contracting Agency", "contracting_agency"), ("Headquarters", "headquarters")]
    places = [("Full Name", "full_name"), ("Alternate Names", "alternate_names"), ("Location Type", "location_type"), ("Geographic Location", "geographic_location"), ("Coordinates", "coordinates"), ("Legal Description", "legal_description"), ("Ownership History Summary", "ownership_history_summary"), ("Scope Significance", "scope_significance")]
    events = [("Full Title", "hearing_title"), ("Convening Body", "committee"), ("Session", "session"), ("Date", "date"), ("Location", "location"), ("Chair", "chair"), ("Ranking Member", "ranking_member"), ("Duration", "duration"), ("Weather", "weather"), ("Instruments Involved", "instruments_involved")]
    papers = [("Title", "internal_title"), ("Authored Date (per document)", "internal_date"), ("Author (per document)", "authors_per_document"), ("Classification", "classification"), ("Pages", "pages")]
    testified = [("Witness", wrapped("witness_path")), ("Oath Status", cell("oath_status")), ("Transcript", wrapped("transcript_node")), ("Written Testimony", wrapped("written_testimony_node")), NOTE]
    hearing = kind == "hearing"
    return {
        "person": [
            facts("Identity", fields("document_intrinsic", [("Full Name", "full_name"), ("Born", "born"), ("Nationality", "nationality")])), prose("Background", data("background"), "background"), prose(f"{topic} Relevance", data("top_relevance"), "top_relevance"),
            split_table("Affiliations", "affiliations", [("Organization", wrapped("organization_path")), ("Role", cell("role")), ("Period", spell), SOURCE, NOTE], by_date("period_start")),
            statements("Statements — Direct", F.filter(items("quotes"), direct)), statements("Statements — Relayed", F.filter(items("quotes"), lambda x: ~direct(x))),
            split_table("Relationships", "relationships", [("Person", wrapped("person_path")), ("Relationship", cell("relationship")), SOURCE, NOTE]),
            unless_empty(items("quotes"), headed("Claim Inventory", table([("Claim", lambda x: X.escape_cell(claims(x))), ("Type", cell("observation_type")), SOURCE], items("quotes"), by_id))),
            unless_empty(items("program_involvement"), headed("Program Involvement", table([("Program", cell("program")), ("Role", cell("role")), ("Period", spell), ("Basis", cell("evidentiary_basis")), ("Confidence", cell("confidence")), SOURCE], items("program_involvement"), by_date("period_start")))),
            unless_empty(items("publication_record"), headed("Publication Record", table([("Date", cell("date")), ("Publication", cell("publication")), ("Outlet", cell("outlet")), ("Node Link", wrapped("node_link")), SOURCE], items("publication_record"), by_date("date")))),
            unless_empty(items("vouching_chain"), headed("Vouching Chain", table([("Voucher", wrapped("voucher_path")), ("Attestation", lambda x: X.escape_cell(X.truncate(of(x, "attestation"), 100))), SOURCE], items("vouching_chain")))),
            unless_empty(items("corroboration_items"), s["corroboration"]), F.when(data("credibility_notes") != "", headed("Credibility Notes", data("credibility_notes"))), s["timeline"], *rest,
        ],
        "organization": [facts("Overview", fields("document_intrinsic", about)), s["description"], grouped_table("Key Personnel", "key_personnel", "leadership_class", CLASSES, "Other Named Personnel", people, by_date("period_start")), passages("Key Passages", by_date("statement_date")), F.when(kind == "gov-contractor", headed("Primary Contracts", table(deals, items("contracts"), by_date("period_start")))), s["timeline"], split_table("Relationships", "org_relationships", [("Organization", wrapped("organization_path")), ("Relationship", cell("relationship_type")), SOURCE, NOTE]), *rest],
        "document": [facts("Document Summary", [*fields("document_intrinsic", papers), ("Primary Source URL", data("context_extrinsic.primary_source_url")), ("Local Archive", archived(data("primary_sources[0].path")))]), s["description"], F.when(kind == "gov-doc", s["provenance"]), passages("Key Passages", by_id), *rest[2:]],
        "event": [
            facts("Event Summary", fields("event_intrinsic", events)), s["description"],
            F.when(hearing, grouped_table("Participants", "participants", "capacity", CAPACITIES, "Other", guests)).otherwise(split_table("Participants", "participants", guests)), s["timeline"],
            F.when(hearing, headed("Key Testimony", F.when(F.size(items("quotes")) > 0, ordered(items("quotes"), statement, by_date("statement_date"), "\n\n")).otherwise("<!-- no testimony recorded -->"))),
            F.when(hearing, headed("Witnesses & Testimony", table(testified, items("witnesses_testimony")))), F.when(~hearing, s["corroboration"]), *rest,
        ],
        "transcript": [facts("Transcript Summary", fields("document_intrinsic", [("Title", "internal_title"), ("Date", "internal_date")])), s["description"], headed("Speakers", table([("Name", cell("name")), ("Role", cell("role")), ("Node Link", wrapped("node_link")), SOURCE], items("speakers"), by_id)), passages("Key Passages", by_date("statement_date")), *rest[2:]],
        "media": [facts("Media Summary", fields("document_intrinsic", [("Title", "internal_title"), ("Date", "internal_date"), ("Duration", "duration"), ("Resolution", "resolution")])), s["description"], s["provenance"], unless_empty(items("media_versioning"), headed("Versioning", table([("Aspect", cell("aspect")), ("Parent Form", cell("parent_form")), ("This Form", cell("this_form")), SOURCE, NOTE], items("media_versioning"), by_id))), passages("Key Passages", by_id), *rest[2:]],
        "location": [facts("Overview", [*fields("document_intrinsic", places), ("Status", of(F.col("fm"), "status"))]), s["description"], headed("Ownership Timeline", table([("Period", spell), ("Owner", owner), ("Use / Status", cell("use_status")), SOURCE, NOTE], items("ownership_timeline"), by_date("period_start"))), headed(f"{topic}-Scope Activity", table([("Period", spell), ("Activity", acted), SOURCE, NOTE], items("top_scope_activity"), by_date("period_start"))), passages("Key Passages", by_date("statement_date")), split_table("Relationships", "location_relationships", [("Entity", wrapped("entity_path")), ("Relationship", cell("relationship")), NOTE]), *rest],
        "finding": [
            prose("Pattern Statement", data("pattern_statement"), "pattern_statement"), s["description"], passages("Evidence", by_date("statement_date"), "Attestation", tiers=True),
            bullets("What the Record Establishes", "establishes", lambda x: F.trim(F.try_variant_get(x, "$", "string"))), bullets("What the Record Doesn't Establish", "does_not_establish", lambda x: F.trim(F.try_variant_get(x, "$", "string"))),
            unless_empty(items("contradictions"), headed("Apparent Contradictions", ordered(items("contradictions"), lambda c: F.concat(F.lit("### "), of(c, "question"), F.lit("\n\n"), table([("Evidence", lambda p: F.concat(F.lit("`"), of(p, "evidence_id"), F.lit("`"))), ("Position", cell("position"))], F.coalesce(F.try_variant_get(c, "$.positions", "array<variant>"), F.array().cast("array<variant>"))), F.when(of(c, "note") != "", F.concat(F.lit("\n\n"), of(c, "note"))).otherwise("")), by_place, "\n\n"))),
            unless_empty(items("timeline"), s["timeline"]), *rest[2:],
        ],
        "investigation": [
            prose("Question", F.coalesce(F.nullif(of(F.col("fm"), "question"), F.lit("")), data("question")), "question"), s["description"], bullets("Hypotheses", "hypotheses", lambda x: F.concat(F.lit("**"), F.upper(of(x, "id")), F.lit("** — "), of(x, "statement"))),
            headed("Cited Findings", table([("Finding", wrapped("finding_path")), ("Pattern", cell("pattern_statement")), ("Relevance", cell("relevance"))], items("cited_findings"))), cards("Hypothesis Evaluation", "hypothesis_evaluation", hypothesis), bullets("Open Questions", "open_questions", strong("question", "what_would_resolve")),
            headed("Best-Current Answer", F.array_join(F.array_compact(F.array(F.nullif(data("best_current_answer.text"), F.lit("")), rollup(F.try_variant_get(F.col("data"), "$.best_current_answer", "variant")))), "\n\n")),
            cards("Counter-Evidence", "counter_evidence", lambda x: F.concat(F.lit("Against "), F.upper(of(x, "against_hypothesis_id"))), keep=False), F.when((F.size(items("closure_path")) > 0) | (of(F.col("fm"), "status") == "paused"), bullets("Closure Path", "closure_path", strong("blocking_event", "expected_unblock_path"))),
            unless_empty(items("resolution_history"), headed("Resolution History", table([("Date", cell("date")), ("Event", cell("event"))], items("resolution_history"), by_date("date")))), s["associated"],
        ],
    }


def title() -> Column:
    slug = F.regexp_extract(data("target_node"), r"([^/]+)$", 1)
    named = [F.nullif(data(k), F.lit("")) for k in ("context_extrinsic.display_title", "event_intrinsic.hearing_title", "document_intrinsic.full_name", "document_intrinsic.internal_title")]
    return F.concat(F.lit("# "), F.coalesce(*named, X.humanize(slug)), F.lit("\n\n"))


def render(artifacts: DataFrame, topic: str = "Topic") -> DataFrame:
    """(path, body) of every artifact whose node type is known. One narrow pass: each type's rows are projected by its own expression."""
    out = None
    for kind, parts in bodies(topic).items():
        text = F.array_join(F.transform(F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p.isNotNull() & (p != "")), lambda p: F.rtrim(p, F.lit("\n"))), "\n" + SEPARATOR)
        rows = artifacts.where(F.col("node_type") == kind).select("path", F.concat(title(), text, F.lit("\n")).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out
