"""Readers of model output: tolerant, column-wise where regular expressions suffice, Arrow UDFs where they don't."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evograph.functions.text import heuristic_context, heuristic_keywords, is_order_question, json_block, list_items, section, strip_fences, stripped
from evograph.functions.vector import clamp

#: The kinds of events and of edges, the confidence of an edge that names none, the least confidence of an
#: inferred edge, and the longest provenance that is kept.
EVENT_TYPES = ["action", "state_change", "preference", "plan"]
EDGE_TYPES = ["causes", "enables", "prevents", "temporal_before", "updates", "contradicts", "belongs_to", "contains", "belongs_to_topic", "topic_contains"]
CONFIDENCE, MIN_CONFIDENCE, PROVENANCE = 0.5, 0.7, 200
#: What a note's evolution may be.
DECISIONS = ["NO_EVOLUTION", "STRENGTHEN", "UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE"]
#: Month names, and spellings of them in dates.
MONTHS = "january february march april may june july august september october november december".split()
SPELLINGS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "januarty": 1, "janury": 1, "febuary": 2, "feburary": 2, "septmber": 9, "ocotber": 10,
}
#: Fixed values, for questions of order: hedges, words that are no option, quotes, ordering words, how near to one (characters) an
#: option stands, and an option's most words.
HEDGES = r"\b(?:not enough|does not specify|cannot determine|no information|insufficient|not specified|do not (?:have|specify))\b"
NO_OPTIONS = ["it", "this", "that", "these", "those", "they", "them"]
QUOTES = "'\"‘’“”"
ORDERING = ["first", "earlier", "earliest", "most recently", "most recent", "recently", "latest"]
NEAR, MOST_WORDS = 80, 6


def _object(raw: Column, ddl: str) -> Column:
    return F.from_json(json_block(strip_fences(raw)), ddl)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


_EVENT = "struct<event_type:string,participants:string,time_anchor:string,state_change:string>"
_EDGE = "struct<source_event_idx:int,target_event_idx:int,edge_type:string,confidence:string,reason:string>"
_CROSS = "struct<existing_event_idx:int,direction:string,edge_type:string,confidence:string,reason:string>"
_confidence = lambda e: clamp(F.coalesce(e["confidence"].try_cast("double"), F.lit(CONFIDENCE)))


def extraction(raw: Column, content: Column | None = None) -> Column:
    """events of an extraction answer: kinds outside the list become action, a single participant is a list of one, provenance is the note's beginning."""
    got = F.coalesce(_object(raw, f"events array<{_EVENT}>")["events"], _empty(_EVENT))
    kind = lambda e: F.replace(F.lower(e["event_type"]), F.lit(" "), F.lit("_"))
    people = lambda e: F.coalesce(F.from_json(e["participants"], "array<string>"), F.when(e["participants"].isNotNull(), F.array(e["participants"])), _empty("string"))
    return F.transform(F.filter(got, lambda e: e.isNotNull()), lambda e: F.struct(
        F.when(kind(e).isin(EVENT_TYPES), kind(e)).otherwise("action").alias("event_type"), F.filter(F.transform(people(e), lambda p: F.trim(p)), lambda p: p != "").alias("participants"),
        F.coalesce(e["time_anchor"], F.lit("unknown")).alias("time_anchor"), F.coalesce(e["state_change"], F.lit("")).alias("state_change"),
        F.substring(F.coalesce(F.lit("") if content is None else content, F.lit("")), 1, PROVENANCE).alias("provenance"),
    ))


def extraction_edges(raw: Column) -> Column:
    """Edges between an extraction's events, by place: those of a known type between two different places in range."""
    got = F.coalesce(_object(raw, f"edges array<{_EDGE}>")["edges"], _empty(_EDGE))
    n = F.size(extraction(raw))
    place = lambda x: (x >= 0) & (x < n)
    ok = lambda e: place(e["source_event_idx"]) & place(e["target_event_idx"]) & (e["source_event_idx"] != e["target_event_idx"]) & e["edge_type"].isin(EDGE_TYPES)
    return F.transform(F.filter(got, ok), lambda e: F.struct(e["source_event_idx"].alias("source"), e["target_event_idx"].alias("target"), e["edge_type"].alias("edge_type"), _confidence(e).alias("confidence"), F.coalesce(e["reason"], F.lit("")).alias("reason")))


def inferred_edges(raw: Column, n: Column) -> Column:
    """Edges between a new event and its candidates 0 to n - 1: those of a known type with enough confidence. from_new: the new event is the source."""
    got = F.coalesce(_object(raw, f"edges array<{_CROSS}>")["edges"], _empty(_CROSS))
    ok = lambda e: (e["existing_event_idx"] >= 0) & (e["existing_event_idx"] < n) & e["edge_type"].isin(EDGE_TYPES) & (_confidence(e) >= MIN_CONFIDENCE)
    return F.transform(F.filter(got, ok), lambda e: F.struct(e["existing_event_idx"].alias("candidate"), (F.coalesce(e["direction"], F.lit("")) == "new_to_existing").alias("from_new"), e["edge_type"].alias("edge_type"), _confidence(e).alias("confidence"), F.coalesce(e["reason"], F.lit("")).alias("reason")))


_GROUP = "struct<label:string,session_ids:array<string>,description:string>"


def clusters(raw: Column, session_ids: Column) -> Column:
    """place, label, session_ids, description of each group of a clustering answer that has sessions; one group of all sessions if there is none."""
    got = F.transform(F.coalesce(_object(raw, f"groups array<{_GROUP}>")["groups"], _empty(_GROUP)), lambda g, i: F.struct(
        i.alias("place"), F.coalesce(g["label"], F.concat(F.lit("Topic "), i)).alias("label"), F.coalesce(g["session_ids"], _empty("string")).alias("session_ids"), F.coalesce(g["description"], F.lit("")).alias("description"),
    ))
    kept = F.filter(got, lambda g: F.size(g["session_ids"]) > 0)
    general = F.array(F.struct(F.lit(0).alias("place"), F.lit("General").alias("label"), session_ids.alias("session_ids"), F.lit("All sessions (clustering fallback)").alias("description")))
    return F.when(F.size(kept) > 0, kept).otherwise(general)


def entities(raw: Column) -> Column:
    """Names and concepts of a question: a JSON array if there is one, else what commas or line ends part."""
    given = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\[.*?\]", 0), F.lit("")), "array<string>")
    parted = F.transform(F.split(raw, r"[,\n]"), lambda x: F.regexp_replace(F.trim(x), "^[\"'\\- ]+|[\"'\\- ]+$", ""))
    return F.coalesce(F.filter(F.transform(F.coalesce(given, parted), lambda x: F.trim(x)), lambda x: x != ""), _empty("string"))


def verdict(raw: Column) -> Column:
    """The relationship that an update answer states: its last RELATIONSHIP line with a known value, else by the words in it; null if it says nothing."""
    lines = F.transform(F.regexp_extract_all(raw, F.lit(r"(?im)^[ \t]*relationship:[ \t]*(.+?)[ \t\r]*$"), 1), F.lower)
    stated = F.try_element_at(F.filter(lines, lambda x: x.isin("update", "contradiction", "independent")), F.lit(-1))
    low = F.lower(raw)
    has = lambda w: F.contains(low, F.lit(w))
    found = F.coalesce(stated, F.when(has("update") & ~has("independent"), "update").when(has("contradict"), "contradiction").when(has("independent"), "independent"))
    return F.when(found == "update", "updates").when(found == "contradiction", "contradicts").when(found == "independent", "independent")


def verdict_reason(raw: Column) -> Column:
    return F.trim(F.regexp_extract(raw, r"(?im)^\s*reason\s*:\s*(.+)$", 1))


def note_analysis(raw: Column, content: Column | None = None) -> Column:
    """keywords, context, tags of an analysis: JSON if it is that, else labelled sections; what is empty comes from the content, tags from the keywords."""
    got = _object(raw, "keywords array<string>, context string, tags array<string>")
    keywords = F.coalesce(got["keywords"], list_items(section(raw, "keywords", "context|tags")), _empty("string"))
    about = F.coalesce(got["context"], section(raw, "context", "tags|keywords"), F.lit(""))
    tags = F.coalesce(got["tags"], list_items(section(raw, "tags", "keywords|context")), _empty("string"))
    if content is not None:
        keywords = F.when(F.size(keywords) > 0, keywords).otherwise(F.coalesce(heuristic_keywords(content), _empty("string")))
        about = F.when(about != "", about).otherwise(F.coalesce(heuristic_context(content), F.lit("")))
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.slice(keywords, 1, 3))
    return F.struct(keywords.alias("keywords"), about.alias("context"), tags.alias("tags"))


def evolution(raw: Column) -> Column:
    """decision and reason: from JSON (should_evolve with its actions, or a decision), else from the DECISION section, else by the words in it."""
    got = _object(raw, "should_evolve boolean, actions array<string>, decision string, reason string")
    acts = F.coalesce(got["actions"], _empty("string"))
    both = lambda a, b: F.when(a & b, "STRENGTHEN_AND_UPDATE").when(a, "STRENGTHEN").when(b, "UPDATE_NEIGHBOR").otherwise("NO_EVOLUTION")
    by_actions = F.when(got["should_evolve"].isNotNull(), F.when(got["should_evolve"], both(F.array_contains(acts, "strengthen"), F.array_contains(acts, "update_neighbor"))).otherwise("NO_EVOLUTION"))
    stated = F.replace(F.upper(section(raw, "decision", "reason")), F.lit(" "), F.lit("_"))
    up = F.upper(raw)
    by_words = both(F.contains(up, F.lit("STRENGTHEN")), F.contains(up, F.lit("UPDATE")))
    decision = F.coalesce(by_actions, got["decision"], F.when(stated.isin(DECISIONS), stated), by_words, F.lit("NO_EVOLUTION"))
    reason = F.when(by_actions.isNotNull(), F.lit("")).otherwise(F.coalesce(got["reason"], section(raw, "reason", "decision"), F.lit("")))
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def strengthen_details(raw: Column) -> Column:
    """connections (places of neighbours) and tags."""
    got = _object(raw, "connections array<int>, suggested_connections array<int>, tags array<string>, tags_to_update array<string>")
    listed = F.filter(F.transform(list_items(section(raw, "connections", "tags")), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    tags = F.coalesce(got["tags"], got["tags_to_update"], list_items(section(raw, "tags", "connections")), _empty("string"))
    return F.struct(F.coalesce(got["connections"], got["suggested_connections"], listed, _empty("int")).alias("connections"), tags.alias("tags"))


def update_neighbours(raw: Column, n: int) -> Column:
    """context and tags for each of n neighbours (empty where the answer has none): JSON arrays, else blocks NEIGHBOR i."""
    got = _object(raw, "new_context_neighborhood array<string>, new_tags_neighborhood array<array<string>>")
    said = got["new_context_neighborhood"].isNotNull() | got["new_tags_neighborhood"].isNotNull()

    def one(i: int) -> Column:
        block = F.regexp_extract(raw, rf"(?is)neighbor\s+{i}\s*:(.*?)(?=neighbor\s+{i + 1}\s*:|$)", 1)
        about = F.when(said, F.get(got["new_context_neighborhood"], F.lit(i))).otherwise(section(block, "context", "tags"))
        tags = F.when(said, F.get(got["new_tags_neighborhood"], F.lit(i))).otherwise(list_items(section(block, "tags", "context")))
        return F.struct(F.coalesce(about, F.lit("")).alias("context"), F.coalesce(tags, _empty("string")).alias("tags"))

    return F.array(*(one(i) for i in range(n)))


def judged(raw: Column) -> Column:
    """judgment and score of a judge's answer: its label (WRONG if it has none), 1 for CORRECT; what isn't JSON is ERROR."""
    got = F.from_json(json_block(strip_fences(raw)), "map<string,string>")
    label = F.when(got.isNull(), "ERROR").otherwise(F.upper(F.trim(F.coalesce(F.try_element_at(got, F.lit("label")), F.lit("WRONG")))))
    return F.struct(label.alias("judgment"), (label == "CORRECT").cast("double").alias("score"))


def bare(option: Column) -> Column:
    """An option without quotes and spaces around it, in lower case."""
    return F.lower(F.regexp_replace(option, f"^[{QUOTES} ]+|[{QUOTES} ]+$", ""))


def order_options(question: Column) -> Column:
    """The options of a question of order, as they stand there: up to four in quotes, else the two sides of the `or` after its first comma; no pronouns, each once."""
    asked = stripped(F.coalesce(question, F.lit("")))
    marked = F.slice(F.regexp_extract_all(asked, F.lit(f"([{QUOTES}])[^{QUOTES}]{{2,40}}\\1"), 0), 1, 4)
    sides = F.split(stripped(F.regexp_replace(F.element_at(F.split(asked, ",", 2), -1), r"[?,.]?\s*\z", "")), r"\s+or\s+", 2)
    named = F.when(F.size(marked) >= 2, marked).when(F.contains(asked, F.lit(",")) & (F.size(sides) == 2), sides).otherwise(_empty("string"))
    keyed = F.transform(named, lambda x: F.struct(bare(x).alias("key"), stripped(x).alias("option")))
    kept = F.filter(keyed, lambda x: (F.length(x["key"]) > 1) & ~x["key"].isin(*NO_OPTIONS))
    names = F.transform(kept, lambda x: x["key"])
    return F.transform(F.filter(kept, lambda x, i: F.array_position(names, x["key"]) == i + 1), lambda x: x["option"])


def choose_first(question: Column, answer: Column, fallback: Column | None = None) -> Column:
    """For a question of order the option that the answer names first, if an ordering word begins near to it; else the fallback (the answer).

    A set of conditions, no search: every option's place in the answer is a number, the least of them wins, and the text
    around that place either has an ordering word or not.
    """
    whole = F.coalesce(answer, F.lit(""))
    other = whole if fallback is None else fallback
    tagged = F.get(F.split(F.get(F.split(whole, r"(?i)ANSWER:\s*", 2), F.lit(1)), r"\n\n", 2), F.lit(0))
    said = F.lower(stripped(F.coalesce(F.nullif(tagged, F.lit("")), whole)))
    found = order_options(question)
    places = F.filter(F.transform(found, lambda x, i: F.struct(F.instr(said, bare(x)).alias("at"), i.alias("i"), x.alias("option"))), lambda x: x["at"] > 0)
    best = F.array_min(places)
    # The text from NEAR characters before the option (and one more, for the word's beginning) to NEAR after it.
    around = F.substring(F.concat(F.repeat(F.lit(" "), NEAR + 1), said), best["at"], 2 * NEAR + 2 + max(map(len, ORDERING)) + 1)
    placed = around.rlike(rf"(?s)^.{{1,{2 * NEAR + 1}}}\b(?:{'|'.join(ORDERING)})\b")
    short = F.size(F.split(bare(best["option"]), r"\s+")) <= MOST_WORDS
    good = is_order_question(question) & (F.size(found) >= 2) & best.isNotNull() & ~said.rlike(HEDGES) & placed & short
    return F.when(good, best["option"]).otherwise(other)


#: The forms that dates are read in; their order decides which one wins.
DATE_FORMS = [
    ("month day year", r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b"),
    ("day month year", r"\b(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})\b"),
    ("year month day", r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"),
    ("month year", r"\b([A-Za-z]+),?\s+(\d{4})\b"),
    ("year month", r"\b(\d{4})[-/](\d{1,2})\b"),
]


def canonical_dates(text: str | None) -> str:
    """Dates in a text as `D month YYYY` or `month YYYY`, form after form of DATE_FORMS; what is no date (1900 to 2100) stays. Null: empty."""
    known = {m: i + 1 for i, m in enumerate(MONTHS)} | SPELLINGS
    out = text or ""
    for form, pattern in DATE_FORMS:
        names = form.split()

        def put(found: re.Match) -> str:
            part = dict(zip(names, found.groups(), strict=True))  # noqa: B023
            month = int(part["month"]) if part["month"].isdigit() else known.get(part["month"].lower(), 0)
            day = int(part.get("day", 1))
            if not (1 <= month <= 12 and 1 <= day <= 31 and 1900 <= int(part["year"]) <= 2100):
                return found[0]
            return " ".join([str(day)] * ("day" in part) + [MONTHS[month - 1], str(int(part["year"]))])

        out = re.sub(pattern, put, out)
    return out


def with_canonical_dates() -> object:
    """canonical_dates as a column function."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(canonical_dates)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")
