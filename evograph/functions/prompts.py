"""Prompts as column expressions: what a model is asked, and in which form it must answer (functions.parsers reads that).

The wording is this package's own. Fixed are the forms of the answers: JSON keys, section names and line heads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, **fields: Column) -> Column:
    """The template with {name} replaced by each field (null: empty text). Braces that name no field stay."""
    out: list[Column] = []
    rest = template
    while rest:
        at = [(rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest]
        if not at:
            out.append(F.lit(rest))
            break
        place, name = min(at)
        if place:
            out.append(F.lit(rest[:place]))
        out.append(F.coalesce(fields[name].cast("string"), F.lit("")))
        rest = rest[place + len(name) + 2 :]
    return F.concat(*out)


def listed(names: Column, none: str = "none") -> Column:
    """An array as text, `none` if it is empty."""
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit(none))


EXTRACTION = """Read this note and list the events in it and how they are linked.
Note ({timestamp}): {content}
About: {context}
Keywords: {keywords}
Answer with JSON alone: {"events": [{"event_type": "action | state_change | preference | plan", "participants": ["name"], "time_anchor": "YYYY-MM-DD or unknown", "state_change": "what happens, in a sentence"}], "edges": [{"source_event_idx": 0, "target_event_idx": 1, "edge_type": "causes | enables | prevents | temporal_before | updates | contradicts", "confidence": 0.9, "reason": "why"}]}"""
CROSS_NOTE = """A new event: {event}
Earlier events, by number:
{candidates}
Which of them is linked to the new one by cause? Answer with JSON alone: {"edges": [{"existing_event_idx": 0, "direction": "existing_to_new | new_to_existing", "edge_type": "causes | enables | prevents | temporal_before", "confidence": 0.9, "reason": "why"}]}"""
UPDATE = """Does the new event replace what the old one says?
New: {new}
Old: {old}
Answer in two lines, with update, contradiction or independent in the first:
RELATIONSHIP: independent
REASON: why"""
ENTITIES = """Which persons and things does this question name? Answer with a JSON array of texts alone.
{question}"""
CLUSTERS = """Put these sessions into groups by what they are about; each belongs to one group.
{sessions}
Answer with JSON alone: {"groups": [{"label": "a few words", "session_ids": ["id"], "description": "a sentence"}]}"""
SUMMARY = """Say in a few sentences what happens in this conversation of {date}: facts, plans, preferences and changes, with names.
{turns}"""
ANALYSIS = """Describe this note in three sections:
KEYWORDS: the most important first, by commas
CONTEXT: one sentence
TAGS: by commas
{content}"""
EVOLUTION = """A new note: {note}
Notes that are near to it:
{neighbours}
Should it be linked to them (STRENGTHEN), should they be changed (UPDATE_NEIGHBOR), both (STRENGTHEN_AND_UPDATE), or neither (NO_EVOLUTION)?
DECISION: one of these
REASON: why"""
STRENGTHEN = """A new note: {note}
Notes that are near to it, by number from 0:
{neighbours}
CONNECTIONS: numbers of those it should link to, by commas
TAGS: the new note's tags, by commas"""
UPDATE_NEIGHBOURS = """A new note: {note}
Notes that are near to it, by number from 0:
{neighbours}
For each of the {count} notes, with what it should say now:
NEIGHBOR 0:
CONTEXT: one sentence
TAGS: by commas"""
ANSWERS = {
    "default": "Answer the question in a few words of the notes and paths below. End with a line ANSWER: and the answer.\n{context}\nQuestion: {question}",
    "temporal": "Answer the question about time by the notes and paths below; name a date in full, not relative to a note's. End with a line ANSWER: and the answer.\n{context}\nQuestion: {question}",
    "open": "Answer the question by the notes and paths below, and by what follows from them. End with a line ANSWER: and the answer.\n{context}\nQuestion: {question}",
    "preference": "Say what the notes and paths below show the user to prefer, as far as it matters for the question; do not answer it. End with a line ANSWER: and that profile.\n{context}\nQuestion: {question}",
}
JUDGE = """Question: {question}
Right answer: {reference}
Given answer: {prediction}
Does the given answer say the same as the right one? Answer with JSON alone: {"label": "CORRECT or WRONG"}"""


def answer_prompt(template: Column, context: Column, question: Column) -> Column:
    """The prompt of a question by the name of its template (functions.text.prompt_template)."""
    out = filled(ANSWERS["default"], context=context, question=question)
    for name in ("temporal", "open", "preference"):
        out = F.when(template == name, filled(ANSWERS[name], context=context, question=question)).otherwise(out)
    return out


def described(kind: Column, participants: Column, anchor: Column, state_change: Column) -> Column:
    """An event in a line of a prompt."""
    return F.concat_ws("; ", kind, listed(participants), anchor, state_change)


def numbered(lines: Column) -> Column:
    """An array of texts, each with its place before it, a line each."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)), "\n")
