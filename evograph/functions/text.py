"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no key terms of a question, an answer or an event.
STOP_WORDS = """
a an the is are was were be been being have has had do does did will would could should may might can to of in for on
with at by from as into through during before after between out off over under again then once here there when where why
how all each every both few more most other some such no not only own same so than too very just because but and or if
while about up it its he she they them his her their what which who whom this that these those i me my we our you your
also many much well like even still already really new get got go going went come came make made take took know knew
think thought see saw want said tell told
""".split()
#: Words that are no keywords of a note.
KEYWORD_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need dare
ought used to of in for on with at by from as into through during before after above below between out off over under
again further then once here there when where why how all both each few more most other some such no nor not only own
same so than too very just because but and or if while about up it its i me my you your he she they we this that these
those what which who whom says said speaker
""".split()
#: Beginnings and parts of questions about time.
TEMPORAL_STARTS = ["when ", "how long ", "how many years", "how many months", "what time ", "what date ", "since when", "how old "]
TEMPORAL_PARTS = ["how long ago", "what year", "what month"]
#: Questions that ask which of several came first or last, and negations that rule them out.
WHICH_FIRST = (
    r"\bwhich (?:[\w']+\s){0,8}(?:first|earlier|earliest|most recent|recently|recent|latest)\b"
    r"|\bwho (?:[\w']+\s){0,8}(?:first|earlier|earliest)\b"
    r"|\bwhich event (?:[\w']+\s){0,8}(?:happened?|occurred|took place)\b"
)
NEGATIONS = r"\bhaven['‘’]?t\b|\bhasn['‘’]?t\b|\bnever\b"


def normalize_role(role: Column) -> Column:
    """assistant -> Assistant, user -> User, none -> Unknown, else with a capital."""
    r = F.trim(F.coalesce(role, F.lit("")))
    return F.when(r == "", F.lit("Unknown")).otherwise(F.initcap(F.lower(r)))


def render_note(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("Speaker "), speaker, F.lit(" says: "), F.coalesce(text, F.lit("")))


def with_caption(text: Column, url: Column, caption: Column) -> Column:
    """A turn's text with its image caption before it, if it has both an image and a caption."""
    return F.when(url.isNotNull() & caption.isNotNull(), F.concat(F.lit("[Image: "), caption, F.lit("] "), text)).otherwise(text)


def index_text(content: Column, context: Column, keywords: Column, tags: Column, rebuilt: bool) -> Column:
    """What is embedded for a note: labelled fields when it is added, plain ones when the index is rebuilt."""
    if rebuilt:
        return F.concat(content, F.lit(" , "), F.concat_ws(" ", context, F.array_join(keywords, " "), F.array_join(tags, " ")))
    return F.concat_ws(" ", F.concat(F.lit("content:"), content), F.concat(F.lit("context:"), context), F.concat(F.lit("keywords: "), F.array_join(keywords, ", ")), F.concat(F.lit("tags: "), F.array_join(tags, ", ")))


def tokens(text: Column) -> Column:
    """Lower-case tokens; . , ! ? are white space."""
    return F.filter(F.split(F.translate(F.lower(text), ".,!?", "    "), r"\s+"), lambda t: t != "")


def key_terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case words of two letters or more that are no stop words, sorted."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    return F.array_sort(F.array_except(F.filter(words, lambda t: F.length(t) > 1), stop))


def heuristic_keywords(text: Column, limit: int = 5) -> Column:
    """The first distinct words of three ASCII letters or more, in lower case, those that first occur with a capital before the others."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Za-z]{3,}$") & ~F.lower(w).isin(KEYWORD_STOP_WORDS))
    first = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    capital = lambda w: w.rlike("^[A-Z]")
    return F.slice(F.transform(F.concat(F.filter(first, capital), F.filter(first, lambda w: ~capital(w))), F.lower), 1, limit)


def heuristic_context(text: Column) -> Column:
    """The first sentence (white space must follow its mark) if the first line has one, else the first 200 characters."""
    first = F.regexp_extract(text, r"(?d)^(.+?[.!?])[\s\p{Z}]", 1)
    return F.regexp_replace(F.when(first != "", first).otherwise(F.substring(text, 1, 200)), r"^\s+|\s+$", "")


def stripped(text: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def normalize_answer(text: Column) -> Column:
    """Without quotes around it and without a final period, unless that follows a digit."""
    t = stripped(F.regexp_replace(stripped(text), "^[\"'“”‘’]+|[\"'“”‘’]+\\z", ""))
    return stripped(F.regexp_replace(t, r"(?<!\p{Nd})\.\z", ""))


def answer_tag(text: Column) -> Column:
    """The line that follows the last ANSWER: at a line's start, else the last one anywhere; null if there is none. White space may stand before the colon,
    and line ends after it; a tag that nothing follows is none."""
    space = r"[\s\p{Z}]*"
    at_start = F.regexp_extract_all(text, F.lit(rf"(?imd)^[ \t]*answer{space}:{space}([^\n]+)"), 1)
    inline = F.regexp_extract_all(text, F.lit(rf"(?i)answer{space}:{space}([^\n]+)"), 1)
    last = lambda a: F.when(F.size(a) > 0, stripped(F.element_at(a, -1)))
    return F.coalesce(last(at_start), last(inline))


def parse_answer(text: Column) -> Column:
    """An answer's text: what its tag says, else the field answer of JSON (which may stand in fences), else all of it."""
    return normalize_answer(F.coalesce(F.nullif(answer_tag(text), F.lit("")), F.get_json_object(strip_fences(text), "$.answer"), text))


def json_field_or_text(text: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{name}"), F.trim(text))


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```[A-Za-z]*[ \t]*$", ""), r"^\s+|\s+$", "")


def json_block(text: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def list_items(text: Column) -> Column:
    """Items of a bulleted, numbered or comma-separated list, without quotes."""
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*(?:[-*\u2022]|\d+[.)])\s*", "")), "^[\"'\\[]+|[\"'\\]]+$", "")
    return F.filter(F.transform(F.split(text, r"[\n,]"), clean), lambda x: x != "")


def section(text: Column, marker: str, following: str) -> Column:
    """The text between a marker and the next of the following ones (alternatives by |), whatever their case."""
    return F.trim(F.regexp_extract(text, rf"(?is){marker}\s*:?\s*(.*?)(?=\s*(?:{following})\s*:|$)", 1))


def session_number(key: Column) -> Column:
    """N of session_N_summary, 0 for any other key."""
    return F.coalesce(F.regexp_extract(key, r"session_(\d+)_summary", 1).try_cast("int"), F.lit(0))


def question_type(question: Column) -> Column:
    """temporal for questions about time, else default."""
    q = F.lower(F.trim(question))
    hit = F.lit(False)
    for x in TEMPORAL_STARTS:
        hit |= q.startswith(x)
    for x in TEMPORAL_PARTS:
        hit |= F.contains(q, F.lit(x))
    return F.when(hit, "temporal").otherwise("default")


def prompt_template(category: Column, question_type: Column, original_type: Column) -> Column:
    """The template of a question: open for category 3, preference for questions of preference, temporal for those about time, else default."""
    return F.when(category == 3, "open").when(original_type == "single-session-preference", "preference").when(question_type == "temporal", "temporal").otherwise("default")


def is_order_question(question: Column) -> Column:
    """Does it ask which of several came first or last, without a negation?"""
    q = F.coalesce(question, F.lit(""))
    return q.rlike(f"(?i){WHICH_FIRST}") & ~q.rlike(f"(?i){NEGATIONS}")


def render_turns(turns: Column) -> Column:
    """A line `role: content` for each turn of an array of (role, content)."""
    role = lambda t: F.coalesce(F.nullif(F.trim(t["role"]), F.lit("")), F.lit("unknown"))
    return F.array_join(F.transform(turns, lambda t: F.concat(role(t), F.lit(": "), F.trim(F.coalesce(t["content"], F.lit(""))))), "\n")


def render_dialogue(turns: Column, date: Column) -> Column:
    """A session as one text: its date if there is one, then what each role said; turns without content are left out."""
    said = F.filter(turns, lambda t: F.trim(F.coalesce(t["content"], F.lit(""))) != "")
    role = lambda t: F.coalesce(F.nullif(F.initcap(F.trim(t["role"])), F.lit("")), F.lit("Unknown"))
    head = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("On "), date, F.lit(", the session contained these exchanges:"))).otherwise("The session contained these exchanges:")
    return F.concat_ws(" ", head, F.nullif(F.array_join(F.transform(said, lambda t: F.concat(role(t), F.lit(" said: "), F.trim(t["content"]))), " "), F.lit("")))


def render_note_fields(timestamp: Column, content: Column, note_context: Column, keywords: Column, tags: Column, mode: str = "full") -> Column:
    """A note as it stands in a context. mode: full, no_context, minimal; any other is full."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    text = lambda c: F.coalesce(c, F.lit(""))
    empty = F.array().cast("array<string>")
    parts = [F.lit("talk start time:"), text(timestamp), F.lit("memory content: "), text(content)]
    if mode not in ("no_context", "minimal"):
        parts += [F.lit("memory context: "), text(note_context)]
    if mode != "minimal":
        parts += [F.lit("memory keywords: "), listed(F.coalesce(keywords, empty)), F.lit("memory tags: "), listed(F.coalesce(tags, empty))]
    return F.concat(*parts)


def safe_name(name: str) -> str:
    """A model's name as part of a path."""
    return name.replace("/", "_")


def is_abstention(answer: Column) -> Column:
    return F.lower(answer).rlike(r"not mentioned|no information|cannot be (determined|answered)|don't know|unknown")


def prompt_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def parity_bit(text: Column) -> Column:
    return (F.conv(F.substring(F.sha2(text, 256), 64, 1), 16, 10).cast("int") % 2).cast("int")


def token_count(text: Column) -> Column:
    """White-space tokens; empty or null: 0. A plug-in replaces it where a tokenizer is at hand."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")), F.lit(0))
