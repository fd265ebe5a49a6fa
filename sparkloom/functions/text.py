"""Text functions as Column builders; all but chunks() run inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Query words that name no topic.
GENERIC_STOP_WORDS = (
    "the and what where when which with from this that you your our are was were will does its how can could would please give have about need "
    "want build final year tell something uses using more information info because working similar related enlist list titles urls article articles website "
    "site know looking company companies business businesses brand brands organisation organization org firm shop store"
).split()
#: Words that frame a question.
FRAMING = (
    "the a an is are do does did can could would will how what where when why who i me my we our you your to of for in on at and or it "
    "this that there please tell know want need help about with from any some get have has was were"
).split()
#: Words without weight when a question is compared with a curated one.
TERM_STOP_WORDS = "the and that this with from your what when where how".split()
#: Query terms beyond this many are cut: a longer query is a pasted text.
MAX_TERMS = 24
PINNED_THRESHOLD = 0.72

#: Patterns of the routing questions (case-insensitive; \b next to ASCII letters only matters for ASCII words).
PERSON = "(?:a real person|human|person|people|someone|somebody|support|customer service|representative|admin|administrator|moderator|owner|agent|team|staff|webmaster)s?"
REACH = "(?:talk|speak|chat|contact|call|email|message|reply|reach|get in touch)"
HUMAN_SUPPORT = [
    rf"\b(?:talk|speak|chat|contact|call|email|message|connect|transfer|reach|get in touch)\b.{{0,60}}\b{PERSON}\b",
    rf"\b{PERSON}\b.{{0,60}}\b{REACH}\b",
    rf"\b(?:have|ask|get|tell|send)\b.{{0,30}}\b{PERSON}\b.{{0,30}}\b(?:contact|call|email|message|reply|reach)\b",
    rf"\b(?:send|pass|forward|relay)\b.{{0,40}}\b(?:message|note|query|question|feedback|request)\b.{{0,40}}\b{PERSON}\b",
    r"\b(?:phone number|direct email|email address|contact details)\b",
    r"\b(?:mujhe|mujhse|mujh se|humain|hamein|hamain|kisi)\b.{0,55}\b(?:insan|insaan|banda|banday|bande|support|admin|owner|agent|team|staff)\b.{0,55}\b(?:baat|bat|rabta|raabta|contact|call|reply)\b",
    r"\b(?:support|admin|owner|agent|team|staff|insan|insaan|banda|banday|bande)\b.{0,55}\b(?:se|say)\b.{0,35}\b(?:baat|bat|rabta|raabta|contact)\b",
    r"\b(?:koi|ap|aap)\b.{0,35}\b(?:mujhe|mujhse|mujh se)\b.{0,35}\b(?:contact|call|reply|rabta|raabta)\b",
    r"(?:انسان|شخص|ایڈمن|مالک|سپورٹ|نمائندہ|ٹیم).{0,60}(?:بات|رابطہ|کال|ای میل)",
    r"(?:بات|رابطہ|کال|ای میل).{0,60}(?:انسان|شخص|ایڈمن|مالک|سپورٹ|نمائندہ|ٹیم)",
]
LATEST_LINK = [r"\b(?:latest|newest|most\s+recent|recent)\b", r"\b(?:url|link|post|article|page|news)\b"]
CONTEXT_LINK = [r"\b(?:url|link)\b", r"\b(?:this|that|it|article|post|page|one|above|mentioned)\b"]
IMAGE = [
    r"\b(?:image|images|pic|pics|picture|photo|screenshot|diagram|circuit|attached|attachment|above|shown|visible|given)\b",
    r"\b(?:this|that|it|same)\b.{0,35}\b(?:post|article|page|project|product)\b",
]
PAGE_OF_IMAGE = r"\b(?:find|locate|identify|match|search|which|where|link|url|post|article|page|project|product)\b"
OVERVIEW = [
    r"\b(?:how many|complete list|full list|entire list|list them all)\b",
    r"\b(?:list|show|name|tell me)\b.{0,20}\b(?:all|every|each)\b",
    r"\b(?:all|every)\b.{0,25}\b(?:formats?|file types?|viewers?|tools?|categories|services?|products?|pages?|articles?)\b",
    r"\b(?:what|which)\b.{0,20}\b(?:formats?|file types?|viewers?|tools?|categories)\b.{0,30}\b(?:support(?:s|ed)?|available|offer(?:s|ed)?|have|has|there)\b",
]
RELATED = r"\b(?:similar|related|alternative|another|other|more like|recommend)\b"
ATTACK_PHRASE = r"\b(?:system prompt|prompt injection|developer mode|jailbreak|dan mode)\b"
DISCARD = r"\b(?:forget|ignore|disregard|discard|override|bypass)\b[\s\S]{0,40}\b(?:everything|all|previous|prior|above|instructions?|rules?|prompts?)\b"
INSTRUCTIONS = [r"\b(?:system|initial|original|previous|above)\s+(?:prompts?|instructions?|rules?|guidelines?|directives?|configuration|setup)\b", r"\byour\s+(?:prompts?|instructions?|directives?)\b"]
REVEAL = r"\b(?:reveal|show|print|repeat|output|display|tell me|give me|what (?:is|are|was|were))\b"
HANDOFF_REPLY = r"\b(?:ask the website team to contact you|submit your details below|request sent)\b"
BOILERPLATE = r"isbn|retrieved [0-9]|archived from|bibliography|references"
NOT_FOUND = r"^(?:404(?:\s+error)?|not found|page not found)(?:\s*[|—–-]|\z)"
GENERIC_SEGMENT = r"^(?:category|categories|tag|tags|search|author|page|blog|articles|posts|project|projects|archive|archives)\z"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PARAGRAPHS = re.compile(r"\n\n+")
SENTENCE = re.compile(r"[^.!?]+[.!?]+|[^.!?]+\Z")
PHONE = r"\+?\d[\d\s().-]{7,}\d"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b as an edge between ASCII word characters, not those of all alphabets."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def _folds() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII or Arabic letter, digit or sign, and those forms, in the same order."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(128, sys.maxunicode + 1))
    pairs = [(c, f) for c, f in forms if len(f) == 1 and f != c and (f < "\x80" or "\u0600" <= f <= "\u06ff")]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


WIDE, NARROW = _folds()


def narrow(text: Column) -> Column:
    """Text with full-width, mathematical and presentation forms as plain letters: what of NFKC bears on the patterns."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, WIDE, NARROW)).otherwise(text)


def matches(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns, case-insensitively, occurs in text."""
    return reduce(lambda a, b: a | b, (text.rlike("(?i)" + ascii_edges(p)) for p in patterns))


def among(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column, least: int = 3) -> Column:
    """Runs of letters and digits of at least that many characters, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space collapsed to one blank and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_framing_verb(query: Column) -> Column:
    """"how does the x work" asks about x: the closing verb goes."""
    framed = F.trim(query).rlike("(?i)" + ascii_edges(r"^how\s+(?:do|does|did|is|are|can)\b.*\b(?:works?|working)\b[\s?.!]*\z"))
    return F.when(framed, F.regexp_replace(query, "(?i)" + ascii_edges(r"\b(?:works?|working)\b[\s?.!]*\z"), " ")).otherwise(query)


def unless_empty(narrow: Column, wide: Column) -> Column:
    """A narrowing holds only if it leaves something."""
    return F.when(F.size(narrow) > 0, narrow).otherwise(wide)


def query_terms(query: Column, site_words: Column | None = None) -> Column:
    """The terms of a question that name its topic, at most MAX_TERMS."""
    raw = F.array_distinct(tokens(strip_framing_verb(query)))
    base = unless_empty(F.array_except(raw, among(GENERIC_STOP_WORDS)), raw)
    if site_words is not None:
        base = unless_empty(F.array_except(base, F.coalesce(site_words, F.array().cast("array<string>"))), base)
    return F.slice(base, 1, MAX_TERMS)


def site_words(url: Column) -> Column:
    """Words of a site's own name, with their singular or plural."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.split(x, "[-_]+")))
    words = F.filter(words, lambda w: F.length(w) >= 3)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.when(w.endswith("s"), F.expr("null").cast("string")).otherwise(F.concat(w, F.lit("s")))))))


def gap_key(question: Column) -> Column:
    """Questions of one topic share a key: framing words and plural s go, and order does not count."""
    kept = F.filter(tokens(question), lambda w: ~w.isin(FRAMING))
    singular = F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    key = F.array_join(F.array_sort(F.array_distinct(singular)), " ")
    return F.when(key == "", squeeze(F.lower(question))).otherwise(key)


def singular(word: Column) -> Column:
    cut = F.when(word.rlike(r"(?:ch|sh|x|z|s)es\z"), F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(F.substring(word, F.lit(1), F.length(word) - 1))
    return F.when((F.length(word) <= 4) | ~word.endswith("s") | word.rlike(r"(?:ss|us|is)\z"), word).otherwise(cut)


def term_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda w: ~w.isin(TERM_STOP_WORDS)), singular))


def pin_score(a: Column, b: Column) -> Column:
    """Cosine of two term sets."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))


def term_overlap(terms: Column, text: Column) -> Column:
    """Share of terms that occur, as substrings, in text; a one-element transform lower-cases the text once, not once a term."""
    held = F.get(F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t)))), F.lit(0))
    return F.when(F.size(terms) > 0, held / F.size(terms)).otherwise(0.0)


def clean_title(title: Column) -> Column:
    """The part before " | ", " - " and their kin."""
    return F.trim(F.get(F.split(title, r"\s[|–—-]\s", 2), F.lit(0)))


def title_precision(title: Column, terms: Column) -> Column:
    """Share of the title's words that hold or are held by a term."""
    words = tokens(clean_title(title))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.exists(terms, lambda t: F.contains(w, t) | F.contains(t, w)))) / F.size(words)).otherwise(0.0)


def url_specificity(url: Column) -> Column:
    """Number of path segments, one more for a long last one, four less for a generic one; -10 for roots and invalid urls."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.get(segments, F.size(segments) - 1)
    generic = F.exists(segments, lambda s: s.rlike("(?i)" + GENERIC_SEGMENT))
    return F.when(F.size(segments) == 0, F.lit(-10)).otherwise(F.size(segments) + (F.length(last) > 12).cast("int") - generic.cast("int") * 4)


def break_character(question: Column) -> Column:
    """Whether a message tries to see or drop the instructions."""
    text = F.regexp_replace(F.lower(question), r"[^a-z0-9\s]", " ")
    return matches(text, ATTACK_PHRASE, DISCARD) | (matches(text, *INSTRUCTIONS) & matches(text, REVEAL))


def human_support(question: Column) -> Column:
    return matches(F.trim(F.regexp_replace(F.regexp_replace(narrow(question), "[’']", ""), r"\s+", " ")), *HUMAN_SUPPORT)


def latest_link(question: Column) -> Column:
    return reduce(lambda a, b: a & b, (matches(question, p) for p in LATEST_LINK))


def context_link(question: Column) -> Column:
    return reduce(lambda a, b: a & b, (matches(question, p) for p in CONTEXT_LINK))


def route(question: Column) -> Column:
    """The first that applies of attack, handoff, latest link, link from context, image, overview, related, and retrieval."""
    image = matches(question, *IMAGE) & matches(question, PAGE_OF_IMAGE)
    steps = [(break_character(question), "attack"), (human_support(question), "handoff"), (latest_link(question), "latest_link"), (context_link(question), "context_link"), (image, "image_page"), (matches(question, *OVERVIEW), "overview"), (matches(question, RELATED), "related")]
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in steps), F.lit("retrieve"))


def clean_chunk_input(text: Column) -> Column:
    """NBSP and blanks to one blank, at most one empty line, trimmed."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


#: Fixed value: values of an Arrow batch that are Python objects at a time.
AT_ONCE = 128


def each(values: Column, f: Callable[[str | None], Any], kind: str, arrow: pa.DataType) -> Column:
    """f of every value, a loop over Arrow batches; of a batch only a few values and results at a time are Python objects."""

    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array([f(v) for v in column.slice(at, AT_ONCE).to_pylist()], arrow) for at in range(0, len(column), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(values)


def chunks(text: Column, target: int = 1200, overlap: int = 180, least: int = 40) -> Column:
    """Chunks of whole sentences up to target characters; each starts with the last overlap characters of the one before.

    A sentence longer than the target stays whole, and a closing chunk under ``least`` characters goes. Every chunk depends on the one before, so
    this is a loop over the sentences of an Arrow batch; as a fold of columns it copied the open chunk at every sentence (12.7 s at sf0.1).
    """
    space = " \t\n\x0b\f\r"

    def cut(body: str) -> list[str]:
        out: list[str] = []
        now = ""
        for block in PARAGRAPHS.split(body):
            for sentence in SENTENCE.findall(block) or [block]:
                if not (s := sentence.strip(space)):
                    continue
                if not now:
                    now = s
                elif len(now) + 1 + len(s) > target:
                    out.append(now)
                    now = f"{now[-overlap:]} {s}".strip(space)
                else:
                    now = f"{now} {s}"
        return [*out, now] if len(now) >= least else out

    return each(clean_chunk_input(text), lambda t: None if t is None else cut(t), "array<string>", pa.list_(pa.string()))
