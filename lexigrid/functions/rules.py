"""Text rules of the corpus and label stages as JVM column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.text import WHITE, squeeze

# Artefacts that extraction leaves in preprint text.
ARTEFACT = r"@x(?:math\d*|cite)|\[[^\]]*?(?:cols|options)=[^\]]*\]"

# English function words.
STOP_WORDS = (
    "the a an and of to in is that for on with as was by at from this are it or be which not but have has he she they we you "
    "his her their will can would could should may more most about between after before when where what who how also its all "
    "some such there these those than then them because into through during including over under up out off again once many "
    "much so very just only own same other each both few no"
).split()

# Phrases of stubs, notices and section headings.
BOILERPLATE = (
    "this article is a stub",
    "this article about",
    "this article needs additional citations",
    "this article relies largely or entirely",
    "this biography of a living person",
    "citation needed",
    "references ^",
    "external links",
    "see also",
    "further reading",
    "wikimedia commons",
    "is a disambiguation page",
    "may be in need of reorganization",
    "to meet wikipedia's quality standards",
)

# Structure that must not stand in a description.
JUNK = r"##|\*\*|<\|>|<\|COMPLETE\|>|\(\"entity\"|\(\"relationship\""

# Numbers as they are compared between texts (four and more digits only with separators).
NUMBER = r"\b\d{1,3}(?:[,.]\d{3})*(?:\.\d+)?\b|\b\d+\.\d+\b|\b\d+%\b"

# The strengths that a relation may have.
WEIGHT_ANCHORS = (0.2, 0.5, 0.8)


def clean_text(text: Column) -> Column:
    """Without artefacts, white space collapsed."""
    return squeeze(F.regexp_replace(text, ARTEFACT, " "))


def is_english(text: Column) -> Column:
    """At least nine tenths of the letters are below U+0250, and three different stop words occur."""
    other = F.regexp_count(text, F.lit(r"[\p{L}&&[^\x00-\x{24F}]]"))
    latin = F.regexp_count(text, F.lit(r"[\p{L}&&[\x00-\x{24F}]]"))
    known = F.array_intersect(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, STOP_WORDS)))
    return (latin > 0) & (latin >= other * 9) & (F.size(known) >= 3)


def is_boilerplate(text: Column) -> Column:
    return F.lower(squeeze(text)).rlike("|".join(map(re.escape, BOILERPLATE)))


def ends_at_boundary(text: Column) -> Column:
    """Ends with a sentence mark, closing quotes and brackets aside."""
    return text.rlike(f"[.!?][\"')\\]}}]*[{WHITE}]*$")


def reject_reason(text: Column, words: Column, least: int = 100, most: int = 300) -> Column:
    """First rule that a passage breaks: length, language, boilerplate; null if none."""
    return (
        F.when(~words.between(least, most), "length").when(~is_english(text), "language").when(is_boilerplate(text), "boilerplate")
    )


def is_clean_description(text: Column) -> Column:
    """No structural junk, no open parenthesis, no odd quote."""
    return (
        ~text.rlike(JUNK)
        & (F.regexp_count(text, F.lit(r"\(")) <= F.regexp_count(text, F.lit(r"\)")))
        & (F.regexp_count(text, F.lit('"')) % 2 == 0)
    )


def numbers_in(text: Column) -> Column:
    """Distinct numbers in order, thousands' commas removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def key(text: Column) -> Column:
    """Comparison key of a title: lower case, runs of other than letters and numbers to blanks.

    Equal to the folded form where NFKC changes nothing; ``operators.titles.folded_key`` is exact.
    """
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Distinct ASCII words of a key."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0))


def grounded(title_key: Column, passage_key: Column, share: float = 0.6, passage_words: Column | None = None) -> Column:
    """The title stands in the passage, or ``share`` of its words do; ``passage_words`` are the passage's, where they are there already."""
    words = tokens(title_key)
    overlap = F.size(F.array_intersect(words, tokens(passage_key) if passage_words is None else passage_words)) >= F.size(words) * F.lit(share)
    return F.contains(passage_key, title_key) | ((F.size(words) > 0) & overlap)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as one division of doubles; 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def strength(value: Column, missing: float = 5.0) -> Column:
    """A stated strength as a number between 0 and 10; ``missing`` where it is none, negative or NaN."""
    number = value.try_cast("double")
    return F.coalesce(F.when((number >= 0) & ~F.isnan(number), F.least(number, F.lit(10.0))), F.lit(missing))


def weight_score(gold: Column, found: Column) -> Column:
    """1 within 0.1 of the gold weight, 0.5 within 0.2, else 0."""
    gap = F.abs(gold - found)
    return F.when(gap <= 0.1 + 1e-12, 1.0).when(gap <= 0.2 + 1e-12, 0.5).otherwise(0.0)


def shorten(text: Column, n: int) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def relation_text(relation: Column) -> Column:
    """A relation in words."""
    return F.trim(F.replace(relation, F.lit("_"), F.lit(" ")))


def entry_line(mark: Column, kind: Column, title: Column, description: Column, most: int = 160) -> Column:
    """An entity as a line of a request; ``most`` characters of its description."""
    return F.concat(F.lit("["), mark, F.lit("] "), squeeze(kind), F.lit(" '"), squeeze(title), F.lit("' — "), F.substring(squeeze(description), 1, most))


def pair_prompt(passage: Column, teacher: Column, student: Column, most: int = 900) -> Column:
    """A request to judge two entities, given as lines; ``most`` characters of the passage come first, if there is one."""
    head = F.when(passage != "", F.concat(F.lit("PASSAGE:\n"), F.substring(passage, 1, most), F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("Entity A (teacher):\n"), teacher, F.lit("\n\nEntity B (student):\n"), student, F.lit("\n\nReturn the JSON object."))


def chat(instruction: Column, prompt: Column, answer: Column) -> Column:
    """Turns of a chat in ChatML."""
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", instruction), turn("user", prompt), turn("assistant", answer))
