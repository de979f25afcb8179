"""Scalar functions on words and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STAGE_ALIASES, STAGE_LABELS

# What is stripped from a generated first word, and from a discovered word.
FIRST_WORD_STRIP = ".,;:!?\"()[]"
DISCOVERED_STRIP = ".,;:!?\"'()[]{}—-–"
# Question, function and meta tokens that mark a change of genre.
GENRE_TOKENS = (
    "what who where when why how which What Who Where When Why How Which WHAT WHO WHERE WHEN WHY HOW WHICH "
    "Options options Question question ____ ___ __ ... the a an is are was were it this that "
    "to of for in on at by with she he her his they them"
).split()


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-" else c for c in chars) + "]"


def strip_chars(text: Column, chars: str) -> Column:
    c = _class(chars)
    return F.regexp_replace(text, f"^{c}+|{c}+$", "")


def first_token(text: Column) -> Column:
    """What stands before the first white space; empty where there is nothing."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\S+)", 1)


def first_word(text: Column) -> Column:
    return strip_chars(first_token(text), FIRST_WORD_STRIP)


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def is_real_word(word: Column) -> Column:
    """Two ASCII characters or more, not underscores alone."""
    return word.rlike(r"^[\x00-\x7F]{2,}$") & ~word.rlike(r"^_+$")


def shares_stem(a: Column, b: Column) -> Column:
    """One holds the other in any case, or they begin alike for four characters and three fifths of the shorter."""
    x, y = F.lower(a), F.lower(b)
    prefix = F.greatest(F.lit(4), F.ceil(F.least(F.length(x), F.length(y)) * F.lit(3) / F.lit(5)).cast("int"))
    alike = (F.length(x) >= prefix) & (F.length(y) >= prefix) & (F.substring(x, F.lit(1), prefix) == F.substring(y, F.lit(1), prefix))
    return F.contains(x, y) | F.contains(y, x) | alike


def category_of(label: Column) -> Column:
    return F.regexp_replace(label, r"_\d+$", "")


# Names of the nine categories of prompts, by what their labels begin with.
CATEGORY_NAMES = {
    "sexual_liminal": "sexual (liminal)",
    "sexual_explicit": "sexual (explicit)",
    "violence_liminal": "violence (liminal)",
    "violence_explicit": "violence (explicit)",
    "death": "death",
    "power": "power",
    "profanity": "profanity",
    "substance": "substance",
    "neutral": "neutral",
}


def coarse_category(label: Column) -> Column:
    """One of five categories by the beginning of a label."""
    out = F.when(label.startswith("sexual_liminal"), "sexual (liminal)").when(label.startswith("sexual_explicit"), "sexual (explicit)")
    return out.when(label.startswith("violence"), "violence").when(label.startswith("neutral"), "neutral").otherwise("other")


def full_category(label: Column) -> Column:
    """One of nine categories: a label that ends in a digit less what follows its last underscore; others stay as they are."""
    stem = F.when(label.rlike(r"\d$"), F.regexp_replace(label, r"_[^_]*$", "")).otherwise(label)
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    return F.coalesce(known[stem], stem)


def stage_label(stage: Column) -> Column:
    """How a stage is captioned; others stay."""
    known = F.create_map(*[F.lit(x) for kv in STAGE_LABELS.items() for x in kv])
    return F.coalesce(known[stage], stage)


def slug(prompt: Column) -> Column:
    """For file names: lower case, runs of other than letters and digits to one underscore, fifty characters, stripped."""
    return F.btrim(F.substring(F.regexp_replace(F.lower(F.trim(prompt)), "[^a-z0-9]+", "_"), 1, 50), F.lit("_"))


def stage_alias(name: Column) -> Column:
    """A stage's name here for any name it is known by; others stay."""
    known = F.create_map(*[F.lit(x) for kv in STAGE_ALIASES.items() for x in kv])
    return F.coalesce(known[name], name)


def part_of_speech(word: Column) -> Column:
    """A part of speech by suffix, where no tagger's table is given."""
    return F.when(word.rlike("(ing|ed)$"), "VERB").when(word.rlike("ly$"), "ADV").when(word.rlike("s$"), "NOUN").otherwise("X")


def transfer_type(target: Column, same_pos: Column, zipf: Column, archaic_below: float = 3.0) -> Column:
    return (
        F.when(target.isin(GENRE_TOKENS), "genre_change").when(zipf < archaic_below, "archaic").when(same_pos, "register_shift").otherwise("category_shift")
    )
