"""Column functions for text: whitespace, cleaning, classes, slugs, labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode whitespace as a character class; Java's and RE2's \s are ASCII only.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"

# Texts, noise phrases and class rules every catalog is built with.
NO_DESCRIPTION = "No description available"
SHORT_DESCRIPTION = "Assessment for evaluating specific skills and competencies"
SHORT_LIMIT = 20
NOISE_PHRASES = [
    "If you choose to continue with your current browser",
    "We recommend upgrading to a modern browser",
    "Outdated browser detected",
    "Latest browser options",
    "I understand and wish to continue",
]
TYPE_RULES = [
    ("Personality & Behavior", ["personality", "opq", "behavior"]),
    ("Cognitive", ["cognitive", "verify", "reasoning"]),
    ("Simulation", ["simulation", "exercise"]),
    ("Technical Skills", ["technical", "programming", "coding", ".net", "java", "python"]),
    ("Language", ["language", "writing", "comprehension"]),
]
DEFAULT_TYPE = "General"

_NOISE = "(?iud)(?:" + "|".join(NOISE_PHRASES) + ").*"
# Words at least one of which every noise phrase holds, and the letters that
# match s or i when case is ignored though lower() keeps them apart.
_NOISE_HINTS = ["browser", "understand"]
_NOISE_LETTERS = "ſıİ"
# Whitespace that is not already one blank.
_LOOSE = rf" [{SPACE}]+|(?! )[{SPACE}]+"
_LINK = rf"http[^{SPACE}]+|www\.[^{SPACE}]+"


def trim_space(text: Column) -> Column:
    """Strip Unicode whitespace from both ends; ``trim`` strips blanks only."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse_space(text: Column) -> Column:
    """Every run of whitespace becomes one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, _LOOSE, " "))


def collapse_blanks(text: Column) -> Column:
    """:func:`collapse_space` of a text whose only whitespace are blanks; few have two in a row."""
    return F.btrim(F.when(text.contains("  "), F.regexp_replace(text, "  +", " ")).otherwise(text))


def remove_noise(text: Column) -> Column:
    """Drop browser warnings to the end of their line and tidy blanks."""
    lowered = F.lower(text)
    # Few texts hold noise; a plain search spares the others the pattern.
    noisy = reduce(or_, [lowered.contains(w) for w in _NOISE_HINTS] + [text.contains(c) for c in _NOISE_LETTERS])
    return collapse_space(F.when(noisy, F.regexp_replace(text, _NOISE, "")).otherwise(text))


def remove_links(text: Column) -> Column:
    linked = text.contains("http") | text.contains("www.")
    return F.when(linked, F.regexp_replace(text, _LINK, "")).otherwise(text)


def default_short(text: Column) -> Column:
    """Texts under 20 characters say too little and get a fixed sentence."""
    return F.when(F.length(text) < SHORT_LIMIT, F.lit(SHORT_DESCRIPTION)).otherwise(text)


def with_clean_description(df: DataFrame, column: str = "description") -> DataFrame:
    """Clean a description: noise, then blanks, then links, then the short default.

    Links go last and leave their blanks behind, which count for the length.
    One column per step, as each step looks at the one before more than once.
    """
    steps = [
        F.coalesce(F.col(column), F.lit(NO_DESCRIPTION)),
        remove_noise(F.col(column)),
        remove_links(F.col(column)),
        default_short(F.col(column)),
    ]
    for step in steps:
        df = df.withColumn(column, step)
    return df


def embedding_text(name: Column, description: Column) -> Column:
    """Of a clean name and description, where only removed links leave blanks in a row."""
    return collapse_blanks(F.concat(name, F.lit(". "), description))


def classify(name: Column, rules=TYPE_RULES, default: str = DEFAULT_TYPE) -> Column:
    """First rule with a word inside the lower-cased name."""
    lowered = F.lower(name)
    branches = None
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        branches = F.when(hit, F.lit(label)) if branches is None else branches.when(hit, F.lit(label))
    return F.lit(default) if branches is None else branches.otherwise(F.lit(default))


def slug(url: Column) -> Column:
    """Last path segment, lower-cased, trailing slashes ignored."""
    trimmed = F.regexp_replace(trim_space(F.lower(url)), r"/+\z", "")
    return F.element_at(F.split(trimmed, "/"), -1)


def shorten(text: Column, limit: int = 200) -> Column:
    """Cut long text at the last blank within ``limit`` characters and add dots."""
    head = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*\z", "")
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def match_label(score: Column) -> Column:
    return (
        F.when(score >= 0.75, F.lit("Excellent Match"))
        .when(score >= 0.60, F.lit("Good Match"))
        .otherwise(F.lit("Fair Match"))
    )


def match_percent(score: Column) -> Column:
    """Percentage, halves up."""
    return F.floor(score * 100 + 0.5).cast("long")


def query_status(query: Column, minimum: int = 20) -> Column:
    """``empty`` or ``too_short`` queries are rejected, others are ``ok``."""
    length = F.length(trim_space(F.coalesce(query, F.lit(""))))
    return (
        F.when(length == 0, F.lit("empty"))
        .when(length < minimum, F.lit("too_short"))
        .otherwise(F.lit("ok"))
    )


def query_warning(query: Column, advised: int = 50) -> Column:
    """True for an entered text too short to give good results; blanks count."""
    length = F.length(F.coalesce(query, F.lit("")))
    return (length > 0) & (length < advised)


def no_type_filter(item_type: Column) -> Column:
    return item_type.isNull() | (item_type == "") | (F.lower(item_type) == "all")


def session_or_new(session_id: Column) -> Column:
    """The given session, or a fresh random one."""
    return F.coalesce(F.nullif(session_id, F.lit("")), F.expr("uuid()"))
