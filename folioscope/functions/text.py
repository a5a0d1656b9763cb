r"""Column expressions over text.

White space is what ECMAScript means by it: Java's ``\s`` is ASCII only, and its ``(?U)\s`` differs in two characters.
Every function gives null for null; lengths count characters (code points).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.words import STOP_WORDS, VAGUE_WORDS

#: Inside a character class of a Java (or RE2) pattern.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Letter or digit runs joined by one of these characters are one word, too.
JOINED = r"[\p{L}\p{N}]+(?:[_\-./@:][\p{L}\p{N}]+)+"
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"
LIST_NUMBER = r"^\d+[.)][" + SPACE + "]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+\\z", "")


def squash(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def tokens(text: Column) -> Column:
    """Words between spaces and punctuation, then the joined words whole; empty ones are left out."""
    split = F.split(text, SEPARATORS)
    return F.filter(F.concat(split, F.regexp_extract_all(text, F.lit(f"({JOINED})"), F.lit(1))), lambda w: w != "")


def term(word: Column) -> Column:
    """The index term of a word: lower case; null if all its joined parts are stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    parts = F.split(F.lower(word), r"[_\-./@:]")
    return F.when(~F.forall(parts, lambda p: F.array_contains(stop, p)), F.lower(word))


def word_term(word: Column) -> Column:
    """``term`` for a column of words: the same, but a plain set lookup for words without a joiner."""
    joined = word.rlike(r"[_\-./@:]")
    return F.when(joined, term(word)).when(~F.lower(word).isin(STOP_WORDS), F.lower(word))


def terms(text: Column) -> Column:
    """Index terms of a text, in order, with repeats."""
    return F.filter(F.transform(tokens(text), term), lambda t: t.isNotNull())


def meaningful_words(phrase: Column) -> Column:
    """Lower-case words (with `$`) that say something about the topic, in order, with repeats."""
    vague = F.array(*map(F.lit, VAGUE_WORDS))
    found = F.regexp_extract_all(F.lower(phrase), F.lit(r"([\p{L}\p{N}$]+)"), F.lit(1))
    return F.filter(found, lambda w: ~F.array_contains(vague, w))


def is_searchable(phrase: Column) -> Column:
    """Whether a phrase says enough to be searched for: two meaningful words."""
    return F.size(meaningful_words(phrase)) >= 2


def render_block(text: Column, list_level: Column, continued: Column) -> Column:
    """A paragraph as a line: bullets and indents for list items, numbers kept, continued items aligned."""
    level = F.coalesce(list_level, F.lit(0))
    indent = F.repeat(F.lit("  "), level - 1)
    return (
        F.when(level <= 0, text)
        .when(F.coalesce(continued, F.lit(False)), F.concat(indent, F.lit("  "), text))
        .when(text.rlike(LIST_NUMBER), F.concat(indent, text))
        .otherwise(F.concat(indent, F.lit("- "), text))
    )


def first_cut(text: Column, limit: int) -> Column:
    """Length of the first piece of a text over the limit: to the last sentence end, else space, else the limit."""
    window = F.substring(text, 1, limit + 1)
    sentence = F.length(F.regexp_extract(window, r"(?s)^(.+[.!?]) ", 1))
    space = F.length(F.regexp_extract(window, r"(?s)^(.+) ", 1))
    return F.when(sentence > 0, sentence).when(space > 0, space).otherwise(limit)


def split_long(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, without the white space at each cut; an empty text has none."""

    def cut(state: Column, _: Column) -> Column:
        rest = state["rest"]
        at = first_cut(rest, limit)
        return F.when(
            F.length(rest) > limit,
            F.struct(
                F.concat(state["pieces"], F.array(trim_end(F.substring(rest, F.lit(1), at)))).alias("pieces"),
                F.regexp_replace(F.substring(rest, at + 1, F.length(rest)), f"^[{SPACE}]+", "").alias("rest"),
            ),
        ).otherwise(state)

    # A cut may come early where a sentence or word ends early, but what follows it then has no such end, so any three
    # cuts in a row take at least ``limit`` characters.
    text = text.cast("string")
    steps = F.sequence(F.lit(1), 3 * (F.floor(F.length(text) / limit).cast("int") + 1))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("pieces"), text.alias("rest"))
    last = lambda rest: F.when(F.length(rest) > 0, F.array(rest)).otherwise(none)
    whole = F.aggregate(steps, start, cut, lambda s: F.concat(s["pieces"], last(s["rest"])))
    return F.when(F.length(text) <= limit, last(text)).otherwise(whole)


def body_text(pages: Column) -> Column:
    """The texts of a chunk's pages, each on its own line; a page without a text counts as empty."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def without_markers(text: Column) -> Column:
    """Without citation markers such as `[3]`."""
    return F.regexp_replace(text, r"\[\d+\]", "")


def short_path(path: Column) -> Column:
    """A section path without the common folder and the file ending."""
    return F.regexp_replace(path, r"^contents/handbook/|\.md\z", "")


def last_sentence_cut(body: Column) -> Column:
    """Where the last sentence of a text starts, not counting stops of abbreviations."""
    ends = F.regexp_extract_all(body, F.lit(r"(?s)(.*?(?:[.!?][" + SPACE + r"]+|\n+))"), F.lit(1))
    abbreviation = r"(?i)(?<![A-Za-z0-9_])(?:e\.g|i\.e|etc|vs|approx|U\.S|U\.K)\.[" + SPACE + r"]+\z"
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"))

    def step(s: Column, piece: Column) -> Column:
        at = (s["at"] + F.length(piece)).cast("int")
        return F.struct(at.alias("at"), F.when(piece.rlike(abbreviation), s["start"]).otherwise(at).alias("start"))

    return F.aggregate(ends, state, step)["start"]
