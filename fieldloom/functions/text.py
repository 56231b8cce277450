"""String functions for names, warnings and comparisons."""

from __future__ import annotations

import unicodedata
from string import ascii_letters
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when text is stripped or split.
# Spark's own trim removes U+0020 only, so the set is passed explicitly.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def char_class(chars) -> str:
    """A regex class for ``chars``, written as ranges so a test stays cheap."""
    points = {ord(c) for c in chars}
    starts = sorted(p for p in points if p - 1 not in points)
    ends = sorted(p for p in points if p + 1 not in points)
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


_WS_CLASS = char_class(WHITESPACE)

# German letters spelled out before accents are dropped.
GERMAN_SPELLINGS = {
    "ä": "ae",
    "ö": "oe",
    "ü": "ue",
    "ß": "ss",
    "Ä": "Ae",
    "Ö": "Oe",
    "Ü": "Ue",
}

MISSING_SEGMENT = "Unknown"


def ustrip(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True when a string holds anything but white space; never null."""
    return F.coalesce(ustrip(text) != "", F.lit(False))


def visible_length(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.translate(text, WHITESPACE, ""))


def squeeze(text: Column, glue: str = " ") -> Column:
    """Strip, then replace each run of white space by ``glue``."""
    return F.regexp_replace(ustrip(text), _WS_CLASS + "+", glue)


def spell_german(text: Column) -> Column:
    for letter, spelling in GERMAN_SPELLINGS.items():
        text = F.replace(text, F.lit(letter), F.lit(spelling))
    return text


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """ASCII forms of all code points, split by how long the form is.

    Compatibility decomposition works per code point and canonical reordering
    only moves combining marks, which are dropped anyway, so folding a string
    is the same as folding its characters one by one.
    """
    sources, targets, longer = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        char = chr(cp)
        form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(form) == 1:
            sources.append(char)
            targets.append(form)
        elif form:
            longer[char] = form
    return "".join(sources), "".join(targets), longer


def _ascii_forms(text: Column, also: str = "", becomes: str = "") -> Column:
    """Every character with an ASCII form replaced by it; others kept.

    Characters with a one-letter form go through ``translate``, together with
    the characters of ``also``; the few with a longer form (ligatures,
    fractions, unit signs) are replaced one distinct character at a time, on
    rows that hold one.
    """
    sources, targets, longer = _fold_tables()
    # One literal, folded to a constant map when the plan is optimised.
    listed = "\x01".join(f"{c}\x02{form}" for c, form in longer.items())
    lookup = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))
    wide = F.array_distinct(F.regexp_extract_all(text, F.lit(char_class(longer)), F.lit(0)))
    spelled = F.aggregate(wide, text, lambda done, c: F.replace(done, c, F.element_at(lookup, c)))
    widened = F.when(text.rlike(char_class(longer)), spelled).otherwise(text)
    kept = [(s, t) for s, t in zip(sources, targets) if s not in also]
    return F.translate(
        widened, also + "".join(s for s, _ in kept), becomes + "".join(t for _, t in kept)
    )


def ascii_fold(text: Column) -> Column:
    """Decompose (NFKD) and drop everything outside ASCII, all inside the JVM.

    Plain ASCII rows skip the work.
    """
    folded = F.regexp_replace(_ascii_forms(text), "[^\\x00-\\x7F]+", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), folded).otherwise(text)


def filename_segment(text: Column) -> Column:
    """A filename-safe segment; empty when nothing usable is left.

    White space becomes dashes character by character: runs of dashes collapse
    and outer dashes fall away in the end, so stripping and squeezing first
    would change nothing. Dropping what is not allowed drops non-ASCII too.
    """
    dashes = "-" * len(WHITESPACE)
    plain = F.translate(text, WHITESPACE, dashes)
    foreign = _ascii_forms(spell_german(text), WHITESPACE, dashes)
    spaced = F.when(text.rlike("[^\\x00-\\x7F]"), foreign).otherwise(plain)
    allowed = F.regexp_replace(spaced, "[^A-Za-z0-9_-]+", "")
    return F.btrim(F.regexp_replace(allowed, "--+", "-"), F.lit("-"))


def fold_for_match(text: Column) -> Column:
    """White space collapsed and case folded, for text equality."""
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """True when ``phrase`` occurs in ``text`` as whole words.

    The plain substring test runs first, so the per-row pattern is compiled
    only for rows that can match at all.
    """
    quoted = F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?U)(?<!\\w)\\Q"), quoted, F.lit("\\E(?!\\w)"))
    return F.when(F.contains(text, phrase), F.rlike(text, pattern)).otherwise(F.lit(False))


def bounded_echo(text: Column, limit: int, tail: str = "...") -> Column:
    """At most ``limit`` characters, marked when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(tail))).otherwise(
        text
    )


def quoted_echo(text: Column) -> Column:
    """A value in single quotes for a message; null shows as ``None``."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    plain = F.concat(F.lit("'"), body, F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    escaped = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    has_single, has_double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (
        F.when(text.isNull(), F.lit("None"))
        .when(has_single & ~has_double, double)
        .when(has_single, escaped)
        .otherwise(plain)
    )


FIELD_TEXT_LIMIT = 500


def too_long(text: Column) -> Column:
    return F.coalesce(F.length(text) > FIELD_TEXT_LIMIT, F.lit(False))


def bounded_value(text: Column) -> Column:
    """Null for text past the field limit."""
    return F.when(~too_long(text), text)


def bounded_warning(text: Column, field: str) -> Column:
    """The warning that goes with ``bounded_value``; null when within bounds."""
    return F.when(
        too_long(text),
        F.lit(
            f"{field}: XML value exceeds {FIELD_TEXT_LIMIT} characters; "
            "falling back to AI extraction"
        ),
    )


def strip_fence(response: Column) -> Column:
    """The inside of a markdown code fence that spans the whole response."""
    stripped = ustrip(response)
    fenced = stripped.startswith("```") & stripped.endswith("```") & (F.length(stripped) >= 6)
    inside = F.substring(stripped, F.lit(4), F.length(stripped) - 6)
    # Behind the opening marks may stand the name of a language.
    untagged = F.ltrim(F.ltrim(inside, F.lit(ascii_letters)), F.lit(" \t\n\r\f\x0b"))
    last = F.when(untagged.endswith("\n"), 1).otherwise(0)
    return F.when(fenced, F.left(untagged, F.length(untagged) - last)).otherwise(response)


# ---- file names -----------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; the root stays ``/``."""
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(head != "", head).when(path.startswith("/"), F.lit("/")).otherwise(head)


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension. A leading dot alone does not start an extension."""
    # Planned names go through this for every request, so no pattern is scanned.
    after = F.substring_index(name, ".", -1)
    ahead = F.length(name) - F.length(after) - 1
    dotted = ahead > 0
    stem = F.when(dotted, F.left(name, ahead)).otherwise(name)
    extension = F.when(dotted, F.concat(F.lit("."), after)).otherwise(F.lit(""))
    return stem, extension


def is_plain_filename(name: Column) -> Column:
    return (
        (name != "")
        & ~name.isin(".", "..")
        & ~F.contains(name, F.lit("/"))
        & ~F.contains(name, F.lit("\\"))
        & ~F.contains(name, F.lit("\x00"))
    )
