"""Text expressions: cleaning, word splitting, tag removal, answer normalisation."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let

# The whitespace set used to split a context into words.
WORD_SPACE = " \\t\\r\\n\\u202F"
WORD_PATTERN = f"[^{WORD_SPACE}]+"

# What Python's str.strip and str.split treat as whitespace.
ANY_SPACE = "[\\s\\x1C-\\x1F\\x85\\p{Z}]"

# Markup removed from HTML contexts, in this order.
HTML_LITERALS = [
    "<!DOCTYPE html>",
    "<html>",
    "</html>",
    "<meta>",
    "<head>",
    "</head>",
    "<body>",
    "</body>",
    "<label>",
    "</label>",
    "<div>",
    "</div>",
    "<a>",
    "</a>",
    "<span>",
    "</span>",
    "<link>",
    "<img>",
    "<sup>",
    "</sup>",
    "<input>",
    "<noscript></noscript>",
    "<p>",
    "</p>",
    "<cite>",
    "</cite>",
    "<tbody>",
    "</tbody>",
    "</br>",
    "<br/>",
    "<h1>",
    "</h1>",
    "<h2>",
    "</h2>",
    "<h3>",
    "</h3>",
    "<form>",
    "</form>",
    "<small>",
    "</small>",
    "<big>",
    "</big>",
    "<b>",
    "</b>",
    "<abbr>",
    "</abbr>",
    "[편집]",
]

# Characters that answer normalisation turns into a space.
QUOTES_AND_BRACKETS = "'\"《》<>〈〉()‘’"


def strip_unicode(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only knows spaces)."""
    head = F.regexp_replace(text, f"^{ANY_SPACE}+", "")
    return F.regexp_replace(head, f"{ANY_SPACE}+\\z", "")


def clean_lines(text: Column) -> Column:
    """The stripped, non-empty lines of a text. Blank lines do not separate anything."""
    lines = F.transform(F.split(text, "\\r\\n|\\r|\\n"), strip_unicode)
    return F.filter(lines, lambda x: x != "")


def words(text: Column) -> Column:
    """Whitespace words of a context."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def word_at(text: Column, char_index: Column) -> Column:
    """Index of the word that holds, or last started before, the character at
    ``char_index`` (0-based code point); -1 inside leading whitespace."""
    head = F.substring(text, F.lit(1), char_index + 1)
    return F.size(words(head)) - 1


def byte_to_char(text: Column, byte_offset: Column) -> Column:
    """UTF-8 byte offset to code-point offset."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset.cast("int"))
    return F.length(F.decode(head, "UTF-8"))


def strip_tags(text: Column) -> Column:
    """Remove bare markup from an HTML context.

    Titles go, table attributes are shortened, a fixed list of literal tags is
    removed one after the other (a removal may create the next tag, so one
    alternation would not be the same), then spaces and newlines are squeezed.
    Tags with attributes and table or list tags stay.
    """
    out = F.regexp_replace(text, "<title>[^\\n]*?</title>", " ")
    out = F.replace(out, F.lit('rowspan="'), F.lit("r"))
    out = F.replace(out, F.lit('colspan="'), F.lit("c"))
    for literal in HTML_LITERALS:
        out = F.replace(out, F.lit(literal), F.lit(""))
    out = F.regexp_replace(out, " +", " ")
    return F.regexp_replace(out, "\\n+", "\n")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Numeric and named (HTML 4) character references to characters."""
    named = F.create_map(
        *[F.lit(x) for name, cp in sorted(html.entities.name2codepoint.items()) for x in (name, chr(cp))]
    )

    def decode(piece: Column) -> Column:
        body = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);?", 1)
        number = F.when(
            F.lower(F.substring(body, 1, 2)) == "#x", F.conv(F.substring(body, 3, 10), 16, 10).cast("bigint")
        ).when(F.substring(body, 1, 1) == "#", F.substring(body, 2, 10).cast("bigint"))
        char = F.when(number.isNotNull() & (number < 1114112), _code_point(number)).otherwise(
            F.element_at(named, body)
        )
        rest = F.regexp_replace(piece, "^(#?[a-zA-Z0-9]+);?", "")
        return F.when((body == "") | char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    pieces = F.split(text, "&")
    decoded = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, 1 << 30), decode), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_text(text: Column) -> Column:
    """Visible text of an HTML fragment."""
    out = F.regexp_replace(text, "(?is)<!--.*?-->|<(script|style|template)\\b[^>]*>.*?</\\1\\s*>", "")
    out = F.regexp_replace(out, "<[/!?a-zA-Z][^>]*>", "")
    return decode_entities(out)


def normalise_answer(text: Column) -> Column:
    """Answer text for scoring: visible text, no quotes or brackets, lower case,
    no ASCII punctuation, no whitespace at all."""
    out = F.translate(html_text(text), QUOTES_AND_BRACKETS, " " * len(QUOTES_AND_BRACKETS))
    out = F.regexp_replace(F.lower(out), "[!-/:-@\\[-`{-~]", "")
    return F.regexp_replace(out, f"{ANY_SPACE}+", "")


def characters(text: Column) -> Column:
    """The code points of a text as an array; empty for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_f1(prediction: Column, truth: Column) -> Column:
    """F1 of two texts as multisets of characters, after normalisation by the caller.
    No common character gives 0, also when both are empty."""

    def count(xs, c):
        return F.size(F.filter(xs, lambda x: x == c))

    def same(p: Column, t: Column) -> Column:
        return F.aggregate(
            F.array_intersect(p, t), F.lit(0), lambda acc, c: acc + F.least(count(p, c), count(t, c))
        )

    common = let(characters(prediction), lambda p: let(characters(truth), lambda t: same(p, t)))
    lengths = F.length(prediction) + F.length(truth)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(F.lit(2.0) * common / lengths)
