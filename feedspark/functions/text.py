"""Text: markup stripping, escapes, entities, keys for search and pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.binding import let
from feedspark.model import nonempty, nonempty_list, present, trimmed

# The entities XML itself defines.
_XML_ENTITIES = ("amp", "lt", "gt", "quot", "apos")
_NAMED = r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;"


def strip_html(value: Column) -> Column:
    """Tags become spaces, whitespace collapses, blank becomes absent."""
    plain = F.regexp_replace(value, r"<[^>]*>", " ")
    return present(collapse(plain))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)[\s\x{FEFF}]+", " "))


def truncate(value: Column, limit: int) -> Column:
    """Collapse whitespace and cut to ``limit - 1`` characters plus an ellipsis."""
    cut = lambda s: F.concat(F.substring(s, 1, limit - 1), F.lit("..."))
    return let(collapse(value), lambda s: F.when(F.length(s) > limit, cut(s)).otherwise(s))


def escape_text(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def escape_attr(value: Column) -> Column:
    return F.replace(escape_text(value), F.lit('"'), F.lit("&quot;"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode_named(names: pd.Series) -> pd.Series:
    return names.map(lambda listed: [html.unescape(n) for n in listed], na_action="ignore")


# Not merged into later expressions, so that a body is put together once.
_decode_named = _decode_named.asNondeterministic()


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_decode_all = F.pandas_udf(_unescaped, T.StringType())


# Not merged into later expressions, so that its result can be used inside a lambda.
_decode_apart = F.pandas_udf(_unescaped, T.StringType()).asNondeterministic()


def decode_apart(markup: Column) -> Column:
    """``decode_text`` for a column that later steps use inside higher-order functions."""
    return F.coalesce(_decode_apart(F.when(F.contains(markup, F.lit("&")), markup)), markup)


def decode_text(markup: Column) -> Column:
    """Decode every HTML entity of a text; rows without one stay out of Python."""
    return F.coalesce(_decode_all(F.when(F.contains(markup, F.lit("&")), markup)), markup)


def decode_entities(body: Column) -> Column:
    """Decode named HTML entities other than the five of XML, ahead of XML parsing.

    Only the distinct names of a body are looked up in Python; the body stays behind.
    """
    names = F.when(body.rlike(_NAMED), F.array_distinct(F.regexp_extract_all(body, F.lit(f"({_NAMED})"), F.lit(1))))

    def piece(text: Column, meanings: Column) -> Column:
        name = F.regexp_extract(text, f"^{_NAMED}", 0)
        return F.when(name == "", text).otherwise(F.concat(F.element_at(meanings, name), F.substr(text, F.length(name) + 1)))

    pieces = F.split(body, "(?=&)")
    decoded = let(
        F.map_from_arrays(names, _decode_named(names)), lambda m: F.array_join(F.transform(pieces, lambda t: piece(t, m)), "")
    )
    return F.coalesce(decoded, body)


def cell_encode(value: Column) -> Column:
    """Escape a cell of the compact line format."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\t"), F.lit("\\t"))
    out = F.replace(out, F.lit("\r"), F.lit("\\r"))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def cell_decode(value: Column) -> Column:
    """Undo ``cell_encode`` in one left-to-right pass.

    Doubled backslashes are set aside first, so that they cannot pair with the letter
    behind them; the placeholder is a private-use character that is itself protected.
    """
    mark = "\ue000"
    hold = F.replace(value, F.lit(mark), F.lit(mark + "p"))
    hold = F.replace(hold, F.lit("\\\\"), F.lit(mark + "b"))
    hold = F.replace(hold, F.lit("\\t"), F.lit("\t"))
    hold = F.replace(hold, F.lit("\\r"), F.lit("\r"))
    hold = F.replace(hold, F.lit("\\n"), F.lit("\n"))
    hold = F.regexp_replace(hold, r"\\(.)", "$1")
    hold = F.replace(hold, F.lit(mark + "b"), F.lit("\\"))
    out = F.replace(hold, F.lit(mark + "p"), F.lit(mark))
    return F.when(F.contains(value, F.lit("\\")), out).otherwise(value)


def haystack(
    title: Column, summary: Column, source_name: Column, tags: Column, author_names: Column
) -> Column:
    """Lower-cased text a search is matched against."""
    rest = F.concat(
        F.coalesce(tags, F.array().cast("array<string>")),
        F.coalesce(author_names, F.array().cast("array<string>")),
    )
    head = F.array(title, F.coalesce(summary, F.lit("")), source_name)
    return F.lower(F.array_join(F.concat(head, rest), " "))


def slug(name: Column, ordinal: Column) -> Column:
    """File stem of a mesh; ``ordinal`` counts from zero."""
    dashed = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.coalesce(
        nonempty(trimmed), F.concat(F.lit("mesh-"), (ordinal + 1).cast("string"))
    )


def keywords(text: Column) -> Column:
    """Comma text to a list of trimmed, non-blank words; absent when none is left."""
    words = F.filter(F.transform(F.split(text, ","), trimmed), lambda w: w != "")
    return let(words, nonempty_list)


def json_string(value: Column) -> Column:
    """A JSON string literal of plain text."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))
