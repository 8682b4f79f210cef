"""Words and phrases in folded texts, and class codes by their shape: plain lists of text, tested in the JVM.

A phrase is looked for in a text's words, joined by single blanks, with one at either end. ``esito`` is found anywhere, `` esito``
only at the start of a word, `` esito `` only as a word. A phrase after ``^`` must begin the text, one after ``^^`` its first or
second word.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the characters of a shape are written: a letter, a digit, a dash that may have blanks around it or be left out, a dash that may be left out.
SHAPE = {"@": "[A-Z]", "#": "[0-9]", "-": r"(?:\s?-\s?)?", "~": "-?"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: also where the optimizer moves expressions into filters."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(folded: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), F.lit(" "))


def _is_said(text: Column, phrase: str) -> Column:
    stem = phrase.lstrip("^")
    if phrase.startswith("^^"):
        second = F.get(F.split(text, " "), F.lit(2))  # before the first is the blank
        return text.startswith(" " + stem) | F.coalesce(second.startswith(stem), F.lit(False))
    return text.startswith(" " + stem) if phrase.startswith("^") else text.contains(stem)


def says(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether words (:func:`words`) have one of the phrases."""
    return bound(text, lambda t: _says(t, phrases))


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (_is_said(text, p) for p in phrases))


def first_said(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default) -> Column:
    """The value of the first rule that has a phrase."""
    return bound(text, lambda t: F.coalesce(*(F.when(_says(t, phrases), value) for value, phrases in rules), F.lit(default)))


def shaped(shapes: tuple[str, ...]) -> str:
    """A pattern that finds a code of one of the shapes that is no part of a longer word or number."""
    forms = "|".join("".join(SHAPE.get(c, c) for c in shape) for shape in shapes)
    return rf"(?<![\p{{L}}\d])({forms})(?![\p{{L}}\d])"
