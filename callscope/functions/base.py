"""Small helpers shared by the column functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Catalyst does not hoist an expression out of a lambda, so ``lower(text)`` written
    inside one would run once per array element.
    """
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the text; false for null text."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def first_contained(text: Column, mapping: Mapping[str, str]) -> Column:
    """Value of the first key, in mapping order, that occurs in the text; else null."""
    return F.coalesce(*[F.when(text.contains(key), F.lit(value)) for key, value in mapping.items()], F.lit(None).cast("string"))


def lookup(value: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Exact-match mapping with a default, also for null."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(default))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks.

    The look-behind lets a run of blanks be tried once, from its start: without it a long
    run inside a text takes quadratic time.
    """
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Null for empty text. ``nullif`` would evaluate a long expression twice inside a lambda."""
    return let(text, lambda t: F.when(t != "", t))


def constant(value: object, kind: str) -> Column:
    """A nested constant as one literal. Catalyst folds the parse away when it plans, and the
    driver sends one text instead of a call per element."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def literal_array(values: Iterable[float]) -> Column:
    return constant([float(value) for value in values], "array<double>")
