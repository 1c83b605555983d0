"""Series names: canonical text, tags, and projections of tags, as column expressions.

A name is ``metric tag=value …`` with at least one tag. Its canonical text has single spaces and tags in
the order of their keys; a backslash before a space keeps it within a word and stays in the text.

Defined cases: null for null names and for bad ones: no tag, a word that isn't tag=value, a key twice,
more than ``MAX_TAGS`` tags, more than ``MAX_BYTES`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS, MAX_BYTES = 32, 4096
_SPACES = r"(?<!\\) +"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in a body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(name: Column) -> Column:
    # a space that ends the text is stripped unless it is escaped
    trimmed = F.when(F.endswith(name, F.lit(" ")), F.regexp_replace(F.ltrim(name), r"(?<!\\) +$", "")).otherwise(F.ltrim(name))
    return F.split(trimmed, _SPACES)


def _entry(word: Column) -> Column:
    key = F.substring_index(word, "=", 1)
    return F.struct(key.alias("key"), F.substring(word, F.length(key) + 2, F.length(word)).alias("value"))


def _parsed(name: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(metric, entries)`` of a good name, with the keys and values in order of the keys. A name is split once."""

    def of_words(words: Column) -> Column:
        metric, n = F.get(words, F.lit(0)), F.size(words) - 1
        entries = F.array_sort(F.transform(F.slice(words, F.lit(2), F.greatest(n, F.lit(0))), _entry))

        def of_entries(e: Column) -> Column:
            # without a '=' a word's value is empty
            whole = F.forall(e, lambda x: (x["key"] != "") & (x["value"] != ""))
            once = F.size(F.array_distinct(e["key"])) == n
            return F.when((metric != "") & ~F.contains(metric, F.lit("=")) & whole & once, body(metric, e))

        return F.when((n > 0) & (n <= MAX_TAGS), let(entries, of_entries))

    return F.when(F.octet_length(name) <= MAX_BYTES, let(_words(name), of_words))


def _text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def metric_of(name: Column) -> Column:
    return _parsed(name, lambda metric, _: metric)


def tags_of(name: Column) -> Column:
    """Map of a name's tags."""
    return _parsed(name, lambda _, e: F.map_from_entries(e))


def parts_of(name: Column) -> Column:
    """metric and tags of a name as a struct; null for a bad name."""
    return _parsed(name, lambda metric, e: F.struct(metric.alias("metric"), F.map_from_entries(e).alias("tags")))


def canonical(name: Column) -> Column:
    """Canonical text of a name as clients send it."""
    return _parsed(name, lambda metric, e: F.concat(metric, F.lit(" "), _text(e)))


def tag_text(tags: Column) -> Column:
    """Canonical text of a map of tags; empty for an empty map."""
    return _text(F.array_sort(F.map_entries(tags)))


def keep_tags(tags: Column, keys: Iterable[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(list(keys)))


def drop_tags(tags: Column, keys: Iterable[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(list(keys)))


def has_tags(tags: Column, keys: Iterable[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.map_contains_key(tags, k)
    return out
