"""URI and QID expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public host names that stand for the canonical host of the same dataset.
DOMAIN_ALIASES = {"edh.ub.uni-heidelberg.de": "edh-www.adw.uni-heidelberg.de"}

# Fragments that only say "the thing itself".
IDENTITY_FRAGMENTS = ("this", "self", "it")


def canonical_uri(uri: Column | str) -> Column:
    """One spelling for every way a URI is written; null for what is no URI.

    Scheme, ``www.``, the host's letter case, an encoded or plain identity fragment and closing slashes make no difference; known
    host aliases are replaced.  The path keeps its case.  The result carries no scheme: ``host/path``.
    """
    u = F.trim(F.col(uri) if isinstance(uri, str) else uri)
    rest = F.regexp_replace(F.replace(u, F.lit("%23"), F.lit("#")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, rf"(?i)/*(#({'|'.join(IDENTITY_FRAGMENTS)}))?/*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/#?]*)", 1)), r"^www\.", "")
    for alias, name in DOMAIN_ALIASES.items():
        host = F.when(host == alias, F.lit(name)).otherwise(host)
    path = F.regexp_replace(rest, r"^[^/#?]*", "")
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/#?]"), F.concat(host, path))


def qids(text: Column | str) -> Column:
    """Every QID in the text as ``Q<number>``, however it is wrapped; an empty array if there is none."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?<![\p{L}\p{N}])[Qq]0*([1-9][0-9]*)(?![\p{L}\p{N}])"), F.lit(1))
    return F.transform(found, lambda n: F.concat(F.lit("Q"), n))


def json_uris(text: Column | str) -> Column:
    """All strings of a JSON object whose values are a string or a list of strings; an empty array for null or broken JSON."""
    t = F.col(text) if isinstance(text, str) else text
    values = F.map_values(F.from_json(t, "map<string,string>"))
    lists = F.transform(values, lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.filter(lists, lambda a: a.isNotNull())), empty)


def map_uris(column: Column | str) -> Column:
    """All strings of a ``MAP<STRING, ARRAY<STRING>>``; an empty array for null."""
    c = F.col(column) if isinstance(column, str) else column
    empty = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.filter(F.map_values(c), lambda a: a.isNotNull())), empty)
