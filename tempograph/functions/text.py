"""Scalar functions over text, as Column expressions; UDFs only for what they can't express."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_key(x: Column | str) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " ")))


def fuzzy_form(x: Column | str) -> Column:
    """normalize_key with all but a-z, 0-9, ' and space made spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_key(x), "[^a-z0-9' ]+", " "), " +", " "))


def runs(x: Column | str) -> Column:
    """Letters, digits and _ in runs, as they are."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(f"({TOKEN})"), 1)


def tokens(x: Column | str) -> Column:
    """Letters, digits and _ in runs, lower-cased after the cut."""
    return F.transform(runs(x), F.lower)


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order."""
    import regex

    return list(dict.fromkeys(t.lower() for t in regex.findall(TOKEN, query or "")))


def indexed_text(table: str) -> Column:
    """The text that full-text search sees of a row."""
    fields = {"entity": ["name", "summary", "group_id"], "entity_edge": ["name", "fact", "group_id"], "episodic": ["content", "source", "source_description", "group_id"], "community": ["name", "group_id"]}[table]
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def lucene_escape(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r'([+\-&|!(){}\[\]^"~*?:\\/ORNTAD])', r"\\$1")


def shingles(x: Column | str) -> Column:
    """Distinct 3-character shingles without spaces: one character is its own shingle, two have none."""
    s = F.regexp_replace(_c(x), " ", "")
    n = F.length(s)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3))))
    return F.when(n >= 3, many).when(n == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets: both empty is 1, one empty 0."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def entropy(x: Column | str) -> Column:
    """Shannon entropy of the characters, spaces left out, in bits."""
    chars = F.filter(F.split(F.regexp_replace(_c(x), " ", ""), ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def high_entropy(x: Column | str) -> Column:
    """Gate of fuzzy matching: short single words are out, and names of under 1.5 bits."""
    f = fuzzy_form(x)
    short = (F.length(f) < 6) & (F.size(F.filter(F.split(f, " "), lambda t: t != "")) < 2)
    return ~short & (entropy(f) >= 1.5)


def token_count(x: Column | str) -> Column:
    """Four characters a token."""
    return F.floor(F.length(_c(x)) / 4)


def one_line(x: Column | str) -> Column:
    return F.translate(_c(x), "\n\r", "  ")


def clean_prompt(x: Column | str) -> Column:
    """Without zero-width and control characters but newline, return and tab."""
    return F.regexp_replace(_c(x), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the JSON of the columns: the key of a response cache."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def format_time(x: Column | str) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss")


def truncate_sentences(text: str | None, most: int) -> str | None:
    """At most ``most`` characters, cut after the last sentence end in them; without one, after the characters.  Negative: from the end."""
    if text is None:
        return None
    if most < 0:
        most = max(0, len(text) + most)
    if len(text) <= most:
        return text
    head = text[:most]
    ends = [m.end() for m in re.finditer(r"[.!?](?:\s|$)", head)]
    return head[: ends[-1]].rstrip() if ends else head.rstrip()


def describe_type(text: str | None) -> str:
    """First paragraph, at most three sentences."""
    first = re.split(r"\n\s*\n", (text or "").strip())[0]
    return " ".join(re.split(r"(?<=[.!?])\s+", " ".join(first.split()))[:3])


_ISO = re.compile(r"\d{4}(?:-?\d{2}-?\d{2}|-?W\d{2}-?\d|-\d{2})?(?:T\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?")


def parse_iso(text: str | None) -> datetime | None:
    """Strict ISO-8601, calendar or week dates, to UTC without zone; none for anything else, white space around included."""
    if not text or not _ISO.fullmatch(text):
        return None
    try:
        d = datetime.fromisoformat(text)
    except ValueError:
        return None
    return d.astimezone(UTC).replace(tzinfo=None) if d.tzinfo else d


@F.pandas_udf(T.TimestampNTZType())
def iso_timestamp(s: pd.Series) -> pd.Series:
    return pd.Series([parse_iso(x) for x in s], dtype="datetime64[us]")


@F.pandas_udf(T.IntegerType())
def json_keys(s: pd.Series) -> pd.Series:
    """Keys of a JSON text to depth 2; 0 if it isn't JSON."""

    def count(x: object, depth: int) -> int:
        if depth == 0:
            return 0
        if isinstance(x, dict):
            return len(x) + sum(count(v, depth - 1) for v in x.values())
        return sum(count(v, depth) for v in x) if isinstance(x, list) else 0

    def one(x: str | None) -> int:
        try:
            return count(json.loads(x), 2) if x else 0
        except ValueError:
            return 0

    return s.map(one)


def join_episodes(contents: list[tuple[str, str]]) -> str:
    """(time, content) of episodes under headers; a single one is verbatim."""
    if len(contents) == 1:
        return contents[0][1]
    return "\n\n".join(f"[Episode {i}] (timestamp: {t})\n{c}" for i, (t, c) in enumerate(contents))
