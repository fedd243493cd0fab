"""Operator 7: secrets found by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5

_LEX = re.compile(
    r"""
      (?P<string>(?:\"\"\"(?:[^\\]|\\.)*?\"\"\")|(?:'''(?:[^\\]|\\.)*?''')|"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|(?<!\w)`(?:[^`\\\n]|\\.)*`)
    | (?P<name>[^\W\d]\w*(?:(?:\.|->|::|-)[^\W\d]\w*)*)
    | (?P<assign>:=|=>|\+=|=(?!=)|:(?!:|//))
    | (?P<other>==|!=|<=|>=|[-+(),;{}\[\].]|\n)
    | (?P<raw>[^\s"'`=:,;(){}\[\]]+)
    """,
    re.X | re.S,
)

_SENSITIVE = [
    (re.compile(r"pass(?:word|wd|phrase|code)?$|pwd|passw|kennwort|contrasena|mot_de_passe"), 0.7),
    (re.compile(r"(?:api|access|secret|private|auth|encryption|signing|account|shared|client)_?key|apikey|key_secret"), 0.7),
    (re.compile(r"secret|token|credential|bearer|jwt"), 0.6),
    (re.compile(r"auth(?!or)|session_?id|cookie|salt|connection_?string|dsn|webhook|signature"), 0.4),
    (re.compile(r"(?:^|_)(?:key|cert|pin)$"), 0.3),
]
#: Names of what is about secrets but isn't one.
_HARMLESS = re.compile(r"(?:_|^)(?:name|field|url|uri|path|file|type|count|length|len|size|limit|max|min|ttl|expiry|expires|header|id|label|hint|policy|regex|pattern|prompt)$|public|placeholder|tokeniz")
_KNOWN = re.compile(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_\w{30,}$|^sk-[\w-]{20,}$|^(?:sk|pk|rk)_(?:live|test)_\w{16,}$|^xox[abpr]-[\w-]{10,}$|^AIza[\w-]{30,}$|^eyJ[\w-]+\.[\w-]+\.[\w-]*$|-----BEGIN [A-Z ]*PRIVATE KEY")
_BLANK = re.compile(r"^(?:x+|\*+|\.+|<[^>]*>|\$\{[^}]*\}|\{\{[^}]*\}\}|%\([^)]*\)s|(?:your|my|the|some|change|insert|replace|example|sample|dummy|test|fake|todo|none|null|true|false|undefined|redacted|foo|bar|baz)(?:$|[\W_]|me).*)$", re.I)


@dataclass
class Pair:
    """A literal that a name gets: by itself, or through the constant named ``via``."""

    name: str
    literal: str
    at: int
    via: str = ""


def _unquote(s: str) -> str:
    n = 3 if s[:3] in ('"""', "'''") and len(s) >= 6 else 1
    return re.sub(r"\\(.)", r"\1", s[n:-n])


def lex(text: str) -> Iterator[tuple[str, str, int]]:
    for m in _LEX.finditer(text):
        yield m.lastgroup or "", m.group(), m.start()


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs of a text in source or configuration syntax.

    Targets: ``name = value``, ``name: value``, ``"name": value``, ``name := value``, ``name => value``,
    ``name: Type = value`` and ``name=value`` arguments.  Values: literals, bare words of configuration
    files, names of earlier constants (also inside ``${...}``), and their sums with ``+`` or side by side.  Comments
    are read like code: what is commented out has leaked too.
    """
    tokens = list(lex(text))
    constants: dict[str, tuple[str, str]] = {}
    out: list[Pair] = []
    i, n = 0, len(tokens)
    while i < n:
        kind, value, at = tokens[i]
        if kind not in ("name", "string") or i + 1 >= n:
            i += 1
            continue
        j = i + 1
        if tokens[j][1] == "]" and j + 1 < n:  # environ["name"] = value
            j += 1
        if tokens[j][0] != "assign":
            i += 1
            continue
        name = _unquote(value) if kind == "string" else value
        if not name or len(name) > 100 or "\n" in name:
            i += 1
            continue
        op = tokens[j][1]
        j += 1
        # name: Type = value
        if op == ":" and j + 1 < n and tokens[j][0] == "name" and tokens[j + 1][1] == "=":
            j += 2
        parts: list[str] = []
        via, literal = "", False
        while j < n:
            k, v, pos = tokens[j]
            if k == "string":
                s = _unquote(v)
                for ref in re.findall(r"\$\{(\w+)\}|\{(\w+)\}", s):
                    known = constants.get(ref[0] or ref[1])
                    if known:
                        s = s.replace("${" + (ref[0] or ref[1]) + "}", known[0]).replace("{" + (ref[0] or ref[1]) + "}", known[0])
                        via = via or known[1] or ref[0] or ref[1]
                parts.append(s)
                literal = True
            elif k == "name" and v in constants and (j + 1 >= n or tokens[j + 1][1] not in ("=", ":", "(", "=>")):
                parts.append(constants[v][0])
                via = via or constants[v][1] or v
                literal = True
            elif k in ("name", "raw") and not parts and re.fullmatch(r"[^\W\d]{1,3}|b|f|r|u", v) and j + 1 < n and tokens[j + 1][0] == "string" and tokens[j + 1][2] == pos + len(v):
                pass  # a string's prefix
            elif k in ("name", "raw") and not parts:
                # a bare value runs to the next space
                end = pos
                while end < len(text) and not text[end].isspace() and text[end] not in ",;\"'`)}]":
                    end += 1
                if end < len(text) and text[end] == "(" or "(" in text[pos:end]:
                    j += 1
                    break
                parts.append(text[pos:end])
                while j + 1 < n and tokens[j + 1][2] < end:
                    j += 1
                literal = True
                j += 1
                break
            else:
                break
            j += 1
            if j < n and tokens[j][1] == "+":
                j += 1
            elif not (j < n and tokens[j][0] == "string"):
                break
        if literal:
            joined = "".join(parts)
            constants[name] = (joined, via)
            constants[name.rsplit(".", 1)[-1]] = (joined, via)
            out.append(Pair(name, joined, at, via))
        i = max(j, i + 1) if literal else i + 1
    return out


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in (s.count(x) for x in set(s))) if s else 0.0


def score(name: str, literal: str) -> float:
    """0 to 1: how much a literal under this name looks like a secret; names weigh most."""
    if len(literal) < 6 or _BLANK.match(literal):
        return 0.0
    if _KNOWN.search(literal):
        return 1.0
    key = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_").replace(" ", "_")
    base = max([w for p, w in _SENSITIVE if p.search(key)], default=0.0)
    if _HARMLESS.search(key):
        base *= 0.3
    if not base:
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    worth = 0.5 * min(entropy(literal) / 3.5, 1) + 0.3 * min(len(literal) / 20, 1) + 0.2 * min(kinds / 2, 1)
    if re.search(r"\s", literal.strip()) or kinds == 1 and literal.isalpha() and base < 0.7:
        worth *= 0.5
    return round(min(1.0, base * 0.6 + worth * (0.25 + 0.5 * base)), 4)


def scan(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Secrets in assignments: (doc_id, line, position, name, via, score, literal_sha256, literal_length, masked).

    Each text is lexed as source or configuration and parsed into name-literal pairs; constants are
    propagated to later names, so that ``a = "..."; password = a`` is found under ``password``; literals
    are scored by their target's name and by their own look, placeholders not at all.  A row for each
    pair that scores ``min_score`` or more; the literal itself isn't carried but by hash, length and its
    first four characters.  ``line`` counts from 1, ``position`` is the character of the name from 0.

    Null and empty texts have none; null ids stay null; repeated rows and repeated assignments give a
    row each; no rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "line", "position", "name", "via", "score", "literal_sha256", "literal_length", "masked"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for p in pairs(text):
                    s = score(p.name, p.literal)
                    if s >= min_score:
                        line = text.count("\n", 0, p.at) + 1
                        rows.append((doc, line, p.at, p.name, p.via or None, s, hashlib.sha256(p.literal.encode("utf-8", "replace")).hexdigest(), len(p.literal), p.literal[:4] + "..."))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    # every assignment sign of the lexer holds one of these: a text without them has no pair, and stays in the JVM
    maybe = docs.where(F.col("text").contains("=") | F.col("text").contains(":"))
    schema = "doc_id long, line long, position long, name string, via string, score double, literal_sha256 string, literal_length long, masked string"
    return maybe.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
