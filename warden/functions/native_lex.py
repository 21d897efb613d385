"""The lexer as Column expressions, for the common subset (no nested comments, dollar tags or escape strings).

It is made of built-in functions (over arrays of tokens, so it runs beside
whole-stage code generation, not in it) and has a DuckDB twin, so queries over
it are checked row by row. ``lexer`` has the full grammar.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import KEYWORDS
from .text import be32, be64, let, lower_ascii

#: One alternation, understood alike by Java and RE2.
PATTERN = r"""--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|'(?:[^']|'')*'|"(?:[^"]|"")*"|\$[0-9]+|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_$]*|<>|!=|<=|>=|::|\s+|."""
DROPPED = r"^(\s+|--.*|/\*(?:.|\n)*)$"
#: The same for Java, a match for each token that stays (group 1, empty at the text's end): what is dropped is run over, and nothing recurs by the length of a literal.
TOKEN = r"""(?:\s++|--[^\n]*+|/\*[^*]*+\*++(?:[^*/][^*]*+\*++)*+/)*+('[^']*+(?:''[^']*+)*'|"[^"]*+(?:""[^"]*+)*"|\$[0-9]++|[0-9]++(?:\.[0-9]++)?|[A-Za-z_][A-Za-z0-9_$]*+|<>|!=|<=|>=|::|\z|.)"""
MAX_INT = 2147483647
DOMAIN = b"statement fingerprint v3 sha256\0"


def tokens(c: Column) -> Column:
    """Tokens as written, without blanks, comments and semicolons at the end."""
    raw = F.array_remove(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1)), "")
    last = lambda raw: F.coalesce(F.array_max(F.transform(raw, lambda t, i: F.when(t != ";", i + 1).otherwise(0))), F.lit(0))
    return let(raw, lambda raw: F.when(F.get(raw, F.size(raw) - 1) == ";", F.slice(raw, F.lit(1), last(raw))).otherwise(raw))


def kind(t: Column) -> Column:
    """keyword, ident, str, int, num, param or op."""
    return (
        F.when(t.startswith("'"), "str").when(t.startswith('"'), "ident").when(t.rlike(r"^\$[0-9]"), "param")
        .when(t.rlike("^[0-9]"), F.when(~t.contains(".") & (F.length(t) <= 10) & (t.try_cast("bigint") <= MAX_INT), "int").otherwise("num"))
        .when(t.rlike("^[A-Za-z_]"), F.when(lower_ascii(t).isin(sorted(KEYWORDS)), "keyword").otherwise("ident"))
        .otherwise("op")
    )


def _first(t: Column, *ranges: tuple[str, str]) -> Column:
    """Whether a token's first character is in a range: cheaper than a pattern, for it is asked of every token."""
    return reduce(lambda a, b: a | b, [F.ascii(t).between(ord(x), ord(y)) for x, y in ranges])


def _number(t: Column) -> Column:
    return _first(t, ("0", "9"))


def _word(t: Column) -> Column:
    return _first(t, ("A", "Z"), ("_", "_"), ("a", "z"))


def _literal(t: Column) -> Column:
    return t.startswith("'") | _number(t)


def written(t: Column) -> Column:
    """A token in canonical text; the branches are those of ``kind``, each looked at once. Words are ASCII: Spark's own case functions serve."""
    low = F.lower(t)
    is_int = ~t.contains(".") & (F.length(t) <= 10) & (t.try_cast("bigint") <= MAX_INT)
    return (
        F.when(_word(t), F.when(low.isin(sorted(KEYWORDS)), F.upper(t)).otherwise(F.concat(F.lit('"'), low, F.lit('"'))))
        .when(t.startswith("'"), "?str").when(_number(t), F.when(is_int, "?int").otherwise("?num")).when(t == "!=", "<>").otherwise(t)
    )


def canonical(c: Column, t: Column | None = None) -> Column:
    """Canonical text. ``t``, here and below: the tokens as a column of their own, so that they are made once for all uses."""
    return F.array_join(F.transform(tokens(c) if t is None else t, written), " ")


def words(c: Column, t: Column | None = None) -> Column:
    """Tokens joined by blanks, for word matching: names lower-cased and bare, literals as ``?``."""
    bare = lambda t: F.when(t.startswith('"'), F.regexp_replace(lower_ascii(F.substring(t, 2, 2147483647)), r'\s|"', "")).otherwise(lower_ascii(t))
    return F.concat(F.lit(" "), F.array_join(F.transform(tokens(c) if t is None else t, lambda x: F.when(_literal(x), "?").otherwise(bare(x))), " "), F.lit(" "))


def keyword_hit(c: Column, keywords: list[str], t: Column | None = None) -> Column:
    """The first configured keyword (of one or more words) that stands in the statement, else null.

    Only texts that contain one of a keyword's words at all are looked at by token.
    """
    return F.when(near_keyword(c, keywords), _first_hit(words(c, t), keywords))


def near_keyword(c: Column, keywords: list[str]) -> Column:
    """Whether a text holds a keyword's first word anywhere: no other text can hold the keyword."""
    return c.rlike("(?i)" + "|".join(re.escape(k.split()[0] if k.split() else k) for k in keywords)) if keywords else F.lit(False)


def near_tautology(c: Column) -> Column:
    """Whether a text holds the letters of ``or`` and a ``=`` anywhere: no other text can hold a tautology."""
    return c.contains("=") & c.rlike("[oO][rR]")


def _first_hit(w: Column, keywords: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(w, F.lit(f" {' '.join(k.split())} ")), F.lit(k)) for k in keywords], F.lit(None).cast("string"))


def tautology(c: Column, t: Column | None = None) -> Column:
    """Whether ``OR literal = literal`` with equal values stands in the statement."""
    t = tokens(c) if t is None else t
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "^'", ""), "'$", "")
    at = lambda i, k: F.get(t, i + k)
    places = F.when(F.size(t) >= 4, F.sequence(F.lit(0), F.size(t) - 4)).otherwise(F.array().cast("array<int>"))
    return near_tautology(c) & F.exists(places, lambda i: (lower_ascii(at(i, 0)) == "or") & _literal(at(i, 1)) & (at(i, 2) == "=") & _literal(at(i, 3)) & (plain(at(i, 1)) == plain(at(i, 3))))


def fingerprint(canonical_text: Column, system_identifier: Column, db_oid: Column, extension_oid: Column, relations: Column | None = None, items: Column | None = None, domain: bytes = DOMAIN) -> Column:
    """64 hex digits: the installation, the canonical text and, if there are any, the plan's dependencies.

    ``relations``: OIDs; ``items``: (cache_id, hash) structs; both are sorted and made distinct here.
    """
    parts = [F.lit(domain), F.lit(b"\0installation\0"), be64(system_identifier), be32(db_oid), be32(extension_oid), F.encode(canonical_text, "utf-8")]
    if relations is not None:
        rel = F.array_sort(F.array_distinct(relations))
        itm = F.array_sort(F.array_distinct(items)) if items is not None else F.array().cast("array<struct<cache_id:bigint,hash:bigint>>")
        hexed = lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0")
        tail = F.unhex(F.concat(hexed(F.size(rel)), F.array_join(F.transform(rel, hexed), ""), hexed(F.size(itm)), F.array_join(F.transform(itm, lambda x: F.concat(hexed(x["cache_id"]), hexed(x["hash"]))), "")))
        parts.append(F.when(F.size(rel) + F.size(itm) > 0, F.concat(F.lit(b"\0pg_plan_dependencies\0"), tail)).otherwise(F.lit(b"")))
    return F.sha2(F.concat(*parts), 256)
