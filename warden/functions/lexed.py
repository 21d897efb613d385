"""Both lexers over one text column: built-in functions where they read a text as the full grammar does, Arrow for the others.

Only texts outside the common subset are sent to Python; the test for it may
send a text too many, never one too few.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexer, native_lex
from .text import lower_ascii

_OPS = r"[-+*/<>=~!@#%^&|`?]"
#: Block comments that can hold nothing else, wherever they stand.
_COMMENT = r"""/\*[ -~&&[^*/'"]]*\*/"""
#: Texts (without such comments) that the built-in form may read otherwise than the full grammar.
ODD = "|".join((
    r"\\", r"/\*", r"\$(?![0-9])", r"\$[0-9]+[A-Za-z_$.]",  # escapes, comments, dollar quotes
    r"[^\x09-\x0d\x20-\x7e]", r"[{}]", r"--[^\n]*\r",  # names beyond ASCII, no tokens, other line ends
    r"(?<![A-Za-z0-9_$])[eEbBxXnN]'", r"(?<![A-Za-z0-9_$])[uU]&['\"]", r"'\s++'", "(?i:uescape)",  # strings with a prefix, or going on
    r"(?<![A-Za-z0-9_$])[0-9]++(?:\.[0-9]*+)?[A-Za-z_]", r"[0-9]\.(?![0-9])", r"(?<![0-9])\.[0-9]", r"[0-9]\.[0-9]++\.", r"(?<![A-Za-z0-9_$])[A-Za-z_$][A-Za-z0-9_$]*+\.[0-9]", r"[0-9]{11}",  # numbers
    rf"(?<!{_OPS})(?!(?:<>|!=|<=|>=|--)(?!{_OPS})){_OPS}{{2}}", r"\.\.|:=",  # operators of several characters
    r"(?i:\b(?:do|copy|load|function|procedure)\b)", r"[A-Za-z0-9_$]{64}", r'"[^"]{64}',  # statements that keep their literals, long names
))
#: Texts that both read alike, seen by one run over their tokens; ``ODD`` is asked of the others only, for it looks for many things at each character.
PLAIN = r"\A(?:" + "|".join((
    r"[\x09-\x0d ]++", r"(?!(?i:do|copy|load|function|procedure|uescape)(?![A-Za-z0-9_$]))[A-Za-z_][A-Za-z0-9_]{0,62}+(?![A-Za-z0-9_$'])",
    r"[0-9]{1,10}+(?:\.[0-9]{1,10}+)?+(?![A-Za-z0-9_$.])", r"\$[0-9]{1,9}+(?![A-Za-z0-9_$.])", r"(?<![0-9])\.(?=[A-Za-z_\"])", r"[(),;\[\]]",
    r"'[ -~&&[^'\\]]*+(?:''[ -~&&[^'\\]]*+)*+'(?!\s*+')", r'"[ -~&&[^"\\]]{1,63}+"(?!")', rf"--(?!{_OPS})[ -~&&[^\\]]*+(?=\n|\z)", r"""/\*[ -~&&[^*/'"\\]]*+\*/""",
    rf"(?:<>|!=|<=|>=|[-+*/<>=~!@#%^|?])(?!{_OPS})", "::(?![:=])", ":(?![:=])",
)) + r")*+\z"
AMBIGUOUS = "statement reads differently with standard_conforming_strings on and off; its fingerprint is ambiguous"
UNREADABLE = "statement could not be tokenized for fingerprinting"
_TAUTOLOGIES = (" or '1'='1'", " or 1=1", " or 1 = 1", "' or '1'='1", '" or "1"="1"')


def _token(t: lexer.Token) -> str:
    """A token as ``native_lex`` knows it."""
    if t.kind in ("ident", "uident"):
        return '"' + t.text.replace('"', '""') + '"'
    if t.kind in ("str", "ustr", "bits", "hex"):
        return "'" + t.text.replace("'", "''") + "'"
    return "0" + t.text if t.kind == "num" and t.text.startswith(".") else t.text


def _read(text: str) -> dict:
    """Canonical text, SQLSTATE, and the tokens of every reading (null if there is none)."""
    tokens: list[str] | None = None
    for conforming in (True, False) if "\\" in text else (True,):
        try:
            found = [_token(t) for t in lexer.lex(text, conforming)]
        except lexer.LexError:
            continue
        if tokens is None:
            tokens = found
        elif tokens != found:
            tokens = [*tokens, ";", *found]
    canonical, state = lexer.canonical(text)
    return {"canonical": canonical, "sqlstate": state, "tokens": tokens}


def with_tokens(df: DataFrame, text_col: str = "query_text", need: Column | None = None, state: Column | None = None) -> DataFrame:
    """``df`` with _tokens (null: no reading), _canonical (null: refused) and canonical_sqlstate.

    ``need``: the rows whose text is read (without it all are); of those of
    ``state`` canonical_sqlstate is told, too. The others are null in all three.

    The Arrow function counts as not deterministic, so that no condition on what
    is made of its rows moves below it: a text would be read again for each.
    """
    c = F.col
    kind = pa.struct([("canonical", pa.string()), ("sqlstate", pa.string()), ("tokens", pa.list_(pa.string()))])
    read = lexer._arrow(_read, kind, "canonical string, sqlstate string, tokens array<string>").asNondeterministic()
    every = F.lit(True) if need is None else F.coalesce(need, F.lit(False))
    looked = every if state is None else every | F.coalesce(state, F.lit(False))
    out = df.withColumns({"_every": every, "_text": c(text_col) if need is None else F.when(looked, c(text_col))})
    out = out.withColumn("_plain", F.coalesce(c("_text").rlike(PLAIN), F.lit(True)))
    out = out.withColumn("_odd", ~c("_plain") & F.regexp_replace("_text", _COMMENT, " ").rlike(ODD))
    out = out.withColumn("_native", native_lex.tokens(F.when(~c("_odd") & (c("_every") | ~c("_plain")), c("_text"))))
    # a quote that is a token of its own opens nothing that ends; an empty name is none
    broken = F.when(~c("_plain"), F.exists("_native", lambda t: t.isin("'", '"', '""')))
    out = out.withColumns({"_odd": c("_odd") | F.coalesce(broken, F.lit(False)), "_written": native_lex.canonical(c("_native"), c("_native"))})
    out = out.withColumn("_read", read(F.when(c("_odd"), c("_text"))))
    either = lambda read, native: F.when(c("_odd"), c(read)).otherwise(c(native))
    return out.withColumns({"_tokens": either("_read.tokens", "_native"), "_canonical": either("_read.canonical", "_written"), "canonical_sqlstate": c("_read.sqlstate")}).drop("_every", "_text", "_plain", "_odd", "_native", "_written", "_read")


def refusal() -> Column:
    return F.when(F.col("canonical_sqlstate") == "0A000", AMBIGUOUS).when(F.col("canonical_sqlstate").isNotNull(), UNREADABLE)


def keyword_hit(c: Column, keywords: list[str], t: Column) -> Column:
    """``native_lex.keyword_hit``; by the raw text where there is no reading."""
    edge = lambda k: rf"(?<![A-Za-z0-9_])\Q{k}\E(?![A-Za-z0-9_])"
    raw = F.coalesce(*[F.when(lower_ascii(c).rlike(edge(k)), F.lit(k)) for k in keywords if k], F.lit(None).cast("string"))
    return F.when(native_lex.near_keyword(c, keywords), F.when(t.isNull(), raw).otherwise(native_lex.keyword_hit(c, keywords, t)))


def tautology(c: Column, t: Column) -> Column:
    """``native_lex.tautology``; by the raw text where there is no reading."""
    raw = reduce(lambda a, b: a | b, [F.contains(lower_ascii(c), F.lit(x)) for x in _TAUTOLOGIES])
    return native_lex.near_tautology(c) & F.when(t.isNull(), raw).otherwise(native_lex.tautology(c, t))
