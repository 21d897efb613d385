"""Text and address functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\r\x0b\x0c"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def statement_text(c: Column) -> Column:
    """The statement without blanks at its edges (only the six ASCII ones)."""
    return F.btrim(c, F.lit(BLANKS))


def utf8_prefix(c: Column, limit: int) -> Column:
    """The longest beginning of at most ``limit`` bytes that ends between characters."""
    raw = F.encode(c, "utf-8")
    cut = F.lit(max(0, limit - 3))
    for m in range(max(0, limit - 2), limit + 1):  # the byte after the cut may not continue a character
        cut = F.when(~F.hex(F.substring(raw, m + 1, 1)).between("80", "BF"), F.lit(m)).otherwise(cut)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(raw.substr(F.lit(1), cut), "utf-8"))


def utf8_cut(c: Column, limit: int) -> Column:
    """Whether ``utf8_prefix`` cuts anything off."""
    return F.octet_length(c) > limit


def split_list(c: Column) -> Column:
    """A comma-separated list without blanks and empty entries."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def ip_address(c: Column) -> Column:
    """Addresses by value, as ``settings.normal_ip`` writes them: zones cut off, IPv4-mapped ones as IPv4; null for what is none."""
    bare = lower_ascii(F.btrim(F.split_part(c, F.lit("%"), F.lit(1)), F.lit(BLANKS)))
    plain = rf"\A{_IPV4}\z"  # most are written so
    return F.when(c.rlike(plain), c).when(bare.rlike(plain), bare).when(bare.contains(":"), _ipv6(bare))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _ipv6(bare: Column) -> Column:
    """An address with colons: eight groups, the longest row of zero groups (two at least, the first of equals) shortened."""
    at = rf"^([0-9a-f:]*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
    none = F.array().cast("array<string>")

    def in_groups(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, at, k).try_cast("int")
        return F.when(text.rlike(at), F.concat(F.regexp_extract(text, at, 1), _hex(part(2) * 256 + part(3)), F.lit(":"), _hex(part(4) * 256 + part(5)))).otherwise(text)

    def expanded(halves: Column) -> Column:
        side = lambda k: F.coalesce(F.filter(F.split(F.get(halves, F.lit(k)), ":"), lambda x, i: (x != "") | (F.get(halves, F.lit(k)) != "")), none)
        return let(F.struct(side(0).alias("l"), side(1).alias("r"), F.size(halves).alias("n")), filled)

    def filled(x: Column) -> Column:
        missing = 8 - F.size(x["l"]) - F.size(x["r"])
        fits = ((x["n"] == 1) & (missing == 0)) | ((x["n"] == 2) & (missing >= 1))
        return F.when(fits, F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["r"]))

    def plain(groups: Column) -> Column:
        good = F.forall(groups, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(groups, lambda x: F.regexp_replace(x, "^0{1,3}(?=.)", "")), ":"))

    def short(text: Column) -> Column:
        mapped = "^0:0:0:0:0:ffff:([0-9a-f]+):([0-9a-f]+)$"
        word = lambda k: F.conv(F.regexp_extract(text, mapped, k), 16, 10).cast("int")
        octets = F.concat_ws(".", *[F.shiftright(word(k), n).bitwiseAND(F.lit(255)).cast("string") for k in (1, 2) for n in (8, 0)])
        out = text
        for n in range(2, 9):
            row = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
            out = F.when(text.rlike(row), F.regexp_replace(text, row, "$1::$2")).otherwise(out)
        return F.when(text.rlike(mapped), octets).otherwise(out)

    return let(let(let(F.split(let(bare, in_groups), "::"), expanded), plain), short)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c.cast("bigint")))


def be32(c: Column) -> Column:
    """An unsigned 32-bit number as four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))


def be64(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


def byte_range(c: Column, location: Column, length: Column) -> tuple[Column, Column]:
    """(text, sqlstate) of a byte range: all of it below location 0, to the end with length 0; XX000 for a range outside the text or inside a character."""
    raw, size = F.encode(c, "utf-8"), F.octet_length(c)
    end = F.when(length == 0, size).otherwise(location + length)
    inside = lambda at: F.coalesce(F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF"), F.lit(False))
    bad = (location >= 0) & ((length < 0) | (location > size) | (end > size) | inside(location) | inside(end))
    text = F.when(location < 0, c).when(~bad, F.decode(F.substring(raw, location + 1, end - location), "utf-8"))
    return text, F.when(bad, "XX000")
