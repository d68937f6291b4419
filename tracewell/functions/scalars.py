"""Scalar functions as Column expressions (X-s1 to X-s31); none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_binary_name(c: Column) -> Column:
    """Dots to slashes, unless there is a slash already."""
    c = F.trim(c)
    return F.when(F.contains(c, F.lit("/")), c).otherwise(F.translate(c, ".", "/"))


def to_dotted_name(c: Column) -> Column:
    return F.translate(c, "/", ".")


def package_of(c: Column) -> Column:
    """What precedes the last slash, '' without one."""
    return F.regexp_extract(c, r"^(.*)/", 1)


def simple_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def arity(desc: Column) -> Column:
    """Number of parameters of a method descriptor, -1 if it is none or a class reference does not end.

    A descriptor without its closing bracket counts what it has.
    """
    params = F.regexp_extract(desc, r"^\(((?:L[^;]*;|[^)L])*)", 1)
    unended = desc.rlike(r"^\((?:L[^;]*;|[^)L])*L[^;]*$")
    n = F.length(F.regexp_replace(params, r"\[*(?:L[^;]*;|[^L\[])", "x"))
    return F.when(~desc.startswith("(") | unended, -1).otherwise(n).cast("long")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; equal 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^k + 0.5) / 10^k, which decimal rounding differs from."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def rarity(frequency: Column) -> Column:
    return 1.0 / (1.0 + F.log2(frequency))


def member_score(unique: Column, frequency: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.25 * F.when(unique, 1.0).otherwise(0.0) + 0.3 * rarity(frequency) + 0.15 * similarity)


def finding_id(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the parts joined by NUL, nulls as ''."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def format_symbol(kind: Column, owner: Column, name: Column, desc: Column) -> Column:
    """class, owner#name(desc) or owner#name:desc."""
    tail = F.when(kind == "class", "").when(kind == "method", F.concat(F.lit("#"), name, F.coalesce(desc, F.lit("")))).otherwise(F.concat(F.lit("#"), name, F.coalesce(F.concat(F.lit(":"), desc), F.lit(""))))
    return F.concat(owner, tail)


def visible_member(access: Column) -> Column:
    """Public or protected, and not synthetic."""
    return (access.bitwiseAND(5) != 0) & (access.bitwiseAND(0x1000) == 0)


def visible_class(access: Column) -> Column:
    """Public and not synthetic; protected does not count."""
    return (access.bitwiseAND(1) != 0) & (access.bitwiseAND(0x1000) == 0)


def wildcard(value: Column, pattern: str) -> Column:
    """Whether a value matches a pattern in which ``*`` stands for anything."""
    literal = "".join(".*" if p == "*" else "\\Q" + p + "\\E" for p in _split(pattern))
    return value.rlike(f"^{literal}$")


def _split(pattern: str) -> list[str]:
    out, text = [], ""
    for ch in pattern:
        if ch == "*":
            out += [text, "*"] if text else ["*"]
            text = ""
        else:
            text += ch
    return out + [text] if text else out


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the common suffix: the first place from the end at which they differ."""
    ends = F.zip_with(F.split(F.reverse(a), ""), F.split(F.reverse(b), ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(ends, True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")
