"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that are cut into bigrams.
CJK = (
    "\\x{3040}-\\x{309F}"
    "\\x{30A1}-\\x{30FA}"
    "\\x{30FC}-\\x{30FF}"
    "\\x{31F0}-\\x{31FF}"
    "\\x{3005}-\\x{3007}"
    "\\x{3400}-\\x{4DBF}"
    "\\x{4E00}-\\x{9FFF}"
    "\\x{F900}-\\x{FAFF}"
    "\\x{FF66}-\\x{FF9F}"
    "\\x{20000}-\\x{2FA1F}"
)
LONGEST_TOKEN, EXCERPT = 40, 320


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_exact(text: Column) -> Column:
    """Trimmed of any white space, in lower case."""
    return F.lower(F.regexp_replace(text, "^[\\p{IsWhite_Space}]+|[\\p{IsWhite_Space}]+$", ""))


def tokenize(text: Column) -> Column:
    """Tokens in order: runs of CJK characters as overlapping bigrams, other words in lower case; 40 bytes or more are left out."""
    # Without CJK, and without letters whose lower case depends on what is around them, words need not be cut one by one.
    plain = F.regexp_extract_all(F.lower(text), F.lit("[\\p{IsAlphabetic}\\p{N}]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+|[\\p{{IsAlphabetic}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))

    def cut(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]") & (F.length(run) > 1), bigrams).otherwise(F.array(F.lower(run)))

    tokens = F.when(text.rlike(f"[{CJK}\\x{{0130}}\\x{{03A3}}]"), F.flatten(F.transform(runs, cut))).otherwise(plain)
    return F.filter(tokens, lambda t: F.octet_length(t) < LONGEST_TOKEN)


def excerpt_around(text: Column, start: Column, length: Column, limit: int = EXCERPT) -> Column:
    """Up to ``limit`` characters centred on a match (1-based); control characters become spaces; empty is null."""
    side = F.floor((F.lit(limit) - F.least(length, F.lit(limit))) / 2)
    first = F.greatest(F.lit(1), F.least(start - side, F.length(text) - limit + 1)).cast("int")
    out = F.trim(F.regexp_replace(F.substring(text, first, F.lit(limit)), "\\p{Cntrl}", " "))
    return F.when(F.length(out) > 0, out)


def longest_query_part(text: Column, query: str, least: int = 2, most: int = 64) -> Column:
    """The longest part of ``query`` that ``text`` contains, the leftmost of equals; null without one of ``least`` characters."""
    parts = [query[i : i + n] for n in range(min(most, len(query)), least - 1, -1) for i in range(len(query) - n + 1)]
    parts = [p for p in dict.fromkeys(parts) if len(p.strip()) >= least]
    return F.coalesce(*(F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in parts)) if parts else F.lit(None).cast("string")


def media_type(value: Column) -> Column:
    """Before the semicolon, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(value, ";", 1)))


def pointer_escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def literal_escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def framed_sha256(domain: str, *fields: Column) -> Column:
    """SHA-256 of a domain tag and fields, each after its length as four bytes."""
    framed = [F.unhex(F.lpad(F.hex(F.octet_length(f).cast("long")), 8, "0")) for f in fields]
    parts = [F.lit(domain).cast("binary")]
    for size, field in zip(framed, fields):
        parts += [size, field.cast("binary")]
    return F.sha2(F.concat(*parts), 256)


def logical_path_ok(path: Column) -> Column:
    """Non-empty, relative, forward slashes only, no dot segments, no control characters."""
    return (F.length(path) > 0) & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~path.rlike("(^|/)\\.{1,2}(/|$)") & ~path.rlike("\\p{Cntrl}")


def folder_name(name: Column) -> Column:
    """Trimmed; null if empty, longer than 255 or with a separator."""
    trimmed = F.trim(name)
    return F.when((F.length(trimmed) > 0) & (F.length(trimmed) <= 255) & ~trimmed.rlike("[/\\\\]"), trimmed)
