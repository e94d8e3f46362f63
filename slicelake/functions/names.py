"""Expressions over object names, globs, headers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_]{0,63}\z"
STAGE_PREFIX_LENGTH = 45


def glob_regex(pattern: Column) -> Column:
    """Regex text for a case-sensitive shell glob: ``*``, ``?``, ``[seq]``, ``[!seq]``.

    ``*`` also crosses ``/``. The pattern is cut into wildcards, bracket sets and
    single literals; each piece is translated on its own, so the pattern may be a column.
    A ``]`` right after the opening bracket belongs to the set; an unclosed ``[`` is literal.
    """
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[!?+\]?+[^\]]*+\]|.)"), F.lit(1))

    def escape(char: Column) -> Column:
        # what is special inside a regex set
        return F.regexp_replace(char, r"([\\\[\]^&\-])", r"\\$1")

    def member(piece: Column) -> Column:
        low, high = F.substring(piece, 1, 1), F.substring(piece, 3, 1)
        return F.when(F.length(piece) == 1, escape(piece)).otherwise(
            F.concat(escape(low), F.lit("-"), escape(high))
        )

    def translate(piece: Column) -> Column:
        body = F.regexp_replace(F.substring(piece, 2, 2147483647), r"\]$", "")
        negated = body.startswith("!")
        body = F.when(negated, F.substring(body, 2, 2147483647)).otherwise(body)
        members = F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1))
        # a range that runs backwards holds nothing
        members = F.filter(
            members, lambda m: (F.length(m) == 1) | (F.substring(m, 1, 1) <= F.substring(m, 3, 1))
        )
        inside = F.array_join(F.transform(members, member), "")
        return (
            F.when(piece == "*", ".*")
            .when(piece == "?", ".")
            .when(F.length(piece) == 1, F.regexp_replace(piece, r"([^A-Za-z0-9_/\- ])", r"\\$1"))
            .when(inside == "", F.when(negated, ".").otherwise("(?!)"))
            .otherwise(F.concat(F.when(negated, "[^").otherwise("["), inside, F.lit("]")))
        )

    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(pieces, translate), ""), F.lit(r")\z"))


def glob_match(name: Column, regex: Column) -> Column:
    return F.rlike(name, regex)


def glob_parts(pattern: Column) -> list[Column]:
    """A glob as ``prefix``, ``suffix`` and ``regex``, for matching many names cheaply.

    A pattern with a single ``*`` and no other wildcard is decided by its literal ends; it has
    no ``regex``. Without wildcards ``suffix`` is NULL too, and the name must equal ``prefix``.
    """
    one_star = pattern.rlike(r"(?s)^[^*?\[]*\*[^*?\[]*\z")
    literal = pattern.rlike(r"(?s)^[^*?\[]*\z")
    return [
        static_prefix(pattern).alias("prefix"),
        F.when(one_star, F.substring_index(pattern, "*", -1)).when(~literal, "").alias("suffix"),
        F.when(~one_star & ~literal, glob_regex(pattern)).alias("regex"),
    ]


def parts_match(name: Column, prefix: Column, suffix: Column, regex: Column) -> Column:
    """Whether a name fits a glob given by its parts: literal ends first, the regex only where needed."""
    ends = (
        name.startswith(prefix)
        & name.endswith(suffix)
        & (F.length(name) >= F.length(prefix) + F.length(suffix))
    )
    return F.when(suffix.isNull(), name == prefix).when(regex.isNull(), ends).otherwise(
        name.startswith(prefix) & glob_match(name, regex)
    )


def static_prefix(pattern: Column) -> Column:
    """Literal text before the first wildcard."""
    return F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0)


def default_folder(pattern: Column) -> Column:
    """Folder part of a pattern, or '' if it has wildcards or there is none."""
    folder = F.regexp_extract(pattern, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(folder.rlike(r"[*?\[]"), "").otherwise(folder)


def safe_filename(filename: Column) -> Column:
    """A bare ASCII file name: separators and blanks become ``_``, edge dots and underscores go."""
    flat = F.regexp_replace(F.coalesce(filename, F.lit("")), r"[/\\]", " ")
    joined = F.regexp_replace(F.trim(F.regexp_replace(flat, r"\s+", " ")), " ", "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9_.\-]", ""), r"^[._]+|[._]+$", "")


def object_path(folder: Column, filename: Column) -> Column:
    name = safe_filename(filename)
    folder = F.trim(F.trim(F.coalesce(folder, F.lit(""))), F.lit("/"))
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def object_path_findings(folder: Column, filename: Column, regex: Column) -> Column:
    """Reasons why a path may not be used with a mapping; empty array if it may."""
    folder = F.coalesce(folder, F.lit(""))
    parts = F.split(F.trim(F.trim(folder), F.lit("/")), "/")
    unsafe = folder.contains("\\") | F.exists(parts, lambda p: p.isin(".", ".."))
    name = safe_filename(filename)
    return F.array_compact(
        F.array(
            F.when(unsafe, "unsafe folder"),
            F.when(~F.lower(name).endswith(".csv"), "not a csv file"),
            F.when(~glob_match(object_path(folder, filename), regex), "outside the pattern"),
        )
    )


def fold(name: Column) -> Column:
    """The form in which names are compared: lower case, with the small letters that have another small form replaced."""
    lowered = F.translate(F.lower(name), "\u017f\u03c2", "s\u03c3")
    return F.replace(lowered, F.lit("\u00df"), F.lit("ss"))


def sanitize_header(header: Column) -> Column:
    name = F.regexp_replace(F.lower(strip(header)), r"[^A-Za-z0-9_]+", "_")
    name = F.regexp_replace(F.regexp_replace(name, r"_+", "_"), r"^_+|_+$", "")
    return _named(name, "column")


def table_from_filename(filename: Column) -> Column:
    base = F.substring_index(filename, "/", -1)
    numbered = F.regexp_extract(base, r"(?i)^([A-Za-z][A-Za-z0-9_]*)_\d+\.csv\z", 1)
    stem = F.regexp_replace(base, r"(?s)\.[^.]*\z", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(numbered != "", F.lower(numbered)).otherwise(_named(F.lower(stem), "table"))


def _named(name: Column, kind: str) -> Column:
    return (
        F.when(name == "", kind)
        .when(name.rlike(r"^[0-9]"), F.concat(F.lit(kind + "_"), name))
        .otherwise(name)
    )


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def is_stage_name(table: Column, stage: Column) -> Column:
    """``<first 45 characters of the table>_stage_<12 hex digits>``."""
    prefix = F.concat(F.substring(table, 1, STAGE_PREFIX_LENGTH), F.lit("_stage_"))
    suffix = F.substring(stage, F.length(prefix) + 1, F.lit(2147483647))
    return stage.startswith(prefix) & suffix.rlike(r"^[0-9a-fA-F]{12}\z")


# The characters Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(value, F.lit(WHITE_SPACE))
