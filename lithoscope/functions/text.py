"""Column functions for source text, lines and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: What ends a line, as Python's str.splitlines() sees it: one of these, or \r\n.  The set comes
#: first, as a pattern that begins with a choice is tried out at every character.
LINE_END = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029](?:(?<=\r)\n)?+"
#: What Python's str.strip() takes away: all that has the property White_Space, and \x1C to \x1F.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes, and `.` that stops at \\n only."""
    return f"(?dU{'iu' if ignore_case else ''}){pattern}"


def has(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(rx(pattern, ignore_case)))


def decode(content: Column) -> Column:
    """UTF-8 if it is valid, else Latin-1; line ends become \\n."""
    s = content.cast("string")
    s = F.when(F.is_valid_utf8(s), s).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(s, "\r\n?", "\n")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where expressions are interpreted."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def without_last(a: Column) -> Column:
    """An array without an empty text at its end."""
    return F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)


def lines(source: Column | str) -> Column:
    """The lines, without an empty one after the last line end."""
    return without_last(F.split(source, LINE_END, -1))


def strip(c: Column) -> Column:
    """As Python's strip(): all Unicode white space."""
    return F.btrim(c, F.lit(SPACE))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirs(path: Column | str) -> Column:
    a = F.split(path, "/")
    return F.slice(a, F.lit(1), F.size(a) - 1)


def suffix(path: Column | str) -> Column:
    """The lower-cased suffix of the last segment; none for `.name` or `name.`."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def symbol_id(path: Column | str, name: Column | str, parent: Column | str | None = None) -> Column:
    plain = F.concat(F.col(path) if isinstance(path, str) else path, F.lit("::"), F.col(name) if isinstance(name, str) else name)
    if parent is None:
        return plain
    p = F.col(parent) if isinstance(parent, str) else parent
    n = F.col(name) if isinstance(name, str) else name
    return F.when(p.isNotNull() & (p != ""), F.concat(F.col(path) if isinstance(path, str) else path, F.lit("::"), p, F.lit("."), n)).otherwise(plain)


def is_test(path: Column | str) -> Column:
    return has(path, V.TEST_PATH)


def severity_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(V.SEVERITIES))
    for i, s in enumerate(V.SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def language(path: Column | str) -> Column:
    """A file's language by its whole name, else by its suffix, else `other`."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs(V.LANGUAGE_NAMES), basename(path)), F.try_element_at(pairs(V.LANGUAGE_SUFFIXES), suffix(path)), F.lit("other"))


def is_kept_path(path: Column | str) -> Column:
    """Neither below an ignored directory nor an ignored file."""
    name = basename(path)
    tail = "(" + "|".join(s.replace(".", r"\.") for s in V.IGNORED_SUFFIXES) + ")$"
    return ~F.arrays_overlap(dirs(path), F.array(*[F.lit(d) for d in V.IGNORED_DIRS])) & ~name.isin(*V.IGNORED_NAMES) & ~F.rlike(F.lower(name), F.lit(tail))


def is_text(content: Column) -> Column:
    """No NUL among the first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, V.SNIFF_BYTES)) == 0
