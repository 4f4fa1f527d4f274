"""Column helpers shared by the rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def branches(words: list[str]) -> str:
    """Words as a pattern that shares their beginnings, so that few branches are tried at each place."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (re.escape(rest[0]) if len(rest) == 1 else branches(rest)) for c, rest in by.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def shortest(words: Iterable[str]) -> list[str]:
    """The words without those that contain another: where such a one occurs, the other does."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(o != w and o in w for o in unique)]


def alternation(words: Iterable[str]) -> str:
    """One pattern for a word list; both Java and RE2 read it."""
    return branches(shortest(words))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs. A look at the next character comes before the branches."""
    few = shortest(words)
    first = "".join(re.escape(c) for c in dict.fromkeys(w[0] for w in few))
    return text.rlike(f"(?=[{first}]){branches(few)}")


def listed(text: Column, words: Iterable[str]) -> Column:
    """The same as ``any_of``, for long lists: Arrow's automaton reads a text once, however many words there are."""
    pattern = "|".join(re.escape(w) for w in shortest(words))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found(text)


def spaced(text: Column, with_percent: bool = True) -> Column:
    """Hyphens and underscores (and ``%20``) as blanks."""
    out = F.translate(text, "-_", "  ")
    return F.replace(out, F.lit("%20"), F.lit(" ")) if with_percent else out


def file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def host(url: Column) -> Column:
    """Lower-case host without port and credentials; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def absolute(base: Column, href: Column) -> Column:
    """The link as seen from a page: absolute, ``//host``, ``/path``, ``?query``, ``#part`` and relative links."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    no_part = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path(base) == "", F.concat(no_query, F.lit("/"))).otherwise(F.regexp_replace(no_query, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(no_query, href)).when(href.startswith("#"), F.concat(no_part, href)).otherwise(F.concat(folder, href))
    )


def two_digits(year: Column) -> Column:
    return F.substring(year.cast("string"), 3, 2)
