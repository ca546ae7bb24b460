"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import LANGUAGES, STOP, SUFFIXES, TERMS

#: Search terms: runs of letters and digits, lower-cased.
TERM = r"[\p{L}\p{N}]+"
IDENTIFIER = r"(?U)[a-z][a-zA-Z0-9]*[A-Z]|[a-zA-Z_]\w*_\w+|[A-Z][a-z]+[A-Z]"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def filter_stop_words(query: Column) -> Column:
    """Queries of more than five words without stop words; identifiers stay, and so does a query of stop words alone."""
    stop = F.array(*map(F.lit, STOP))
    words = _words(query)
    kept = F.filter(words, lambda t: t.rlike(IDENTIFIER) | ~F.array_contains(stop, F.lower(t)))
    return F.when((F.size(words) <= 5) | (F.size(kept) == 0), query).otherwise(F.array_join(kept, " "))


def technical_query(query: Column) -> Column:
    """Terms of code for the words of a query, in order, each once; null if no word has any."""
    table = F.create_map(*[x for k, v in TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = _words(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", " "))
    stop = F.array(*map(F.lit, STOP))
    known = F.filter(words, lambda t: ~F.array_contains(stop, t) & F.map_contains_key(table, t))
    found = F.array_distinct(F.flatten(F.transform(known, lambda t: table[t])))
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def normalized_name(name: Column) -> Column:
    """Snake case without one trailing suffix such as service or controller, unless nothing else is left."""
    parted = F.regexp_replace(name, "(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z][a-z])", "_$1$2")
    snake = F.replace(F.lower(parted), F.lit("-"), F.lit("_"))
    short = F.regexp_replace(F.regexp_replace(snake, f"({'|'.join(SUFFIXES)})$", ""), "_+$", "")
    return F.when(short != "", short).otherwise(snake)


def pascal_name(snake: Column) -> Column:
    return F.replace(F.initcap(F.replace(snake, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def language_of(path: Column) -> Column:
    """Language by the file's extension; null if it isn't a supported one."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)))


def directory_of(path: Column) -> Column:
    """Parent directory of a path; '.' at the root."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.contains(path, F.lit("/")), found).otherwise(".")


def stem_of(path: Column) -> Column:
    """File name without directory and last extension, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def first_lines(content: Column, n: int) -> Column:
    """At most n lines, and how many more there are."""
    lines = F.split(content, "\n")
    more = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(lines) > n, more).otherwise(content)


def filled_lines(content: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""))


def path_filter(path: Column, extension: str | None = None, prefix: str | None = None) -> Column:
    """Paths of an extension (dot or not) below a literal prefix."""
    found = F.lit(True)
    if extension:
        found = found & path.endswith("." + extension.lstrip("*").lstrip("."))
    if prefix:
        found = found & path.startswith(prefix)
    return found


def file_filter(value: str | None, extension: str | None = None, prefix: str | None = None) -> tuple[str | None, str | None]:
    """An alias for either filter: '.py' and '*.py' name an extension, all else a path; stated arguments win."""
    if value and value.startswith((".", "*.")):
        return extension or value.lstrip("*"), prefix
    return extension, prefix or value
