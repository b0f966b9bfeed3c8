"""Column functions over text: tokens, lines, comments, names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.params import SOURCE_EXTENSIONS


def _spaced(word: Column) -> Column:
    """A space at each lower-to-upper step and before the last capital of a run of capitals."""
    return F.regexp_replace(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def _more_tokens(word: Column) -> Column:
    """The ``_`` parts and then the camel-case parts of a word, lower-case."""
    none = F.array().cast("array<string>")
    under = F.when(F.contains(word, F.lit("_")), F.array_remove(F.split(F.lower(word), "_"), "")).otherwise(none)
    camel = F.split(_spaced(word), " ")
    return F.concat(under, F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(none))


def identifier_tokens(text: Column) -> Column:
    """Lower-case tokens of ``[A-Za-z0-9_]+`` runs, each followed by its ``_`` parts and its camel-case parts; repeats stay."""

    def parts(word: Column) -> Column:
        # Most words of prose have none; a word is only searched if it may.
        plain = (word == F.lower(word)) & ~F.contains(word, F.lit("_"))
        return F.when(plain, F.array(word)).otherwise(F.concat(F.array(F.lower(word)), _more_tokens(word)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), parts))


#: A word that may have parts: an underscore, or a capital that is not its first character. Nothing is tried twice.
COMPOUND = r"(?<![A-Za-z0-9_])[A-Z]?+[a-z0-9]*+[A-Z_][A-Za-z0-9_]*+"


def identifier_words(text: Column) -> Column:
    """The tokens of ``identifier_tokens`` in another order, for counting: all words of the lowered text, then the parts
    of its compound words. Two passes over the text in place of several expressions a word."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.concat(words, F.flatten(F.transform(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)), _more_tokens)))


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of an array's distinct words, from the runs of the sorted array."""

    def runs(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        tf = lambda at: lambda s, k: F.struct(F.get(ws, s).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - s).cast("long").alias("tf"))
        return bound(starts, lambda at: F.transform(at, tf(at)))

    return F.when(F.size(words) > 0, bound(F.sort_array(words), runs))


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed once: it is the variable of a transform over one element."""
    return F.transform(F.array(value), use)[0]


def filename_mentions(text: Column) -> Column:
    """Distinct lower-case file names in a question: a known source extension, or ``.lock``."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[\w\-]+\.[A-Za-z0-9]{1,8}"), F.lit(0)), F.lower)
    known = F.array(*[F.lit(e[1:]) for e in [*SOURCE_EXTENSIONS, ".lock"]])
    return F.array_distinct(F.filter(names, lambda n: F.array_contains(known, F.substring_index(n, ".", -1))))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def right_stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _is_code(line: Column) -> Column:
    return (stripped(line) != "") & ~stripped(line).rlike("^(#|//)")


def only_comments(text: Column) -> Column:
    """Every non-blank line starts with # or //; true for blank text."""
    return ~F.exists(lines(text), _is_code)


def has_code(text: Column, least: int = 2) -> Column:
    return F.size(F.filter(lines(text), _is_code)) >= least


def total_lines(text: Column) -> Column:
    """Line feeds, and one more for a last line without one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))


def chunk_id(path: Column, start: Column, end: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), name), 256), 1, 24)


def embed_input(text: Column, most: int = 6000) -> Column:
    """What the embedder gets: stripped, cut, and a single space where nothing is left."""
    clean = F.substring(stripped(text), 1, most)
    return F.when(clean == "", " ").otherwise(clean)


def cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def extension(path: Column) -> Column:
    """The last suffix with its dot, lower-case; none for names like ``.env`` or ``Makefile``."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
