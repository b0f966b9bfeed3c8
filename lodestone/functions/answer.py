"""Parts of an answer: text and fenced blocks, chart specifications, inline markup, citations, suggested questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

CHART = "type string, title string, labels array<string>, datasets array<struct<label: string, data: array<double>>>"


#: The format of fenced blocks, inline markup and citations.
FENCE = r"```(\w*)\n([\s\S]*?)```"
INLINE = r"(?m)\*\*.+?\*\*|`[^`]+`|^### .+$|^- .+"
CITATION = r"^[\w./\\:-]+$"
#: Suggested questions: what their numbering may consist of, their least and greatest length, and how many are kept.
NUMBERING, LENGTHS, SUGGESTIONS = "0123456789.-) ", (6, 149), 4


def fences(text: Column) -> Column:
    """array<struct<lang, code>> of ```lang blocks in order; lang defaults to ``text``."""
    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), fence)


def fence(block: Column) -> Column:
    """struct<lang, code> of one whole block; its ends are known, so the block is not searched again."""
    lang = F.lower(F.regexp_extract(block, r"^```(\w*)\n", 1))
    code = F.substring(block, F.length(lang) + 5, F.length(block) - F.length(lang) - 7)
    return F.struct(F.when(lang == "", "text").otherwise(lang).alias("lang"), stripped(code).alias("code"))


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<matched, body>>: all of the text in order, what ``pattern`` matches and what lies between."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = lambda matched: lambda b: F.struct(F.lit(matched).alias("matched"), b.alias("body"))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern), piece(False)).alias("gap"), F.transform(found, piece(True)).alias("hit"))
    return F.filter(F.flatten(F.transform(pairs, lambda z: F.array(z["gap"], z["hit"]))), lambda p: p["body"] != "")


def parts(text: Column) -> Column:
    """array<struct<kind, lang, body>>: an answer's text, chart, mermaid and code parts in order. A chart that cannot be
    read is code."""

    def part(p: Column) -> Column:
        lang = p["block"]["lang"]
        kind = F.when(~p["matched"], "text").when(p["readable"], lang).otherwise("code")
        shown = F.when((lang == "chart") & ~p["readable"], "chart (invalid JSON)").otherwise(lang)
        return F.struct(kind.alias("kind"), F.when(p["matched"], shown).alias("lang"), F.when(p["matched"], p["block"]["code"]).otherwise(p["body"]).alias("body"))

    # in steps, as a function applied to an element is computed once and its result can be named many times
    blocks = F.transform(pieces(text, FENCE), lambda p: F.struct(p["matched"].alias("matched"), p["body"].alias("body"), F.when(p["matched"], fence(p["body"])).alias("block")))
    readable = lambda b: F.when(b["lang"] == "chart", chart(b["code"]).isNotNull()).otherwise(b["lang"] == "mermaid")
    return F.transform(F.transform(blocks, lambda p: F.struct(p["matched"].alias("matched"), p["body"].alias("body"), p["block"].alias("block"), readable(p["block"]).alias("readable"))), part)


def markup(text: Column) -> Column:
    """array<struct<kind, body>> of a text part: citation, bold, code, heading, bullet and the plain text between."""

    def segment(p: Column) -> Column:
        b = p["body"]
        bold = F.substring(b, F.lit(3), F.length(b) - 4)
        marked = F.startswith(b, F.lit("**"))
        cited = marked & bold.rlike(CITATION) & F.contains(bold, F.lit(":"))
        kind = F.when(~p["matched"], "text").when(cited, "citation").when(marked, "bold").when(F.startswith(b, F.lit("`")), "code").when(F.startswith(b, F.lit("#")), "heading").otherwise("bullet")
        body = F.when(~p["matched"], b).when(marked, bold).when(F.startswith(b, F.lit("`")), F.substring(b, F.lit(2), F.length(b) - 2))
        return F.struct(kind.alias("kind"), F.coalesce(body, F.regexp_replace(b, "^(### |- )", "")).alias("body"))

    return F.transform(pieces(text, INLINE), segment)


def suggested(text: Column) -> Column:
    """The first questions that a model listed, one a line, without their numbering."""
    least, most = LENGTHS
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda q: F.ltrim(stripped(q), F.lit(NUMBERING)))
    return F.slice(F.filter(lines, lambda q: F.length(q).between(least, most)), 1, SUGGESTIONS)


def percent(current: Column, total: Column) -> Column:
    """Progress in whole percent, halves up; 0 of nothing."""
    return F.when(total > 0, F.floor(current / total * 100 + 0.5)).otherwise(0).cast("long")


def chart(code: Column) -> Column:
    """A chart's struct from JSON as written, without trailing commas, with double for single quotes, or from the
    first object in the text; null if none has type, labels and datasets."""
    plain = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    tries = [code, plain(code), plain(F.replace(code, F.lit("'"), F.lit('"'))), plain(F.regexp_extract(code, r'(\{[\s\S]*"type"\s*:[\s\S]*\})', 1))]

    def complete(c: Column) -> Column:
        spec = F.from_json(c, CHART)
        return F.when((spec["type"] != "") & spec["labels"].isNotNull() & spec["datasets"].isNotNull(), spec)

    return F.coalesce(*[complete(c) for c in tries])


def citations(text: Column) -> Column:
    """Bold ``file:line`` mentions."""
    bold = F.regexp_extract_all(text, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))
    return F.filter(bold, lambda b: b.rlike(CITATION) & F.contains(b, F.lit(":")))
