"""Where files come from: repository addresses, folders of files, and which of them are source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension
from lodestone.params import AST_LANGUAGES, DEFAULTS, DISPLAY_LANGUAGES, GENERATED_SUFFIXES, LOCK_FILES, SKIP_DIRS, SKIP_EXTENSIONS, SOURCE_EXTENSIONS

REPOSITORY = r"^https?://(www\.)?%s/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$"


def valid_address(url: Column, host: str) -> Column:
    """Two path parts on ``host`` (a pattern), nothing else."""
    return F.regexp_replace(F.trim(url), "/+$", "").rlike(REPOSITORY % host)


def repository_key(url: Column) -> Column:
    """owner_name_hash of the last two path parts, without ``.git``; a hash alone where there are fewer. The hash is of
    owner/name, so that a_b/c and a/b_c differ."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1), F.substring(F.sha2(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)), 256), 1, 8))).otherwise(F.substring(F.sha2(url, 256), 1, 16))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def as_text(content: Column) -> Column:
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")


def language(path: Column) -> Column:
    """python, javascript or typescript; ``text`` for other source files; else null."""
    ext = extension(path)
    out = F.when(ext.isin(SOURCE_EXTENSIONS), "text")
    for e, name in AST_LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def display_language(path: Column) -> Column:
    """The language that a viewer colours a file in; ``text`` where it is not known."""
    ext, out = extension(path), F.lit("text")
    for e, name in DISPLAY_LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def skip_reason(path: Column, size: Column, content: Column | None = None) -> Column:
    """Why a file is left out, or null: folder, no_ext, extension, generated, size, binary. What the path tells
    comes first, so content is looked at last."""
    parts = F.split(path, "/")
    folder = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(folder, lambda d: d.isin(SKIP_DIRS) | (F.startswith(d, F.lit(".")) & (d != ".github")))
    name, ext = F.lower(F.element_at(parts, -1)), extension(path)
    made = name.isin(LOCK_FILES)
    for suffix in GENERATED_SUFFIXES:
        made = made | F.endswith(name, F.lit(suffix))
    out = (
        F.when(skipped, "folder")
        .when(ext == "", "no_ext")
        .when(ext.isin(SKIP_EXTENSIONS) | ~ext.isin(SOURCE_EXTENSIONS), "extension")
        .when(made, "generated")
        .when((size == 0) | (size > DEFAULTS.max_file_bytes), "size")
    )
    return out if content is None else out.when(F.locate("\x00", F.decode(F.substring(content, 1, 4096), "ISO-8859-1")) > 0, "binary")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, content) of two versions to (path, change): added, deleted or changed, by content hash."""
    a = old.select("path", F.sha2("content", 256).alias("was"))
    b = new.select("path", F.sha2("content", 256).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("path", change.alias("change"))
