"""What surrounds a search: neighbouring lines, history, query rewriting and the prompt's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import right_stripped, stripped
from lodestone.params import DEFAULTS


def enriched(content: Column, ls: Column, start: Column, end: Column, around: int = DEFAULTS.context_lines, shown: int = DEFAULTS.shown_lines) -> Column:
    """``content`` (lines start..end of the file's lines ``ls``) between notes of up to ``around`` lines above and
    below, of which the nearest ``shown`` are given."""
    first = F.greatest(F.lit(0), start - 1 - around)
    n_above = start - 1 - first
    n_below = F.least(F.size(ls), end + around) - end
    none = F.array().cast("array<string>")
    above = F.slice(ls, F.greatest(start - F.least(n_above, F.lit(shown)), F.lit(1)), F.greatest(F.least(n_above, F.lit(shown)), F.lit(0)))
    below = F.slice(ls, end + 1, F.greatest(F.least(n_below, F.lit(shown)), F.lit(0)))
    head = F.when(n_above > 0, F.concat(F.array(F.concat(F.lit("  // ... "), n_above.cast("string"), F.lit(" lines above ..."))), F.transform(above, right_stripped))).otherwise(none)
    tail = F.when(n_below > 0, F.concat(F.transform(below, right_stripped), F.array(F.concat(F.lit("  // ... "), n_below.cast("string"), F.lit(" lines below ..."))))).otherwise(none)
    return F.array_join(F.concat(head, F.array(content), tail), "\n")


def user_questions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return paired.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def contextual_queries(questions: DataFrame) -> DataFrame:
    """(conv_id, turn, search_text): the question after the conversation's previous one, unless that is blank or the same."""
    last = stripped(F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn")))
    same = last.isNull() | (last == "") | (F.lower(last) == F.lower("question"))
    return questions.select("conv_id", "turn", F.when(same, F.col("question")).otherwise(F.concat_ws(" ", last, "question")).alias("search_text"))


def history_sections(questions: DataFrame, turns: int = DEFAULTS.history_turns, most: int = DEFAULTS.history_answer_chars) -> DataFrame:
    """(conv_id, turn, history): the last pairs before a question that have both parts, answers cut."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)
    pair = F.struct(F.col("question").alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    return questions.select("conv_id", "turn", history_text(F.collect_list(pair).over(before), most).alias("history"))


def history_text(recent: Column, most: int = DEFAULTS.history_answer_chars) -> Column:
    """The section of array<struct<q, a>>: pairs that have both parts, answers cut."""
    whole = F.filter(recent, lambda h: (h["q"] != "") & (h["a"] != ""))
    shown = F.transform(whole, lambda h: F.concat(F.lit("Previous Q: "), h["q"], F.lit("\nPrevious A: "), F.substring(h["a"], 1, most), F.when(F.length(h["a"]) > most, "...").otherwise("")))
    return F.when(F.size(whole) > 0, F.concat(F.lit("CONVERSATION HISTORY (use this for follow-up context):\n"), F.array_join(shown, "\n"), F.lit("\n\n"))).otherwise("")


def prompt_headers(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits (*by, position, file_path, name, chunk_type, parent, start_line, end_line) with their ``header``; pieces of
    one chunk are numbered."""
    same = Window.partitionBy(*by, "file_path", "name", "chunk_type")
    n, i = F.count("*").over(same), F.row_number().over(same.orderBy("position"))
    note = F.when(n > 1, F.concat(F.lit(" — PART "), i.cast("string"), F.lit("/"), n.cast("string"), F.lit(" OF THE SAME "), F.upper("chunk_type"), F.lit(", NOT A SEPARATE ONE"))).otherwise("")
    place = F.concat(F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    called = (
        F.when(F.col("chunk_type") == "class", F.concat(F.lit("class "), "name"))
        .when(F.col("chunk_type") == "method", F.concat(F.coalesce("parent", F.lit("")), F.lit("."), "name", F.lit("()")))
        .when(F.col("chunk_type") == "function", F.concat("name", F.lit("()")))
        .when(F.col("chunk_type") == "module", F.lit("module-level code"))
        .otherwise(F.col("name"))
    )
    return hits.withColumn("header", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), called, place, note))


def file_overview(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, file_path, overview): the distinct labels of a file's hits in order of first appearance."""
    label = (
        F.when(F.col("chunk_type") == "class", F.concat(F.lit("class "), "name"))
        .when(F.col("chunk_type") == "function", F.concat(F.lit("fn "), "name"))
        .when(F.col("chunk_type") == "method", F.concat(F.lit("fn "), F.coalesce("parent", F.lit("")), F.lit("."), "name"))
        .when(F.col("chunk_type") == "module", F.lit("module-level"))
        .otherwise(F.concat_ws(" ", "chunk_type", "name"))
    )
    first = hits.groupBy(*by, "file_path", label.alias("label")).agg(F.min("position").alias("at"))
    joined = first.groupBy(*by, "file_path").agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("ls"))
    return joined.select(*by, "file_path", F.concat(F.lit("  "), "file_path", F.lit(": "), F.array_join(F.transform("ls", lambda x: x["label"]), ", ")).alias("overview"))


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, n_hits, prompt) of questions (query_id, question, history, missing): an overview of the files, the hits
    (query_id, position, file_path, language, name, chunk_type, parent, start_line, end_line, content) under their headers,
    the history and the question; ``missing`` are file names in it that no file has. A question without hits has no row.
    A prompt is one text, so a question's hits come together; they are as many as a search shows."""
    fenced = F.concat("header", F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    parts = prompt_headers(hits, ("query_id",)).select("query_id", F.lit("").alias("file"), F.col("position").cast("long").alias("at"), fenced.alias("part"))
    files = file_overview(hits, ("query_id",)).select("query_id", F.col("file_path").alias("file"), F.lit(0).cast("long").alias("at"), F.col("overview").alias("part"))
    gathered = lambda is_file: F.sort_array(F.collect_list(F.when(is_file, F.struct("at", "file", "part"))))["part"]
    both = parts.withColumn("is_file", F.lit(False)).unionByName(files.withColumn("is_file", F.lit(True))).groupBy("query_id").agg(gathered(F.col("is_file")).alias("files"), gathered(~F.col("is_file")).alias("parts"))
    passages = F.array_join(F.concat(F.array(F.lit("FILES IN RETRIEVED CHUNKS:")), "files", F.array(F.lit("")), "parts"), "\n\n")
    absent = F.when(F.size("missing") > 0, F.concat(F.lit("\n\nThe repository has no file named "), F.array_join("missing", ", "), F.lit(". Say that it was not found and do not guess what it holds."))).otherwise("")
    n = F.size("parts")
    text = F.concat(F.lit("The "), n.cast("string"), F.lit(" best passages of the repository:\n\n"), passages, F.lit("\n\n---\n\n"), "history", F.lit("Question: "), "question", F.lit("\n\nAnswer from these passages alone, and cite file:first-last line for what you say."), absent)
    return both.join(questions, "query_id").select("query_id", n.alias("n_hits"), text.alias("prompt"))
