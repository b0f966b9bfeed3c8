"""BM25 over an inverted index: postings and a row per term, both tables. Documents are tokenised once, when the index is
built; a search reads the postings of its terms only. Counts are sums, so indexes of parts add up to that of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted, identifier_tokens, identifier_words
from lodestone.params import DEFAULTS, Params
from lodestone.sources.shared import once, spread, stored


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, doc_len), doc_id unique: a document's tokens are counted within its row, nothing is shuffled."""
    words = docs.select(F.col(doc_id).alias("doc_id"), identifier_words(F.col(text)).alias("words"))
    # Outer: the filter that Spark infers from an inner explode would compute every array a second time.
    rows = words.select("doc_id", F.size("words").alias("doc_len"), F.explode_outer(counted(F.col("words"))).alias("t"))
    return rows.where("t is not null").select("doc_id", "doc_len", "t.term", "t.tf")


def by_term(posted: DataFrame) -> DataFrame:
    """In ranges of (term, document): a search by term reads a few files' row groups, and a frequent term takes several
    ranges."""
    return posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def term_counts(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same from the documents themselves: each one's distinct words are exploded and counted where they lie."""
    # Outer: see ``postings``.
    words = docs.select(F.explode_outer(F.array_distinct(identifier_words(F.col(text)))).alias("term"))
    return term_counts(words.where("term is not null"))


def vocabulary(docs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(term, df, raw_idf, idf) of a table's rows without their postings, made once while its files stay the same."""

    def made() -> DataFrame:
        terms, n = stored(document_counts(spread(docs)), "vocabulary"), docs.count()
        return with_idf(terms, n, mean_idf(terms, n), p)

    return once(docs, f"vocabulary-{p}", made, lambda terms: [terms])


def raw_idf(n_docs: int) -> Column:
    return F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def mean_idf(terms: DataFrame, n_docs: int) -> float:
    return terms.agg(F.avg(raw_idf(n_docs))).first()[0] or 0.0


def with_idf(terms: DataFrame, n_docs: int, mean: float, p: Params = DEFAULTS) -> DataFrame:
    """(term, df) with raw_idf and idf: a negative idf becomes epsilon times the mean over the vocabulary."""
    rows = terms.withColumn("raw_idf", raw_idf(n_docs))
    return rows.withColumn("idf", F.when(F.col("raw_idf") < 0, F.lit(mean * p.bm25_epsilon)).otherwise(F.col("raw_idf")))


class Index:
    """Postings (doc_id, term, tf, doc_len), terms (term, df, raw_idf, idf) and the mean length of a document."""

    def __init__(self, posted: DataFrame, terms: DataFrame, mean_length: float, p: Params = DEFAULTS):
        self.postings, self.terms, self.mean_length, self.params = posted, terms, mean_length, p

    @classmethod
    def build(cls, docs: DataFrame, p: Params = DEFAULTS) -> Index:
        posted = stored(postings(spread(docs)), "postings")
        terms = stored(term_counts(posted), "terms")
        n = docs.count()
        words = posted.agg(F.sum("tf")).first()[0] or 0
        return cls(posted, with_idf(terms, n, mean_idf(terms, n), p), words / max(n, 1), p)

    @classmethod
    def of_table(cls, docs: DataFrame, p: Params = DEFAULTS) -> Index:
        """The index of a table's rows, built once while its files stay the same."""
        return once(docs, f"bm25-{p}", lambda: cls.build(docs, p), lambda index: [index.postings, index.terms])

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, term, qtf) to (query_id, doc_id, score, rank), the best k of each query. The terms of the
        questions cut the postings before anything else; each task hands on k rows a query."""
        p = self.params
        asked = questions.join(self.terms.select("term", "idf"), "term")
        hits = self.postings.join(asked, "term")
        norm = F.col("tf") + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("doc_len") / F.lit(self.mean_length))
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (p.bm25_k1 + 1) / norm), 9).alias("score"))
        return best(scored.where("score > 0"), k, F.col("score").desc(), F.col("doc_id"))


def bm25(docs: DataFrame, questions: DataFrame, k: int, p: Params = DEFAULTS) -> DataFrame:
    return Index.build(docs, p).search(questions, k)


def best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query_id by ``order``, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k by ``order`` with their rank from 1; k rows reach one task, the rest is cut where it lies."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def question_terms(questions: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, text) to (query_id, term, qtf); without query_id all rows are the question 0."""
    query_id = F.col("query_id") if "query_id" in questions.columns else F.lit(0)
    return questions.select(query_id.alias("query_id"), F.explode(identifier_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
