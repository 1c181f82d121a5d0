"""A corpus pipeline over `documents`: STAGES are applied one after another, each to all that the last one kept.

Every stage decides row by row, so rows that share an id, or have none, each get a decision of their own (and of copies
one stays). Null and
empty texts go in the first stage, as they have no letters. An empty table gives no rows. All but the last stage return
the columns of their input, whatever their names, with the values that they had (passages changes text and n_chars).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, ngramjoin, packing, places, quality, substrings
from lodestar.llm.queries import vocabulary_file
from lodestar.llm.tables import is_letterless, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document of a lower score fits no learned language: neither its family nor its language is told apart (each by 1/2 is 1/4).
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told go: those without a letter (null and empty ones too), and those whose
    score is below LEAST_SCORE. If no language could be learned, all texts with letters stay."""
    model = langid.train(docs)
    if not model.families.names:
        return docs.where(~is_letterless(F.col("text"))).select(docs.columns)
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model)
    return found.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select("__row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go. Rows are judged one by one and marked by their places in their files, so
    texts stay where they are. DataFrame functions only."""
    docs = places.from_files(docs)
    judged = quality.judge(places.placed(docs.select("lang", "text")).select(F.struct("f", "i").alias("row"), "lang", "text"), id_col="row")
    return places.apart(docs, judged.where("not kept").select("row.f", "row.i"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word n-grams at a Jaccard similarity of 0.8 the document of smallest id stays (rows
    without one come last; of rows of one id the one of the smallest hash of the text, of copies one). Texts without
    words link with nothing. Rows that go are marked by their places in their files, so texts stay where they are."""
    docs = places.from_files(docs)
    found = written(ngramjoin.groups(docs, k=5, num=4, den=5).where("group is not null"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t", "f", "i")).alias("x"))
    return places.without(docs, places.marked(found.join(first, "group").where("f <> x.f or i <> x.i").select("f", "i")))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier go from the text; n_chars follows. Texts without one stay as they
    are, and a document whose text goes wholly stays with an empty one."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substrings.dedup(docs.select("doc_id", "text", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__rest")), window=50, carry=("__rest",), unchanged=True)
    own = out.select("doc_id", "text", *[F.col(f"__rest.c{i}").alias(c) for i, c in enumerate(rest)])
    if "n_chars" in rest:
        own = own.withColumn("n_chars", F.char_length("text").cast("long"))
    return own.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece, as the operator gives them."""
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("language", identify), ("quality", rules), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", pack)]
#: Tokenizing, learned decisions and connected components are not SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
