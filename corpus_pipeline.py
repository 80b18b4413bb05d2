"""A training-corpus pipeline over the documents table, in five written stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.llm import packing, quality, suffixes, superminhash, toxicity, wordpieces
from tarnwerk.llm.queries import table, word_tokenizer
from tarnwerk.llm.workspace import Workspace, digest, empty, fresh_name, whole


def _of(docs: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """Rows of ``docs`` that are in ``rows`` by doc_id, text (its digest) and the columns ``more``, null
    being a value."""
    own = {"doc_id": whole(docs, "doc_id", "long"), "digest": digest(docs)} | {c: whole(docs, c, "string") for c in more}
    names = {c: fresh_name(docs, f"kept_{c}") for c in own}
    rows = rows.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = [own[c].eqNullSafe(rows[n]) for c, n in names.items()]
    return docs.join(rows, reduce(lambda x, y: x & y, same), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores below 0.5 stay; the model learns from the labels of ``docs``' rows that aren't
    held out, and without labels all rows stay. Null and empty texts have the bias's score. A row without an id,
    or with one that other rows share, is judged by its text like any other; repeated rows stay or go
    together. All columns stay; an empty table gives no rows."""
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return _of(docs, toxicity.score(docs, model, digests=True).where("score < 0.5"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source stay. Null and empty
    texts, and those of fewer than 50 words, go. Rows that share an id, or have none, are judged one by one;
    repeated rows stay or go together. Null languages and sources are groups of their own. All columns stay;
    an empty table gives no rows."""
    return _of(docs, quality.judged(docs, digests=True).where("kept"), "lang", "source")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, also where its rows share an id or have none; rows of different
    components all stay, whatever their ids. Of texts without words only repeats of id and text go."""
    work = Workspace(spark, "kept")
    found = superminhash.near_duplicates(docs, words=5, percent=80, digests=True).where("kept")
    found = work.keep(found.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("digest", "doc_id", "n")).alias("r")).select("r.*")
    wordless = found.where("root is null").select("digest", "doc_id", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("n")).alias("n"))
    rows = work.keep(first.unionByName(wordless))
    again = rows.where("n > 1")
    if empty(again):
        return _of(docs, rows)
    name = fresh_name(docs, "text_digest")
    repeated = _of(docs, again)
    return _of(docs, rows.where("n = 1")).union(repeated.withColumn(name, digest(repeated)).dropDuplicates(["doc_id", name]).drop(name))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its text without passages of 240 bytes (about fifty short words) that also start
    anywhere else, ``n_chars`` following the text. Null texts stay null, short and empty ones as they are; a
    text of which another row has a copy becomes empty. Ids play no part but in naming one of equal
    texts; an empty table gives no rows."""
    cut = suffixes.cut_repeats(docs, suffixes.PASSAGE, suffixes.PASSAGE_GRAM, with_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences of at most 2,048 tokens: doc_id, piece, start, length,
    ids_crc32, sequence_id and offset. Null and empty texts are one piece of one token; very long ones are
    cut into pieces. Rows without an id and repeated rows are packed like any other; an empty table gives no
    rows."""
    return packing.pack(docs, wordpieces.word_encoder(word_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: No stage but the base rules can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
