"""Corpus preparation: language ID, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written
as Parquet in the shared folder and read again.  All stages but the last return the columns of the input;
`n_chars` follows the text where a stage changes it.

Edge cases, the same in every stage: an empty table gives an empty table.  A null text is no language and goes with
the first stage; later stages keep one untouched (packing gives it the end id alone), and an empty text likewise.  A
null id comes before every id.  Rows that share a doc_id are documents of their own; only rows that share id and text
are one to the near-dedup stage and stay or go together.  Repeated rows give repeated results.  Further columns travel
in a struct, so none of their names, whatever characters they hold, can clash with what an operator adds.  Texts are
taken whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import added
from kerbline.llm.language_id import UNKNOWN, fit, held_out, identify
from kerbline.llm.line_dedup import dedup_lines
from kerbline.llm.near_dedup import near_duplicates
from kerbline.llm.packing import pack
from kerbline.llm.radix_substrings import dedup_substrings
from kerbline.session import cut, ensure_checkpoint_dir


def _col(name: str) -> Column:
    """A column by its name as it stands: a dot in it is no field."""
    return F.col("`" + name.replace("`", "``") + "`")


def _parted(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, text and the columns `own`; all columns but the text once more in a struct `row`."""
    rest = F.struct(*[_col(c) for c in docs.columns if c != "text"]).alias("row")
    return docs.select("doc_id", "text", *own, rest)


def _whole(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from `row`, with the text that a stage left; n_chars follows a changed text."""
    changed = F.col("text") if text is None else text
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"}
    if text is not None and "n_chars" in columns:
        columns["n_chars"] = F.char_length(changed).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.alias(c) if c == "text" else columns[c].alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    parted = _parted(docs, "lang")
    model = fit(parted.where(~held_out("doc_id", folds=4, fold=2)))
    return _whole(identify(parted, model, columns=["row", "text"]).where(F.col("lang_pred") != UNKNOWN), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines, single lines too, with 50 characters or more go; so does a document of which nothing is left."""
    found = dedup_lines(_parted(docs), min_lines=1, min_chars=50)
    return _whole(found.where("NOT emptied"), docs, F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (then the smallest digest of its text)."""
    mark = F.sha2(F.col("text").cast("binary"), 256)
    found = near_duplicates(docs.select("doc_id", "text", mark.alias("mark")), width=5, percent=80, columns=["mark"])
    rows = cut(found.where("n_shingles > 0").select("component", F.struct("doc_id", "rest.mark").alias("key")).distinct())
    stays = rows.groupBy("component").agg(F.min("key").alias("kept")).select("kept")
    out = rows.join(stays, F.col("key") == F.col("kept"), "left_anti")
    gone_id, gone_mark = added(docs.columns, "gone_id", "gone_mark")
    gone = out.select(F.col("key.doc_id").alias(gone_id), F.col("key.mark").alias(gone_mark))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (mark == F.col(gone_mark)), "left_anti")


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has go from the text."""
    found = dedup_substrings(_parted(docs), width=50, whole_chars=True, columns=["row"])
    return _whole(found, docs, F.col("kept").cast("string"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    found = pack(docs, tokenizer="word_bpe_49k.json", end=1, length=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("packing", pack_sequences),
]

#: SQL cannot express language ID, the near-dedup components or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    place = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
