"""Training-data pipeline over the documents table.

Each stage takes the documents that the one before kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common
from tracemill.llm.packing import pack_documents
from tracemill.llm.quality import classify
from tracemill.llm.similar_texts import BROADCAST_ROWS, deduplicate
from tracemill.llm.suffix_dedup import cut_spans, remove_repeats

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of a passage that counts as repeated, and of its anchor. Of the windows of 51 words in prose of four languages
#: less than one in a thousand is shorter than 255 bytes, so a passage of over 50 words holds such a string.
PASSAGE, PASSAGE_ANCHOR = 240, 160


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A row whose id is null or shared goes if any row of that id is rejected, so repeated rows go or stay together. A null
    or empty text is judged by its host and path; without labels every document is accepted; other columns are left out,
    whatever their names; an empty table stays empty. Texts are read whole, one Arrow batch at a time.
    """
    _common.tune(spark)
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = _common.Tables(spark, "rejected").keep(judged.where("NOT accept").select(F.col("doc_id").alias("rejected_id")).distinct())
    few = rejected.count() <= BROADCAST_ROWS
    return docs.select(*COLUMNS).join(F.broadcast(rejected) if few else rejected, F.col("doc_id").eqNullSafe(F.col("rejected_id")), "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts: the one with the least id; the rest as in ``similar_texts``.

    SimHash components (``simhash_dedup``, three of 64 bits) propose, bands propose what is further apart; exact similarity decides.
    All null and empty texts are equal, so one of them stays; of repeated rows one stays; a null id goes before any other.
    """
    _common.tune(spark)
    return deduplicate(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE bytes that occur again; a character that is cut apart goes whole.

    Every occurrence goes, so ties need no order, and repeated rows empty each other. A null text becomes the empty text,
    and ``n_chars`` counts what is left; a document stays even if nothing is left of it. The rest as in ``suffix_dedup``.
    """
    _common.tune(spark)
    names = ["lang", "source"]
    kept = docs.select("doc_id", F.to_json(F.struct(F.col("lang"), F.col("source"))).alias("rest"), "text")

    def use(doc_id, text, spans, rest):
        left = cut_spans(text, spans).decode("utf-8", "ignore")
        return doc_id, left, rest, len(left)

    out = remove_repeats(kept, use, "doc_id long, text string, rest string, n_chars long", PASSAGE, PASSAGE_ANCHOR, carry="rest")
    parts = F.from_json("rest", "lang string, source string")
    return out.select("doc_id", "text", *(parts[n].alias(n) for n in names), "n_chars").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens; nulls, ties and long texts as in ``packing``."""
    import public_tokenizers

    _common.tune(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained classifier nor the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last stage's rows."""
    tables = _common.Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
