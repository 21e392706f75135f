"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
Columns beyond those that a stage needs pass through it, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, language, packing, shinglesets, substrings
from tessel.llm.common import Written, plain, settings, table


#: Languages to keep (None: all that were learned), and the least score: below it the prediction is likelier wrong than right.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are surely in a language to keep.

    Null texts, texts without a letter and texts with a score under LEAST_SCORE go: fragments,
    gibberish, and texts that mix languages.
    """
    rows, names = plain(docs, doc_id="doc_id", text="text")
    judged = language.identify(docs, language.learn(docs), keep=True)
    wanted = F.col("lang_pred") != language.UNKNOWN if LANGUAGES is None else F.col("lang_pred").isin(*LANGUAGES)
    return judged.where(wanted & (F.col("score") >= LEAST_SCORE)).select(*rows.columns).toDF(*names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near-duplicates.

    Those are joined by pairs whose sets of five-word shingles have a Jaccard similarity of at
    least 0.8. The vantage-point trees over SimHash fingerprints give the closest of them; at 0.8
    a pair differs in about ten bits of 64, which trees can't prune, so the others are met by
    their rarest shingles and judged by 128 bits. All are settled on the sets themselves.
    Rows that share an id stay or go together; rows without an id stay.
    """
    rows, names = plain(docs, doc_id="doc_id", text="text")
    # In their slots the texts are looked up and sorted out where they lie, and not shuffled.
    lying = substrings.laid_out(rows, substrings.bucket_count(spark), by_split=True)
    found = Written(shinglesets.near_copies(lying.df, slot_col="slot"), "near-copies", narrow=True)
    gone = found.df.where("doc_id <> component_id").select("doc_id").distinct()
    gone = Written(found.df.select("slot", "doc_id").join(gone, "doc_id").select(F.col("slot").alias("gone_slot"), F.col("doc_id").alias("gone_id")).distinct(), "gone", narrow=True)
    docs = lying.df
    with settings(spark, **substrings.AS_THEY_LIE):
        here = (docs["slot"] == F.col("gone_slot")) & (docs["doc_id"].cast("long") == F.col("gone_id"))
        out = Written(docs.join(gone.df.hint("shuffle_hash"), here, "left_anti").select(*rows.columns), "without-near-copies")
    for t in (lying, found, gone):
        t.drop()
    return out.df.toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts. A text that loses nothing stays as it is; one that loses all its words goes."""
    rows, names = plain(docs, doc_id="doc_id", text="text", **({"n_chars": "n_chars"} if "n_chars" in docs.columns else {}))
    cut = substrings.remove_duplicates(rows, texts=True, extra=["n_chars"] if "n_chars" in rows.columns else [])
    cut = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept"))
    if "n_chars" in rows.columns:
        length = F.length("text").cast(rows.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*rows.columns).toDF(*names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 1024."""
    import public_tokenizers

    return packing.pack(docs, bpe.library_ids(public_tokenizers.path("byte_bpe_50k.json")), end_id=2, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the language model; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        now = Written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        before, docs = now, now.df
    return STAGES[-1][1](spark, docs, sf_dir)
