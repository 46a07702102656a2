"""The corpus pipeline: quality, near-duplicates, repeated lines, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and all
but the last return the columns of docs. run() applies them to the documents table; between stages the
documents are written once to the shared folder, as a job over Parquet files would do, so that no stage
is computed again for a later one.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near_copies, packing, secret_scan, simhash, substring, weak_quality
from millrace.llm.components import components
from millrace.llm.shared import dropped, forget, whole_text, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars (if there) follows the text; it is null where the text is."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return weak_quality.kept(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __near_file and __near_row, which tell a row from all others (equal ones too) in whatever order it is read."""
    try:
        at = docs.metadataColumn("_metadata")
        return docs.withColumns({"__near_file": F.xxhash64(at["file_path"]), "__near_row": at["row_index"]})
    except AnalysisException:  # not a table of files
        return _numbered(written(docs, "docs"))


def _signed(rows: DataFrame) -> DataFrame:
    """place, size, fp, one, two and bands of rows (place, data): a fingerprint and a signature of shingles by one pass over the texts."""

    def made(batches):
        forget()
        for b in batches:
            data = [x.as_py() for x in b.column(1)]
            fps = np.array([simhash.fingerprint(x) for x in data], np.uint64).view(np.int64)
            one, two, bands = zip(*map(near_copies.signature, data)) if data else ((), (), ())
            columns = [pa.array(map(len, data), pa.int64()), pa.array(fps), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["place", "size", "fp", "one", "two", "bands"])

    kind = rows.select("place").schema.simpleString()[7:-1]
    return rows.mapInArrow(made, f"{kind}, size long, fp long, one long, two long, bands array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id; of rows with that id the first by a hash of the text.

    Near-duplicates are documents connected by links: of fingerprints (op5) at two bits or fewer, and of five-word shingles of
    Jaccard similarity 0.8 or more. Nulls count as empty texts, all texts without a word as equal. Rows without an id are a class's
    last choice; of repeated rows one stays. An empty table gives no rows. Columns keep their names, whatever these are but
    __near_file and __near_row.
    """
    docs = _numbered(docs)
    here = ["__near_file", "__near_row"]
    text = whole_text()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(text).alias("hash"), F.col(here[0]).alias("file"), F.col(here[1]).alias("row"))
    # Written, so that the numbers of nodes stay.
    signed = written(_signed(docs.select(place.alias("place"), text.cast("binary").alias("data"))).withColumn("node", F.monotonically_increasing_id()), "signed")
    classes = simhash.classes(signed.select(F.col("node").alias("doc_id"), "fp"))
    near = written(signed.select("node", "fp").join(classes, "fp").filter("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b")), "near")
    equal, sets = near_copies.equal_sets(signed)
    groups = components(near_copies.met(sets)).join(signed.select("node", "size"), "node")
    members = near_copies.dealt(written(groups, "groups")).join(signed.select("node", "place.file", "place.row"), "node")
    members = written(members.select("node", "root", "i", "j", F.col("file").alias(here[0]), F.col("row").alias(here[1])), "members")
    texts = docs.select(*here, text.cast("binary").alias("data")).join(members.hint("shuffle_hash"), here)
    similar = written(near_copies.verified(texts), "similar")
    roots = components(near.unionByName(equal).unionByName(similar))
    classed = written(signed.select("node", "place").join(roots, "node").select("root", "place"), "classed")
    first = written(classed.groupBy("root").agg(F.min("place").alias("first")), "first")
    # Links tie a class's nodes; all but its first go.
    lost = classed.join(first, "root").filter(~F.col("place").eqNullSafe(F.col("first")))
    lost = written(lost.select(F.col("place.file").alias(here[0]), F.col("place.row").alias(here[1])), "lost")
    dropped(signed, near, equal, members, similar, classed, first)
    return docs.join(lost.hint("shuffle_hash"), here, "left_anti").drop(*here)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier document (or place) has; those left without a word go.

    Of rows with equal id and text each is cut alike; a null text stays null, and a text that had no word from the start stays.
    An empty table gives no rows. Columns keep their names, whatever these are but those that begin with __cut_.
    """
    cut = substring.deduplicated(docs, spans_col="__cut_spans")
    lost = (F.size("__cut_spans") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _counted(cut.filter(~F.coalesce(lost, F.lit(False))).drop("__cut_spans"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked in their texts."""
    return _counted(secret_scan.masked(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in training sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("secret scans", secrets),
    ("packing", packed),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(*before)  # what a stage has read goes once its rows are written
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
