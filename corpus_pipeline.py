"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the
table that the stage before kept, written as Parquet and read again. All but the
last return the columns of ``docs``.

* language_id: a document stays if a language was found (its text has a letter)
  with a posterior of at least ``LEAST_SCORE``.
* ngram_jaccard: of each group of near copies (five words, 0.8) the row with the
  smallest doc_id stays; of equal rows, one. Documents without words are in no group.
* suffix_dedup: bytes that lie in a repeated 400-byte string go; ``text`` and
  ``n_chars`` (if present) follow. A character that a cut splits becomes U+FFFD.
* packing: sequences of power-of-two length; one row per sequence.

Columns are renamed while an operator works, so none can clash with its own.
Null texts: rejected by the first stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark.llm import jaccard, langid, packing, repeats
from threatspark.llm.common import read_table, stored

LEAST_SCORE = 0.5
#: Words, pre-tokens and bytes that a packing worker holds: less than alone, as the stages before have filled the executor.
PACK_STORE, PACK_BYTES = (100_000, 80_000), 2 << 20


def _neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under neutral column names, and those names."""
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = _neutral(docs)
    model = langid.fit(df, at["text"], at["lang"])
    out = langid.predict(df, model, at["text"])
    return _named(out.filter((F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_SCORE)), at)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = _neutral(docs)
    found = stored(jaccard.jaccard_components(df, at["doc_id"], at["text"], with_keys=True)
                   .withColumnRenamed(at["doc_id"], "id").filter(F.col("group").isNotNull()), "groups")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key"))
    stays = found.groupBy("group").agg(best.alias("best")).select(F.col("best.row_key").alias("row_key"))
    goes = found.select("row_key").distinct().join(stays, "row_key", "left_anti")
    keyed = df.withColumn("row_key", F.xxhash64(at["doc_id"], at["text"]))
    kept = keyed.join(goes, "row_key", "left_anti")
    equal = found.groupBy("row_key").count().filter("count > 1").join(goes, "row_key", "left_anti").select("row_key")
    if not equal.isEmpty():
        kept = kept.join(equal, "row_key", "left_anti").unionByName(
            kept.join(equal, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return _named(kept, at)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = _neutral(docs)
    out = repeats.remove_repeats(df, at["text"])
    text = F.when(F.col("n_removed") == 0, F.col(at["text"])).otherwise(
        F.make_valid_utf8(F.col("kept").cast("string")))
    out = out.withColumn(at["text"], text)
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(at["n_chars"], F.when(F.col("n_removed") == 0, F.col(at["n_chars"]))
                             .otherwise(F.length(at["text"])).cast(kind))
    return _named(out, at)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return (packing.pack(docs.select("doc_id", "text"), store=PACK_STORE, batch_bytes=PACK_BYTES)
            .select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                    "sequence_id", "offset"))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("suffix_dedup", suffix_dedup),
          ("packing", pack)]

#: The stages learn, join hashed sets and tokenize: no SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
