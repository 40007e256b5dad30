"""A corpus from raw documents to packed training sequences, stage by stage.

The stages set small Arrow batches for their session, so a Python worker's
memory does not follow the texts' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prematch.llm import langid, minhash, mixing, packing, substrings
from prematch.llm._session import small_batches, written
from prematch.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels, tokenizer_path

#: One text in so many tells the language stage how much coverage a learned language has; the others train it.
LANGUAGE_FOLDS = 5
#: The mix takes this share of the tokens it is given, each document at most once: little enough that no domain
#: or language runs short of its target on the test tables.
MIX_SHARE = (1, 3)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters or like no learned language go.

    The bound on coverage comes from held-out texts, by their length. Null
    texts go; ids may be null or repeat, rows are judged one by one.
    """
    small_batches(spark)
    held_out = F.pmod(F.xxhash64("text"), F.lit(LANGUAGE_FOLDS)) == 0
    model = langid.train(docs.where(~held_out))
    at = "__said"
    least = langid.least_coverage(docs.where(held_out), model, F.col(f"{at}.n_grams"))
    said = docs.withColumn(at, langid.judged(docs["text"], model))
    rejected = (F.col(f"{at}.lang_pred") == langid.UNDETERMINED) | (F.col(f"{at}.coverage") < least)
    return said.where(~rejected).select(*docs.columns)


def _key(docs: DataFrame) -> Column:
    """A document is known by its id and its text: ids may be null or repeat."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one of the smallest id.

    A null id comes after all others, equal ids go by a hash of the text, then
    of the whole row. Texts without words are no copies of each other.
    """
    small_batches(spark)
    keyed = docs.withColumn("__key", _key(docs))
    found = minhash.near_duplicates(keyed, id_col="__key", percent=80, bands=36, keep={"__id": keyed["doc_id"]})
    found = found.select(
        F.col("doc_id").alias("__key"), "component_id", "__id", (F.col("n_shingles") == 0).alias("__empty")
    )
    found = written(found, "near")
    first = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key"))).alias("m")
    keep = found.where("NOT __empty").groupBy("component_id").agg(first).select("m.__key", F.lit(False).alias("__empty"))
    keep = keep.unionByName(found.where("__empty").select("__key", "__empty").distinct())
    # Rows of equal id and text share a key.
    out = keyed.join(keep, "__key").withColumn("__n", F.when(F.col("__empty"), F.monotonically_increasing_id()))
    order = Window.partitionBy("__key", "__n").orderBy(F.xxhash64(*docs.columns))
    return out.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; untouched texts stay as they are; a document that is nothing but repeats goes."""
    small_batches(spark)
    names = {f"__{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    keyed = docs.withColumn("__key", _key(docs))
    keep = {k: keyed[c] for k, c in names.items()} | {"__null": keyed["text"].isNull()}
    out = substrings.remove_repeats(keyed, id_col="__key", keep=keep, as_is=True)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    back = {c: F.col(k) for k, c in names.items()}
    back["text"] = F.when(~F.col("__null"), F.col("kept_text"))
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") == 0, back["n_chars"]).otherwise(F.length("kept_text").cast("long"))
    return out.select(*[back[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical budgets take stay, each once; a leaf's last one is cut to the words taken."""
    # Rows of equal id, text and leaf share a key; they are taken in order of their number.
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text", *mix_levels().values()))
    taken = mixing.mix(
        keyed, levels=mix_levels(), weights=MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1, seed=MIX_SEED, keep={"__key": keyed["__key"]}
    )
    taken = taken.groupBy("__key").agg(
        F.sort_array(F.collect_list("n_taken"), asc=False).alias("__takes"), F.first("n_tokens").alias("__words")
    )
    order = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
    out = keyed.withColumn("__k", F.row_number().over(order)).join(taken, "__key").where("__k <= size(__takes)")
    take, word = F.expr("int(__takes[__k - 1])"), F.lit(mixing.WORDS)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", word, F.lit(0)), 1, take), " ")
    out = out.withColumn("__cut", F.when(take < F.col("__words"), cut))
    new = {"text": F.coalesce("__cut", F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("__cut").cast("long"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs


#: Language ID is learned and packing needs a tokenizer: SQL cannot express these stages.
ORACLE_SQL = None
