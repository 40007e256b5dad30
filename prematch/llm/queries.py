"""Registered queries of the thirteen operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, langid, lexical, minhash, mixing, packing, phrases, pq, quality, recurrent, substrings, tokens, urls

#: Production parameters of the mix: the tree's columns, weights, share of all tokens, most epochs, seed.
MIX_DOMAINS = 4
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 2), 4, 17


#: (verdict, host suffix, start of the path)
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(modulus: int) -> Column:
    """A document's fold: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def mix_levels() -> dict[str, Column]:
    """domain (sources in groups, by the number at the end of their names), language, source."""
    number = F.expr(r"try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INT)")
    return {"domain": F.concat(F.lit("d"), (number % MIX_DOMAINS).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(
        docs, levels=mix_levels(), weights=MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED
    )


def op3_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pq.near_duplicates(vectors, cosine=0.98)


def op4_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return recurrent.score(docs, fold(7).eqNullSafe(2))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash.near_duplicates(docs, shingle=5, percent=85)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, URL_RULES)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(4).eqNullSafe(2)
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, keep={"held_out": held_out})


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, tokenizer_path(), capacity=1024)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substrings.remove_repeats(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = fold(3).eqNullSafe(1)
    model = quality.train(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, model, keep={"held_out": held_out})


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return phrases.collocations(docs, max_n=4, least=30, inside=80, top=2000)


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens.count_tokens(docs, tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical.search(docs, items, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hnsw": op1_hnsw,
        "op2_mixing": op2_mixing,
        "op3_pq": op3_pq,
        "op4_recurrent": op4_recurrent,
        "op5_minhash": op5_minhash,
        "op6_urls": op6_urls,
        "op7_langid": op7_langid,
        "op8_packing": op8_packing,
        "op9_substrings": op9_substrings,
        "op10_quality": op10_quality,
        "op11_phrases": op11_phrases,
        "op12_tokens": op12_tokens,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.mix_sql(
            table="documents",
            levels={
                "domain": rf"'d' || CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % {MIX_DOMAINS} AS VARCHAR)",
                "lang": "lang",
                "source": "source",
            },
            weights=MIX_WEIGHTS,
            share=MIX_SHARE,
            max_epochs=MIX_EPOCHS,
            seed=MIX_SEED,
        ),
        "op11_phrases": phrases.collocations_sql(),
        "op13_lexical": lexical.search_sql(),
    }
