"""BM25 and TF-IDF ranking as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .index import Index

SCORERS = ("bm25", "tfidf")
#: Terms of an expansion that each task holds, and that are written into a filter.
KNOWN, LITERALS = 500_000, 1_000


def known(q: DataFrame, key: str) -> tuple[DataFrame, list | None]:
    """An expansion's terms that an index has: of many, few are known, so each task holds them up to KNOWN and no posting is
    shuffled; their keys up to LITERALS, which reach the Parquet scan."""
    q = q.persist()
    n = q.count()
    return F.broadcast(q) if n <= KNOWN else q, [r[0] for r in q.select(key).collect()] if 0 < n <= LITERALS else None


def idf(df: Column, n: float) -> Column:
    return F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)


def term_score(scorer: str, tf: Column, df: Column, dl: Column, n: float, avg_dl: float) -> Column:
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}")
    if scorer == "tfidf":
        return (1 + F.log(tf)) * idf(df, n)
    norm = L.K1 * (1 - L.B + L.B * dl / max(avg_dl, 1.0))
    return idf(df, n) * tf * (L.K1 + 1) / (tf + norm)


def score(index: Index, weights: dict[str, float] | DataFrame, scorer: str = "bm25", source_weight: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id, source, score of every document with a query term.

    weights: term to weight. A query's own terms are a dict and become literals, which reach the
    Parquet scan; an expansion, which grows with the corpus, is a DataFrame (term, weight) and is
    joined. Frequencies and N are those of the whole collection, also where candidates (doc_id)
    restrict the documents. Lengths are joined to the query's postings only; a document without a
    length takes the floor of the average.
    """
    spark = index.docs.sparkSession
    if isinstance(weights, DataFrame):
        q = weights.select("term", "weight")
        # by code where the index has codes: strings are looked up in the dictionary only
        p, s, key = (index.coded, index.codes, "word_code") if index.coded is not None else (index.postings, index.stats, "term")
        q, few = known(s.join(q, "term"), key)
        p = (p if few is None else p.where(F.col(key).isin(few))).join(q, key)
    else:
        if not weights:
            return spark.createDataFrame([], "doc_id string, source string, score double")
        q = F.broadcast(spark.createDataFrame(sorted(weights.items()), "term string, weight double"))
        s = index.stats.where(F.col("term").isin(list(weights)))
        p = index.of_terms(weights).join(q, "term").join(F.broadcast(s), "term")
    if candidates is not None:
        p = p.join(candidates.select("doc_id"), "doc_id", "left_semi")
    p = p.join(index.docs.select("doc_id", "dl"), "doc_id", "left")
    dl = F.coalesce("dl", F.lit(int(index.avg_dl)))
    one = term_score(scorer, F.col("tf"), F.col("df"), dl, index.n_docs, index.avg_dl) * F.col("weight")
    if source_weight:
        one = one * F.when(F.col("source") == "attack", L.ATTACK_WEIGHT).otherwise(1.0)
    return p.groupBy("doc_id").agg(F.any_value("source").alias("source"), F.sum(one).alias("score"))


def top(scores: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """rank, doc_id, source, score of the n best; ties by doc_id. The rank window holds n rows."""
    from pyspark.sql import Window

    s = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(n)
    return s.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "source", "score")


def result_url(doc_id: Column) -> Column:
    """Where a document is described; fixed formats."""
    t = F.regexp_replace(doc_id, r"\.", "/")
    return (F.when(doc_id.startswith("CVE-"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), doc_id))
            .when(doc_id.rlike(r"^T[\d.]+$"), F.concat(F.lit("https://attack.mitre.org/techniques/"), t, F.lit("/"))).otherwise(""))


def source_of_id(doc_id: Column) -> Column:
    return F.when(doc_id.startswith("CVE-"), "nvd").when(doc_id.rlike(r"^T\d{4}"), "attack").otherwise("unknown")


def source_label(source: Column) -> Column:
    return F.when(source == "attack", "ATT&CK").otherwise("NVD")


def results(ranked: DataFrame) -> DataFrame:
    """Rank, rounded score, label, id and url of each hit."""
    return ranked.select("rank", F.round("score", 4).alias("score"), source_label(F.col("source")).alias("label"), "doc_id", result_url(F.col("doc_id")).alias("url"))
