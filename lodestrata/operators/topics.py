"""Topic model, topic words, dominant topics, coherence, and the tactic by topic matrix."""

from __future__ import annotations

import math
import warnings
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import analyzer
from . import lda

MIN_TOKENS, NO_BELOW, NO_ABOVE, KEEP = 5, 10, 0.4, 100_000


def topic_corpus(corpus: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, tokens of documents that are no techniques and have enough tokens."""
    return analyzer.topic_tokens(corpus.where("source <> 'attack'")).where(F.size("tokens") >= min_tokens).select("doc_id", "tokens")


def vocabulary(tokens: DataFrame, no_below: int = NO_BELOW, no_above: float = NO_ABOVE, keep: int = KEEP) -> DataFrame:
    """term, df of terms in at least no_below documents and at most a share no_above of them, the keep most frequent.

    Each document adds one empty term, so terms and documents are counted in one pass.
    """
    every = F.concat(F.array_distinct("tokens"), F.array(F.lit("")))
    v = tokens.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = v.agg(F.coalesce(F.max(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("n")).scalar()
    return v.where((F.col("term") != "") & (F.col("df") >= no_below) & (F.col("df") <= no_above * n)).orderBy(F.desc("df"), "term").limit(keep)


@dataclass
class Topics:
    model: lda.Model
    words: list[str]
    doc_topics: DataFrame  # doc_id, dominant_topic, confidence


def train(tokens: DataFrame, n_topics: int = 20, passes: int = 5, seed: int = 42, chunk: int = 2000, no_below: int = NO_BELOW, no_above: float = NO_ABOVE, learn: bool = True) -> Topics:
    """Topics of tokens (doc_id, tokens) by lda.fit(), with a learned prior for each word unless learn is off.

    One pass is a step for each chunk of documents; a corpus of more than lda.STEPS chunks takes that many
    larger steps, so the number of jobs does not grow with it. The vocabulary (at most KEEP words) is the
    driver's.
    """
    spark = tokens.sparkSession
    words = [r["term"] for r in vocabulary(tokens, no_below, no_above).orderBy("term").collect()]
    batches = max(1, min(lda.STEPS, math.ceil(tokens.count() / chunk)))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bags = lda.bags(tokens.select("doc_id", "tokens").repartition(parts), words, batches, seed).persist()
    model = lda.fit(bags, len(words), n_topics, passes, batches, seed, learn)
    d = lda.document_topics(bags, model).select("doc_id", dominant(F.col("p")).alias("dominant_topic"), F.array_max("p").alias("confidence")).persist()
    d.count()
    bags.unpersist()
    return Topics(model, words, d)


def dominant(p):
    """Place of the largest share; the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def topic_terms(topics: Topics, n: int = 15) -> DataFrame:
    """topic_id, terms: array of (word, weight), the n words of the largest shares; ties by word."""
    rows = []
    for k, p in enumerate(topics.model.shares):
        # words are sorted, so a stable order breaks ties
        first = np.argsort(-p, kind="stable")[:n].tolist()
        rows.append((k, [(topics.words[i], float(p[i])) for i in first]))
    return SparkSession.active().createDataFrame(rows, "topic_id int, terms array<struct<word:string,weight:double>>")


def top_terms(weights: DataFrame, n: int = 15) -> DataFrame:
    """The same from a table topic_id, word, weight: what save() writes."""
    rank = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("weight"), "word"))
    few = weights.select("topic_id", "word", "weight", rank.alias("rank")).where(F.col("rank") <= n)
    terms = F.sort_array(F.collect_list(F.struct("rank", "word", "weight")))
    return few.groupBy("topic_id").agg(F.transform(terms, lambda t: F.struct(t["word"].alias("word"), t["weight"].alias("weight"))).alias("terms"))


def topic_labels(terms: DataFrame, n: int = 3) -> DataFrame:
    """topic_id, label such as 'T02: a, b, c'."""
    return terms.select("topic_id", F.concat(F.format_string("T%02d: ", "topic_id"), F.array_join(F.slice(F.col("terms.word"), 1, n), ", ")).alias("label"))


def _covered(places: list[int], window: int, last: int) -> list[tuple[int, int]]:
    """Starts of the windows that hold a word, as separate ranges, from its places in order; last is the last start."""
    out: list[tuple[int, int]] = []
    for p in places:
        lo, hi = max(0, p - window + 1), min(p, last)
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def _common(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> int:
    """Numbers that are in a range of both lists, by one sweep over them."""
    n = i = j = 0
    while i < len(x) and j < len(y):
        n += max(0, min(x[i][1], y[j][1]) - max(x[i][0], y[j][0]) + 1)
        if x[i][1] < y[j][1]:
            i += 1
        else:
            j += 1
    return n


def window_counts(terms: DataFrame, tokens: DataFrame, window: int = 110) -> DataFrame:
    """a, b, n: windows of so many neighbouring tokens that hold both words, for each two words a < b of a topic.

    Rows with a = b count the windows of one word, the row of two empty words all windows; a document of at most
    window tokens is one window. Windows are never listed: a word's places give the ranges of starts whose windows
    hold it, and two words' ranges are intersected by a sweep. So a document takes time in proportion to its
    tokens and the places of its topic words. Each task adds up its documents' counts, of which there are as
    many as pairs of words within topics. A null list of tokens is a document without any.
    """
    topics = [sorted({x["word"] for x in r["terms"]}) for r in terms.select("terms").collect()]
    partners: dict[str, set[str]] = {}
    for t in topics:
        for k, a in enumerate(t):
            partners.setdefault(a, set()).update(t[k + 1:])

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for ts in b.column(0).slice(k, 256).to_pylist():
                    places: dict[str, list[int]] = {}
                    for i, w in enumerate(ts or ()):
                        if w in partners:
                            places.setdefault(w, []).append(i)
                    last = max(0, len(ts or ()) - window)
                    c["", ""] += last + 1
                    held = {w: _covered(p, window, last) for w, p in places.items()}
                    for a, x in held.items():
                        c[a, a] += sum(hi - lo + 1 for lo, hi in x)
                        for w in partners[a] & held.keys():
                            if n := _common(x, held[w]):
                                c[a, w] += n
        if c:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in c]), pa.array([w for _, w in c]), pa.array(list(c.values()), pa.int64())], names=["a", "b", "n"])

    return tokens.select("tokens").mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def coherence(terms: DataFrame, tokens: DataFrame, sample: int | None = None, window: int = 110, seed: int = 42) -> DataFrame:
    """c_v, n_topics, n_docs: Röder et al. 2015, over all documents, or over a sample by hash that is the same each time.

    The driver gets window_counts(), whose number depends on the topics only.
    """
    spark = tokens.sparkSession
    topics = [[x["word"] for x in r["terms"]] for r in terms.orderBy("topic_id").collect()]
    if sample is not None:
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tokens = tokens.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).repartition(parts)
    got = {(r["a"], r["b"]): r["n"] for r in window_counts(terms, tokens, window).collect()}
    total, eps = max(1, got.get(("", ""), 0)), 1e-12

    def npmi(a, b):
        pa, pb = got.get((a, a), 0) / total, got.get((b, b), 0) / total
        pab = got.get((min(a, b), max(a, b)), 0) / total
        if not pa or not pb:
            return 0.0
        return math.log((pab + eps) / (pa * pb)) / -math.log(pab + eps)

    scores = []
    for t in topics:
        m = np.array([[npmi(a, b) for b in t] for a in t])
        whole = m.sum(0)
        n = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
        scores.append(float(np.mean(np.divide(m @ whole, n, out=np.zeros(len(t)), where=n > 0))))
    value = float(np.mean(scores)) if scores else 0.0
    return spark.createDataFrame([(value, len(topics), tokens.count())], "c_v double, n_topics int, n_docs long")


def tactic_topic(pairs: DataFrame, tactics: DataFrame, doc_topics: DataFrame, n_topics: int, distinct: bool = False) -> DataFrame:
    """tactic and a column a topic: technique and advisory pairs, or different advisories.

    Tactics without any are rows of 0. The shares of topics are sums of a row, so no pivot pass.
    """
    d = doc_topics.select(F.upper("doc_id").alias("cve_id"), "dominant_topic")
    x = pairs.select("tid", F.upper("cve_id").alias("cve_id")).join(d, "cve_id").join(F.broadcast(tactics), "tid")
    if distinct:
        x = x.select("tactic", "cve_id", "dominant_topic").distinct()
    cells = x.groupBy("tactic").agg(*(F.count_if(F.col("dominant_topic") == i).alias(f"topic_{i}") for i in range(n_topics)))
    axis = tactics.select("tactic").distinct()
    return axis.join(cells, "tactic", "left").na.fill(0).orderBy("tactic")


def heat_map(pairs: DataFrame, tactics: DataFrame, doc_topics: DataFrame, n_topics: int, distinct: bool = False) -> DataFrame | None:
    """tactic_topic(), or None, with a warning, where there is nothing to draw: no tactic, or no advisory under any of them."""
    if tactics.isEmpty():
        warnings.warn("no tactics: no heat map", stacklevel=2)
        return None
    m = tactic_topic(pairs, tactics, doc_topics, n_topics, distinct)
    if m.where(reduce(Column.__or__, (F.col(f"topic_{i}") > 0 for i in range(n_topics)), F.lit(False))).isEmpty():
        warnings.warn("no advisory of any technique has a topic: the heat map is empty", stacklevel=2)
        return None
    return m


def word_cloud(terms: DataFrame, n: int = 40) -> DataFrame:
    """topic_id, word, weight of each topic's first words: what a cloud draws."""
    return terms.select("topic_id", F.explode(F.slice("terms", 1, n)).alias("t")).select("topic_id", "t.word", "t.weight")


def save(topics: Topics, path: str, n: int = 15, coherent: DataFrame | None = None) -> None:
    """Model, vocabulary, topic words and dominant topics; coherent (see coherence()) too if given."""
    spark, m = topics.doc_topics.sparkSession, topics.model
    rows = [(k, m.topic_prior, w.tolist()) for k, w in enumerate(m.weights)]
    spark.createDataFrame(rows, "topic_id int, topic_prior double, weights array<double>").write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(k, w, float(e)) for k, (w, e) in enumerate(zip(topics.words, m.word_prior))], "code int, word string, prior double").write.mode("overwrite").parquet(f"{path}/words")
    topic_terms(topics, n).write.mode("overwrite").parquet(f"{path}/topic_terms")
    topics.doc_topics.write.mode("overwrite").parquet(f"{path}/doc_topics")
    if coherent is not None:
        coherent.coalesce(1).write.mode("overwrite").json(f"{path}/coherence")


def load(spark: SparkSession, path: str) -> Topics:
    words = spark.read.parquet(f"{path}/words").orderBy("code").collect()
    rows = spark.read.parquet(f"{path}/model").orderBy("topic_id").collect()
    model = lda.Model(np.array([r["weights"] for r in rows]), rows[0]["topic_prior"], np.array([r["prior"] for r in words]))
    return Topics(model, [r["word"] for r in words], load_doc_topics(spark, path))


def load_topic_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/topic_terms")


def load_doc_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/doc_topics")
