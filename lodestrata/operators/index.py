"""Inverted index as tables: postings, term statistics, document lengths, collection statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions.scratch import Written

#: Terms whose codes each task holds, and postings that a task sorts.
FREQUENT, SORTED = 200_000, 2_000_000


def dedup(corpus: DataFrame) -> DataFrame:
    """One row a doc_id: that of the last feed, by file order and place where those are given, else the greatest of the rest."""
    order = [c for c in ("feed", "place") if c in corpus.columns]
    rest = [c for c in corpus.columns if c not in ("doc_id", *order)]
    last = corpus.groupBy("doc_id").agg(F.max(F.struct(*order, F.struct(*rest).alias("r"))).alias("m"))
    return last.select("doc_id", "m.r.*")


def postings(terms: DataFrame) -> DataFrame:
    """term, doc_id, source, tf."""
    return terms.groupBy("term", "doc_id", "source").agg(F.count("*").cast("int").alias("tf"))


def lengths_of(lists: DataFrame) -> DataFrame:
    """doc_id, source, dl of analyzer.doc_terms()."""
    return lists.where("part = 0").select("doc_id", "source", "dl")


def postings_of(lists: DataFrame) -> DataFrame:
    """term, doc_id, source, tf of analyzer.doc_terms(): with unique ids a row's counts are its postings as they are."""
    return lists.select("doc_id", "source", F.inline("list")).select("term", "doc_id", "source", "tf")


def term_stats(postings: DataFrame) -> DataFrame:
    """term, df: documents of the term."""
    return postings.groupBy("term").agg(F.count("*").cast("long").alias("df"))


def numbered(values: DataFrame, to: str) -> DataFrame:
    """The different values of a one-column frame with their 0-based place in sorted order.

    Values are dealt by ranges and sorted within them; a range's first number is how many values
    those before it have. So the only window without a partition holds a row for each range, and no
    beginning that many values share makes a task larger than the others. The ranges are written to a table: they are
    found by sampling, so a lost one could not be computed again with the same numbers.
    """
    name = values.columns[0]
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = values.distinct().repartitionByRange(parts, name).sortWithinPartitions(name).select(name, F.monotonically_increasing_id().alias("at"))
    s = Written(s).df
    part = F.shiftright("at", 33)
    sizes = s.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return s.withColumn("part", part).join(F.broadcast(first), "part").select(name, (F.col("first") + F.col("at") - F.shiftleft("part", 33)).cast("int").alias(to))


def dictionary(stats: DataFrame) -> DataFrame:
    """term, word_code: the term's 0-based place in the sorted vocabulary."""
    return numbered(stats.select("term"), "word_code")


def with_codes(postings: DataFrame, codes: DataFrame) -> DataFrame:
    """Postings with word_code, of a dictionary (term, word_code, df).

    The most frequent terms have most postings, and their codes go to every task, so those postings are not shuffled for
    them and none fills a task; only the postings of the other terms, whose frequency is bounded by that, are joined by term.
    """
    common = codes.orderBy(F.desc("df"), "term").limit(FREQUENT)
    least = common.agg(F.min("df")).first()[0]
    often, rare = (codes.where(c).select("term", "word_code") for c in (F.col("df") > (least or 0), F.col("df") <= (least or 0)))
    x = postings.join(F.broadcast(often), "term", "left")
    columns = [*postings.columns, "word_code"]
    return x.where("word_code is not null").select(columns).unionByName(x.where("word_code is null").drop("word_code").join(rare.hint("merge"), "term").select(columns))


def collection_stats(docs: DataFrame) -> DataFrame:
    """n_docs, avg_dl; one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def summary(stats: DataFrame) -> DataFrame:
    """vocabulary, postings; one row."""
    return stats.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


def nested(postings: DataFrame) -> DataFrame:
    """term, df, list of its postings: the layout of the text files, for export. A term's list is one row."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "source"))).alias("list"))


def merge(*parts: DataFrame) -> DataFrame:
    """Postings of several indexes as one; those of a term and document are summed.

    They are dealt by document, into as many tasks as they are read in at least, so a task's groups do not grow with them.
    """
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    n = max(int(all_.sparkSession.conf.get("spark.sql.shuffle.partitions")), all_.rdd.getNumPartitions())
    return all_.repartition(n, "doc_id").groupBy("term", "doc_id", "source").agg(F.sum("tf").cast("int").alias("tf"))


@dataclass
class Index:
    """The tables of an index. corpus and terms are computed once and read by all others.

    An index that was loaded has its dictionary (term, word_code, df) and its postings by code (word_code,
    doc_id, source, tf): a query's terms are looked up by range in the one and their codes by range in the other.
    One that was built has lists, the postings by document as analyzer.doc_terms() gives them; with persist they are a table
    that no executor's memory holds, and docs and postings are read from it.
    """

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    n_docs: int
    avg_dl: float
    codes: DataFrame | None = None
    coded: DataFrame | None = None
    lists: DataFrame | None = None
    written: Written | None = None

    @classmethod
    def build(cls, corpus: DataFrame, persist: bool = True) -> Index:
        """From a corpus (doc_id, source, text) with unique ids, analysed once and by document; nothing but its texts is shuffled."""
        x = analyzer.doc_terms(analyzer.spread(corpus))
        w = Written(x) if persist else None
        x = w.df if persist else x
        d, p = lengths_of(x), postings_of(x)
        s = collection_stats(d).first()
        t = term_stats(p)
        return cls(d, p, t.persist() if persist else t, s["n_docs"], float(s["avg_dl"]), lists=x, written=w)

    def release(self) -> None:
        """Let go of what build() keeps; the index can't be read any more."""
        for x in (self.docs, self.postings, self.stats):
            x.unpersist()
        if self.written is not None:
            self.written.drop()

    def by_document(self) -> DataFrame:
        """doc_id, source, dl, part, list (term, tf): see analyzer.doc_terms(); gathered from the postings where they aren't kept so."""
        if self.lists is not None:
            return self.lists
        x = self.postings.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("list"))
        none = F.array().cast("array<struct<term:string,tf:int>>")
        return self.docs.join(x, "doc_id", "left").select("doc_id", "source", "dl", F.lit(0).alias("part"), F.coalesce("list", none).alias("list"))

    def dictionary(self) -> DataFrame:
        """term, word_code: the stored one, or see dictionary()."""
        return self.codes.select("term", "word_code") if self.codes is not None else dictionary(self.stats)

    def save(self, path: str) -> None:
        """Parquet: the dictionary by term and the postings by code, in ranges, so that a query's filters skip files and row groups."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        codes = self.codes if self.codes is not None else self.stats.join(dictionary(self.stats), "term").select("term", "word_code", "df")
        codes.repartitionByRange(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        codes = self.docs.sparkSession.read.parquet(f"{path}/dictionary")
        coded = self.coded if self.coded is not None else with_codes(self.postings, codes)
        coded = coded.select("word_code", "doc_id", "source", "tf").repartitionByRange(max(parts, (codes.agg(F.sum("df")).first()[0] or 0) // SORTED), "word_code", "doc_id").sortWithinPartitions("word_code", "doc_id")
        coded.write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").partitionBy("source").parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        d, codes, coded = (spark.read.parquet(f"{path}/{x}") for x in ("docs", "dictionary", "postings"))
        s = collection_stats(d).first()
        post = coded.join(codes.select("term", "word_code"), "word_code").select("term", "doc_id", "source", "tf")
        return cls(d, post, codes.select("term", "df"), s["n_docs"], float(s["avg_dl"]), codes, coded)

    def of_terms(self, terms) -> DataFrame:
        """Postings of some terms; the filter, on terms or on their codes, reaches the Parquet scan."""
        if self.coded is None:
            return self.postings.where(F.col("term").isin(list(terms)))
        known = {r["word_code"]: r["term"] for r in self.codes.where(F.col("term").isin(list(terms))).select("term", "word_code").collect()}
        name = F.broadcast(self.docs.sparkSession.createDataFrame(list(known.items()), "word_code int, term string"))
        return self.coded.where(F.col("word_code").isin(list(known))).join(name, "word_code").select("term", "doc_id", "source", "tf")
