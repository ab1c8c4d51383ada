"""An index in generations: batches of documents are added, replaced and removed, and readers merge them without a shuffle.

Three tables lie below one folder, each with a partition a generation and a fixed number of buckets:

* postings (term, doc_id, source, tf, slice), bucketed by term and slice, a hash of doc_id, so that no frequent term
  fills a bucket of its own. tf 0 says that the document, replaced or removed, has the term no longer.
* forward (doc_id, term), bucketed by doc_id: the terms that such a row has to be written for.
* docs (doc_id, source, dl), bucketed by doc_id; dl null says that the document is removed.

The newest row of a term and document counts. All rows of one lie in one bucket, so reading and compacting merge bucket by
bucket; only a new batch is shuffled. Batch k is generation 2k; what compaction makes of all batches up to k is 2k + 1.
docs is written last and says which generations are whole: those it lacks are not read, and a batch that is added
again takes their place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import analyzer, scratch
from ..sources import files
from .index import Index, collection_stats, lengths_of, postings_of, summary, term_stats

#: Columns, bucket keys and order within a bucket of each table; in the order of writing.
TABLES = {
    "forward": ("doc_id string, term string", "doc_id", "doc_id"),
    "postings": ("term string, doc_id string, source string, tf int, slice int", "term, slice", "term, slice, doc_id"),
    "docs": ("doc_id string, source string, dl int", "doc_id", "doc_id"),
}


def _names(listed: str) -> list[str]:
    return [x.split()[0] for x in listed.split(", ")]


@dataclass
class Generations:
    """buckets is the number of tasks of a merge; slices is how many buckets a term's postings lie in at most."""

    spark: SparkSession
    path: str
    buckets: int
    slices: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None, slices: int = 16, corpus: DataFrame | None = None) -> Generations:
        """The index at a path that all executors share. A new one takes buckets and slices, another keeps its own. If no
        buckets are given, they are as many as the session's shuffle partitions, and as the tasks that analyse corpus, the
        first batch, if it is known: a bucket is sorted by one task."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        path = fs.makeQualified(at).toString()
        if not files.exists(spark, f"{path}/layout"):
            buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), analyzer.parts(corpus) if corpus is not None else 1)
            spark.createDataFrame([(buckets, slices)], "buckets int, slices int").coalesce(1).write.json(f"{path}/layout")
        n = spark.read.schema("buckets int, slices int").json(f"{path}/layout").first()
        g = cls(spark, path, n["buckets"], n["slices"])
        for name, (columns, keys, order) in TABLES.items():
            spark.sql(f"create table if not exists {g._table(name)} ({columns}, generation int) using parquet options ('partitionOverwriteMode' 'dynamic') partitioned by (generation) "
                      f"clustered by ({keys}) sorted by ({order}) into {g.buckets} buckets location '{path}/{name}'")
            fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
            spark.sql(f"msck repair table {g._table(name)} sync partitions")
        return g

    def _table(self, name: str) -> str:
        return f"generations_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{name}"

    def committed(self) -> list[int]:
        """Generations that are whole, oldest first."""
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"show partitions {self._table('docs')}").collect())

    def next_batch(self) -> int:
        """The number behind those of all batches so far."""
        return self.committed()[-1] // 2 + 1 if self.committed() else 0

    def _rows(self, name: str, below: int | None = None) -> DataFrame:
        some = [g for g in self.committed() if below is None or g < below]
        return self.spark.table(self._table(name)).where(F.col("generation").isin(some))

    def _newest(self, name: str, *keys: str, below: int | None = None) -> DataFrame:
        """The newest row of each key; keys begin with the table's bucket keys, so rows stay where they are. One generation has no older rows."""
        if len([g for g in self.committed() if below is None or g < below]) < 2:
            return self._rows(name, below)
        return self._rows(name, below).withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("generation")))).where("place = 1").drop("place")

    def _live(self, below: int | None = None) -> DataFrame:
        return self._newest("docs", "doc_id", below=below).where("dl is not null")

    def _terms(self, docs: DataFrame, below: int | None = None) -> DataFrame:
        """doc_id, term of documents given as doc_id and the generation they are from. No row of forward is newer than
        its document, so 'not older' says 'equal', and the join's only key is the one that both sides are bucketed by."""
        d = docs.select("doc_id", F.col("generation").alias("from"))
        return self._rows("forward", below).join(d, "doc_id").where(F.col("generation") >= F.col("from")).select("doc_id", "term")

    def _dead(self, docs: DataFrame, generation: int) -> DataFrame:
        """doc_id, term that documents of older generations have no longer in this one, whose rows of forward are written but
        not committed yet; both lie in the same buckets, so there is no shuffle of rows."""
        d = docs.select("doc_id", F.col("generation").alias("from"))
        some = [*(x for x in self.committed() if x < generation), generation]
        rows = self.spark.table(self._table("forward")).where(F.col("generation").isin(some)).join(d, "doc_id").where(F.col("generation") >= F.col("from"))
        return rows.groupBy("doc_id", "term").agg(F.max("generation").alias("newest")).where(F.col("newest") < generation).select("doc_id", "term")

    def _slice(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.slices)).cast("int").alias("slice")

    def _write(self, name: str, rows: DataFrame, generation: int, deal: bool = True) -> None:
        columns, keys, _ = TABLES[name]
        rows = rows.select(*_names(columns), F.lit(generation).alias("generation"))
        (rows.repartition(self.buckets, *_names(keys)) if deal else rows).write.insertInto(self._table(name), overwrite=True)

    def append(self, corpus: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Add batch number batch (0 and up): corpus (doc_id, source, text) with unique ids, which replace documents of
        the same ids, and removed (doc_id), of which those in corpus stay. A batch that is added again replaces itself; one
        that is compacted already is left alone. Empty and null texts are documents without terms."""
        g, done = 2 * batch, self.committed()
        if any(x % 2 and x > g for x in done):
            return
        lists = scratch.Written(analyzer.doc_terms(analyzer.spread(corpus)))
        docs, counts = lengths_of(lists.df), postings_of(lists.df)
        ids = docs.select("doc_id", "source")
        gone = removed.select("doc_id").distinct().join(ids, "doc_id", "left_anti") if removed is not None else ids.select("doc_id").limit(0)
        touched = ids.select("doc_id").unionByName(gone)
        # documents are dealt with their lists, which become rows behind that
        self._write("forward", postings_of(lists.df.repartition(self.buckets, "doc_id")), g, deal=False)
        if any(x < g for x in done):
            counts = counts.unionByName(self._dead(self._live(g).join(touched, "doc_id", "left_semi"), g).select("term", "doc_id", F.lit("").alias("source"), F.lit(0).alias("tf")))
        self._write("postings", counts.withColumn("slice", self._slice()), g)
        self._write("docs", docs.unionByName(gone.select("doc_id", F.lit("").alias("source"), F.lit(None).cast("int").alias("dl"))), g)
        lists.drop()

    def take(self, index: Index) -> None:
        """An index that was built at once, as batch 0 of a new one."""
        p = index.postings.select("term", "doc_id", "source", "tf")
        self._write("forward", p, 0)
        self._write("postings", p.withColumn("slice", self._slice()), 0)
        self._write("docs", index.docs, 0)

    def compact(self, keep: bool = False) -> int | None:
        """Write all generations as one, without rows of what is gone, and drop them unless keep; the new one's number.

        A reader finds the same rows at any moment, also if compaction is broken off: old generations go oldest first,
        so none of a term's rows outlives the row that ends it. Then compact() again finishes.
        """
        have = self.committed()
        if not have:
            return None
        to = have[-1] | 1
        if have[-1] != to:
            self._write("forward", self._terms(self._live().hint("merge")), to, deal=False)
            self._write("postings", self.postings(), to, deal=False)
            self._write("docs", self._live(), to, deal=False)
        if not keep:
            for g in (x for x in have if x < to):
                for name in TABLES:
                    scratch.drop(self.spark, f"{self.path}/{name}/generation={g}")
                    self.spark.sql(f"alter table {self._table(name)} drop if exists partition (generation = {g})")
        return to

    def postings(self) -> DataFrame:
        """term, doc_id, source, tf, slice of the documents that are; a filter on term reaches the Parquet scan."""
        return self._newest("postings", "term", "slice", "doc_id").where("tf > 0").drop("generation")

    def docs(self) -> DataFrame:
        """doc_id, source, dl."""
        return self._live().drop("generation")

    def index(self) -> Index:
        """The tables that ranking, Boolean queries and semantic vectors read."""
        d, p = self.docs(), self.postings().drop("slice")
        s = collection_stats(d).first()
        return Index(d, p, term_stats(p), s["n_docs"], float(s["avg_dl"]))

    def summary(self) -> DataFrame:
        """generations, vocabulary, postings; one row."""
        return summary(term_stats(self.postings())).select(F.lit(len(self.committed())).alias("generations"), "vocabulary", "postings")
