"""The engine: ingest, build, and search by one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions.scratch import drop
from ..operators import blocks, boolean, expand, lsa, rank
from ..operators.generations import Generations
from ..operators.index import Index, dedup
from ..sources import files, nvd


@dataclass
class Engine:
    """Tables that queries read. keywords and pairs serve expansion, semantic serves the lsa scorer.

    With blocks, Boolean queries are answered on bits, and ranked ones without a Boolean part skip postings.
    """

    spark: SparkSession
    index: Index
    keywords: DataFrame | None = None
    pairs: DataFrame | None = None
    semantic: lsa.Lsa | None = None
    blocks: blocks.Blocks | None = None

    @classmethod
    def build(cls, corpus: DataFrame, techniques: DataFrame | None = None, components: int | None = None) -> Engine:
        """From a corpus (doc_id, source, text) and techniques (tid, name, description, detection, platforms, data_sources)."""
        i = Index.build(corpus)
        k = expand.kw_technique(techniques).persist() if techniques is not None else None
        p = expand.technique_cve(i.postings, techniques).persist() if techniques is not None else None
        return cls(corpus.sparkSession, i, k, p, lsa.build(i, components) if components else None)

    @staticmethod
    def corpus(spark: SparkSession, nvd_dir: str, attack_path: str) -> DataFrame:
        """doc_id, source, text of feeds and bundle, without repeated ids."""
        for p in (nvd_dir, attack_path):
            if not files.exists(spark, p):
                raise FileNotFoundError(p)
        parts = (nvd.read_nvd(spark, nvd_dir), nvd.attack_corpus(nvd.read_stix(spark, attack_path)))
        one, two = (dedup(x).select("doc_id", "source", "text") for x in parts)
        return one.unionByName(two)

    @classmethod
    def ingest(cls, spark: SparkSession, nvd_dir: str, attack_path: str, components: int | None = None) -> Engine:
        return cls.build(cls.corpus(spark, nvd_dir, attack_path).persist(), nvd.techniques(nvd.read_stix(spark, attack_path)), components)

    def save(self, path: str) -> None:
        """Write all tables to path, whose generations, if any, are of an earlier build and go. The engine must not read those."""
        self.index.save(f"{path}/index")
        drop(self.spark, f"{path}/generations")
        if self.keywords is not None:
            self.keywords.write.mode("overwrite").parquet(f"{path}/kw_technique")
            self.pairs.write.mode("overwrite").parquet(f"{path}/technique_cve")
        if self.semantic is not None:
            lsa.save(self.semantic, f"{path}/lsa")
        (self.blocks or blocks.build(self.index)).save(f"{path}/blocks")

    def release(self) -> None:
        """Let go of what the index and its blocks keep."""
        self.index.release()
        if self.blocks is not None:
            self.blocks.release()

    @staticmethod
    def add(spark: SparkSession, path: str, corpus: DataFrame, removed: DataFrame | None = None) -> Generations:
        """Add documents (doc_id, source, text; unique ids) to what was saved, replace those of the same ids, and remove
        others (doc_id). From then on load() takes the index from these generations, and has no blocks; semantic vectors
        and the technique map are those of the last build."""
        g = Generations.open(spark, f"{path}/generations")
        if not g.committed():
            g.take(Index.load(spark, f"{path}/index"))
        g.append(corpus, g.next_batch(), removed)
        return g

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        if not files.exists(spark, f"{path}/index"):
            raise FileNotFoundError(f"no index in {path}")
        have = lambda n: spark.read.parquet(f"{path}/{n}") if files.exists(spark, f"{path}/{n}") else None
        if files.exists(spark, f"{path}/generations") and (g := Generations.open(spark, f"{path}/generations")).committed():
            i, b = g.index(), None
        else:
            i, b = Index.load(spark, f"{path}/index"), blocks.Blocks.load(spark, f"{path}/blocks") if files.exists(spark, f"{path}/blocks") else None
        return cls(spark, i, have("kw_technique"), have("technique_cve"), lsa.load(spark, f"{path}/lsa") if files.exists(spark, f"{path}/lsa") else None, b)

    def terms(self, query: str, acronyms: bool = False) -> list[str]:
        """Terms of a query, in order, repeats kept; acronyms as in documents only if asked for. No Spark job."""
        return analyzer.analyze(query, "index" if acronyms else "query")

    def weights(self, terms: list[str], expanded: bool = True) -> dict[str, float] | DataFrame:
        if expanded and self.keywords is not None:
            return expand.expand(terms, self.keywords, self.pairs)
        return dict.fromkeys(terms, 1.0)

    def explain_expansion(self, query: str) -> DataFrame:
        return expand.expand(self.terms(query), self.keywords, self.pairs)

    def boolean(self, query: str) -> DataFrame:
        tree = boolean.parse(query, self.terms)
        return blocks.fits(self.blocks, tree) if self.blocks is not None else boolean.execute(self.index, tree)

    def search(self, query: str, scorer: str = "bm25", top_n: int = 10, expanded: bool = True, source_weight: bool = True, mode: str = "auto", rerank: str = "candidates", acronyms: bool = False, skip: bool = True) -> DataFrame:
        """rank, doc_id, source, score.

        mode auto takes a query with AND, OR or NOT as Boolean; ranked and boolean force either.
        A Boolean query restricts the documents before the limit; with rerank 'overfetch' ten times
        top_n are ranked by BM25 without expansion and then restricted, and where none is left the
        first documents that fit are given. The lsa scorer always restricts after its limit. With skip, blocks (if there
        are any) spare a ranked query most postings; it pays on large indexes, as it takes some more jobs.
        """
        if scorer not in (*rank.SCORERS, "lsa"):
            raise ValueError(f"unknown scorer {scorer!r}")
        wanted = None
        if mode == "boolean" or mode == "auto" and boolean.is_boolean(query):
            wanted = self.boolean(query)
            query = boolean.without_operators(query)
        terms = self.terms(query, acronyms)
        if rerank == "overfetch" and wanted is not None:
            some = rank.top(rank.score(self.index, dict.fromkeys(terms, 1.0)), top_n * 10).join(wanted, "doc_id", "left_semi")
            best = rank.top(some.drop("rank"), top_n)
            if not best.isEmpty():
                return best
            return rank.top(boolean.first(wanted, top_n).join(self.index.docs.select("doc_id", "source"), "doc_id").withColumn("score", F.lit(0.0)), top_n)
        if scorer == "lsa":
            if self.semantic is None:
                raise ValueError("the index has no semantic vectors")
            w = self.weights(terms) if expanded and self.keywords is not None else None
            hits = lsa.search(self.semantic, terms, top_n, w)
            return rank.top(hits.join(wanted, "doc_id", "left_semi") if wanted is not None else hits, top_n)
        if skip and self.blocks is not None and wanted is None:
            return blocks.search(self.blocks, self.index, self.weights(terms, expanded), top_n, scorer, source_weight)[0]
        return rank.top(rank.score(self.index, self.weights(terms, expanded), scorer, source_weight, wanted), top_n)
