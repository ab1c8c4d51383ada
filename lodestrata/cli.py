"""Command line: build, add, merge, lsa, build-map, search, boolean, expand, topics with the heat map."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .operators import boolean, expand, lsa, rank, topics
from .operators.generations import Generations
from .operators.index import dedup
from .plans.engine import Engine
from .sources import files, nvd


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestrata")
    sub = p.add_subparsers(dest="do", required=True)
    b = sub.add_parser("build")
    b.add_argument("--nvd", required=True)
    b.add_argument("--attack", required=True)
    b.add_argument("--components", type=int)
    b.add_argument("--skip-ingest", action="store_true", help="take the corpus of the last build")
    b.add_argument("--skip-index", action="store_true", help="write the corpus only")
    b.add_argument("--shard-size", type=int, default=files.SHARD_DOCUMENTS)
    n = sub.add_parser("add")
    n.add_argument("--nvd", required=True, help="feeds whose documents are added, or replace those of the same ids")
    g = sub.add_parser("merge")
    g.add_argument("--keep", action="store_true", help="keep the merged generations")
    v = sub.add_parser("lsa")
    v.add_argument("--components", type=int, default=300)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--scorer", choices=[*rank.SCORERS, "lsa"], default="bm25")
    s.add_argument("--no-expand", action="store_true")
    s.add_argument("--no-source-weight", action="store_true")
    q = sub.add_parser("boolean")
    q.add_argument("query")
    q.add_argument("--top", type=int, default=10)
    q.add_argument("--no-rank", action="store_true")
    e = sub.add_parser("expand")
    e.add_argument("query")
    t = sub.add_parser("topics")
    t.add_argument("--nvd", required=True)
    t.add_argument("--attack", required=True)
    t.add_argument("--topics", type=int, default=20)
    t.add_argument("--passes", type=int, default=5)
    t.add_argument("--top-words", type=int, default=15)
    t.add_argument("--min-doc-len", type=int, default=topics.MIN_TOKENS)
    m = sub.add_parser("build-map")
    m.add_argument("--attack", required=True)
    m.add_argument("--min-overlap", type=int, default=L.MIN_OVERLAP)
    for x in (b, n, g, s, q, e, t, m, v):
        x.add_argument("--index", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.do == "build":
        at = f"{a.index}/corpus"
        if a.skip_ingest and not files.exists(spark, at):
            raise FileNotFoundError(f"no corpus in {at}")
        if not a.skip_ingest:
            files.write_corpus(Engine.corpus(spark, a.nvd, a.attack), at, a.shard_size)
        if not a.skip_index:
            Engine.build(files.read_corpus(spark, at), nvd.techniques(nvd.read_stix(spark, a.attack)), a.components).save(a.index)
        return
    if a.do == "add":
        Engine.add(spark, a.index, nvd.read_nvd(spark, a.nvd).transform(dedup).select("doc_id", "source", "text")).summary().show()
        return
    if a.do == "merge":
        if not files.exists(spark, f"{a.index}/generations"):
            raise FileNotFoundError(f"no generations in {a.index}")
        g = Generations.open(spark, f"{a.index}/generations")
        g.compact(a.keep)
        g.summary().show()
        return
    if a.do == "topics":
        corpus = nvd.read_nvd(spark, a.nvd).transform(dedup).select("doc_id", "source", "text")
        tokens = topics.topic_corpus(corpus, a.min_doc_len).persist()
        got = topics.train(tokens, a.topics, a.passes)
        coherent = topics.coherence(topics.topic_terms(got, a.top_words), tokens).persist()
        topics.save(got, f"{a.index}/topics", a.top_words, coherent)
        coherent.show()
        if files.exists(spark, f"{a.index}/technique_cve"):
            m = topics.heat_map(spark.read.parquet(f"{a.index}/technique_cve"), nvd.technique_tactics(nvd.read_stix(spark, a.attack)), got.doc_topics, a.topics)
            if m is not None:
                m.show(100)
        return
    engine = Engine.load(spark, a.index)
    if a.do == "lsa":
        lsa.save(lsa.build(engine.index, a.components), f"{a.index}/lsa")
        return
    if a.do == "build-map":
        pairs = expand.technique_cve(engine.index.postings, nvd.techniques(nvd.read_stix(spark, a.attack)), a.min_overlap)
        pairs.write.mode("overwrite").parquet(f"{a.index}/technique_cve")
        files.write_technique_map(spark.read.parquet(f"{a.index}/technique_cve"), f"{a.index}/technique_map")
        expand.map_totals(spark.read.parquet(f"{a.index}/technique_cve")).show()
        return
    if a.do == "expand":
        engine.explain_expansion(a.query).orderBy(F.desc("weight"), "term").show(100, False)
    elif a.do == "boolean" and a.no_rank:
        boolean.first(engine.boolean(a.query), a.top).show(a.top, False)
    elif a.do == "boolean":
        rank.results(engine.search(a.query, top_n=a.top, expanded=False, mode="boolean", rerank="overfetch")).show(a.top, False)
    else:
        rank.results(engine.search(a.query, a.scorer, a.top, not a.no_expand, not a.no_source_weight)).show(a.top, False)


if __name__ == "__main__":
    main()
