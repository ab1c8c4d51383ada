"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL.

Documents stand for advisories (CVE-2024-<id>), benchmark items for techniques (T<1000 + id>).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analyzer, scratch
from .functions import lexicon as L
from .functions.dialect import DUCK, SPARK
from .operators import blocks, boolean, expand, index, lsa, rank, topics
from .operators.generations import Generations
from .plans.engine import Engine
from .sources import files, nvd

#: Terms with a useful document frequency in the driver's invented texts.
QUERY, WEIGHTED = "thtion erble attion", {"thtion": 1.0, "erbl": 0.6, "attion": 0.4}
TACTICS = ("Execution", "Persistence", "Discovery", "Collection", "Exfiltration", "Impact", "Lateral Movement")
N_TOPICS = 20
#: Two identifiers and an acronym behind each text, so their rules have something to do.
TAGGED = "concat(coalesce(text, ''), ' see CVE-2021-', cast(doc_id as varchar(20)), ', cwe-79 T1021.002 RCE xss MS17-010 poc.')"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents").select(F.concat(F.lit("CVE-2024-"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("nvd").alias("source"), "text")
    b = _read(spark, sf, "benchmark").select(F.concat(F.lit("T"), (1000 + F.col("item_id")).cast("string")).alias("doc_id"), F.lit("attack").alias("source"), "text")
    return d.unionByName(b)


def techniques(spark: SparkSession, sf: str) -> DataFrame:
    """An item's first 40 characters are its name, its text the description."""
    b = _read(spark, sf, "benchmark")
    none = F.array().cast("array<string>")
    return b.select(F.concat(F.lit("T"), (1000 + F.col("item_id")).cast("string")).alias("tid"), F.substring("text", 1, 40).alias("name"), F.col("text").alias("description"),
                    F.lit("").alias("detection"), F.array(F.lit("Windows")).alias("platforms"), none.alias("data_sources"))


def tactics(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.concat(F.lit("T"), (1000 + F.col("item_id")).cast("string")).alias("tid"), F.element_at(F.array(*map(F.lit, TACTICS)), (F.col("item_id") % 7 + 1).cast("int")).alias("tactic"))


_cache: dict = {}


def _engine(spark: SparkSession, sf: str) -> Engine:
    """The index of a folder is built once a session and shared by its queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cache:
        for x in _cache.values():
            if isinstance(x, Engine):
                x.release()
        _cache.clear()
        c = corpus(spark, sf)
        _cache[key] = Engine(spark, index.Index.build(c))
    return _cache[key]


def _blocked(spark: SparkSession, sf: str) -> Engine:
    e = _engine(spark, sf)
    if e.blocks is None:
        e.blocks = blocks.build(e.index)
    return e


def _expandable(spark: SparkSession, sf: str) -> Engine:
    e = _engine(spark, sf)
    if e.keywords is None:
        t = techniques(spark, sf)
        e.keywords = expand.kw_technique(t).persist()
        e.pairs = expand.technique_cve(e.index.postings, t).persist()
    return e


def _tagged(spark, sf):
    return _read(spark, sf, "documents").selectExpr("cast(doc_id as string) as doc_id", "'nvd' as source", f"{TAGGED} as text")


def _bool(query: str):
    return lambda s, d: _blocked(s, d).boolean(query)


def _skipping(weights: dict[str, float], **how):
    return lambda s, d: blocks.search(_blocked(s, d).blocks, _engine(s, d).index, weights, **how)[0]


def _posting_blocks(s, d):
    return _blocked(s, d).blocks.lists.select("term", "block", "n", *(F.round(x, 6).alias(x) for x in ("bm25", "tfidf", "bm25_weighted")))


def _search(query: str, **how):
    return lambda s, d: (_expandable if how.get("expanded") else _engine)(s, d).search(query, **{"expanded": False, "skip": False, **how})


def _weighted(s, d):
    return rank.top(rank.score(_engine(s, d).index, WEIGHTED))


def _lsa_engine(s, d):
    e = _engine(s, d)
    if e.semantic is None:
        e.semantic = lsa.build(e.index)
    return e


def _topics(s, d):
    key = "topics", s.sparkContext.applicationId, d
    if key not in _cache:
        _cache[key] = topics.train(_topic_tokens(s, d), N_TOPICS)
    return _cache[key]


def _topic_tokens(s, d):
    key = "topic_tokens", s.sparkContext.applicationId, d
    if key not in _cache:
        _cache[key] = topics.topic_corpus(analyzer.spread(corpus(s, d))).persist()
    return _cache[key]


def _coherence(s, d):
    return topics.coherence(topics.topic_terms(_topics(s, d)), _topic_tokens(s, d))


def _rule_topics(s, d):
    return _read(s, d, "documents").select(F.concat(F.lit("CVE-2024-"), F.col("doc_id").cast("string")).alias("doc_id"), (F.col("doc_id") % N_TOPICS).cast("int").alias("dominant_topic"))


def _rule_weights(s, d):
    """topic_id, word, weight: shares of words in the documents that a rule gives each topic."""
    t = topics.topic_corpus(corpus(s, d)).select((F.substring_index("doc_id", "-", -1).cast("long") % N_TOPICS).cast("int").alias("topic_id"), F.explode("tokens").alias("word"))
    n = t.groupBy("topic_id", "word").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.groupBy("topic_id").agg(F.sum("n").alias("all"))), "topic_id").select("topic_id", "word", (F.col("n") / F.col("all")).alias("weight"))


def _windows(s, d):
    return topics.window_counts(topics.top_terms(_rule_weights(s, d), 5), topics.topic_corpus(corpus(s, d)), 10)


def _pairs(s, d):
    """The technique map by itself, of the beginnings of descriptions, from texts, or from the folder's index if it has one already."""
    e, t = _cache.get((s.sparkContext.applicationId, d)), techniques(s, d)
    if e is None:
        return expand.technique_cve_of_texts(corpus(s, d), t, beginning=expand.BEGINNING)
    key = "pairs", s.sparkContext.applicationId, d
    if key not in _cache:
        _cache[key] = expand.technique_cve(e.index.postings, t, beginning=expand.BEGINNING).persist()
    return _cache[key]


def _vector(s, d):
    v = _read(s, d, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return lsa.nearest(v, "vec_id", "embedding", [float(x) for x in q], 10)


def _vectors_many(s, d):
    """Every 50th vector as a query, against all."""
    v = _read(s, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return lsa.nearest_many(v, "vec_id", "embedding", q, 5)


def _lsa_many(s, d):
    """Every 50th document's first words as a query."""
    return lsa.search_many(_lsa_engine(s, d).semantic, _first_words(s, d), 5)


def _first_words(s, d):
    """query_id, text: the first words of every 50th document."""
    return _read(s, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))


def _rule_semantic(s, d):
    """A model whose vectors are the table's: documents have those of their numbers, terms those of their codes, around again."""
    key = "rule_semantic", s.sparkContext.applicationId, d
    if key not in _cache:
        v = _read(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
        terms = index.dictionary(_engine(s, d).index.stats).join(v, F.col("word_code") % v.count() == F.col("v")).select("term", "vec")
        at = scratch.folder(s)
        lsa.save(lsa.Lsa(terms, v.select(F.concat(F.lit("CVE-2024-"), F.col("v").cast("string")).alias("doc_id"), "vec"), [1.0], 1.0), at)
        _cache[key] = lsa.load(s, at)
    return _cache[key]


def _semantic_queries(s, d):
    """Component by component, the vectors of the queries."""
    return lsa.query_vectors(_rule_semantic(s, d), _first_words(s, d)).select("query_id", F.posexplode("vec").alias("j", "x")).select("query_id", "j", F.round("x", 6).alias("x"))


def _semantic_saved(s, d):
    m = _rule_semantic(s, d)
    both = m.terms.select(F.lit("term").alias("kind"), F.col("term").alias("name"), "vec").union(m.docs.select(F.lit("document"), "doc_id", "vec"))
    return both.select("kind", "name", F.size("vec").alias("n"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"))


def _semantic(query: str, **how):
    return lambda s, d: Engine(s, _engine(s, d).index, semantic=_rule_semantic(s, d)).search(query, scorer="lsa", expanded=False, **how)


def _lengths_file(s, d):
    at = scratch.folder(s)
    files.write_json(_engine(s, d).index.docs, at)
    return files.read_json(s, at, "doc_id string, source string, dl int")


def _html(s, d):
    return _read(s, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("nvd").alias("source"), F.col("html").alias("text"))


# --- files: written from the driver's tables to a shared folder, and read again ------------------------

def _feeds(s, d):
    """Feeds of 500 documents: the older layout for even ids, the newer one, compressed, for odd ones."""
    at = scratch.folder(s)
    doc = _read(s, d, "documents").withColumn("id", F.concat(F.lit("cve-2024-"), F.col("doc_id").cast("string"))).withColumn("feed", F.floor(F.col("doc_id") / 1000))
    lang = lambda *x: F.array(*(F.struct(F.lit(k).alias("lang"), (v if not isinstance(v, str) else F.lit(v)).alias("value")) for k, v in x))
    refs = F.array(F.struct(F.concat(F.lit("http://x.test/"), "doc_id").alias("name"), F.array(F.lit("Patch")).alias("tags")), F.struct(F.lit("Vendor Bulletin").alias("name"), F.array(F.lit("Exploit")).alias("tags")))
    one = F.struct(F.struct(F.col("id").alias("ID")).alias("CVE_data_meta"), F.struct(lang(("en", F.col("text")), ("fr", "non")).alias("description_data")).alias("description"),
                   F.struct(F.array(F.struct(lang(("en", "CWE-79")).alias("description"))).alias("problemtype_data")).alias("problemtype"), F.struct(refs.alias("reference_data")).alias("references"))
    two = F.struct("id", lang(("en", F.col("text")), ("es", "no")).alias("descriptions"), F.array(F.struct(lang(("es", "CWE-1"), ("en", "CWE-2")).alias("description"))).alias("weaknesses"))
    for even, cve, name, how in ((0, one, "CVE_Items", "none"), (1, two, "vulnerabilities", "gzip")):
        items = doc.where(F.col("doc_id") % 2 == even).groupBy("feed").agg(F.collect_list(F.struct(cve.alias("cve"))).alias(name))
        items.select(name).write.mode("append").option("maxRecordsPerFile", 1).option("compression", how).json(at)
    return index.dedup(nvd.read_nvd(s, at)).select("doc_id", "source", "text")


def _bundle(s, d):
    """A bundle of the benchmark's items: some are revoked, deprecated, or no techniques."""
    at, b, i = scratch.folder(s), _read(s, d, "benchmark").join(tactics(s, d).withColumn("item_id", F.expr("cast(substring(tid, 2) as long) - 1000")), "item_id"), F.col("item_id")
    refs = F.array(F.struct(F.lit("other").alias("source_name"), F.lit(None).cast("string").alias("external_id"), F.lit("note").alias("description")), F.struct(F.lit("mitre-attack").alias("source_name"), F.lower("tid").alias("external_id"), F.lit(None).cast("string").alias("description")))
    o = F.struct(F.when(i % 11 == 0, "malware").otherwise("attack-pattern").alias("type"), (i % 5 == 0).alias("revoked"), (i % 7 == 0).alias("x_mitre_deprecated"), F.substring("text", 1, 40).alias("name"), F.col("text").alias("description"), refs.alias("external_references"),
                 F.lit("watch").alias("x_mitre_detection"), F.array(F.lit("Windows")).alias("x_mitre_platforms"), F.array(F.lit("Logs")).alias("x_mitre_data_sources"), F.array(F.struct(F.lower(F.replace("tactic", F.lit(" "), F.lit("-"))).alias("phase_name"))).alias("kill_chain_phases"))
    b.agg(F.collect_list(o).alias("objects")).coalesce(1).write.json(at)
    return nvd.read_stix(s, at)


def _corpus_files(s, d):
    at = scratch.folder(s)
    files.write_corpus_text(analyzer.token_arrays(corpus(s, d)), at)
    return files.read_corpus_text(s, at)


def _postings_files(s, d):
    e, at = _engine(s, d), scratch.folder(s)
    files.postings_lines(e.index.postings, index.dictionary(e.index.stats)).write.text(at)
    return files.parse_postings(s.read.text(at)).select("word_code", "term", "doc_id", "tf", "source")


def _map_file(s, d):
    at = scratch.folder(s)
    files.write_technique_map(_pairs(s, d), at)
    return files.read_technique_map(s, at)


def _saved(s, d):
    at = scratch.folder(s)
    _expandable(s, d).save(at)
    return Engine.load(s, at)


def _generations(s, d):
    """All documents and items as batch 0; in batch 1 each third document comes again, tagged, and of the others each seventh goes."""
    key = "generations", s.sparkContext.applicationId, d
    if key not in _cache:
        c = F.col("doc_id")
        g, doc, name = Generations.open(s, scratch.folder(s), corpus=corpus(s, d)), _read(s, d, "documents"), F.concat(F.lit("CVE-2024-"), c.cast("string")).alias("doc_id")
        g.append(corpus(s, d), 0)
        g.append(doc.where(c % 3 == 1).select(name, F.lit("nvd").alias("source"), F.expr(f"{TAGGED} as text")), 1, doc.where(c % 7 == 0).select(name))
        _cache[key] = g
    return _cache[key]


def _compacted(s, d):
    g = _generations(s, d)
    g.compact()
    return g.summary()


def _shares(n: int = N_TOPICS):
    """A made-up topic distribution of a document, with ties."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("doc_id") * 7 + i * 13) % 29).cast("double") / 29)


def _codes(s, d):
    return index.dictionary(_engine(s, d).index.stats)


QUERIES = {
    "tokens_index": lambda s, d: analyzer.token_arrays(corpus(s, d)).select("doc_id", "source", F.array_join("tokens", " ").alias("tokens")),
    "tokens_query": lambda s, d: analyzer.token_arrays(corpus(s, d), "query").select("doc_id", "source", F.array_join("tokens", " ").alias("tokens")),
    "tokens_html": lambda s, d: analyzer.terms(_html(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_terms")),
    "security_ids": lambda s, d: _tagged(s, d).select("doc_id", F.array_join(F.expr(analyzer.ids(SPARK, "text")), " ").alias("ids")),
    "acronyms": lambda s, d: analyzer.terms(_tagged(s, d)).where(F.col("term").isin("remotecodeexecut", "crosssitescript")).groupBy("term").agg(F.count("*").alias("n")),
    "inspect_first20": lambda s, d: analyzer.token_arrays(corpus(s, d)).orderBy("doc_id").limit(20).select("doc_id", F.size("tokens").alias("n"), F.array_join(F.slice("tokens", 1, 10), " ").alias("first10")),
    "tf": lambda s, d: _engine(s, d).index.postings.select("term", "doc_id", "source", "tf"),
    "df": lambda s, d: _engine(s, d).index.stats.select("term", "df"),
    "vocabulary": lambda s, d: _engine(s, d).index.stats.select("term"),
    "dictionary": _codes,
    "doc_lengths": lambda s, d: _engine(s, d).index.docs.select("doc_id", "source", "dl"),
    "collection_stats": lambda s, d: index.collection_stats(_engine(s, d).index.docs).select("n_docs", F.round("avg_dl", 6).alias("avg_dl")),
    "index_summary": lambda s, d: index.summary(_engine(s, d).index.stats),
    "postings_nested": lambda s, d: index.nested(_engine(s, d).index.postings).select("term", "df", F.array_join(F.transform("list", lambda x: F.concat(x["doc_id"], F.lit(","), x["tf"].cast("string"))), " ").alias("list")),
    "index_merge": lambda s, d: index.merge(*(index.postings_of(analyzer.doc_terms(analyzer.spread(corpus(s, d).where(F.col("source") == x)))) for x in ("nvd", "attack"))),
    "generations_postings": lambda s, d: _generations(s, d).postings().select("term", "doc_id", "source", "tf"),
    "generations_docs": lambda s, d: _generations(s, d).docs().select("doc_id", "source", "dl"),
    "generations_bm25": lambda s, d: Engine(s, _generations(s, d).index()).search(QUERY, expanded=False),
    "generations_bool": lambda s, d: Engine(s, _generations(s, d).index()).boolean("(thtion OR erth) AND NOT CVE-2021-1"),
    "generations_compacted": _compacted,
    "term_postings": lambda s, d: _engine(s, d).index.of_terms(["thtion"]).select("doc_id", "tf", "source"),
    "bm25_top10": _search(QUERY),
    "bm25_no_source_weight": _search(QUERY, source_weight=False),
    "tfidf_top10": _search(QUERY, scorer="tfidf"),
    "bm25_weighted": _weighted,
    "bm25_scores": lambda s, d: rank.score(_engine(s, d).index, dict.fromkeys(("thtion", "erbl", "attion"), 1.0)).select("doc_id", "source", F.round("score", 6).alias("score")),
    "bm25_skipping": _skipping(dict.fromkeys(WEIGHTED, 1.0)),
    "bm25_weighted_skipping": _skipping(WEIGHTED),
    "tfidf_skipping": _skipping(dict.fromkeys(WEIGHTED, 1.0), scorer="tfidf"),
    "posting_blocks": _posting_blocks,
    "bool_and": _bool("thtion AND erble"),
    "bool_or": _bool("erth OR oned"),
    "bool_not": _bool("NOT thing"),
    "bool_and_not": _bool("eran AND NOT eror"),
    "bool_paren": _bool("(thtion OR erth) AND (oned OR NOT eror) AND NOT thing"),
    "bool_words": _bool("thtion erble OR eran eror"),
    "bool_stop_operand": _bool("NOT the"),
    "bool_unranked": lambda s, d: boolean.first(_blocked(s, d).boolean("thtion AND erble"), 10),
    "bool_then_bm25": _search("thtion AND erble"),
    "bool_overfetch": _search("thtion AND erble", rerank="overfetch"),
    "kw_technique": lambda s, d: expand.kw_technique(techniques(s, d)),
    "technique_cve": lambda s, d: _pairs(s, d).select("tid", "cve_id"),
    "technique_map": lambda s, d: expand.technique_map(_pairs(s, d)).select("tid", F.array_join("cves", " ").alias("cves")),
    "expand_weights": lambda s, d: expand.expand(["thtion", "erbl", "attion"], _expandable(s, d).keywords, _pairs(s, d)),
    "bm25_expanded": _search(QUERY, expanded=True),
    "result_urls": lambda s, d: corpus(s, d).select("doc_id", rank.result_url(F.col("doc_id")).alias("url"), rank.source_label(F.col("source")).alias("label"), rank.source_of_id(F.col("doc_id")).alias("inferred")),
    "result_page": lambda s, d: rank.results(_engine(s, d).search(QUERY, expanded=False)),
    "topic_tokens": lambda s, d: analyzer.topic_tokens(corpus(s, d)).select("doc_id", F.array_join("tokens", " ").alias("tokens")),
    "topic_corpus": lambda s, d: topics.topic_corpus(corpus(s, d)).select("doc_id", F.size("tokens").alias("n")),
    "topic_vocab": lambda s, d: topics.vocabulary(topics.topic_corpus(analyzer.spread(corpus(s, d)))),
    "tactic_topic_heatmap": lambda s, d: topics.tactic_topic(_pairs(s, d), tactics(s, d), _rule_topics(s, d), N_TOPICS),
    "tactic_topic_distinct": lambda s, d: topics.tactic_topic(_pairs(s, d), tactics(s, d), _rule_topics(s, d), N_TOPICS, True),
    "tactic_titles": lambda s, d: tactics(s, d).select("tid", nvd.tactic_title(F.lower(F.replace("tactic", F.lit(" "), F.lit("-")))).alias("title")),
    "lsa_weights": lambda s, d: lsa.weights(_engine(s, d).index).select("term", "doc_id", F.round("value", 6).alias("value")),
    "vector_top10": _vector,
    "source_feeds": _feeds,
    "source_bundle": lambda s, d: nvd.attack_corpus(_bundle(s, d)),
    "source_tactics": lambda s, d: nvd.technique_tactics(_bundle(s, d)),
    "corpus_files": _corpus_files,
    "postings_files": _postings_files,
    "technique_map_file": _map_file,
    "doc_lengths_file": _lengths_file,
    "map_totals": lambda s, d: expand.map_totals(_pairs(s, d)),
    "saved_bm25": lambda s, d: _saved(s, d).search(QUERY, expanded=False),
    "saved_dictionary": lambda s, d: _saved(s, d).index.dictionary(),
    "saved_postings": lambda s, d: _saved(s, d).index.of_terms(["thtion", "erbl", "the", "nosuchterm"]),
    "saved_bm25_expanded": lambda s, d: _saved(s, d).search(QUERY),
    "dominant_topic": lambda s, d: _read(s, d, "documents").select("doc_id", topics.dominant(_shares()).alias("dominant_topic"), F.round(F.array_max(_shares()), 6).alias("confidence")),
    "topic_top_terms": lambda s, d: topics.word_cloud(topics.top_terms(_rule_weights(s, d))).select("topic_id", "word", F.round("weight", 9).alias("weight")),
    "topic_top_labels": lambda s, d: topics.topic_labels(topics.top_terms(_rule_weights(s, d))),
    "coherence_windows": _windows,
    "vector_many_top5": _vectors_many,
    "lsa_many_top5": _lsa_many,
    "semantic_saved": _semantic_saved,
    "semantic_query_vectors": _semantic_queries,
    "semantic_top10": _semantic(QUERY),
    "semantic_then_boolean": _semantic("thtion AND erble", top_n=50),
    "lsa_top10": lambda s, d: _lsa_engine(s, d).search(QUERY, scorer="lsa", expanded=False),
    "lda_topics": lambda s, d: topics.topic_terms(_topics(s, d)),
    "lda_doc_topics": lambda s, d: _topics(s, d).doc_topics,
    "lda_word_cloud": lambda s, d: topics.word_cloud(topics.topic_terms(_topics(s, d), 40)),
    "lda_labels": lambda s, d: topics.topic_labels(topics.topic_terms(_topics(s, d))),
    "coherence": _coherence,
}

# --- the same for DuckDB -------------------------------------------------------------------------

_CORPUS = "select 'CVE-2024-' || doc_id as doc_id, 'nvd' as source, text from documents union all select 'T' || (1000 + item_id), 'attack', text from benchmark"
_LATER = f"select 'CVE-2024-' || doc_id as doc_id, 'nvd' as source, case when doc_id % 3 = 1 then {TAGGED} else text end as text from documents where doc_id % 3 = 1 or doc_id % 7 <> 0 union all select 'T' || (1000 + item_id), 'attack', text from benchmark"
_TECH = "select 'T' || (1000 + item_id) as tid, text[1:40] as name, text[1:40] || ' ' || text || '  Windows ' as full_text from benchmark"
_TTERMS, _WHOLE_TTERMS = (analyzer.terms_sql(f"select 'T' || (1000 + item_id) as doc_id, text[1:40] || ' ' || {x} || '  Windows' as text from benchmark", "query", "doc_id") for x in ("text[1:500]", "text"))
_FIRST8 = "select doc_id, 'query' as source, array_to_string(string_split(text, ' ')[1:8], ' ') as text from documents where doc_id % 50 = 0"
_TAGGED = f"select doc_id::varchar as doc_id, 'nvd' as source, {TAGGED} as text from documents"


def _with(body: str, *more: str, docs: str = _CORPUS) -> str:
    parts = [f"corpus as materialized ({docs})", f"tok as materialized ({analyzer.terms_sql('select * from corpus')})",
             "post as materialized (select term, doc_id, source, count(*)::int as tf from tok group by all)", "stat as materialized (select term, count(*) as df from post group by 1)",
             "docs as materialized (select c.doc_id, c.source, coalesce(n, 0)::int as dl from corpus c left join (select doc_id, count(*) as n from tok group by 1) using (doc_id))",
             "coll as (select count(*) as n, avg(dl) as a from docs)", *more]
    return f"with {', '.join(parts)} {body}"


def _scores(weights: dict[str, float], scorer: str = "bm25", boost: bool = True, where: str = "") -> str:
    q = ", ".join(f"('{t}', {w}::double)" for t, w in weights.items())
    return _scores_of(f"select * from (values {q}) q(term, weight)", scorer, boost, where)


def _scores_of(q: str, scorer: str = "bm25", boost: bool = True, where: str = "") -> str:
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)"
    one = f"(1 + ln(tf)) * {idf}" if scorer == "tfidf" else f"{idf} * tf * ({L.K1} + 1) / (tf + {L.K1} * (1 - {L.B} + {L.B} * dl / greatest(a, 1)))"
    up = f" * case when post.source = 'attack' then {L.ATTACK_WEIGHT} else 1 end" if boost else ""
    return f"select post.doc_id, any_value(post.source) as source, round(sum({one} * weight{up}), 6) as score from post join ({q}) q using (term) join stat using (term) join docs using (doc_id), coll {where} group by 1"


def _top(scores: str, n: int = 10) -> str:
    return f"select row_number() over (order by score desc, doc_id)::int as rank, doc_id, source, score from ({scores}) order by score desc, doc_id limit {n}"


_MODEL = ("dic as materialized (select term, (row_number() over (order by term) - 1)::int as word_code from stat)", "tv as materialized (select term, embedding as vec from dic join embeddings on vec_id = word_code % (select count(*) from embeddings))",
          "tj as materialized (select term, unnest(range(len(vec)))::int as j, unnest(vec)::double as x from tv)")


def _near(terms: tuple[str, ...]) -> str:
    q = f"select list(x / (n + 1e-10) order by j) as q from (select *, sqrt(sum(x * x) over ()) as n from (select j, sum(x) as x from tj where term in {terms} group by 1))"
    return f"select 'CVE-2024-' || vec_id as doc_id, 'nvd' as source, round(list_inner_product(embedding::double[], q), 6) as score from embeddings, ({q})"


def _flags(having: str, universe: bool = False) -> str:
    t = lambda w: f"bool_or(term = '{w}')"
    for w in ("thtion", "erbl", "erth", "one", "thing", "eran", "eror"):
        having = having.replace(f"<{w}>", t(w))
    return f"select doc_id from post group by 1 having {having}"


_Q3 = {"thtion": 1.0, "erbl": 1.0, "attion": 1.0}
_KW = analyzer.keywords_sql(_TECH)
_PAIRS, _WHOLE_PAIRS = (f"tt as materialized (select distinct doc_id as tid, term from ({x})), pair as materialized (select tid, doc_id as cve_id, count(*) as overlap from post join tt using (term) where source = 'nvd' group by all)" for x in (_TTERMS, _WHOLE_TTERMS))
_KWC = f"kw as materialized ({_KW})"
_EXP = ("x as materialized (select t as term, 1.0::double as weight, 'query' as origin from (values ('thtion'), ('erbl'), ('attion')) q(t)), h as materialized (select distinct tid from kw join x on keyword = term), "
        f"e as materialized (select term, max(weight) as weight, arg_max(origin, weight) as origin from (select * from x union all select tid, {L.TECHNIQUE_WEIGHT}, 'technique' from h union all select distinct cve_id, {L.CVE_WEIGHT}, 'advisory' from pair semi join h using (tid) where overlap >= 3) group by 1)")
_TOPIC = f"select doc_id, source, {analyzer.topic_array(DUCK, 'coalesce(text, chr(32))')} as tokens from ({_CORPUS})"
_TCORP = f"select doc_id, tokens from ({_TOPIC}) where source <> 'attack' and len(tokens) >= 5"
_RULE_WEIGHTS = (f"tc as materialized ({_TCORP}), tw as (select (split_part(doc_id, '-', 3)::bigint % {N_TOPICS})::int as topic_id, unnest(tokens) as word from tc), wt as (select topic_id, word, count(*) as n from tw group by all), "
                 "wl as (select *, row_number() over (partition by topic_id order by n desc, word) as k, n / sum(n) over (partition by topic_id) as weight from wt)")
_TACTIC = "select 'T' || (1000 + item_id) as tid, [" + ", ".join(f"'{t}'" for t in TACTICS) + "][item_id % 7 + 1] as tactic from benchmark"


def _heat(distinct: bool) -> str:
    cells = ", ".join(f"count(*) filter (topic = {i})::bigint as topic_{i}" for i in range(N_TOPICS))
    hits = f"select {'distinct' if distinct else ''} tactic, {'cve_id,' if distinct else ''} doc_id::bigint % {N_TOPICS} as topic from (select tid, cve_id, replace(cve_id, 'CVE-2024-', '') as doc_id from pair where overlap >= 3) join ({_TACTIC}) using (tid)"
    return _with(f"select tactic, {cells} from (select distinct tactic from ({_TACTIC})) left join ({hits}) using (tactic) group by 1", _PAIRS)


def _tokens(side: str) -> str:
    return f"select c.doc_id, c.source, coalesce(string_agg(term, ' ' order by pos), '') as tokens from ({_CORPUS}) c left join ({analyzer.terms_sql(_CORPUS, side)}) t on t.doc_id = c.doc_id group by 1, 2"


@functools.cache
def sql() -> dict[str, str]:
    return {
        "tokens_index": _tokens("index"),
        "tokens_query": _tokens("query"),
        "tokens_html": f"select doc_id, count(*) as n, count(distinct term) as n_terms from ({analyzer.terms_sql(chr(10).join(['select page_id::varchar as doc_id, chr(110) as source, html as text from pages']))}) group by 1",
        "security_ids": f"select doc_id, array_to_string({analyzer.ids(DUCK, 'text')}, ' ') as ids from ({_TAGGED})",
        "acronyms": f"select term, count(*) as n from ({analyzer.terms_sql(_TAGGED)}) where term in ('remotecodeexecut', 'crosssitescript') group by 1",
        "inspect_first20": f"select c.doc_id, count(term)::int as n, coalesce(string_agg(term, ' ' order by pos) filter (k <= 10), '') as first10 from (select doc_id from ({_CORPUS}) order by doc_id limit 20) c left join (select *, row_number() over (partition by doc_id order by pos) as k from ({analyzer.terms_sql(_CORPUS)})) t on t.doc_id = c.doc_id group by 1",
        "tf": _with("select term, doc_id, source, tf from post"),
        "df": _with("select term, df from stat"),
        "vocabulary": _with("select term from stat"),
        "dictionary": _with("select term, (row_number() over (order by term) - 1)::int as word_code from stat"),
        "doc_lengths": _with("select * from docs"),
        "collection_stats": _with("select n as n_docs, round(a, 6) as avg_dl from coll"),
        "index_summary": _with("select count(*) as vocabulary, sum(df)::bigint as postings from stat"),
        "postings_nested": _with("select term, count(*) as df, string_agg(doc_id || ',' || tf, ' ' order by doc_id, tf) as list from post group by 1"),
        "index_merge": _with("select term, doc_id, source, tf from post"),
        "generations_postings": _with("select term, doc_id, source, tf from post", docs=_LATER),
        "generations_docs": _with("select * from docs", docs=_LATER),
        "generations_bm25": _with(_top(_scores(_Q3)), docs=_LATER),
        "generations_bool": _with("select doc_id from post group by 1 having (bool_or(term = 'thtion') or bool_or(term = 'erth')) and not bool_or(term = 'CVE-2021-1')", docs=_LATER),
        "generations_compacted": _with("select 1 as generations, count(*) as vocabulary, sum(df)::bigint as postings from stat", docs=_LATER),
        "term_postings": _with("select doc_id, tf, source from post where term = 'thtion'"),
        "bm25_top10": _with(_top(_scores(_Q3))),
        "bm25_no_source_weight": _with(_top(_scores(_Q3, boost=False))),
        "tfidf_top10": _with(_top(_scores(_Q3, "tfidf"))),
        "bm25_weighted": _with(_top(_scores(WEIGHTED))),
        "bm25_scores": _with(_scores(_Q3)),
        "bm25_skipping": _with(_top(_scores(_Q3))),
        "bm25_weighted_skipping": _with(_top(_scores(WEIGHTED))),
        "tfidf_skipping": _with(_top(_scores(_Q3, "tfidf"))),
        "posting_blocks": _with(f"select term, block, count(*)::int as n, round(max(b), 6) as bm25, round(max(1 + ln(tf)), 6) as tfidf, round(max(b * w), 6) as bm25_weighted from ("
                                f"select term, tf, code // {blocks.SIZE} as block, case when source = 'attack' then {L.ATTACK_WEIGHT} else 1 end as w, tf * ({L.K1} + 1) / (tf + {L.K1} * (1 - {L.B} + {L.B} * dl / greatest(a, 1))) as b from post join num using (doc_id, source), coll) group by 1, 2",
                                "num as materialized (select doc_id, source, dl, (row_number() over (order by source, dl, doc_id) - 1)::int as code from docs)"),
        "bool_and": _with(_flags("<thtion> and <erbl>")),
        "bool_or": _with(_flags("<erth> or <one>")),
        "bool_not": _with(_flags("not <thing>")),
        "bool_and_not": _with(_flags("<eran> and not <eror>")),
        "bool_paren": _with(_flags("(<thtion> or <erth>) and (<one> or not <eror>) and not <thing>")),
        "bool_words": _with(_flags("<thtion> and <erbl> or <eran> and <eror>")),
        "bool_stop_operand": _with("select doc_id from docs where dl > 0"),
        "bool_unranked": _with(_flags("<thtion> and <erbl>") + " order by doc_id limit 10"),
        "bool_then_bm25": _with(_top(_scores({"thtion": 1.0, "erbl": 1.0}, where=f"where doc_id in ({_flags('<thtion> and <erbl>')})"))),
        "bool_overfetch": _with(_top(f"select doc_id, source, score from ({_top(_scores({'thtion': 1.0, 'erbl': 1.0}), 100)}) where doc_id in ({_flags('<thtion> and <erbl>')})")),
        "kw_technique": f"select keyword, tid from ({_KW})",
        "technique_cve": _with("select tid, cve_id from pair where overlap >= 3", _PAIRS),
        "technique_map": _with("select tid, string_agg(cve_id, ' ' order by cve_id) as cves from pair where overlap >= 3 group by 1", _PAIRS),
        "expand_weights": _with("select * from e", _PAIRS, _KWC, _EXP),
        "bm25_expanded": _with(_top(_scores_of("select term, weight from e")), _WHOLE_PAIRS, _KWC, _EXP),
        "result_urls": f"select doc_id, case when doc_id like 'CVE-%' then 'https://nvd.nist.gov/vuln/detail/' || doc_id else 'https://attack.mitre.org/techniques/' || replace(doc_id, '.', '/') || '/' end as url, case source when 'attack' then 'ATT&CK' else 'NVD' end as label, source as inferred from ({_CORPUS})",
        "result_page": _with(f"select rank, round(score, 4) as score, case source when 'attack' then 'ATT&CK' else 'NVD' end as label, doc_id, case when doc_id like 'CVE-%' then 'https://nvd.nist.gov/vuln/detail/' || doc_id else 'https://attack.mitre.org/techniques/' || replace(doc_id, '.', '/') || '/' end as url from ({_top(_scores(_Q3))})"),
        "topic_tokens": f"select doc_id, array_to_string(tokens, ' ') as tokens from ({_TOPIC})",
        "topic_corpus": f"select doc_id, len(tokens)::int as n from ({_TCORP})",
        "topic_vocab": f"with t as materialized ({_TCORP}) select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from t) group by 1 having count(*) >= 10 and count(*) <= 0.4 * (select count(*) from t) order by df desc, term limit 100000",
        "tactic_topic_heatmap": _heat(False),
        "tactic_topic_distinct": _heat(True),
        "tactic_titles": f"select tid, tactic as title from ({_TACTIC})",
        "lsa_weights": _with("select term, doc_id, round(tf * ln((n - df + 0.5) / (df + 0.5) + 1), 6) as value from post join stat using (term), coll"),
        "source_feeds": "select 'CVE-2024-' || doc_id as doc_id, 'nvd' as source, coalesce(text, '') || case when doc_id % 2 = 0 then ' CWE-79 Patch Vendor Bulletin Exploit' else ' CWE-1' end as text from documents",
        "source_bundle": "select 'T' || (1000 + item_id) as doc_id, 'attack' as source, text[1:40] || ' note  ' || replace(text, chr(10), ' ') || ' watch Windows Logs ' || phase as text from (select *, replace(lower(tactic), ' ', '-') as phase from benchmark join (" + _TACTIC + ") on tid = 'T' || (1000 + item_id)) where item_id % 5 <> 0 and item_id % 7 <> 0 and item_id % 11 <> 0",
        "source_tactics": f"select tid, tactic from ({_TACTIC}) where (substr(tid, 2)::bigint - 1000) % 11 <> 0",
        "corpus_files": f"select doc_id, source, tokens as text from ({_tokens('index')})",
        "postings_files": _with("select word_code, term, doc_id, tf, source from post join (select term, (row_number() over (order by term) - 1)::int as word_code from stat) using (term)"),
        "technique_map_file": _with("select tid, cve_id from pair where overlap >= 3", _PAIRS),
        "map_totals": _with("select count(distinct tid) as n_techniques, count(*) as n_pairs from pair where overlap >= 3", _PAIRS),
        "saved_bm25": _with(_top(_scores(_Q3))),
        "saved_dictionary": _with("select term, (row_number() over (order by term) - 1)::int as word_code from stat"),
        "saved_postings": _with("select term, doc_id, source, tf from post where term in ('thtion', 'erbl', 'the', 'nosuchterm')"),
        "saved_bm25_expanded": _with(_top(_scores_of("select term, weight from e")), _WHOLE_PAIRS, _KWC, _EXP),
        "dominant_topic": f"select doc_id, (list_position(p, list_max(p)) - 1)::int as dominant_topic, round(list_max(p), 6) as confidence from (select doc_id, list_transform(range({N_TOPICS}), lambda i: ((doc_id * 7 + i * 13) % 29)::double / 29) as p from documents)",
        "topic_top_terms": f"with {_RULE_WEIGHTS} select topic_id, word, round(weight, 9) as weight from wl where k <= 15",
        "topic_top_labels": f"with {_RULE_WEIGHTS} select topic_id, 'T' || lpad(topic_id::varchar, 2, '0') || ': ' || string_agg(word, ', ' order by k) as label from wl where k <= 3 group by 1",
        # windows are listed one by one here
        "coherence_windows": f"""with {_RULE_WEIGHTS}, top as (select topic_id, word from wl where k <= 5), used as (select distinct word from top),
            pos as (select doc_id, greatest(len(tokens) - 10, 0) as last, unnest(tokens) as word, unnest(range(len(tokens))) as p from tc),
            held as materialized (select distinct doc_id, word, unnest(range(greatest(0, p - 9), least(p, last) + 1)) as w from pos semi join used using (word)),
            near as (select distinct x.word as a, y.word as b from top x join top y using (topic_id) where x.word < y.word)
            select '' as a, '' as b, sum(greatest(len(tokens) - 10, 0) + 1)::bigint as n from tc union all select word, word, count(*) from held group by 1
            union all select x.word, y.word, count(*) from held x join near on near.a = x.word join held y on y.word = near.b and y.doc_id = x.doc_id and y.w = x.w group by 1, 2""",
        "semantic_saved": _with("select 'term' as kind, term as name, len(vec)::int as n, round(vec[1]::double, 6) as first from tv union all select 'document', 'CVE-2024-' || vec_id, len(embedding)::int, round(embedding[1]::double, 6) from embeddings", *_MODEL),
        "semantic_query_vectors": _with("select query_id, j, round(x / (sqrt(sum(x * x) over (partition by query_id)) + 1e-10), 6) as x from (select doc_id as query_id, j, sum(x) as x from qt join tj using (term) group by 1, 2)", *_MODEL,
                                        f"qt as materialized ({analyzer.terms_sql(_FIRST8, 'query')})"),
        "semantic_top10": _with(_top(_near(("thtion", "erbl", "attion"))), *_MODEL),
        "semantic_then_boolean": _with(_top(f"select doc_id, source, score from ({_top(_near(('thtion', 'erbl')), 50)}) where doc_id in ({_flags('<thtion> and <erbl>')})", 50), *_MODEL),
        "doc_lengths_file": _with("select * from docs"),
        "vector_many_top5": "select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from (select q.vec_id as query_id, v.vec_id, round(list_inner_product(v.embedding::double[], q.embedding::double[]), 6) as score from embeddings v, embeddings q where q.vec_id % 50 = 0)) where rank <= 5",
        "vector_top10": "select v.vec_id, round(list_inner_product(v.embedding::double[], q.embedding::double[]), 6) as score from embeddings v, embeddings q where q.vec_id = 0 order by score desc, v.vec_id limit 10",
    }


FLAGSHIP = "bm25_expanded"
