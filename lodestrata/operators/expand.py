"""Query expansion by techniques, and the technique to advisory map by keyword overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions import lexicon as L
from . import index

#: Terms of techniques up to which the driver and each task hold them: some 40 MB.
BROADCAST_TERMS = 1_000_000
#: Counters, and matches of terms, that a task holds at once.
COUNTERS, MATCHES = 2_000_000, 1_000_000
#: Characters of description and detection that the map of techniques by itself takes; expansions take whole texts.
BEGINNING = 500, 200


def kw_technique(techniques: DataFrame) -> DataFrame:
    """keyword, tid from techniques (tid, name, description, detection, platforms, data_sources)."""
    c = lambda x: F.coalesce(x, F.lit(""))
    full = F.concat_ws(" ", c(F.col("name")), c(F.col("description")), c(F.col("detection")), F.array_join(F.coalesce("platforms", F.array()), " "), F.array_join(F.coalesce("data_sources", F.array()), " "))
    return analyzer.keywords(techniques.select("tid", c(F.col("name")).alias("name"), full.alias("full_text"))).select("keyword", "tid")


def technique_terms(techniques: DataFrame, beginning: tuple[int, int] | None = None) -> DataFrame:
    """tid, term without repeats, of name, description, detection, platforms; query analyzer.

    beginning: how many characters of description and detection are taken; all of them without it.
    """
    c = lambda x: F.coalesce(x, F.lit(""))
    long = [c(F.col(x)) for x in ("description", "detection")]
    if beginning is not None:
        long = [F.substring(x, 1, n) for x, n in zip(long, beginning)]
    text = F.concat_ws(" ", c(F.col("name")), *long, F.array_join(F.coalesce("platforms", F.array()), " "))
    t = analyzer.term_counts(techniques.select(F.upper("tid").alias("doc_id"), text.alias("text")), "query")
    return t.select(F.col("doc_id").alias("tid"), "term").distinct()


def _prefixes(sets: DataFrame, key: str, common: DataFrame, min_overlap: int) -> DataFrame:
    """key, term: each set's terms but its min_overlap - 1 most frequent ones; sets with fewer terms than min_overlap have none.

    common: term, n (how many sets of the other side hold it), which orders all sets alike. Two sets that share
    min_overlap terms share the least frequent of those, and it is among these terms of both.
    """
    s = sets.join(common, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("ts"))
    first = F.slice("ts", F.lit(1), F.size("ts") - (min_overlap - 1))
    return s.where(F.size("ts") >= min_overlap).select(key, F.explode(first).alias("t")).select(key, "t.term")


def overlaps(left: DataFrame, right: DataFrame, min_overlap: int) -> DataFrame:
    """a, b, overlap of each two sets of left (a, term) and right (b, term) that share at least min_overlap terms.

    For sides of any size. Terms that only one side has are left out first, which shortens the sets. Then
    prefixes only are joined (see _prefixes), so the most frequent terms, whose pairs are most, join
    little or nothing; pairs found are verified on all terms.
    """
    common = left.groupBy("term").agg(F.count("*").alias("x")).join(right.groupBy("term").agg(F.count("*").alias("y")), "term").select("term", (F.col("x") * F.col("y")).alias("n"))
    pairs = _prefixes(left, "a", common, min_overlap).join(_prefixes(right, "b", common, min_overlap), "term").select("a", "b").distinct()
    return pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= min_overlap)


def _parts(b: pa.RecordBatch, starts: np.ndarray, names: int):
    """A batch's rows (a, codes) in ranges of at most COUNTERS counters and MATCHES matches, or of one row, whose matches its codes bound."""
    ends = b.column(1).offsets.to_numpy()
    c = b.column(1).values.to_numpy()[ends[0]:ends[-1]]
    matches = np.r_[0, np.cumsum(starts[c + 1] - starts[c])][ends - ends[0]]
    lo, most = 0, max(1, COUNTERS // max(1, names))
    while lo < b.num_rows:
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(matches, matches[lo] + MATCHES, "right")) - 1))
        yield lo, min(hi, b.num_rows)
        lo = hi


def _taxonomy(known: list[tuple[str, str]]) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray]:
    """Names, codes of terms, and for each code where the places of its names begin, and all these places, of a list of (name, term)."""
    names, terms = sorted({b for b, _ in known}), sorted({t for _, t in known})
    place, code = {b: k for k, b in enumerate(names)}, {t: k for k, t in enumerate(terms)}
    of = np.array(sorted((code[t], place[b]) for b, t in known), np.int64).reshape(-1, 2)
    return names, code, np.searchsorted(of[:, 0], np.arange(len(terms) + 1)), of[:, 1]


def _hits(b: pa.RecordBatch, names: list[str], starts: np.ndarray, others: np.ndarray, min_overlap: int):
    """Batches a, b, overlap: how many of the codes of each row (a, codes) each name has, where these are enough."""
    for b in (b.slice(lo, hi - lo) for lo, hi in _parts(b, starts, len(names))):
        ends = b.column(1).offsets.to_numpy()
        c = b.column(1).values.to_numpy()[ends[0]:ends[-1]]
        n = starts[c + 1] - starts[c]
        # of each code of each set all its others: places in a list of all
        at = np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(ends)), n)
        count = np.bincount(row * len(names) + others[at], minlength=b.num_rows * len(names))
        hit = np.flatnonzero(count >= min_overlap)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit // max(1, len(names)))), pa.array(names, pa.string()).take(pa.array(hit % max(1, len(names)))), pa.array(count[hit], pa.int64())], names=["a", "b", "overlap"])


def _counted(sets: DataFrame, known: list[tuple[str, str]], min_overlap: int) -> DataFrame:
    """The same for right sets known as a list of (b, term), which each task holds: a, b, overlap.

    A set of the left side meets in one row the codes of its terms that are known at all; a task counts how often each
    b has one of them. So no row is made for a pair that shares too few.
    """
    spark = sets.sparkSession
    names, code, starts, others = _taxonomy(known)
    shared = spark.sparkContext.broadcast((names, starts, others))
    codes = F.broadcast(spark.createDataFrame(list(code.items()), "term string, code int"))
    held = sets.join(codes, "term").groupBy("a").agg(F.collect_list("code").alias("codes")).where(F.size("codes") >= min_overlap)

    def run(batches):
        for b in batches:
            yield from _hits(b, *shared.value, min_overlap)

    return held.mapInArrow(run, "a string, b string, overlap long")


def _counted_texts(texts: DataFrame, known: list[tuple[str, str]], min_overlap: int) -> DataFrame:
    """The same for texts (a, text): a text's terms are counted where it is analysed, so none becomes a row."""
    shared = texts.sparkSession.sparkContext.broadcast(_taxonomy(known))

    def run(batches):
        names, code, starts, others = shared.value
        for b in (b.slice(k, analyzer.SLICE) for b in batches for k in range(0, b.num_rows, analyzer.SLICE)):
            sets = [[code[t] for t in code.keys() & analyzer.term_set(x)] for x in b.column(1).to_pylist()]
            yield from _hits(pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["a", "codes"]), names, starts, others, min_overlap)

    return texts.select("a", "text").mapInArrow(run, "a string, b string, overlap long")


def _advisories(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").rlike(r"(?i)^CVE-\d{4}-\d+$"))


def _known(terms: DataFrame) -> list[tuple[str, str]] | None:
    """Techniques' terms as a list of (tid, term), if they are at most BROADCAST_TERMS."""
    known = terms.limit(BROADCAST_TERMS + 1).collect()
    return [(r["tid"], r["term"]) for r in known] if len(known) <= BROADCAST_TERMS else None


def technique_cve(postings: DataFrame, techniques: DataFrame, min_overlap: int = L.MIN_OVERLAP, beginning: tuple[int, int] | None = None) -> DataFrame:
    """tid, cve_id, overlap: advisories that share at least min_overlap terms with a technique (see technique_terms).

    Techniques are a taxonomy: while they have at most BROADCAST_TERMS terms, tasks hold them and count (see
    _counted); beyond that both sides are joined by prefixes of their terms (see overlaps).
    """
    t = technique_terms(techniques, beginning)
    p = _advisories(postings).select(F.upper("doc_id").alias("a"), "term")
    if (known := _known(t)) is not None:
        hits = _counted(p, known, min_overlap)
    else:
        hits = overlaps(p, t.withColumnRenamed("tid", "b"), min_overlap)
    return hits.select(F.col("b").alias("tid"), F.col("a").alias("cve_id"), "overlap")


def technique_cve_of_texts(corpus: DataFrame, techniques: DataFrame, min_overlap: int = L.MIN_OVERLAP, beginning: tuple[int, int] | None = None) -> DataFrame:
    """The same from a corpus (doc_id, source, text; unique ids), where no index is there: nothing but texts is shuffled.

    Only techniques of more than BROADCAST_TERMS terms need postings.
    """
    docs = _advisories(corpus)
    if (known := _known(technique_terms(techniques, beginning))) is None:
        return technique_cve(index.Index.build(docs).postings, techniques, min_overlap, beginning)
    texts = analyzer.spread(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    hits = _counted_texts(texts.select(F.upper("doc_id").alias("a"), "text"), known, min_overlap)
    return hits.select(F.col("b").alias("tid"), F.col("a").alias("cve_id"), "overlap")


def technique_map(pairs: DataFrame) -> DataFrame:
    """tid, its sorted cve ids; a technique's list is one row, as in the file that it is exported to."""
    return pairs.groupBy("tid").agg(F.array_sort(F.collect_set("cve_id")).alias("cves"))


def map_totals(pairs: DataFrame) -> DataFrame:
    """n_techniques, n_pairs of a map; one row, 0 for an empty one."""
    return pairs.select("tid", "cve_id").distinct().agg(F.count_distinct("tid").alias("n_techniques"), F.count("*").alias("n_pairs"))


def expand(terms: list[str], keywords: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """term, weight, origin: the terms at 1, techniques whose keyword is a term, and their advisories.

    The maximum over all reasons equals taking them in turn, as each reason's weight is above the next's.
    """
    spark = keywords.sparkSession
    q = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    hit = keywords.join(F.broadcast(q), keywords.keyword == q.term).select(F.col("tid").alias("term")).distinct()
    out = q.select("term", F.lit(1.0).alias("weight"), F.lit("query").alias("origin")).unionByName(hit.select("term", F.lit(L.TECHNIQUE_WEIGHT).alias("weight"), F.lit("technique").alias("origin")))
    if pairs is not None:
        # techniques are a taxonomy of bounded size, so the pairs stay where they are
        cves = pairs.join(F.broadcast(hit), pairs.tid == hit.term, "left_semi").select(F.col("cve_id").alias("term")).distinct()
        out = out.unionByName(cves.select("term", F.lit(L.CVE_WEIGHT).alias("weight"), F.lit("advisory").alias("origin")))
    return out.groupBy("term").agg(F.max("weight").alias("weight"), F.max_by("origin", "weight").alias("origin"))
