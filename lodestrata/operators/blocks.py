"""Postings in blocks of numbered documents: ranking that skips blocks, and Boolean queries on bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.scratch import Written
from . import boolean
from .index import Index, numbered
from .rank import SCORERS, idf, known, top

#: Documents of a block: the fewer, the closer its bounds (64 at most, the bits of a long); blocks that are scored first
#: for a threshold, and terms of a query up to which bounds are those of single documents.
SIZE, PROBED, CLOSE = 16, 16, 16
#: Scores are compared to so many digits.
DIGITS = 6
#: Documents of a run, of which ranges are made (whole blocks), words of a range, and postings that a task of build() holds.
RUN, TASK, HELD = 16 * SIZE, 4_000_000, 250_000
#: Rows that a task of save() sorts.
SORTED = 1_000_000
#: Rows of Blocks.lists.
_BOUNDS = [f"{s}{k}" for s in SCORERS for k in ("", "_weighted")]
FIELDS = ["term", "block", "n", "bits", *_BOUNDS, "list"]
SCHEMA = f"term string, block int, n int, bits long, {', '.join(f'{x} double' for x in _BOUNDS)}, list array<struct<slot:int,tf:int,dl:int,attack:boolean>>"


@dataclass
class Blocks:
    """docs: code, doc_id, source, dl. lists: term, block, n, bits, the largest parts of scores, and list (slot, tf, dl, attack).

    Codes number documents by source and length, so documents of a block contribute alike. bits has a one for each document of
    the block with the term; universe (block, bits) one for each with any term.
    """
    docs: DataFrame
    lists: DataFrame
    universe: DataFrame
    written: Written | None = None

    def save(self, path: str) -> None:
        """Lists by term and block, so that a query reads its terms' pages, and of those only what it selects. Those that build()
        wrote are in that order a batch of blocks and stay so, as another would shuffle all of them."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.docs.repartitionByRange(parts, "code").sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/docs")
        lists = self.lists if self.written is not None else self.lists.repartitionByRange(max(parts, self.lists.count() // SORTED), "term", "block").sortWithinPartitions("term", "block")
        lists.write.mode("overwrite").parquet(f"{path}/lists")
        self.universe.write.mode("overwrite").parquet(f"{path}/universe")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Blocks:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("docs", "lists", "universe")))

    def release(self) -> None:
        for x in (self.docs, self.lists, self.universe):
            x.unpersist()
        if self.written is not None:
            self.written.drop()


@dataclass(frozen=True)
class Read:
    """What a query scored of what it would have without skipping."""
    postings: int
    of_postings: int
    blocks: int
    of_blocks: int


def _part(scorer: str, tf, dl, avg_dl: float, log=F.log):
    """A posting's score but for what all of its term's postings have in common; of columns, or with log=np.log of arrays."""
    if scorer == "tfidf":
        return 1 + log(tf)
    return tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * dl / max(avg_dl, 1.0)))


def _boost(attack: Column) -> Column:
    return F.when(attack, L.ATTACK_WEIGHT).otherwise(1.0)


def _bit(slot: str) -> Column:
    return F.expr(f"bit_or(shiftleft(1L, {slot}))")


def _key() -> Column:
    """What documents are numbered by: source, length and id."""
    return F.concat_ws("\x01", "source", F.lpad(F.col("dl").cast("string"), 10, "0"), "doc_id")


def number(docs: DataFrame) -> DataFrame:
    """code, doc_id, source, dl: the place of each document by source, length and id."""
    x = F.split("key", "\x01", 3)
    return numbered(docs.select(_key().alias("key")), "code").select("code", x[2].alias("doc_id"), x[0].alias("source"), x[1].cast("int").alias("dl"))


def _cuts(docs: DataFrame) -> list[tuple[int, str]]:
    """First code and key of ranges of documents, each of whole blocks and some TASK words, or one run of RUN documents."""
    run = (F.col("code") / RUN).cast("int").alias("run")
    sizes = docs.groupBy(run).agg(F.sum("dl").alias("n"), F.min("code").alias("code")).orderBy("run").collect()
    most = min(TASK, sum(r["n"] for r in sizes) / docs.sparkSession.sparkContext.defaultParallelism)
    codes, held = [], most
    for r in sizes:
        if held >= most:
            codes.append(r["code"])
            held = 0
        held += r["n"]
    first = docs.sparkSession.createDataFrame([(c,) for c in codes], "code int")
    return sorted(tuple(r) for r in docs.join(F.broadcast(first), "code").select("code", _key()).collect())


def _lists(codes: np.ndarray, dl: np.ndarray, attack: np.ndarray, lists: pa.Array, avg_dl: float) -> pa.RecordBatch:
    """Rows of Blocks.lists, by term and block, of some blocks' documents (code, dl, attack, list of term and tf)."""
    row, flat = np.repeat(np.arange(len(codes)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
    term, tf = flat.field(0).dictionary_encode(), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int32)
    names = term.dictionary.take(pc.array_sort_indices(term.dictionary))
    t, block = pc.index_in(term.dictionary, names).to_numpy(zero_copy_only=False)[term.indices.to_numpy(zero_copy_only=False)].astype(np.int64), codes // SIZE
    key = t * (block[-1] - block[0] + 1) + (block - block[0])[row]
    order = np.argsort(key, kind="stable")
    key, row, tf, t = key[order], row[order], tf[order], t[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    slot, d, a = (codes % SIZE)[row], dl[row], attack[row]
    of = lambda f, x: f.reduceat(x, at) if len(at) else x
    bounds = {s: _part(s, tf.astype(np.float64), d, avg_dl, np.log) for s in SCORERS}
    most = [pa.array(of(np.maximum, b * w)) for b in bounds.values() for w in (1.0, np.where(a, L.ATTACK_WEIGHT, 1.0))]
    one = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(tf), pa.array(d), pa.array(a)], names=["slot", "tf", "dl", "attack"])
    ends = np.r_[at, len(key)].astype(np.int32)
    columns = [names.take(pa.array(t[at])), pa.array(block[row[at]].astype(np.int32)), pa.array(np.diff(ends)), pa.array(of(np.bitwise_or, np.int64(1) << slot)), *most, pa.ListArray.from_arrays(pa.array(ends), one)]
    return pa.RecordBatch.from_arrays(columns, names=FIELDS)


def _blocked(first: list[int], avg_dl: float):
    """A task of build(): rows (bucket, key, dl, attack, list) by key, those of a document one after another, become rows of
    Blocks.lists. Some HELD postings are held, or one block's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, bucket, last, code = [], 0, None, None, 0

        def made(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            codes, dl, attack = (np.concatenate([h[k] for h in held]) for k in range(3))
            lists = pa.concat_arrays([h[3] for h in held])
            # the last block may go on with the next batch
            k = len(codes) if whole else int(np.searchsorted(codes, codes[-1] // SIZE * SIZE))
            if k:
                x = _lists(codes[:k], dl[:k], attack[:k], lists.slice(0, k), avg_dl)
                yield from (x.slice(lo, 10_000) for lo in range(0, x.num_rows, 10_000))
            held = [(codes[k:], dl[k:], attack[k:], lists.slice(k))] if k < len(codes) else []
            n = sum(len(h[3].flatten()) for h in held)

        for b in (b.slice(lo, 64) for b in batches for lo in range(0, b.num_rows, 64)):
            keys, of = b.column(1).to_pylist(), b.column(0).to_pylist()
            codes = np.empty(len(keys), np.int64)
            for i, (k, of_k) in enumerate(zip(keys, of)):
                code = first[of_k] if of_k != bucket else code + (k != last)
                codes[i], bucket, last = code, of_k, k
            held.append((codes, b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(bool), b.column(4)))
            n += len(b.column(4).flatten())
            if n >= HELD:
                yield from made(False)
        if held:
            yield from made(True)

    return run


def build(index: Index) -> Blocks:
    """Blocks of an index, whose docs have every document of its postings. A block has SIZE documents at most.

    Documents with their lists are dealt by ranges of numbers that begin at blocks, and sorted within them: a task counts
    numbers on, so neither postings nor blocks are shuffled one by one.
    """
    docs = number(index.docs).persist()
    cuts = _cuts(docs)
    some = docs.where("dl > 0").select(F.floor(F.col("code") / SIZE).cast("int").alias("block"), (F.col("code") % SIZE).cast("int").alias("slot")).groupBy("block").agg(_bit("slot").alias("bits")).persist()
    if not cuts:
        return Blocks(docs, index.docs.sparkSession.createDataFrame([], SCHEMA), some)
    starts = F.array(*(F.lit(k) for _, k in cuts))
    bucket = (F.size(F.filter(starts, lambda k: k <= F.col("key"))) - 1).alias("bucket")
    rows = index.by_document().select(_key().alias("key"), "dl", (F.col("source") == "attack").alias("attack"), "part", "list")
    rows = rows.select(bucket, "key", "dl", "attack", "part", "list").repartitionById(len(cuts), "bucket").sortWithinPartitions("bucket", "key", "part")
    lists = Written(rows.select("bucket", "key", "dl", "attack", "list").mapInArrow(_blocked([c for c, _ in cuts], index.avg_dl), SCHEMA))
    return Blocks(docs, lists.df, some, lists)


def _weighed(index: Index, weights: dict[str, float] | DataFrame) -> tuple[DataFrame, list[str] | None]:
    """term, factor (weight times idf) of a query's terms that the index has; the terms if they are few."""
    s = index.stats
    if not isinstance(weights, DataFrame):
        s = s.where(F.col("term").isin(list(weights)))
        weights = index.docs.sparkSession.createDataFrame(sorted(weights.items()), "term string, weight double")
        return F.broadcast(s.join(F.broadcast(weights), "term").select("term", (F.col("weight") * idf(F.col("df"), index.n_docs)).alias("factor"))), [r["term"] for r in weights.collect()]
    return known(s.join(weights.select("term", "weight"), "term").select("term", (F.col("weight") * idf(F.col("df"), index.n_docs)).alias("factor")), "term")


def _scored(lists: DataFrame, scorer: str, avg_dl: float, source_weight: bool) -> DataFrame:
    """code, score of the documents in some blocks' lists (term, block, list, factor)."""
    x = lists.select("block", "factor", F.inline("list"))
    one = _part(scorer, F.col("tf"), F.col("dl"), avg_dl) * F.col("factor") * (_boost(F.col("attack")) if source_weight else 1.0)
    return x.groupBy((F.col("block") * SIZE + F.col("slot")).alias("code")).agg(F.sum(one).alias("score"))


def _bounds(mine: DataFrame, few: list[str] | None, bound: str) -> DataFrame:
    """block, n (postings of the query's terms), most: what a document of the block scores at most.

    Bits tell which terms a document has, so a bound is the largest of its documents' sums of those terms' largest parts. Of a
    query of more than CLOSE terms it is the sum for all terms that the block has.
    """
    part = F.col(bound) * F.col("factor")
    if few is None or len(few) > CLOSE:
        return mine.groupBy("block").agg(F.sum("n").alias("n"), F.sum(part).alias("most"))
    of = lambda x, i: F.max(F.when(F.col("term") == few[i], x))
    x = mine.groupBy("block").agg(F.sum("n").alias("n"), *(of(part, i).alias(f"w{i}") for i in range(len(few))), *(of(F.col("bits"), i).alias(f"b{i}") for i in range(len(few))))
    has = lambda i, k: F.coalesce(F.col(f"b{i}"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << k).cast("long")) != 0
    sums = [reduce(Column.__add__, (F.when(has(i, k), F.col(f"w{i}")).otherwise(0.0) for i in range(len(few)))) for k in range(SIZE)]
    return x.select("block", "n", F.greatest(*sums).alias("most"))


def search(blocks: Blocks, index: Index, weights: dict[str, float] | DataFrame, n: int = 10, scorer: str = "bm25", source_weight: bool = True) -> tuple[DataFrame, Read]:
    """rank.top() of rank.score(), from fewer postings: rank, doc_id, source, score, and what was read.

    Blocks of the largest bounds (see _bounds) are scored first, PROBED or as many as results are wanted; the n-th best score
    there is a threshold that every result reaches. So blocks whose bound is below it are never scored, and all
    others are, whole: the result is exact. Bounds come from a few columns of one row for each term and
    block; lists are read for the blocks that are left.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}")
    if isinstance(weights, dict) and not weights:
        return index.docs.sparkSession.createDataFrame([], "rank int, doc_id string, source string, score double"), Read(0, 0, 0, 0)
    q, few = _weighed(index, weights)
    lists = blocks.lists.where(F.col("term").isin(few)) if few is not None else blocks.lists
    mine = lists.join(q, "term")
    most = _bounds(mine, few, f"{scorer}{'_weighted' if source_weight else ''}")
    first = most.orderBy(F.desc("most"), "block").limit(max(PROBED, n))
    seen = _scored(mine.join(F.broadcast(first.select("block")), "block", "left_semi"), scorer, index.avg_dl, source_weight)
    best = seen.orderBy(F.desc("score")).limit(n).collect()
    # what rounds to the same score may still win by its id
    least = best[-1]["score"] - 10.0**-DIGITS if len(best) == n else float("-inf")
    left = F.col("most") >= least
    c = most.agg(F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("of_p"), F.count_if(left).alias("b"), F.count("*").alias("of_b")).first()
    found = _scored(mine.join(most.where(left).select("block"), "block", "left_semi"), scorer, index.avg_dl, source_weight)
    # ids are needed to break ties, so those of all documents that reach the threshold are looked up
    found = found.where(F.col("score") >= least).join(blocks.docs.select("code", "doc_id", "source"), "code").select("doc_id", "source", "score")
    return top(found, n, DIGITS), Read(c["p"], c["of_p"], c["b"], c["of_b"])


def fits(blocks: Blocks, tree) -> DataFrame:
    """doc_id of the documents that fit a Boolean query (see boolean.parse): boolean.execute() on bits.

    Each term's bits of a block are one long; AND, OR and NOT are bitwise operations on them, NOT against the universe's
    bits. Documents are told by number until the result's ids are looked up.
    """
    words = boolean.terms_of(tree)
    bits = [F.bit_or(F.when(F.col("term") == w, F.col("bits"))).alias(f"b{i}") for i, w in enumerate(words)]
    x = blocks.lists.where(F.col("term").isin(words)).groupBy("block").agg(*bits) if words else blocks.universe.select("block").limit(0)
    if boolean.has_not(tree):
        x = blocks.universe.withColumnRenamed("bits", "all").join(x, "block", "left")
    place = {w: i for i, w in enumerate(words)}
    none = F.lit(0).cast("long")

    def value(t) -> Column:
        if isinstance(t, boolean.Term):
            return reduce(Column.bitwiseAND, (F.coalesce(f"b{place[w]}", none) for w in t.words)) if t.words else none
        parts = [value(p) for p in t.parts]
        if t.kind == "not":
            return F.col("all").bitwiseAND(F.bitwise_not(parts[0]))
        return parts[0].bitwiseAND(parts[1]) if t.kind == "and" else parts[0].bitwiseOR(parts[1]) if t.kind == "or" else parts[0].bitwiseAND(F.bitwise_not(parts[1]))

    hit = x.select("block", value(tree).alias("bits")).where("bits <> 0")
    codes = hit.select(F.col("block"), F.explode(F.expr(f"filter(sequence(0, {SIZE - 1}), i -> (shiftrightunsigned(bits, i) & 1) = 1)")).alias("slot"))
    return codes.select((F.col("block") * SIZE + F.col("slot")).alias("code")).join(blocks.docs.select("code", "doc_id"), "code").select("doc_id")
