"""Mixing sources to target weights, by blocks of packed words."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 256
SHARD_SLOTS = 1024
SEED = 20_240_601
#: Documents of a source that one task numbers.
BUCKET_DOCS = 512


def targets(sizes: dict, weights=WEIGHTS, most: float = MAX_REPEATS) -> dict:
    """Words for each source: its weight's share of all words, at most `most` times its size.

    sizes: source to number of words. Sources take the weights in turn by code point, null last.
    What a source cannot take is shared by weight among those below their limit, until none is
    above. One entry per source, so driver-side.
    """
    # UTF-8 keeps the order of code points
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        t = {s: float(most * sizes[s]) if s in full else left * w[s] / open_w for s in order}
        over = {s for s in order if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over
        if len(full) == len(order):
            return {s: float(most * sizes[s]) for s in order}


def _multinomial(rng: random.Random, n: int, p: list[float]) -> list[int]:
    """Counts of n draws, one binomial per category given those before."""
    out, rest = [], sum(p)
    for x in p:
        k = rng.binomialvariate(n, min(1.0, max(0.0, x / rest))) if n and rest > 0 and x > 0 else 0
        out.append(k)
        n, rest = n - k, rest - x
    return out


def plan_shards(slots: dict, per_shard: int = SHARD_SLOTS, seed: int = SEED, shards: int = 4096, run: int = 65_536):
    """Rows (shard, source index, first slot, number) that share each source's slots out over shards.

    Each shard draws multinomial source counts, with the slots that the sources still have to give
    as probabilities, so every source ends at its number; a draw above what is left is cut and the
    next shards make up for it. There are at most about `shards` shards; rows hold at most `run`
    slots. Shards and counts only, never blocks.
    """
    names = list(slots)
    left, at, shard = [slots[s] for s in names], [0] * len(names), 0
    per_shard = max(per_shard, -(-sum(left) // shards))
    while any(left):
        rng = random.Random(f"{seed}/{shard}")
        counts = [min(a, b) for a, b in zip(_multinomial(rng, per_shard, [float(x) for x in left]), left)]
        for i, k in enumerate(counts):
            for first in range(at[i], at[i] + k, run):
                yield shard, i, first, min(run, at[i] + k - first)
            at[i], left[i] = at[i] + k, left[i] - k
        shard += 1


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 that is computed for each index alone.

    Rounds that add a hash of one coordinate to the other permute the grid of a x b places, where a
    is the root of n and a * b exceeds n by less than a; from a place beyond n the walk goes on.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turn(v):
        def one(s, r):
            x = F.pmod(s["x"] + F.pmod(F.xxhash64(s["y"], key, r), a), a)
            return F.struct(x.alias("x"), F.pmod(s["y"] + F.pmod(F.xxhash64(x, key, r + 100), b), b).alias("y"))
        return F.aggregate(F.array(*map(F.lit, range(3))), F.struct(F.floor(v / b).cast("long").alias("x"), F.pmod(v, b).alias("y")), one, lambda s: s["x"] * b + s["y"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), turn(index), lambda v, _: F.when(v < n, v).otherwise(turn(v)))
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(walked)


def _sizes(docs: DataFrame) -> list:
    """source, size, docs: a row for each source, of which there are as many as weights to set."""
    return docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()


def place(docs: DataFrame, n: list) -> DataFrame:
    """Each row's first word in its source's stream: docs with at (long).

    docs: source, size, key (orders a source's rows); n: its _sizes(). Rows go to buckets by hash, a bucket's words
    are summed with map-side combination, and only bucket sums are run through a window by source;
    the rows are numbered inside their bucket. So a source with a third of all rows is spread over
    all tasks.
    """
    buckets = max([1, *(-(-r["docs"] // BUCKET_DOCS) for r in n)])
    d = docs.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), (F.sum("s").over(
        W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).alias("base"))
    sums = C.cut(sums)
    if buckets * len(n) <= 100_000:
        sums = F.broadcast(sums)
    d = d.withColumn("own", F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(sums, d.source.eqNullSafe(F.col("s_source")) & (d.bucket == F.col("s_bucket")), "left")
    return d.withColumn("at", F.coalesce("base", F.lit(0)) + F.col("own")).drop("own", "base", "s_source", "s_bucket", "bucket")


def slots_of(spark: SparkSession, sizes: dict, goal: dict, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as slots: shard, source, slot, turn, block (index in its source), words.

    Slot j of a source is block perm(j mod blocks) of turn j div blocks, with a permutation of its
    own for each turn; so no block is used once more before all were. A source's tail block is
    short, and the last slots are cut where its words reach the rounded target. Words before a slot
    follow from its number and from whether the tail came earlier in its turn, so there is no
    running sum; tails are at most MAX_REPEATS rows a source.
    """
    names = sorted((s for s in sizes if sizes[s] > 0), key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    blocks = {s: -(-sizes[s] // block) for s in names}
    need = {s: min(round(goal[s]), MAX_REPEATS * sizes[s]) for s in names}
    # one slot more than needed in the last turn, as the tail may lie in it
    slots = {s: min((x := divmod(need[s], sizes[s]))[0] * blocks[s] + (x[1] > 0) * (-(-x[1] // block) + 1), -(-need[s] // sizes[s]) * blocks[s]) for s in names}
    rows = list(plan_shards(slots, seed=seed))
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0)], "shard long, i int, first long, n long").where("n > 0")
    about = spark.createDataFrame([(i, s, sizes[s], blocks[s], need[s]) for i, s in enumerate(names)] or [(-1, None, 1, 1, 0)], "i int, source string, size long, blocks long, need long")
    s = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "i", "first").join(F.broadcast(about), "i")
    s = s.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    s = s.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("pos", F.col("slot") % F.col("blocks"))
    s = s.withColumn("block", permuted(F.col("pos"), F.col("blocks"), F.concat_ws("/", F.lit(seed), "i", "turn")))
    s = s.withColumn("full", F.least(F.lit(block), F.col("size") - F.col("block") * block))
    s = C.cut(s)
    tail = s.where(F.col("block") == F.col("blocks") - 1).select("i", "turn", F.col("pos").alias("tail_pos"), (block - F.col("full")).alias("short"))
    s = s.join(F.broadcast(tail), ["i", "turn"], "left")
    before = F.col("turn") * F.col("size") + F.col("pos") * block - F.when(F.col("tail_pos") < F.col("pos"), F.col("short")).otherwise(0)
    s = s.withColumn("words", F.greatest(F.lit(0), F.least("full", F.col("need") - before)))
    return s.where("words > 0").select("shard", "i", "source", "slot", "turn", "block", "words")


def mix(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each placed row (source, at, size > 0) gives to the mix.

    Rows are cut at block borders and joined to slots by source and block index. Returns source,
    at (together a row's identity), taken, and runs: array<struct<turn, first, last>> of its words,
    counted from 0, last excluded. A row has at most MAX_REPEATS runs for each of its blocks.
    """
    b = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    pieces = placed.where("size > 0").select("source", "at", "size", b.alias("block"))
    s = slots.select(F.col("source").alias("ss"), F.col("block").alias("sb"), "turn", "words")
    j = pieces.join(s, pieces.source.eqNullSafe(s.ss) & (pieces.block == s.sb))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("at"))
    last = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("at"))
    j = j.select("source", "at", "turn", first.alias("first"), last.alias("last")).where("last > first")
    return j.groupBy("source", "at").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.sort_array(F.collect_list(F.struct("turn", "first", "last"))).alias("runs"))


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, key; key makes rows with equal ids and texts interchangeable only."""
    return docs.select("doc_id", "source", *more, C.count_words(F.col("text")).alias("size"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of documents.

    Null or empty texts have size 0 and taken 0. A null source is a source. Repeated rows are laid
    out one after the other and each has its own row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = C.cut(_measured(docs))
    n = _sizes(d)
    sizes = {r["source"]: r["size"] for r in n}
    placed = place(d, n)
    goal = targets(sizes, weights)
    placed = C.cut(placed.select("doc_id", "source", "size", "at"))
    got = mix(placed, slots_of(spark, sizes, goal, block, seed), block).select(F.col("source").alias("gs"), F.col("at").alias("ga"), "taken")
    about = spark.createDataFrame([(s, int(sizes[s]), float(goal[s])) for s in sizes] or [("", 0, 0.0)], "s string, source_size long, target double")
    out = placed.join(got, placed.source.eqNullSafe(F.col("gs")) & (placed.at == F.col("ga")) & (placed.size > 0), "left")
    out = out.join(F.broadcast(about), out.source.eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", F.col("size").cast("long"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of docs: one row for each turn that takes a document.

    A row whose whole text is taken keeps it; another holds the taken words, joined by a space.
    n_chars, if there, is that of the new text. Documents of which nothing is taken are left out.
    """
    spark = docs.sparkSession
    d = C.cut(_measured(docs))
    n = _sizes(d)
    sizes = {r["source"]: r["size"] for r in n}
    placed = C.cut(place(d, n).select("source", "size", "at"))
    got = mix(placed, slots_of(spark, sizes, targets(sizes, weights), block, seed), block).select(F.col("source").alias("gs"), F.col("at").alias("ga"), "runs")
    # the same rows with their texts: the order of equal keys is free, as such rows are equal
    names = [c for c in docs.columns if c not in ("doc_id", "source")]
    wide = docs.select("doc_id", "source", F.struct(*(docs[c] for c in names)).alias("__row"), C.count_words(F.col("text")).alias("size"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    wide = place(wide, n)
    out = wide.join(got, wide.source.eqNullSafe(F.col("gs")) & (wide.at == F.col("ga")) & (wide.size > 0))
    turns = F.array_distinct(F.transform("runs", lambda r: r["turn"]))
    out = out.withColumn("__turn", F.explode(turns))
    out = out.withColumn("__runs", F.expr("filter(runs, r -> r.turn = __turn)"))
    taken = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])
    text = F.col("__row.text")
    part = F.array_join(C.let(C.words(text), lambda ws: F.flatten(F.transform("__runs", lambda r: F.slice(ws, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int"))))), " ")
    out = out.withColumn("__text", F.when(taken == F.col("size"), text).otherwise(part))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*(F.col(c) if c in ("doc_id", "source") else new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op9_source_mixing": (op9_source_mixing, None)}
