"""MinHash near-duplicates: banded candidates, odd sketches, confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .shingles import mix64, shingle_sets

SHINGLE = 4
PERCENT = 80
#: Bands of ROWS samples each: a pair at 0.8 shares none with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
#: Samples folded into an odd sketch of BITS bits.
SAMPLES, BITS = 480, 1024
#: Largest XOR count of a candidate: 4.7 standard deviations over the mean at 0.8, or 0.68 as an estimate.
MAX_XOR = 232
CHUNK_CHARS = 250_000
#: Rows of a bucket that one task compares with each other.
BUCKET_ROWS = 1024
#: Classes whose sets meet in one task are at most about twice this.
BLOCK_CLASSES, SALTS = 256, 4
#: A class with more shingles is a block of its own, so the sets that meet in a task take some 200 MB at most, or as
#: much as two of the longest texts'.
LARGE = 50_000
BROADCAST_IDS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20_240_607))
_XOR = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    least = None
    for i in range(0, len(s), 256):
        m = ((s[i:i + 256, None] ^ _XOR) * _MUL).min(0)
        least = m if least is None else np.minimum(least, m)
    return least


def band_keys(m: np.ndarray) -> np.ndarray:
    """A key for each band, of the band's number and its samples."""
    k = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        k = mix64(k + m[r:BANDS * ROWS:ROWS])
    return k


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples with their places: each one flips the bit that it hashes to."""
    at = mix64(m + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(bool)
    return np.packbits(odd).view(np.uint64)


def similarity_from_xor(z: float) -> float:
    """Jaccard similarity that an XOR count of two odd sketches stands for (Mitzenmacher et al. 2014)."""
    return 1 + BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * z / BITS)))


def _by_size(texts: list) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK_CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _sketch(batches):
    for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for a, z in _by_size(texts):
            sets = shingle_sets(texts[a:z], SHINGLE)
            rows = []
            for s in sets:
                if len(s):
                    m = samples(s)
                    d = (int(s.sum()), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()))
                    rows.append((len(s), *np.array(d, np.uint64).view(np.int64).tolist(), band_keys(m).view(np.int64), odd_sketch(m).tobytes()))
                else:
                    rows.append((0, None, None, None, None))
            n, d1, d2, keys, odd = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, z - a), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "odd"])


def _sets(batches):
    for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for a, z in _by_size(texts):
            yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([s.tobytes() for s in shingle_sets(texts[a:z], SHINGLE)], pa.binary())], names=["cls", "set"])


def _odd(x: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(x["odd"]), np.uint64).reshape(len(x), -1)


def _propose(best: bool):
    """Of a bucket's pairs that lie in different components and have close sketches: for each row
    the closest one (best), or else the blocks that meet (lo, hi) with the classes concerned."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 2 if best else 3), np.int64)]
        for _, x in g.groupby(["bucket", "i", "j"], sort=False):
            cls, comp, block, odd = x["cls"].to_numpy(), x["comp"].to_numpy(), x["block"].to_numpy(), _odd(x)
            part, i, j = x["part"].to_numpy(), x["i"].iat[0], x["j"].iat[0]
            left, right, found = np.flatnonzero(part == i), np.flatnonzero(part == j), []
            for these, those in [(left, right)] if i == j else [(left, right), (right, left)]:
                for k in these:
                    r = those[comp[those] != comp[k]]
                    z = np.bitwise_count(odd[r] ^ odd[k]).sum(1, dtype=np.int64)
                    r, z = r[z <= MAX_XOR], z[z <= MAX_XOR]
                    if best and len(r):
                        other = cls[r[np.argmin(z)]]
                        found.append([[min(cls[k], other), max(cls[k], other)]])
                    elif len(r):
                        # the other class of a pair speaks for itself
                        found.append([(min(block[k], x), max(block[k], x), cls[k]) for x in set(block[r].tolist())])
            if found:
                out.append(np.unique(np.concatenate(found), axis=0))
        rows = np.unique(np.concatenate(out), axis=0)
        if best:
            return pd.DataFrame(rows, columns=["a", "b"])
        met = pd.DataFrame(rows, columns=["lo", "hi", "cls"]).groupby(["lo", "hi"], sort=False)["cls"]
        keys = list(met.groups)
        return pd.DataFrame({"lo": [k[0] for k in keys], "hi": [k[1] for k in keys], "classes": pd.Series([met.get_group(k).tolist() for k in keys], dtype=object)})
    return run


class _Joined(dict):
    """Sets that have been joined; find() gives the least member."""

    def find(self, x):
        while (y := self.get(x, x)) != x:
            self[x] = self.get(y, y)
            x = y
        return x

    def join(self, x, y) -> None:
        self[max(x, y)] = min(x, y)


def _confirm_blocks(g: pd.DataFrame) -> pd.DataFrame:
    """Links between classes of two blocks whose components differ and that no other link joins yet."""
    cls, comp, odd, sets = g["cls"].to_numpy(), g["comp"].to_numpy(), _odd(g), [np.frombuffer(s, np.uint64) for s in g["set"]]
    joined, out = _Joined(), []
    for k in range(len(g) - 1):
        z = np.bitwise_count(odd[k + 1:] ^ odd[k]).sum(1, dtype=np.int64)
        near = np.flatnonzero((z <= MAX_XOR) & (comp[k + 1:] != comp[k]))
        for r in (near[np.argsort(z[near], kind="stable")] + k + 1).tolist():
            if (s := joined.find(comp[k])) != (t := joined.find(comp[r])) and similar(sets[k], sets[r]):
                joined.join(s, t)
                out.append((min(cls[k], cls[r]), max(cls[k], cls[r])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _confirm(key, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Links among the pairs, without those between classes that other links of the block join."""
    have: dict = {}
    for c, s in zip(sets["cls"], sets["set"]):
        have.setdefault(c, []).append(np.frombuffer(s, np.uint64))
    joined, out = _Joined(), []
    for a, b in zip(pairs["a"], pairs["b"]):
        if (s := joined.find(a)) != (t := joined.find(b)) and any(similar(x, y) for x in have[a] for y in have[b]):
            joined.join(s, t)
            out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= PERCENT * (len(x) + len(y) - n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text string).

    Texts with equal sets form a class with one sketch. Classes that share a band key meet in
    buckets; each is first tried against the least of its bucket, then against the closest sketch of
    another component. At last all pairs that lie in different components and have close sketches
    are tried: buckets tell which blocks of classes meet, and a block pair's task tries its classes,
    so no list of pairs is made and no link between components is lost. Pairs are confirmed on the
    full sets, and confirmed links run through distributed components. Large buckets are compared in
    chunks; a class's set travels once for each block that its own meets.

    Documents without words, or with a null text or id, link with nothing. component_id is null and
    kept true for a null id. Rows that share an id are one document: each row is returned, and links
    of any of them count for all. An empty table gives no rows. Very long texts are hashed in pieces;
    their sets, 8 bytes a word, are held whole. Other columns are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = C.cut(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, odd binary"))
    one = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = C.cut(one.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("cls"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.count("*").alias("copies")))

    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("center")).where("n > 1")
    members = C.cut(banded.join(shared, "bucket"))
    near = members.groupBy("cls").agg(F.min("center").alias("center"))
    crowd = near.groupBy("center").agg(F.count("*").alias("size"))
    total = near.count()
    block = F.when(F.col("size") <= BLOCK_CLASSES, F.pmod(F.xxhash64("center"), F.lit(max(1, -(-total // BLOCK_CLASSES))))).otherwise(
        F.xxhash64("center", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / BLOCK_CLASSES))))
    block = F.when(F.col("n_shingles") > LARGE, F.xxhash64("cls", F.lit(1))).otherwise(block)
    near = C.cut(near.join(crowd, "center").join(classes.select("cls", "n_shingles"), "cls").select("cls", block.alias("block")))

    wanted = near.select(F.col("cls").alias("doc_id"))
    texts = docs.join(F.broadcast(wanted) if total <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    # a text that occurs more than once under its id is taken once
    sets = C.cut(texts.mapInArrow(_sets, "cls long, set binary").dropDuplicates(["cls", "set"]) if total else docs.limit(0).select(F.col("doc_id").alias("cls"), F.lit(b"").alias("set")))
    odd = C.cut(classes.select("cls", "odd").join(near, "cls"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = [near.select(F.col("cls").alias(e), F.col("block").alias(f"block_{e}")) for e in "ab"]
        p = pairs.join(ends[0], "a").join(ends[1], "b")
        # a block pair's links are dealt to SALTS tasks
        key = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b"), F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        p = C.cut(p.select(key.alias("key"), "a", "b"))
        s = p.select(F.col("key").alias("skey"), F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")
        return p.groupBy("key").cogroup(s.groupBy("skey")).applyInPandas(_confirm, "a long, b long")

    def proposed(comps: DataFrame, best: bool) -> DataFrame:
        m = members.select("bucket", "cls", "n").join(comps, members.cls == comps.node, "left").withColumn("comp", F.coalesce("component", "cls"))
        mixed = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        m = m.join(mixed, "bucket").select("bucket", "cls", "comp", "n").join(odd, "cls")
        parts = F.ceil(F.col("n") / BUCKET_ROWS)
        m = m.withColumn("part", F.pmod(F.xxhash64("cls"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        m = m.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        m = m.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, rows // BUCKET_ROWS))))
        found = m.groupBy("task").applyInPandas(_propose(best), "a long, b long" if best else "lo long, hi long, classes array<long>")
        if best:
            return found.distinct()
        found = found.groupBy("lo", "hi").agg(F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
        return found.select("lo", "hi", F.explode("classes").alias("cls"))

    def confirmed_blocks(met: DataFrame, comps: DataFrame) -> DataFrame:
        m = met.join(odd.select("cls", "odd"), "cls").join(sets, "cls").join(comps, met.cls == comps.node, "left")
        m = m.select("lo", "hi", "cls", "odd", "set", F.coalesce("component", "cls").alias("comp"))
        return m.groupBy("lo", "hi").applyInPandas(_confirm_blocks, "a long, b long")

    rows = members.count()
    close = C.cut(members.where("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b")).distinct())
    # at most one pair for each row of a bucket; these need no sketch
    links = C.cut(confirmed(close))
    comps = C.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    for best in (True, False):
        found = proposed(comps, best)
        more = C.cut(confirmed(found) if best else confirmed_blocks(found, comps))
        if more.isEmpty():
            continue
        links = links.union(more)
        comps = C.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    digest = F.struct("d1", "d2", "n_shingles")
    copied = classes.where("copies > 1").select(digest.alias("digest"), "cls", "copies")
    listed = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = C.looked_up(sketched.select("doc_id", "n_shingles", digest.alias("digest")), copied, "digest", "copies", listed, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")).alias("cls"))
    out = out.join(comps, out.cls == comps.node, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) that stay: one document of each group, with all columns.

    That is the one with the group's smallest id; of rows that repeat an id the first by text, then by
    the whole row as JSON. Rows without an id stay. Ids to drop are broadcast while there are at most
    BROADCAST_IDS of them. Rows are kept apart as structs, so columns may have any names and types.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    gone = C.cut(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct())
    stay = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "id", "left_anti")
    twice = C.cut(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not twice.isEmpty():
        once, rest = stay.join(twice, "id", "left_anti"), stay.join(twice, "id", "left_semi")
        stay = once.unionByName(rest.groupBy("id").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row")))
    return stay.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same from the definition, without hashes.
SQL = f"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end as s from w),
n as (select doc_id, len(s)::bigint as n from s),
e as (select doc_id, unnest(s) as g from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {PERCENT} * (x.n + y.n - k)),
r as (select doc_id as node, doc_id as comp from documents union select l.b, r.comp from r join l on l.a = r.node),
c as (select node, min(comp) as comp from r group by 1)
select doc_id, n as n_shingles, comp as component_id, doc_id = comp as kept from n join c on c.node = n.doc_id
"""
QUERIES = {"op7_minhash_near_dedup": (op7_minhash_near_dedup, SQL)}
