"""Embedding near-duplicates: random hyperplanes in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

COSINE = 0.95
#: Chance to miss a pair at just COSINE, over all tables.
MISS = 1e-4
#: Distinct vectors that a signature gathers on average, without structure.
PER_BUCKET = 512
#: Sign bits that travel to a bucket with each vector, whatever the number of tables; a multiple of 64.
FILTER_BITS = 384
#: Vectors of a bucket that one task compares with each other.
CHUNK = 1024
SEED = 20_240_611


def plan_tables(n: int) -> tuple[int, int]:
    """Bits a table and number of tables for n distinct vectors.

    A bit of a pair at angle a agrees with probability 1 - a/pi; the tables are as many as leave
    MISS. Bits grow with the logarithm of n, so buckets stay small.
    """
    bits = max(1, math.ceil(math.log2(max(2, n) / PER_BUCKET)))
    same = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, count))


def most_different(bits: int) -> int:
    """Sign bits in which a pair at COSINE differs at most, but for five standard deviations."""
    p = math.acos(COSINE) / math.pi
    return math.floor(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _signed(bits: int, tables: int):
    """For each vector FILTER_BITS sign bits, packed, and each table's bits as a long."""
    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        count = max(bits * tables, FILTER_BITS)
        planes: dict = {}
        for b in batches:
            for g in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                vectors = g.column(1).to_pylist()
                signs = np.zeros((len(vectors), count), bool)
                dims = np.array([len(v) for v in vectors])
                for d in np.unique(dims):
                    p = planes.setdefault(int(d), hyperplanes(int(d), count))
                    at = np.flatnonzero(dims == d)
                    signs[at] = (np.array([vectors[k] for k in at], float) @ p) > 0
                sigs = signs[:, :bits * tables].reshape(len(vectors), tables, bits) @ weight
                offsets = np.arange(0, sigs.size + 1, tables, dtype=np.int32)
                packed = pa.array([x.tobytes() for x in np.packbits(signs[:, :FILTER_BITS], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([g.column(0), pa.array(dims, pa.int32()), packed, pa.ListArray.from_arrays(offsets, sigs.ravel())], names=["node", "dim", "signs", "sigs"])
    return run


def _groups(x: pd.DataFrame, by: list[str]) -> list[np.ndarray]:
    """Row numbers of each group."""
    ids = x.groupby(by, sort=False).ngroup().to_numpy()
    order = np.argsort(ids, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(ids[order])) + 1)


def _parts(x: pd.DataFrame, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions in rows of the two chunks of a group that are compared, and whether they are one chunk."""
    part, i, j = x["part"].to_numpy()[rows], x["i"].iat[rows[0]], x["j"].iat[rows[0]]
    a = np.flatnonzero(part == i)
    return (a, a, True) if i == j else (a, np.flatnonzero(part == j), False)


def _joined(up: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """up, each row's least known row of its component, with the pairs r, c joined."""
    while True:
        a, b = up[r], up[c]
        low, new = np.minimum(a, b), up.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def _edges(node: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge, greater node first, from each row to the first one of its component."""
    k = np.flatnonzero(up != np.arange(len(up)))
    return np.maximum(node[k], node[up[k]]), np.minimum(node[k], node[up[k]])


def _hamming(signs: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a bucket that differ in at most `most` sign bits."""
    first = most_different(128)
    up = np.arange(len(node))
    for lo in range(0, len(a), 128):
        k, q = a[lo:lo + 128], b[lo:] if same else b
        # two words of bits rule out nearly all pairs, the others are looked at whole
        apart = np.bitwise_count(signs[k, 0][:, None] ^ signs[q, 0][None]) + np.bitwise_count(signs[k, 1][:, None] ^ signs[q, 1][None])
        r, c = np.nonzero(apart <= first)
        r, c = k[r], q[c]
        close = (r != c) & (np.bitwise_count(signs[r] ^ signs[c]).sum(1, dtype=np.int64) <= most)
        up = _joined(up, r[close], c[close])
    return _edges(node, up)


def _unpacked(signs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint64).reshape(len(signs), -1)


def _of_bucket(most: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        k = np.arange(len(x))
        u, v = _hamming(_unpacked(x["signs"]), x["node"].to_numpy(), k, k, True, most)
        return pd.DataFrame({"u": u, "v": v})
    return run


def _of_chunks(most: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        signs, node = _unpacked(x["signs"]), x["node"].to_numpy()
        out = [_hamming(signs[g], node[g], *_parts(x, g), most) for g in _groups(x, ["t", "bucket", "dim", "i", "j"])]
        return pd.DataFrame({"u": np.concatenate([e[0] for e in out]), "v": np.concatenate([e[1] for e in out])})
    return run


def _compared(x: pd.DataFrame) -> pd.DataFrame:
    """Links within families, summed by node, and the edges of spanning forests of them.

    Both ends of a link count the other end's copies. Edges are fewer than a group's rows; their
    column v is set.
    """
    nodes, links, edges = [], [], []
    ids, weight, vectors = x["node"].to_numpy(), x["copies"].to_numpy(), x["v"].to_numpy()
    for g in _groups(x, ["family", "dim", "i", "j"]):
        a, b, same = _parts(x, g)
        v = np.array(vectors[g].tolist(), float)
        v /= np.sqrt((v * v).sum(1))[:, None]
        node, copies = ids[g], weight[g]
        up, count = np.arange(len(g)), np.zeros(len(g), np.int64)
        for lo in range(0, len(a), 256):
            k, q = a[lo:lo + 256], b[lo:] if same else b
            r, c = np.nonzero(v[k] @ v[q].T >= COSINE)
            r, c = k[r], q[c]
            if same:
                r, c = r[r < c], c[r < c]
            np.add.at(count, r, copies[c])
            np.add.at(count, c, copies[r])
            up = _joined(up, r, c)
        at = np.flatnonzero(count)
        nodes.append(node[at])
        links.append(count[at])
        edges.append(_edges(node, up))
    u, v = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    n, inverse = np.unique(np.concatenate(nodes), return_inverse=True)
    total = np.zeros(len(n), np.int64)
    np.add.at(total, inverse, np.concatenate(links))
    return pd.DataFrame({"node": np.concatenate([n, u]), "links": np.concatenate([total, np.zeros(len(u), np.int64)]), "v": pd.array([*[pd.NA] * len(n), *v.tolist()], dtype="Int64")})


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows (node, n in its group) once for each pair i <= j of chunks of the group with theirs, part."""
    parts = F.ceil(F.col("n") / CHUNK)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))


def _families(signed: DataFrame, n: int, tables: int) -> DataFrame:
    """node, component of the nodes that differ from others of a bucket in few of the sign bits.

    Rows of a bucket meet once: a bucket of at most CHUNK rows is compared where it was counted.
    Larger ones are dealt to tasks by pairs of chunks; the few largest stay where they are until then.
    The merge join lets both read one exchange.
    """
    key = ["t", "bucket", "dim"]
    b = signed.select("node", "dim", "signs", F.posexplode("sigs").alias("t", "bucket"))
    sizes = C.cut(b.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    often = (F.col("n") > CHUNK) & (F.col("n") * 1000 > n * tables)
    hot = F.broadcast(sizes.where(often))
    rest = b.join(hot.select(key), key, "left_anti").join(sizes.where(~often).hint("merge"), key)
    large = _chunked(b.join(hot, key).unionByName(rest.where(F.col("n") > CHUNK)))
    large = large.withColumn("task", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(max(1, n * tables // CHUNK))))
    most, pair = most_different(FILTER_BITS), "u long, v long"
    near = rest.where(F.col("n") <= CHUNK).groupBy(key).applyInPandas(_of_bucket(most), pair)
    return C.components(near.union(large.groupBy("task").applyInPandas(_of_chunks(most), pair)))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector (vec_id long, embedding array).

    Equal vectors are one node, by their smallest id and with their number as weight, so copies are
    never expanded. Nodes meet in a bucket for each table's signature, with FILTER_BITS sign bits
    only; pairs that differ in few of those bits join families, by distributed components. So a
    vector travels once, to its family, where cosines are taken in double precision. Buckets and
    families are compared in chunks of CHUNK rows, links are summed per node and edges are kept as
    spanning forests at once, so no list of pairs is made.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing;
    vectors of different lengths do not either. A null vec_id gets a row with no links, a null
    component and kept true. Rows that repeat an id count as one vector, the least of them; it gets
    one row. An empty table gives no rows.
    """
    spark, spilled = vectors.sparkSession, []

    def spill(df, **observed):
        df, at, seen = C.spill(df, **observed)
        spilled.append(at)
        return df, seen

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    none = v.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    v = v.where("vec_id is not null")
    # vectors travel to be told apart by id only if an id repeats at all
    if not v.groupBy("vec_id").count().where("count > 1").isEmpty():
        v = spill(v.groupBy("vec_id").agg(F.min("v").alias("v")))[0]
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # a key for equal vectors: the array itself would do, but is wide; adding 0 makes -0 the same as 0.
    # 128 bits: two of a billion vectors share one by chance with probability 1e-21
    plain = F.transform("v", lambda x: x + 0.0)
    h = F.struct(F.xxhash64(F.lit(1), plain).alias("a"), F.xxhash64(F.lit(2), plain).alias("b"))
    v = v.withColumn("fine", fine).withColumn("h", F.when(F.col("fine"), h))
    keys = C.cut(v.select("vec_id", "fine", "h"))
    nodes, seen = spill(v.where("fine").groupBy("h").agg(F.min("vec_id").alias("node"), F.first("v").alias("v"), F.count("*").alias("copies")), total=F.coalesce(F.sum("copies"), F.lit(0)))
    n, total = seen["n"], seen["total"]
    bits, tables = plan_tables(n)
    signed = spill(nodes.select("node", "v").mapInArrow(_signed(bits, tables), "node long, dim int, signs binary, sigs array<long>"))[0]
    families = _families(signed, n, tables).withColumnRenamed("component", "family")
    sizes = C.cut(families.groupBy("family").agg(F.count("*").alias("n")))
    members = families.count()
    # chunks are dealt with ids alone; the vectors come last
    f = _chunked(C.looked_up(families, sizes.withColumn("often", F.col("n")), "family", "often", members))
    f = f.withColumn("task", F.pmod(F.xxhash64("family", "i", "j"), F.lit(max(1, members // CHUNK))))
    f = f.select("node", "family", "part", "i", "j", "task").join(nodes.drop("h"), "node").withColumn("dim", F.size("v"))
    got = C.cut(f.groupBy("task").applyInPandas(_compared, "node long, links long, v long"))
    counts = got.where("v is null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = C.components(got.where("v is not null").select(F.col("node").alias("u"), "v"))
    out = nodes.select("node", "copies", "h").join(counts, "node", "left").join(comps, "node", "left")
    out = C.cut(out.select("h", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    for at in spilled:
        C.drop(spark, at)
    linked = C.looked_up(keys.where("fine").select("vec_id", "h"), out, "h", "copies", total)
    alone = keys.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(none)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Brute force. DuckDB's cosine of lists is in double precision after the cast.
SQL = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
r as (select vec_id as node, vec_id as comp from embeddings union select l.b, r.comp from r join l on l.a = r.node),
c as (select node, min(comp) as comp from r group by 1),
k as (select a, count(*) as n from l group by 1)
select node as vec_id, coalesce(n, 0)::bigint as n_links, comp as component_id, node = comp as kept from c left join k on k.a = c.node
"""
QUERIES = {"op1_embedding_near_dedup": (op1_embedding_near_dedup, SQL)}
