"""SentencePiece encoding and decoding of texts of any length, by a parallel scan.

The model at hand is of the BPE kind, whose result is not the best-scoring path of a lattice. Its
result is, however, the only path all of whose neighbours are compatible: two pieces are if merging
their joined text gives just them. So a path weighs 0 where all neighbours are compatible and minus
infinity elsewhere, and a chunk of a text has a max-plus transfer matrix, from the pieces that may
lie across its first border to those that may lie across its last one. Matrices combine
associatively, the only finite path picks each border's piece, and each chunk is traced back alone.

No piece holds a space mark behind another character, so nothing is merged across the beginning of a
word. Between the first and last such place of a chunk the library encodes; only the words at
borders, and chunks without a space, need the lattice.
"""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts longer than this are split, into chunks of so many characters.
GIANT, CHUNK = 65_536, 16_384
#: Characters beyond a border that a chunk sees: more than the longest piece.
LOOK = 32
SPACE = "▁"
RESET, UNKNOWN = -2, -1


class Pieces:
    """A model with its vocabulary, and the lattice over compatible pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.lib.get_piece_size()
        usable = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.score = {self.lib.id_to_piece(i): self.lib.get_score(i) for i in usable}
        self.number = {self.lib.id_to_piece(i): i for i in usable}
        self.piece = {i: p for p, i in self.number.items()}
        self.byte = {self.lib.id_to_piece(i): i for i in range(n) if self.lib.is_byte(i)}
        self.longest = max(map(len, self.number))
        assert self.longest < LOOK and not any(SPACE in p.lstrip(SPACE) for p in self.number)
        self.compatible = functools.lru_cache(200_000)(self._compatible)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the neighbours whose joined piece scores best merge, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        return self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]

    @staticmethod
    def resets(s: str, at: int) -> bool:
        """Whether a word begins at a place: pieces on both sides are independent."""
        return 0 < at < len(s) and s[at] == SPACE and s[at - 1] != SPACE

    def here(self, s: str, at: int) -> list[tuple[int, int]]:
        """(end, number) of the pieces that begin at a place; a character without a piece stands for itself."""
        out = [(e, n) for e in range(at + 1, min(len(s), at + self.longest) + 1) if (n := self.number.get(s[at:e])) is not None and self.whole(n)]
        return out if s[at] in self.number else [*out, (at + 1, UNKNOWN)]

    @functools.lru_cache(40_000)  # noqa: B019
    def whole(self, n: int) -> bool:
        """Whether merging a piece's text gives the piece: others never come out."""
        return self.merged(self.piece[n]) == [self.piece[n]]

    def walk(self, s: str, starts: dict, stop: int):
        """Lattice from start states to the first states at or behind stop.

        A state is (end, number); behind a reset the number is RESET. Returns for each state reached
        its predecessors, in order of its end.
        """
        layers: dict[int, dict[int, list]] = {}
        for (end, number), label in starts.items():
            layers.setdefault(end, {})[number] = [label]
        at = min(layers)
        done: dict = {}
        while layers and (at := min(layers)) < stop:
            states = layers.pop(at)
            for number, back in states.items():
                done[at, number] = back
                for e, n in self.here(s, at):
                    if number == RESET or self.compatible(number, n):
                        key = RESET if self.resets(s, e) else n
                        layers.setdefault(e, {}).setdefault(key, []).append(((at, number), n))
        for e, states in layers.items():
            for number, back in states.items():
                done[e, number] = back
        return done

    def across(self, s: str, at: int) -> list[tuple[int, int]]:
        """States that a border at a place may have: it is a reset, or lies in or behind a piece."""
        if self.resets(s, at) or at == 0:
            return [(at, RESET)]
        return sorted({(e, RESET if self.resets(s, e) else n) for b in range(max(0, at - self.longest), at) for e, n in self.here(s, b) if e >= at})

    def inner(self, s: str, a: int, z: int) -> tuple[int, int] | None:
        """The first and the last reset of a chunk."""
        first = next((k for k in range(a, z) if self.resets(s, k) or k == 0), None)
        return None if first is None else (first, next(k for k in range(z, a - 1, -1) if self.resets(s, k) or k == 0))

    def transfer(self, s: str, a: int, z: int) -> list[tuple]:
        """Finite entries of the chunk's matrix: (end, number in), (end, number out), relative to its borders."""
        ins = self.across(s, a) if a else [(0, RESET)]
        span = self.inner(s, a, z)
        if span is None:
            return [(i[0] - a, i[1], e - z, n) for i in ins for e, n in self._reach(s, i, z)]
        heads = [i for i in ins if i[0] <= span[0] and (i == (span[0], RESET) or (span[0], RESET) in self.walk(s, {i: None}, span[0]))]
        tails = self._reach(s, (span[1], RESET), z)
        return [(i[0] - a, i[1], e - z, n) for i in heads for e, n in tails]

    def _reach(self, s: str, start: tuple[int, int], stop: int) -> list[tuple[int, int]]:
        return [k for k in self.walk(s, {start: None}, stop) if k[0] >= stop] if start[0] < stop else [start]

    def path(self, s: str, start: tuple[int, int], end: tuple[int, int]) -> list[int]:
        """Piece numbers from one state to another, by the only way there is."""
        if start == end:
            return []
        done = self.walk(s, {start: None}, end[0])
        found: list = []

        def back(state, tail):
            stack = [(state, tail)]
            while stack:
                at, rest = stack.pop()
                if at == start:
                    found.append(rest)
                    continue
                stack += [(p[0], (p[1], p[0][0], rest)) for p in done.get(at, []) if p is not None]

        back(end, None)
        node, out = found[0], []
        while node is not None:
            n, at, node = node
            out += [n] if n != UNKNOWN else self.bytes_of(s[at])
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[f"<0x{b:02X}>"] for b in char.encode("utf-8", "surrogatepass")]

    def traced(self, s: str, a: int, z: int, start: tuple[int, int], end: tuple[int, int]) -> list[int]:
        """Numbers of the pieces of a chunk behind its start state, up to its end state's piece."""
        span = self.inner(s, a, z)
        if span is None or start[0] > span[0]:
            return self.path(s, start, end)
        middle = self.lib.encode(s[span[0] + 1:span[1]].replace(SPACE, " ")) if span[1] > span[0] else []
        return self.path(s, start, (span[0], RESET)) + middle + self.path(s, (span[1], RESET), end)


_loaded: dict = {}


def load(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def chunks(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + size)) for a in range(0, n, size)] or [(0, 0)]


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The max-plus product of two neighbouring chunks' matrices; finite entries are all 0, so it tells which states meet."""
    onward: dict = {}
    for i0, i1, o0, o1 in b:
        onward.setdefault((i0, i1), []).append((o0, o1))
    return list(dict.fromkeys((i0, i1, *o) for i0, i1, m0, m1 in a for o in onward.get((m0, m1), ())))


def scan(matrices: list[list[tuple]]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Border states of each chunk on the only finite path, from the chunks' matrices in order.

    Products of neighbours are multiplied in pairs, as a tree; from its root the border between the two
    halves of each node is the state that its start reaches and from which its end is reached.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([product(x[k], x[k + 1]) if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)])
    first = (0, RESET)
    borders = [(first, next((o0, o1) for i0, i1, o0, o1 in levels[-1][0] if (i0, i1) == first and o0 == 0))]
    for x in reversed(levels[:-1]):
        halves = []
        for k, (start, end) in enumerate(borders):
            if 2 * k + 1 == len(x):
                halves.append((start, end))
                continue
            reached = {(o0, o1) for i0, i1, o0, o1 in x[2 * k] if (i0, i1) == start}
            middle = next((i0, i1) for i0, i1, o0, o1 in x[2 * k + 1] if (o0, o1) == end and (i0, i1) in reached)
            halves += [(start, middle), (middle, end)]
        borders = halves
    return borders


def marked(text: str) -> str:
    """The text as the model sees it: a space mark first, and for each space."""
    return SPACE + text.replace(" ", SPACE)


def encode_giant(p: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """The whole scan on one text in one process: what the distributed form does in tasks."""
    s = marked(text)
    cs = chunks(len(s), size)
    states = scan([p.transfer(s, a, z) for a, z in cs])
    return [n for (a, z), (i, o) in zip(cs, states) for n in p.traced(s, a, z, (a + i[0], i[1]), (z + o[0], o[1]))]


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for each row of docs (doc_id long, text string).

    round_trip: decoding gives the text back; it cannot where the text holds the space mark itself.
    Texts up to giant characters are encoded where they are read. Longer ones are cut into chunks of
    which each sees LOOK characters beyond its borders; matrices of a text (some hundred bytes a
    chunk) meet in one task, chunks are then traced and decoded apart, and a text's ids meet in its
    row. Null gives no ids and a round trip to null; an empty text none. Repeated rows are rows of
    their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def small(batches):
        p = load(proto.value)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                ts = b.column(1).slice(lo, 128).to_pylist()
                ids = p.lib.encode([t or "" for t in ts], num_threads=1)
                back = p.lib.decode(ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(ts)), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([x == (t or "") for x, t in zip(back, ts)], pa.bool_())],
                                                 names=["doc_id", "n_tokens", "ids", "round_trip"])

    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    short = d.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(small, schema)
    long = d.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()).withColumn("s", F.concat(F.lit(SPACE), F.replace(F.col("text"), F.lit(" "), F.lit(SPACE))))
    n = F.length("s")
    at = F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("a")
    cut = long.select("row", "doc_id", "s", n.alias("n"), at).select("row", "doc_id", "n", "a", F.substring("s", F.greatest(F.lit(0), F.col("a") - LOOK) + 1, F.lit(size + 2 * LOOK + 1)).alias("s"))
    cut = C.cut(cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "a"))

    def local(r):
        """Chunk and its borders within what it sees."""
        lo = max(0, r.a - LOOK)
        z = min(r.n, r.a + size)
        return r.s[:z - lo + LOOK], r.a - lo, z - lo

    def matrices(batches):
        p = load(proto.value)
        for b in batches:
            rows = [(r.row, r.a, *zip(*p.transfer(*local(r)))) for r in b.itertuples()]
            yield pd.DataFrame({"row": [x[0] for x in rows], "a": [x[1] for x in rows], **{k: pd.Series([list(x[i]) for x in rows], dtype=object) for i, k in ((2, "ia"), (3, "ib"), (4, "oa"), (5, "ob"))}})

    def borders(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("a")
        st = scan([list(zip(*(map(int, r[k]) for k in ("ia", "ib", "oa", "ob")))) for _, r in g.iterrows()])
        return pd.DataFrame([(r, a, *i, *o) for r, a, (i, o) in zip(g["row"], g["a"], st)], columns=["row", "a", "i0", "i1", "o0", "o1"])

    kind = "array<int>"
    m = cut.mapInPandas(matrices, f"row long, a int, ia {kind}, ib {kind}, oa {kind}, ob {kind}")
    states = m.groupBy("row").applyInPandas(borders, "row long, a int, i0 int, i1 int, o0 int, o1 int")

    def trace(batches):
        p = load(proto.value)
        for b in batches:
            out = []
            for r in b.itertuples():
                s, a, z = local(r)
                ids = p.traced(s, a, z, (a + r.i0, r.i1), (z + r.o0, r.o1))
                want = s[a + r.i0:z + r.o0]
                back = p.lib.decode(ids) if ids else ""
                # the library drops a first space mark
                ok = marked(back) == want if want.startswith(SPACE) else back.replace(" ", SPACE) == want
                out.append((r.row, r.doc_id, r.a, ids, ok))
            yield pd.DataFrame({"row": [x[0] for x in out], "doc_id": [x[1] for x in out], "a": [x[2] for x in out], "ids": pd.Series([x[3] for x in out], dtype=object), "ok": [x[4] for x in out]})

    t = cut.join(states, ["row", "a"]).select("row", "doc_id", "n", "a", "s", "i0", "i1", "o0", "o1").mapInPandas(trace, "row long, doc_id long, a int, ids array<int>, ok boolean")
    whole = t.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("a", "ids"))).alias("c"), F.bool_and("ok").alias("ok"))
    ids = F.flatten(F.transform("c", lambda x: x["ids"]))
    literal = long.select("row", F.col("text").contains(SPACE).alias("odd"))
    whole = whole.join(literal, "row").select("doc_id", ids.alias("ids"), (F.col("ok") & ~F.col("odd")).alias("round_trip"))
    return short.unionByName(whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from ids; ids null gives null."""
    with open(model, "rb") as f:
        proto = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        p = load(proto.value)
        for b in batches:
            ids = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else p.lib.decode(x) for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_sentencepiece": (op4_sentencepiece, None)}
