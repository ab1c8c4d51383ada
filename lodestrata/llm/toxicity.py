"""Toxicity: Levenshtein automata over a lexicon trie, then context windows and a fitted document score."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .shingles import mix64

#: Labelled documents that lexicon and score are fitted on: those with the smallest hashes.
FIT_DOCUMENTS = 20_000
#: What a term needs: toxic documents, log odds, and to be no longer than words are.
MIN_TOXIC_DOCS, MIN_LOG_ODDS, MAX_LENGTH = 3, 1.5, 40
#: Word beginnings of these lengths are terms too, where they beat chance.
STEMS = (4, 5, 6)
#: Edits allowed by the term's length.
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW = 4
#: Parts of automaton states that a worker holds at once, of some 100 bytes each at most.
MAX_HELD = 1_000_000
#: Words whose matches a worker holds, and characters of texts whose words are looked up together.
MAX_WORDS, GROUP_CHARS = 200_000, 400_000
#: Words that tell of a quotation, of a denial, and of being meant.
QUOTING = frozenset("said says say wrote writes quoted quote called calls word words term dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
DENYING = frozenset("not no never nobody isn't aren't wasn't nicht kein keine nie pas jamais nunca jamás".split())
MEANING = frozenset("you your you're u ur they them he she du dein ihr euch tu toi vous ton tú usted eres".split())
#: Signs read as letters.
LEET = str.maketrans("013457@$!", "oieastasi")
FEATURES = ("best", "total", "density", "direct", "exact", "fuzzy", "stems", "several", "terms")
_TOKEN = re.compile(r"[^\s\"'“”„«»‘’.,;:?()\[\]{}<>|*#%&]+|[\"“”„«»]")
_MARKS = frozenset("\"“”„«»")


def held_out(doc_id):
    """Whether crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def edits_allowed(term: str) -> int:
    return 0 if term.endswith("*") else 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class Automaton:
    """Words within the allowed edits of any term: Levenshtein automata of all terms, run on the trie.

    A state is a set of (trie node, edits left); its successors are computed when first needed, so
    most words leave after a few dictionary lookups. Deletion, insertion, substitution and
    exchange of neighbours each cost one edit; exchange is kept as (node, edits, awaited letter).
    Terms ending in * are stems: they accept as soon as they are read without an edit.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = list(terms)
        self.weights = [terms[t] for t in self.terms]
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.reach: list[int] = [0]
        self.allow = []
        for k, t in enumerate(self.terms):
            word, stem, at = t.rstrip("*"), t.endswith("*"), 0
            allowed = edits_allowed(t)
            self.allow.append(allowed)
            path = [0]
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                    self.stem.append(-1)
                    self.reach.append(-1)
                at = self.next[at][c]
                path.append(at)
            for x in path:  # the most edits that any term through this node allows
                self.reach[x] = max(self.reach[x], allowed)
            (self.stem if stem else self.end)[at] = k
        self._clear()

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.stems_at: list[int] = []
        self.held = 0
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """With the states that skip letters of a term, which the word lacks."""
        todo = list(items)
        while todo:
            node, e, wait = todo.pop()
            if not wait:
                for child in self.next[node].values():
                    if e < self.reach[child] and (x := (child, e + 1, "")) not in items:
                        items.add(x)
                        todo.append(x)
        best: dict = {}
        for node, e, wait in items:
            best[node, wait] = min(e, best.get((node, wait), 9))
        return frozenset((n, e, w) for (n, w), e in best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.held += len(s) + 10
            self.sets.append(s)
            self.moves.append({})
            ends = [(e, -self.weights[k], k) for n, e, w in s if not w and (k := self.end[n]) >= 0 and e <= self.allow[k]]
            self.accept.append((min(ends)[2], min(ends)[0]) if ends else None)
            stems = [(self.weights[k], k) for n, e, w in s if not w and not e and (k := self.stem[n]) >= 0]
            self.stems_at.append(max(stems)[1] if stems else -1)
        return self.states[s]

    def _move(self, state: int, c: str) -> int:
        out: set = set()
        for node, e, wait in self.sets[state]:
            if wait:
                # the letters came in exchanged order: first the later one, now the earlier one
                first = self.next[node].get(c)
                if first is not None and (second := self.next[first].get(wait)) is not None and e <= self.reach[second]:
                    out.add((second, e, ""))
                continue
            for x, child in self.next[node].items():
                if x == c:
                    out.add((child, e, ""))
                elif e < self.reach[child]:
                    out.add((child, e + 1, ""))
                    if c in self.next[child] and e < self.reach[self.next[child][c]]:
                        out.add((node, e + 1, c))
            if e < self.reach[node]:
                out.add((node, e + 1, ""))
        return self._state(self._closed(out)) if out else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the nearest term, of equally near ones the weightiest; 9 for a stem."""
        s, stem = self.start, -1
        for c in word:
            m = self.moves[s]
            n = m.get(c)
            if n is None:
                if self.held > MAX_HELD:  # states are a cache: start afresh
                    self._clear()
                    return self.match(word)
                n = m[c] = self._move(s, c)
            if n < 0:
                break
            s = n
            if self.stems_at[s] >= 0:
                stem = self.stems_at[s]
        else:
            if self.accept[s]:
                return self.accept[s]
        return (stem, 9) if stem >= 0 else None


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))


def letters(words: list[str]) -> np.ndarray:
    """A row of code points for each of some words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def cuttings(codes: np.ndarray, most: int) -> np.ndarray:
    """Hashes of each word without up to most (1 or 2) of its letters, a row a word.

    A word's hash is a polynomial in its letters; what lies behind a letter that is taken out moves
    down by one power, so all cuttings come from the running sums.
    """
    n = codes.shape[1]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]))[:n]
    p = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers, axis=1, out=p[:, 1:])
    whole = p[:, n:]
    out = [whole, p[:, :n] + (whole - p[:, 1:]) * _UNDO]
    if most > 1:
        j, k = np.triu_indices(n, 1)
        out.append(p[:, j] + (p[:, k] - p[:, j + 1]) * _UNDO + (whole - p[:, k + 1]) * _UNDO * _UNDO)
    return mix64(np.hstack(out))


class _Index:
    """Terms with the same number of edits, found by the cuttings that they share with a word."""

    def __init__(self, terms: list[str], numbers: list[int], edits: int):
        self.edits, hashes, of = edits, [], []
        for n in {len(t) for t in terms}:
            at = [i for i, t in enumerate(terms) if len(t) == n]
            h = cuttings(letters([terms[i] for i in at]), edits)
            hashes.append(h.ravel())
            of.append(np.repeat([numbers[i] for i in at], h.shape[1]))
        h, of = np.concatenate(hashes), np.concatenate(of)
        order = np.argsort(h, kind="stable")
        self.hashes, starts = np.unique(h[order], return_index=True)
        self.terms = [tuple(sorted(set(x.tolist()))) for x in np.split(of[order], starts[1:])]
        # most hashes of words are told apart by a few of their bits
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True
        self.shortest, self.longest = min(map(len, terms)) - edits, max(map(len, terms)) + edits

    def find(self, words: list[str], out: dict[str, set[int]]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            if self.shortest <= len(w) <= self.longest:
                by.setdefault(len(w), []).append(w)
        for n, ws in by.items():
            step = max(1, 1_000_000 // (1 + n + n * n // 2))
            for part in (ws[i:i + step] for i in range(0, len(ws), step)):
                h = cuttings(letters(part), self.edits)
                r, c = np.nonzero(self.bits[h >> np.uint64(44)])
                h = h[r, c]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                for i, k in zip(r[hit].tolist(), at[hit].tolist()):
                    out.setdefault(part[i], set()).update(self.terms[k])


class Lexicon:
    """Automaton's matches for a large number of terms, all with their edits.

    Each edit, an exchange too, is undone by taking at most one letter from either side, so a word
    and a term within d edits share a cutting of d letters at most. Hashes of the cuttings of many
    words at once tell which terms come into question, none is missed, and the automaton on the trie
    of just those decides.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = list(terms)
        self.weights = [terms[t] for t in self.terms]
        self.exact = {t: k for k, t in enumerate(self.terms) if not t.endswith("*")}
        self.stems = {t.rstrip("*"): k for k, t in enumerate(self.terms) if t.endswith("*")}
        self.stem_lengths = sorted({len(t) for t in self.stems}, reverse=True)
        loose = {d: [t for t in self.exact if edits_allowed(t) == d] for d in (1, 2)}
        self.near = [_Index(ts, [self.exact[t] for t in ts], d) for d, ts in loose.items() if ts]
        self._clear()

    def _clear(self) -> None:
        self.automata: dict[tuple[int, ...], Automaton] = {}
        self.held = 0

    def candidates(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Terms that may lie within their edits of each word, for words that have any."""
        out: dict[str, set[int]] = {}
        for x in self.near:
            x.find(words, out)
        return {w: tuple(sorted(k)) for w, k in out.items()}

    def _nearest(self, word: str, some: tuple[int, ...]) -> tuple[int, int] | None:
        if word in self.exact:
            return self.exact[word], 0
        if some:
            if self.held > MAX_HELD:  # automata are a cache: start afresh
                self._clear()
            a = self.automata.get(some)
            if a is None:
                a = self.automata[some] = Automaton({self.terms[k]: self.weights[k] for k in some})
                self.held += a.held + 4 * len(a.next)
            before = a.held
            m = a.match(word)
            self.held += a.held - before
            if m:
                return some[m[0]], m[1]
        for n in self.stem_lengths:
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]], 9
        return None

    def matches(self, words) -> dict[str, tuple[int, int] | None]:
        """For each word the (term number, edits) of the nearest term, of equally near ones the weightiest; 9 for a stem."""
        words = list(words)
        some = self.candidates([w for w in words if w and w not in self.exact])
        return {w: self._nearest(w, some.get(w, ())) for w in words}

    def match(self, word: str) -> tuple[int, int] | None:
        return self.matches([word])[word]


class _Found(dict):
    """Word to match or None, of the words learned so far; emptied when large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.matches = lexicon.matches

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) > MAX_WORDS:
            self.clear()
            new = list(words)
        bare = {w: w.strip("!$@-_+=~/\\^`") for w in new}
        got = self.matches({b for b in bare.values() if b})
        read = {w: w.translate(LEET).strip("-_+=~/\\^`") for w, b in bare.items() if b and got[b] is None and not b.isalpha() and w.translate(LEET) != w}
        plain = self.matches(set(read.values()))
        for w, b in bare.items():
            self[w] = (got[b] or plain.get(read.get(w))) if b else None


_ready: dict = {}


def _finder(terms: dict[str, float]) -> tuple[_Found, list[str], list[float]]:
    """One lexicon a worker, kept over its tasks."""
    key = tuple(terms.items())
    if key not in _ready:
        _ready.clear()
        x = Lexicon(terms)
        _ready[key] = _Found(x), x.terms, x.weights
    return _ready[key]


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def measured(texts: list, found: _Found, weights: list[float]):
    """features() of each text; the words of some texts are looked up together."""
    group: list = []
    size = 0
    for k, t in enumerate(texts):
        group.append(_tokens(t))
        size += len(t or "")
        if size > GROUP_CHARS or k == len(texts) - 1:
            found.learn(set().union(*group))
            for tokens in group:
                yield features(tokens, found, weights)
            group, size = [], 0


def features(tokens: list[str], found: _Found, weights: list[float]) -> list[float] | None:
    """FEATURES of a whole text's tokens; None if it holds no term.

    A term's weight falls within a quotation, behind a denial and with edits, and rises where words
    that address someone are near.
    """
    at = [i for i, w in enumerate(tokens) if found[w]]
    if not at:
        return None
    best = total = 0.0
    direct, kinds = 0, [0, 0, 0]
    terms = set()
    for i in at:
        k, edits = found[tokens[i]]
        before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
        w = weights[k]
        if not _MARKS.isdisjoint(before) and not _MARKS.isdisjoint(after) or not QUOTING.isdisjoint(before):
            w *= 0.3
        elif not MEANING.isdisjoint(before) or not MEANING.isdisjoint(after):
            direct, w = direct + 1, w * 1.3
        if not DENYING.isdisjoint(before):
            w *= 0.5
        kind = 0 if not edits else 2 if edits == 9 else 1
        kinds[kind] += 1
        w *= (1.0, 0.7, 0.6)[kind]
        best, total = max(best, w), total + w
        terms.add(k)
    n = len(tokens)
    return [best, math.log1p(total), total / n, math.log1p(direct), *map(math.log1p, kinds), float(len(terms) > 1), math.log1p(len(terms))]


def _counted(batches):
    """Documents with a term or stem, of either label, summed over a task's batches."""
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ws = {w.strip("!$@-_+=~/\\^`") for w in _tokens(text)}
            ws = {w for w in ws if 3 <= len(w) <= MAX_LENGTH}
            for w in ws | {w[:k] + "*" for w in ws for k in STEMS if len(w) > k}:
                counts.setdefault(w, [0, 0])[toxic] += 1
    items = list(counts.items())
    for i in range(0, len(items), 50_000):
        part = items[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), *(pa.array([v[j] for _, v in part], pa.int64()) for j in (0, 1))], names=["term", "clean", "toxic"])


def learn_terms(labelled: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Terms (words, and stems as beginnings with *) to log odds, from text and toxic (0, 1).

    A term is kept if its documents are toxic more often than chance allows among all terms tried:
    n times the divergence of its rate from the overall rate exceeds the log of their number by 2.
    Terms come from FIT_DOCUMENTS documents at most, so their number does not grow with the corpus.
    """
    if not clean or not toxic:
        return {}
    counts = labelled.select("text", "toxic").mapInArrow(_counted, "term string, clean long, toxic long")
    counts = C.cut(counts.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    base = toxic / (clean + toxic)
    n, r = F.col("c") + F.col("t"), F.col("t") / (F.col("c") + F.col("t"))
    gain = n * (r * F.log(r / base) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - base))).otherwise(0.0))
    odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    need = math.log(max(2, counts.count())) + 2
    top = (counts.where((F.col("t") >= MIN_TOXIC_DOCS) & (r > base)).select("term", gain.alias("gain"), odds.alias("odds"))
           .where((F.col("gain") > need) & (F.col("odds") > MIN_LOG_ODDS)).orderBy(F.desc("gain"), "term").collect())
    return {x["term"]: float(x["odds"]) for x in top}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, d = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + d + 1e-9 * np.eye(len(w)), x.T @ (y - p) - d @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Terms and document weights, from at most FIT_DOCUMENTS labelled documents that are not held out.

    A document labelled more than once is toxic if any label says so; null labels do not count.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out("l_id")).orderBy(F.xxhash64("l_id"), "l_id").limit(FIT_DOCUMENTS)
    have = docs.select("doc_id", "text").join(F.broadcast(known), docs.doc_id == known.l_id)
    # dealt by id: copies of a text are as frequent as they like
    have = C.cut(have.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id")).select("text", "toxic"))
    n = {r["toxic"]: r["count"] for r in have.groupBy("toxic").count().collect()}
    terms = learn_terms(have, n.get(0, 0), n.get(1, 0))

    def fitted(batches):
        found, _, weights = _finder(terms)
        for b in batches:
            rows = [x or [0.0] * len(FEATURES) for x in measured(b.column(0).to_pylist(), found, weights)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = have.mapInArrow(fitted, "toxic int, x array<double>").collect()
    if not rows:
        return terms, [0.0] * len(FEATURES) + [-2.0]
    w = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return terms, w.tolist()


def score(docs: DataFrame, terms: dict[str, float], weights: list[float]) -> DataFrame:
    """doc_id, score, n_terms (different ones) for each row of docs (doc_id, text), over whole texts.

    Null and empty texts have no term and take the intercept's score.
    """
    def scored(batches):
        found, _, odds = _finder(terms)
        w, b = np.array(weights[:-1]), weights[-1]
        base = 1 / (1 + math.exp(-b))
        for batch in batches:
            xs = list(measured(batch.column(1).to_pylist(), found, odds))
            s = [base if x is None else float(1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))) for x in xs]
            n = [0 if x is None else round(math.expm1(x[-1])) for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "n_terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, n_terms long")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms for each row of docs.

    Fitted on the labels that are not held out; a null doc_id is not held out and has no label.
    Equal texts score alike, so do repeated rows, which each get theirs. Null and empty texts have no
    term and the score of one without any. Very long texts are read whole, by one task each. Without
    labels of both kinds every score is one constant; empty tables give none. Other columns of either
    table are not read, whatever their names.
    """
    terms, weights = fit(docs, labels)
    s = score(docs, terms, weights)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


QUERIES = {"op6_toxicity": (op6_toxicity, None)}
