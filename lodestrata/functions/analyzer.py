"""Text to terms: the index analyzer, the query analyzer, the topic analyzer and keyword extraction.

A document is analysed where it is read, by one Arrow task that keeps each different token's term, so
there is no shuffle before terms are counted, and a query is analysed on the driver by the same code.
The DuckDB expressions below say the same independently; the catalog's queries hold one against the other.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from . import porter
from .dialect import DUCK, Dialect

#: Different tokens whose terms a worker holds, documents whose rows it makes at once, and terms of a row of doc_terms() at most.
HELD, SLICE, LISTED = 500_000, 256, 512
_IDS = [re.compile(p) for p in L.ID_PATTERNS]
#: What a text, in capitals, has at least where a pattern of _IDS matches.
_ID_SIGNS = ["CVE-", "CWE-", "CAPEC-", re.compile(r"T\d{4}"), re.compile(r"TA\d{4}"), re.compile(r"MS\d{2}-")]
_ID_TOKEN, _TOPIC_ID = re.compile(L.ID_TOKEN), re.compile(L.TOPIC_ID_TOKEN)
_CLEAN = [re.compile(p) for p in L.CLEAN]
#: What a token has at least where a pattern of _CLEAN matches; what no word has.
_CLEANED, _OTHER = re.compile(r"\.\S|[/;@#$<>\[\]_]"), re.compile("[^a-zA-Z]")
_MARKUP = [re.compile(p) for p in L.TOPIC_MARKUP]
_INDEX_STOPS, _TOPIC_STOPS, _ENGLISH = L.index_stops(), L.topic_stops(), frozenset(L.ENGLISH_STOPS)


class _Terms(dict):
    """Token to term, '' where a token has none; computed when first asked for, emptied when large."""

    def __init__(self, of: Callable[[str], str]):
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> str:
        if len(self) >= HELD:
            self.clear()
        t = self[token] = self.of(token)
        return t


def _index_term(token: str) -> str:
    if not (token.isascii() and token.isalpha()):  # cleaning leaves letters as they are
        if _ID_TOKEN.match(token):
            return token.upper()
        if _CLEANED.search(token):
            for p in _CLEAN:
                token = p.sub("", token)
        token = token.strip(string.punctuation)
        letters = _OTHER.sub("", token)
        if len(letters) < len(token) and any(map(str.isdigit, token)):
            return ""
        token = letters
    word = token.lower()
    if len(word) <= 2 or word in _INDEX_STOPS:
        return ""
    t = porter.stem(word)
    return t if len(t) > 2 else ""


def _topic_term(token: str) -> str:
    if _TOPIC_ID.match(token):
        return ""
    word = re.sub("[^a-z]", "", token)
    return word if len(word) >= 4 and word not in _TOPIC_STOPS else ""


_term_of, _topic_of = _Terms(_index_term), _Terms(_topic_term)
#: The same with acronyms written out.
_written_of = _Terms(lambda token: _index_term(L.ACRONYMS.get(token.lower(), token)))


def _id_patterns(text: str) -> list[re.Pattern]:
    """Patterns of identifiers that a text may have; the others can't match in it, nor once some of it became spaces."""
    upper = text.upper()
    return [p for p, sign in zip(_IDS, _ID_SIGNS) if (sign in upper if isinstance(sign, str) else sign.search(upper))]


def security_ids(text: str) -> list[str]:
    """Identifiers of a text, upper-cased, pattern by pattern."""
    return [x.upper() for p in _id_patterns(text) for x in p.findall(text)]


def _split(text: str) -> tuple[list[str], list[str]]:
    """Identifiers of a text, and its other tokens."""
    found, rest = [], text
    for p in _id_patterns(text):
        found += [x.upper() for x in p.findall(text)]
        rest = p.sub(" ", rest)
    return found, rest.split()


def words(text: str, side: str = "index") -> list[str]:
    """Tokens before cleaning. The index side takes identifiers first and writes acronyms out; the query side does neither."""
    if side == "query":
        return text.split()
    found, rest = _split(text)
    return found + [L.ACRONYMS.get(t.lower(), t) for t in rest]


def analyze(text: str | None, side: str = "index") -> list[str]:
    """Terms of a text, in order, repeats kept; null has none."""
    if side == "query":
        return [t for w in (text or "").split() if (t := _term_of[w])]
    found, rest = _split(text or "")
    return [t for w in found if (t := _term_of[w])] + [t for w in rest if (t := _written_of[w])]


def term_set(text: str | None) -> set[str]:
    """The different terms of a text, of the index side."""
    found, rest = _split(text or "")
    return {*map(_term_of.__getitem__, found), *map(_written_of.__getitem__, set(rest))} - {""}


def topic_words(text: str | None) -> list[str]:
    """Tokens of the topic model, unstemmed."""
    x = text or ""
    for p in _MARKUP:
        x = p.sub(" ", x)
    return [t for w in x.lower().split() if (t := _topic_of[w])]


def keyword_set(tid: str, name: str, full_text: str) -> set[str]:
    """Stems of words of four letters or more that are no stop words, the id, and stems of name words."""
    out = {porter.stem(w) for w in set(re.findall("[a-zA-Z]{4,}", full_text.lower())) if w not in _ENGLISH}
    out |= {k for w in name.lower().split() if (k := porter.stem(w)) not in _ENGLISH}
    return {k for k in out if len(k) >= L.MIN_KEYWORD} | {tid.upper()}


# --- Spark ---------------------------------------------------------------------------------------

def parts(corpus: DataFrame) -> int:
    """Tasks that a corpus is analysed in: four for each part that it is read as, which has 128 MB at most, and one a core at least."""
    return max(corpus.sparkSession.sparkContext.defaultParallelism, 4 * corpus.rdd.getNumPartitions())


def spread(corpus: DataFrame) -> DataFrame:
    """The corpus dealt anew by doc_id, so that tasks are alike and small also where a file's row groups are few and large.

    Analysis costs far more than moving the texts. corpus should be a scan or kept, as its parts are counted.
    """
    return corpus.repartition(parts(corpus), "doc_id")


# workers find these by name, so a worker's tasks share its terms
def _placed(text: str | None, side: str) -> list[tuple]:
    return [(k, t) for k, w in enumerate(words(text or "", side)) if (t := _term_of[w])]


def _counted(text: str | None, side: str) -> list[tuple]:
    return list(Counter(analyze(text, side)).items())


def _listed(text: str | None, side: str) -> list[tuple]:
    return [(topic_words(text) if side == "topic" else analyze(text, side),)]


def _flat(docs: DataFrame, keep: list[str], text: str, analyzed: Callable[[str | None], list[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Columns keep and fields: a row for each tuple that a document's text gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = [analyzed(t) for t in b.column(b.num_columns - 1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = zip(*(x for f in found for x in f)) if len(at) else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(len(keep))] + [pa.array(c, f[2]) for c, f in zip(columns, fields)], names=[*keep, *(f[0] for f in fields)])

    of = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {of[c]}" for c in keep] + [f"{n} {t}" for n, t, _ in fields])
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def _keys(corpus: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "source") if c in corpus.columns]


def terms(corpus: DataFrame, side: str = "index", text: str = "text") -> DataFrame:
    """Rows doc_id, source, pos, term of a corpus (doc_id, source, text). Documents without terms give none."""
    return _flat(corpus, _keys(corpus), text, partial(_placed, side=side), [("pos", "int", pa.int32()), ("term", "string", pa.string())])


def term_counts(corpus: DataFrame, side: str = "index", text: str = "text") -> DataFrame:
    """Rows doc_id, source, term, tf of each row of a corpus; with unique ids that is the postings, without a shuffle."""
    return _flat(corpus, _keys(corpus), text, partial(_counted, side=side), [("term", "string", pa.string()), ("tf", "int", pa.int32())])


def doc_terms(corpus: DataFrame) -> DataFrame:
    """doc_id, source, dl, part, list (term, tf) of each document: a row for each LISTED of its terms, and one of a document without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = [_counted(t, "index") for t in b.column(2).to_pylist()]
            rows = [(k, lo) for k, f in enumerate(found) for lo in range(0, max(1, len(f)), LISTED)]
            ends = np.cumsum([0, *(min(LISTED, len(found[k]) - lo) for k, lo in rows)])
            flat = pa.StructArray.from_arrays([pa.array([t for f in found for t, _ in f], pa.string()), pa.array([n for f in found for _, n in f], pa.int32())], names=["term", "tf"])
            at, dl = pa.array([k for k, _ in rows], pa.int64()), pa.array([sum(n for _, n in f) for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), dl.take(at), pa.array([lo // LISTED for _, lo in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "source", "dl", "part", "list"])

    return corpus.select("doc_id", "source", F.col("text").cast("string")).mapInArrow(run, "doc_id string, source string, dl int, part int, list array<struct<term:string,tf:int>>")


def token_arrays(corpus: DataFrame, side: str = "index") -> DataFrame:
    """doc_id, source, tokens in order, for every document, also those without a token."""
    return _flat(corpus, _keys(corpus), "text", partial(_listed, side=side), [("tokens", "array<string>", pa.list_(pa.string()))])


def topic_tokens(corpus: DataFrame) -> DataFrame:
    return _flat(corpus, _keys(corpus), "text", partial(_listed, side="topic"), [("tokens", "array<string>", pa.list_(pa.string()))])


def keywords(techniques: DataFrame) -> DataFrame:
    """tid, keyword, without repeats within a technique, of techniques (tid, name, full_text)."""
    def run(batches):
        for b in batches:
            rows = [(tid, k) for tid, name, text in zip(*(c.to_pylist() for c in b.columns)) for k in sorted(keyword_set(tid, name, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["tid", "keyword"])

    return techniques.where("tid is not null").select("tid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "full_text"))).mapInArrow(run, "tid string, keyword string").distinct()


# --- expressions for DuckDB, and ids for Spark SQL too -----------------------------------------------

def ids(d: Dialect, text: str) -> str:
    """Identifiers of a text, upper-cased, pattern by pattern."""
    return d.mapped(d.joined(*(d.all_matches(text, p) for p in L.ID_PATTERNS)), "i", "upper(i)")


def acronym(d: Dialect, token: str) -> str:
    return f"case lower({token}) " + " ".join(f"when {d.text(k)} then {d.text(v)}" for k, v in L.ACRONYMS.items()) + f" else {token} end"


def split_words(d: Dialect, text: str) -> str:
    return d.kept(d.pieces(text, f"[{L.WHITE}]+"), "t", "t <> ''")


def raw_tokens(d: Dialect, text: str, side: str = "index") -> str:
    """Tokens before cleaning. The index side takes identifiers first and writes acronyms out; the query side does neither."""
    if side == "query":
        return split_words(d, text)
    rest = text
    for p in L.ID_PATTERNS:
        rest = d.replaced(rest, p, " ")
    return d.joined(ids(d, text), d.mapped(split_words(d, rest), "t", acronym(d, "t")))


def clean_steps(d: Dialect, token: str = "token") -> list[tuple[str, str]]:
    """Columns: is_id, cleaned ('' where the token is dropped)."""
    x = token
    for p in L.CLEAN:
        x = d.replaced(x, p)
    x = d.replaced(x, f"^[{L.PUNCTUATION}]+|[{L.PUNCTUATION}]+$")
    letters = d.replaced("bare", "[^a-zA-Z]+")
    return [("is_id", d.matches(token, L.ID_TOKEN)), ("bare", x),
            ("cleaned", f"case when is_id then upper({token}) when bare = '' or {d.matches('bare', L.DIGIT)} then '' when length({letters}) <= 2 then '' else lower({letters}) end")]


def topic_array(d: Dialect, text: str) -> str:
    """Tokens of the topic model, unstemmed."""
    x = text
    for p in L.TOPIC_MARKUP:
        x = d.replaced(x, p, " ")
    words = d.kept(split_words(d, f"lower({x})"), "u", f"not {d.matches('u', L.TOPIC_ID_TOKEN)}")
    letters = d.mapped(words, "v", d.replaced("v", "[^a-z]+"))
    return d.kept(letters, "z", f"length(z) >= 4 and not ({d.among('z', L.topic_stops())})")


# --- DuckDB --------------------------------------------------------------------------------------

def terms_sql(corpus: str, side: str = "index", keep: str = "doc_id, source") -> str:
    """SQL for the rows of terms() over a subquery."""
    d = DUCK
    q = f"select {keep}, unnest(tk) as token, unnest(range(len(tk))) as pos from (select *, {raw_tokens(d, 'coalesce(text, chr(32))', side)} as tk from ({corpus}))"
    for name, e in clean_steps(d):
        q = f"select *, {e} as {name} from ({q})"
    q = f"select {keep}, pos, is_id, cleaned from ({q}) where cleaned <> '' and (is_id or not ({d.among('cleaned', L.index_stops())}))"
    v = f"select cleaned as v, stem from ({porter.stem_sql(f'select distinct cleaned from ({q}) where not is_id', 'cleaned', 'stem')})"
    return f"select {keep}, pos, term from (select {keep}, pos, case when is_id then cleaned else stem end as term from ({q}) left join ({v}) on v = cleaned) where length(term) > 2"


def keywords_sql(techniques: str) -> str:
    d = DUCK
    stops = d.among
    w = f"select distinct tid, unnest({d.mapped(d.all_matches('full_text', '[a-zA-Z]{4,}'), 'x', 'lower(x)')}) as word from ({techniques})"
    w = porter.stem_sql(f"select * from ({w}) where not ({stops('word', L.ENGLISH_STOPS)})", "word", "keyword")
    n = porter.stem_sql(f"select distinct tid, unnest({split_words(d, 'lower(name)')}) as word from ({techniques})", "word", "keyword")
    return (f"select distinct tid, keyword from (select tid, keyword from ({w}) union all select tid, keyword from ({n}) where not ({stops('keyword', L.ENGLISH_STOPS)})) "
            f"where length(keyword) >= {L.MIN_KEYWORD} union select tid, upper(tid) from ({techniques})")
