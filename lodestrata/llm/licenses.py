"""License scans: Aho-Corasick over tags and notices, licence expressions by a shunting yard."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

# How restrictive terms of a kind are, from 0 (none found) to 1.
PUBLIC, PERMISSIVE, WEAK, UNKNOWN, STRONG, LIMITED, RESERVED = 0.1, 0.3, 0.5, 0.6, 0.7, 0.9, 1.0
#: What a notice of an exception counts as.
EXCEPTION = "+exception"
# Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Other notices.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl-1.0",
    "python software foundation license": "psf", "artistic license": "artistic", "open font license": "ofl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "common development and distribution license": "cddl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "free documentation license": "gfdl", "open database license": "odbl", "server side public license": "sspl",
    "business source license": "busl", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "cc0": "cc0", "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain", "this is free and unencumbered software": "unlicense",
    "proprietary and confidential": "reserved", "classpath exception": EXCEPTION, "linking exception": EXCEPTION, "runtime library exception": EXCEPTION,
}
# Beginnings of identifiers, the label that they get and its kind; the longest that fits counts.
FAMILIES = {
    "mit": ("mit", PERMISSIVE), "mit-0": ("mit-0", PUBLIC), "0bsd": ("0bsd", PUBLIC), "bsd": ("bsd", PERMISSIVE), "apache": ("apache", PERMISSIVE), "isc": ("isc", PERMISSIVE),
    "zlib": ("zlib", PERMISSIVE), "bsl": ("bsl-1.0", PERMISSIVE), "psf": ("psf", PERMISSIVE), "python": ("psf", PERMISSIVE), "artistic": ("artistic", WEAK), "ofl": ("ofl", WEAK),
    "cc0": ("cc0", PUBLIC), "unlicense": ("unlicense", PUBLIC), "wtfpl": ("wtfpl", PUBLIC), "public-domain": ("public-domain", PUBLIC), "pddl": ("pddl", PUBLIC),
    "cc-by": ("cc-by", PERMISSIVE), "cc-by-sa": ("cc-by-sa", STRONG), "cc-by-nd": ("cc-by-nd", LIMITED), "cc-by-nc": ("cc-by-nc", LIMITED),
    "cc-by-nc-sa": ("cc-by-nc-sa", LIMITED), "cc-by-nc-nd": ("cc-by-nc-nd", LIMITED), "mpl": ("mpl", WEAK), "epl": ("epl", WEAK), "cddl": ("cddl", WEAK), "lgpl": ("lgpl", WEAK),
    "gpl": ("gpl", STRONG), "agpl": ("agpl", STRONG), "eupl": ("eupl", STRONG), "gfdl": ("gfdl", STRONG), "odbl": ("odbl", STRONG), "sspl": ("sspl", LIMITED),
    "busl": ("busl", LIMITED), "reserved": ("reserved", RESERVED), "none": ("none", RESERVED), "proprietary": ("reserved", RESERVED),
}
# What stands before an expression. Behind the first, an unknown identifier is one too.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:", "@license")
#: Binding strength of the operators.
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Notices up to this many bytes apart belong to one expression if an operator stands between them.
GAP = 64

_SEPARATORS = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ITEM = re.compile(rb"[ \t]*(?:([()|/&])|([0-9a-z][0-9a-z.+:-]*))")


def tokens(raw: bytes, at: int, end: int, read: list[int]):
    """Tokens of the lower-cased text from at on, up to anything that is none; read gets the end of each one that was taken."""
    while at < end and (m := _ITEM.match(raw, at, end)):
        at = m.end()
        sign, word = m.groups()
        yield {b"|": "or", b"/": "or", b"&": "and"}.get(sign, sign.decode()) if sign else word.rstrip(b".:").decode()
        read.append(at)


def shunting_yard(items, known=lambda x: True) -> tuple[list[str], bool]:
    """Longest expression that the tokens begin with, in reverse Polish order, and whether it is well-formed.

    It ends before the first token that cannot follow, such as a word behind an operand; an operator
    without a right side is dropped and an open bracket closed, and then it is not well-formed. So a text
    is read no further than its expression goes.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, whole, depth = True, True, 0
    for t in items:
        if operand and t == "(":
            stack.append(t)
            depth += 1
        elif operand and t not in STRENGTH and t != ")" and known(t):
            out.append(t)
            operand = False
        elif not operand and t in STRENGTH:
            while stack and STRENGTH.get(stack[-1], 0) >= STRENGTH[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif not operand and t == ")" and depth:
            while (x := stack.pop()) != "(":
                out.append(x)
            depth -= 1
        else:
            break
    if operand and out:
        # the last operator, and brackets opened behind it
        while stack.pop() == "(":
            pass
        whole = False
    out += (x for x in reversed(stack) if x != "(")
    return out, whole and "(" not in stack and bool(out)


@functools.lru_cache(4096)
def family(name: str) -> tuple[str, float]:
    """Label and level of an identifier or a notice's label."""
    name = name.removesuffix("+")
    fits = [f for f in FAMILIES if name.startswith(f) and re.match(r"$|[^a-z]|v\d", name[len(f):])]
    return FAMILIES[max(fits, key=len)] if fits else ("other", UNKNOWN)


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """Level and labels of the terms that a user of the text would choose.

    'and' binds to both sides, 'or' lets the less restrictive one (the first of equal ones) be
    chosen, and 'with' an exception turns strong copyleft into weak.
    """
    stack: list[tuple[float, set[str], bool]] = []
    for t in rpn:
        if t not in STRENGTH:
            label, level = family(t)
            stack.append((level, {label}, "exception" in t))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append((min(a[0], WEAK) if b[2] and a[0] == STRONG else a[0], a[1], False))
        elif t == "and":
            stack.append((max(a[0], b[0]), a[1] | b[1], False))
        else:
            stack.append((*min(a, b, key=lambda x: x[0])[:2], False))
    return (stack[-1][0], sorted(stack[-1][1])) if stack else (0.0, [])


def operands(rpn: list[str]) -> list[str]:
    """Labels of all licences of an expression; exceptions are none."""
    last, out = None, []
    for t in reversed(rpn):
        if t not in STRENGTH and last != "with":
            out.append(family(t)[0])
        last = t
    return sorted(set(out))


@functools.lru_cache(8)
def _automata(base: tuple, notices: tuple):
    """Automaton of the phrases between blanks, and that of the tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    spelt = {p.replace("license", "licence"): v for p, v in (*base, *notices)} | dict(notices)
    for p, label in (spelt | dict(base)).items():
        phrases.add_word(f" {p} ", (label, len(p.split()), len(p) + 2, p in dict(base)))
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def _hits(norm: str, automaton) -> list[tuple]:
    """(start, end, start word, words, label, base) of each phrase, by start, the longest first."""
    hits, seen, word = [], 0, -1
    for end, (label, n, size, base) in automaton.iter(norm):
        # phrases are found by their ends; blanks up to the start are counted on from the last one's
        start = end - size + 1
        word += norm.count(" ", seen, start + 1) if start >= seen else -norm.count(" ", start + 1, seen)
        seen = start + 1
        hits.append((start, end, word, n, label, base))
    return sorted(hits, key=lambda h: (h[0], -h[1], h[4]))


def _neighbours(norm: str, hits: list[tuple], taken: list[tuple[int, int]]):
    """Expressions of neighbouring notices; those in the words of taken (in order) belong to a tag's expression."""
    groups: list[list[str]] = []
    reach, near, k = -1, False, 0
    for start, end, word, _, label, _ in hits:
        while k < len(taken) and taken[k][1] <= word:
            k += 1
        if k < len(taken) and taken[k][0] <= word:
            near = False
            continue
        if end <= reach:  # part of a longer one
            continue
        between = set(norm[reach:start + 1].split()) if near and start - reach <= GAP else ()
        op = next((o for o in ("or", "with", "and") if o in between), None)
        near = bool(op) or label != EXCEPTION
        if op:
            groups[-1] += ["with" if label == EXCEPTION else op, label]
        elif near:
            groups.append([label])
        reach = end
    return (shunting_yard(g) for g in groups)


def _tagged(raw: bytes, blank: bytes, automaton):
    """Expressions behind tags, with the words that they take up; each ends at its line's end or the next tag at the latest.

    raw and blank are the lower-cased text and the same with blanks for all that is in no word.
    """
    at = [(e + 1, t) for e, t in automaton.iter(raw.decode("latin-1"))]
    seen = word = 0
    for k, (lo, tag) in enumerate(at):
        end, after = at[k + 1] if k + 1 < len(at) else (len(raw), "")
        line = raw.find(b"\n", lo, end - len(after))
        hi = line if line >= 0 else end - len(after)
        known = (lambda x: True) if tag == TAGS[0] else (lambda x: family(x)[0] != "other" or "exception" in x)
        if not tag.endswith(":") and blank[lo:lo + 1].strip(b" "):  # only the beginning of a word
            continue
        read = [lo]
        rpn, whole = shunting_yard(tokens(raw, lo, hi, read), known)
        if rpn:
            word += len(blank[seen:lo].split())
            first, seen = word, read[-1]
            word += len(blank[lo:seen].split())
            yield rpn, whole, (first, word)


def scan_text(text: bytes, base: tuple, notices: tuple) -> dict:
    """What scan() says on one text (UTF-8)."""
    phrases, tags = _automata(base, notices)
    blank = text.translate(_SEPARATORS)
    words = re.sub(b"  +", b" ", blank).strip(b" ")
    norm = f" {words.decode('latin-1')} "
    hits = _hits(norm, phrases) if words else []
    # bytes.lower() touches A-Z only
    tagged = list(_tagged(text.lower(), blank, tags))
    found = [(*x, "notice") for x in _neighbours(norm, hits, [x[2] for x in tagged])] + [(rpn, whole, "tag") for rpn, whole, _ in tagged]
    expressions = []
    for rpn, whole, origin in found:
        level, chosen = evaluate(rpn)
        expressions.append({"origin": origin, "rpn": rpn, "labels": operands(rpn), "chosen": chosen, "level": level, "valid": whole})
    hits = [h[2:] for h in hits if h[4] != EXCEPTION]
    mine = [h for h in hits if h[3]]
    labels = {h[2] for h in hits}.union(*(e["labels"] for e in expressions))
    return {"n_words": words.count(b" ") + 1 if words else 0, "n_base": len(mine),
            "first_word": min((h[0] for h in mine), default=None), "last_word": max((h[0] for h in mine), default=None),
            "base_labels": ",".join(sorted({h[2] for h in mine})), "labels": ",".join(sorted(labels)), "score": max((e["level"] for e in expressions), default=0.0),
            "hits": [{"word": w, "words": n, "label": x, "base": b} for w, n, x, b in hits], "expressions": expressions}


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<word:long,words:int,label:string,base:boolean>>, "
          "expressions array<struct<origin:string,rpn:array<string>,labels:array<string>,chosen:array<string>,level:double,valid:boolean>>")
_HITS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())]))
_STRINGS = pa.list_(pa.string())
_EXPRESSIONS = pa.list_(pa.struct([("origin", pa.string()), ("rpn", _STRINGS), ("labels", _STRINGS), ("chosen", _STRINGS), ("level", pa.float64()), ("valid", pa.bool_())]))
_ARROW = pa.schema([*((k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("hits", _HITS), ("expressions", _EXPRESSIONS)])


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Licence terms of each row of docs (doc_id, text): doc_id and SCHEMA.

    One automaton finds all phrases in the text's words (lower-cased letters, digits and what is not
    ASCII, between single blanks), another one the tags in the text as it is. Neighbouring notices with
    'or', 'and' or 'with' between them and what follows a tag are expressions, which a shunting yard
    brings into reverse Polish order and evaluate() evaluates. hits are all phrases (word: place of the
    first word, from 0), overlapping ones too; those of base give n_base, first_word, last_word and
    base_labels. labels has those of all hits and expressions; both strings are sorted and joined by
    commas. score is the level of the most restrictive expression, since all of a text's terms bind; 0
    without any.

    A text is scanned where it is read, in time and memory that grow with its length; nothing is
    shuffled. A null text is an empty one and has no words; a null doc_id stays null; repeated rows and
    equal texts each get their row; an empty table gives none; other columns are not read.
    """
    b, n = tuple(base.items()), tuple(notices.items())

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 64):
                part = texts.slice(lo, 64)
                rows = [scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"", b, n) for t in part]
                out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), *out.columns], names=["doc_id", *_ARROW.names])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents, without the lists."""
    return scan(C.table(spark, sf_dir, "documents")).drop("hits", "expressions")


QUERIES = {"op11_license_scans": (op11_license_scans, None)}
