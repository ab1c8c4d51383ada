"""Boolean queries: a parser on the driver, and one aggregate and one predicate for all operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index

DETECT = re.compile(r"\b(AND|OR|NOT)\b", re.IGNORECASE)


class BooleanSyntaxError(ValueError):
    """The query is not a Boolean expression."""


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not, and_not
    parts: tuple


def is_boolean(query: str) -> bool:
    return bool(DETECT.search(query))


def without_operators(query: str) -> str:
    return DETECT.sub(" ", query)


def parse(query: str, analyze: Callable[[str], list[str]]) -> Term | Node:
    """The query as a tree. OR binds least, then AND and AND NOT, then NOT; all but NOT associate left.

    Words in a row are one operand: the conjunction of their terms. NOT takes a word or parenthesis.
    """
    tokens = re.findall(r"[()]|[^\s()]+", query)
    at = 0

    def word(k: int) -> str:
        return tokens[k].upper() if k < len(tokens) else ""

    def primary():
        nonlocal at
        if word(at) == "(":
            at += 1
            inner = either()
            if word(at) != ")":
                raise BooleanSyntaxError("a parenthesis is not closed")
            at += 1
            return inner
        words = []
        while at < len(tokens) and word(at) not in ("AND", "OR", "NOT", "(", ")"):
            words.append(tokens[at])
            at += 1
        if not words:
            raise BooleanSyntaxError(f"an operand is missing before {tokens[at]!r}" if at < len(tokens) else "an operand is missing at the end")
        return Term(tuple(dict.fromkeys(analyze(" ".join(words)))))

    def negated():
        nonlocal at
        if word(at) == "NOT":
            at += 1
            return Node("not", (primary(),))
        return primary()

    def both():
        nonlocal at
        left = negated()
        while word(at) == "AND":
            at += 1
            if word(at) == "NOT":
                at += 1
                left = Node("and_not", (left, primary()))
            else:
                left = Node("and", (left, negated()))
        return left

    def either():
        nonlocal at
        left = both()
        while word(at) == "OR":
            at += 1
            left = Node("or", (left, both()))
        return left

    tree = either()
    if at < len(tokens):
        raise BooleanSyntaxError(f"unexpected {tokens[at]!r}")
    return tree


def terms_of(tree) -> list[str]:
    return list(dict.fromkeys(tree.words if isinstance(tree, Term) else [t for p in tree.parts for t in terms_of(p)]))


def has_not(tree) -> bool:
    """Whether a document without any of the terms may fit."""
    return isinstance(tree, Node) and (tree.kind == "not" or any(map(has_not, tree.parts)))


def condition(tree, flag: Callable[[str], Column]) -> Column:
    if isinstance(tree, Term):
        return reduce(Column.__and__, map(flag, tree.words)) if tree.words else F.lit(False)
    parts = [condition(p, flag) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    return parts[0] & parts[1] if tree.kind == "and" else parts[0] | parts[1] if tree.kind == "or" else parts[0] & ~parts[1]


def execute(index: Index, tree) -> DataFrame:
    """doc_id of the documents that fit; the universe is the documents with a posting.

    The postings of all terms are read once and folded to one row of flags a document. Only a query
    with NOT needs the universe.
    """
    words = terms_of(tree)
    if has_not(tree):
        p = index.postings if words else index.postings.limit(0)
        if not words:
            keep = index.docs.where("dl > 0").select("doc_id")
            return keep.where(condition(tree, lambda t: F.lit(False)))
        flags = index.docs.where("dl > 0").select("doc_id")
        hit = p.where(F.col("term").isin(words)).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == w).alias(f"b{i}") for i, w in enumerate(words)))
        flags = flags.join(hit, "doc_id", "left")
    else:
        if not words:
            return index.docs.select("doc_id").limit(0)
        flags = index.of_terms(words).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == w).alias(f"b{i}") for i, w in enumerate(words)))
    number = {w: i for i, w in enumerate(words)}
    return flags.where(condition(tree, lambda t: F.coalesce(F.col(f"b{number[t]}"), F.lit(False)))).select("doc_id")


def first(found: DataFrame, n: int = 10) -> DataFrame:
    """The first n ids, unranked."""
    return found.orderBy("doc_id").limit(n)
