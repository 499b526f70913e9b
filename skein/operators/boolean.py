"""Boolean queries: AND, OR, NOT and parentheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECEDENCE = {"NOT": 3, "AND": 2, "OR": 1, "(": 0}


class QueryError(ValueError):
    """A boolean query that can't be read."""


def postfix(query: str) -> list[str]:
    """The query's operands and operators in postfix order. Operators are upper case only."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand may come next
    for token in query.replace("(", " ( ").replace(")", " ) ").split():
        if token in ("NOT", "("):
            if not operand:
                raise QueryError(f"an operator is missing before {token!r}")
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                raise QueryError("unexpected )")
            stack.pop()
        elif token in PRECEDENCE:
            if operand:
                raise QueryError(f"an operand is missing before {token}")
            while stack and PRECEDENCE[stack[-1]] > PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                raise QueryError(f"an operator is missing before {token!r}")
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise QueryError("the query ends too early")
    return out + stack[::-1]


def evaluate(tokens: list[str], value) -> object:
    """A postfix query over values that have &, | and ~; value: operand to value."""
    stack = []
    for token in tokens:
        if token == "NOT":
            stack.append(~stack.pop())
        elif token in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if token == "AND" else a | b)
        else:
            stack.append(value(token))
    return stack.pop()


def operands(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys(t for t in tokens if t not in PRECEDENCE))


class _Flag:
    """A boolean with the operators of a column."""

    def __init__(self, on: bool):
        self.on = on

    def __and__(self, other: _Flag) -> _Flag:
        return _Flag(self.on and other.on)

    def __or__(self, other: _Flag) -> _Flag:
        return _Flag(self.on or other.on)

    def __invert__(self) -> _Flag:
        return _Flag(not self.on)


def select(postings: DataFrame, docs: DataFrame, tokens: list[str], terms: dict[str, str | None] | None = None) -> DataFrame:
    """The doc_ids that satisfy a postfix query, in one pass over the postings of its terms.

    terms: the term that stands for an operand; None matches nothing. Only a query that holds for documents without any
    of its terms reads the document table as well.
    """
    names = operands(tokens)
    known = {x: x for x in names} if terms is None else {x: terms.get(x) for x in names}
    wanted = sorted({t for t in known.values() if t is not None})
    column = {t: f"t{i}" for i, t in enumerate(wanted)}
    has = lambda x: F.lit(False) if known[x] is None else F.coalesce(F.col(column[known[x]]), F.lit(False))
    condition: Column = evaluate(tokens, has)
    empty = evaluate(tokens, lambda x: _Flag(False)).on
    if not wanted:
        return docs.select("doc_id").where(condition)
    found = postings.select("term", "doc_id").where(F.col("term").isin(wanted)).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == t).alias(c) for t, c in column.items()))
    if empty:
        found = docs.select("doc_id").join(found, "doc_id", "left")
    return found.where(condition).select("doc_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi").distinct()


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def complement(a: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents but those of a; of an empty a, all."""
    return docs.select("doc_id").join(a, "doc_id", "left_anti")

