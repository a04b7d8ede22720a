"""A read-only subset of Cypher, compiled to DataFrames.

``MATCH`` patterns with labels, property maps, edges in either direction and repeated variables; several
patterns by commas or repeated ``MATCH``; ``WHERE`` with comparisons, string operators, ``IN`` lists, ``IS NULL``,
``AND``, ``OR``, ``NOT`` and parentheses; ``RETURN`` of variables and properties; ``AS_OF``, ``ORDER BY``, ``SKIP`` and
``LIMIT``. Results are sets. Scope and time come from the snapshot, at the base of the plan: every node and
every edge of a match holds at the time that is asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_pattern
from ..model import SCHEMAS
from ..snapshot import Snapshot


class CypherError(Exception):
    """Any fault of a query text."""


class CypherSyntaxError(CypherError):
    """The text is no query."""


class UnsupportedCypher(CypherError):
    """The text asks for something outside the subset."""


UNSUPPORTED = {"MERGE", "CREATE", "DELETE", "SET", "REMOVE", "DETACH", "CALL", "OPTIONAL", "UNION", "FOREACH", "UNWIND", "WITH"}
AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
NODE_COLUMNS = dict(c.split(" ", 1) for c in SCHEMAS["entities"].split(", "))
EDGE_COLUMNS = dict(c.split(" ", 1) for c in SCHEMAS["edges"].split(", "))
_SHAPES = [
    ("space", r"\s+|//[^\n]*"),
    ("text", r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""),
    ("number", r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w])"),
    ("word", r"[A-Za-z_]\w*"),
    ("sign", r"<>|<=|>=|->|<-|--|[-()\[\]{},.:=<>*|$]"),
]
_LEXER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _SHAPES))


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None = None
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Hop:
    var: str
    relation: str | None
    forward: bool
    target: Node


@dataclass(frozen=True)
class Pattern:
    head: Node
    hops: tuple[Hop, ...] = ()


@dataclass(frozen=True)
class Ref:
    var: str
    prop: str | None = None


@dataclass(frozen=True)
class Test:
    op: str
    args: tuple


@dataclass(frozen=True)
class Item:
    ref: Ref
    name: str


@dataclass(frozen=True)
class Query:
    patterns: tuple[Pattern, ...]
    where: Test | None
    items: tuple[Item, ...]
    order: tuple[tuple[Ref, bool], ...] = ()
    skip: int = 0
    limit: int | None = None
    as_of: str | None = None


@dataclass
class Parser:
    source: str
    parity: bool = False
    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    at: int = 0
    hidden: int = 0

    def __post_init__(self) -> None:
        pos = 0
        while pos < len(self.source):
            m = _LEXER.match(self.source, pos)
            if not m:
                raise CypherSyntaxError(f"unexpected {self.source[pos]!r} at {pos}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], pos))
            pos = m.end()
        self.tokens.append(("end", "", pos))
        for i, (kind, text, _) in enumerate(self.tokens):
            before = self.tokens[i - 1][1].upper() if i else ""
            if kind == "word" and text.upper() in UNSUPPORTED and before not in (".", ":", "STARTS", "ENDS"):
                raise UnsupportedCypher(f"{text.upper()} is outside the subset")

    # tokens
    def peek(self, text: str) -> bool:
        kind, got, _ = self.tokens[self.at]
        return got == text if kind == "sign" else kind == "word" and got.upper() == text

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise CypherSyntaxError(f"expected {text} at {self.tokens[self.at][2]}, found {self.tokens[self.at][1]!r}")

    def word(self) -> str:
        kind, text, pos = self.tokens[self.at]
        if kind != "word":
            raise CypherSyntaxError(f"expected a name at {pos}, found {text!r}")
        self.at += 1
        return text

    def name(self) -> str:
        """A variable, or a hidden one."""
        if self.tokens[self.at][0] == "word":
            return self.word()
        self.hidden += 1
        return f"_{self.hidden}"

    def literal(self):
        kind, text, pos = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "number":
            return float(text) if re.search("[.eE]", text) else int(text)
        if kind == "word" and text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise CypherSyntaxError(f"expected a value at {pos}, found {text!r}")

    def integer(self) -> int:
        kind, text, pos = self.tokens[self.at]
        if kind != "number" or not text.isdigit():
            raise CypherSyntaxError(f"expected a count at {pos}, found {text!r}")
        self.at += 1
        return int(text)

    # clauses
    def query(self) -> Query:
        patterns: list[Pattern] = []
        self.need("MATCH")
        while True:
            patterns.append(self.pattern())
            if not (self.take(",") or self.take("MATCH")):
                break
        where = self.either() if self.take("WHERE") else None
        while self.take("MATCH"):
            raise UnsupportedCypher("MATCH after WHERE is outside the subset")
        self.need("RETURN")
        if self.peek("DISTINCT"):
            self.at += 1
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        order: list[tuple[Ref, bool]] = []
        rest: dict = {}
        while self.tokens[self.at][0] != "end":
            if self.take("AS_OF"):
                rest["as_of"] = self.literal()
                if not isinstance(rest["as_of"], str):
                    raise CypherSyntaxError("AS_OF takes a time in quotes")
            elif self.take("LIMIT"):
                rest["limit"] = self.integer()
            elif self.take("SKIP"):
                rest["skip"] = self.integer()
            elif self.take("ORDER"):
                self.need("BY")
                while True:
                    ref = self.ref()
                    order.append((ref, self.take("DESC") or (self.take("ASC") and False)))
                    if not self.take(","):
                        break
            else:
                raise CypherSyntaxError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return Query(tuple(patterns), where, tuple(items), tuple(order), **rest)

    def pattern(self) -> Pattern:
        if self.tokens[self.at][0] == "word" and self.tokens[self.at + 1][1] == "=":
            raise UnsupportedCypher("path variables are outside the subset")
        head = self.node()
        hops = []
        while self.peek("-") or self.peek("<-") or self.peek("--") or self.peek("->"):
            hops.append(self.hop())
        return Pattern(head, tuple(hops))

    def node(self) -> Node:
        self.need("(")
        var = self.name()
        label = self.word() if self.take(":") else None
        props = []
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                props.append((key, self.literal()))
                if not self.peek("}"):
                    self.need(",")
        self.need(")")
        return Node(var, label, tuple(props))

    def hop(self) -> Hop:
        back = self.take("<-")
        short = not back and self.take("--")
        if not back and not short:
            self.need("-")
        var, relation = None, None
        if not short and self.take("["):
            var = self.name()
            if self.take(":"):
                relation = self.word()
            if self.peek("*") or self.peek("|"):
                raise UnsupportedCypher("paths of variable length and relation alternatives are outside the subset")
            self.need("]")
        if back:
            if not (var is None and self.peek("(")):
                self.need("-")
        elif short:
            if not self.take(">"):
                raise UnsupportedCypher("edges without a direction are outside the subset")
        else:
            self.need("->")
        if var is None:
            self.hidden += 1
            var = f"_{self.hidden}"
        return Hop(var, relation, not back, self.node())

    def either(self) -> Test:
        out = self.both()
        while self.peek("OR"):
            if self.parity:
                raise UnsupportedCypher("OR is outside the subset")
            self.at += 1
            out = Test("OR", (out, self.both()))
        return out

    def both(self) -> Test:
        out = self.term()
        while self.take("AND"):
            out = Test("AND", (out, self.term()))
        return out

    def term(self) -> Test:
        if self.take("NOT"):
            return Test("NOT", (self.term(),))
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        left = self.operand()
        for sign in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(sign):
                return Test(sign, (left, self.operand()))
        if self.take("CONTAINS"):
            return Test("CONTAINS", (left, self.operand()))
        for word in ("STARTS", "ENDS"):
            if self.take(word):
                self.need("WITH")
                return Test(word, (left, self.operand()))
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.literal())
                if not self.peek("]"):
                    self.need(",")
            return Test("IN", (left, tuple(values)))
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return Test("IS NOT NULL" if negated else "IS NULL", (left,))
        raise CypherSyntaxError(f"expected a comparison at {self.tokens[self.at][2]}")

    def operand(self):
        kind, text, _ = self.tokens[self.at]
        if kind == "word" and text.upper() not in ("TRUE", "FALSE", "NULL"):
            return self.ref()
        return self.literal()

    def ref(self) -> Ref:
        var = self.word()
        if self.peek("(") and var.lower() in AGGREGATES:
            raise UnsupportedCypher(f"{var}() is outside the subset")
        return Ref(var, self.word() if self.take(".") else None)

    def item(self) -> Item:
        ref = self.ref()
        name = self.word() if self.take("AS") else (f"{ref.var}.{ref.prop}" if ref.prop else ref.var)
        return Item(ref, name)


def parse(source: str, parity: bool = False) -> Query:
    """The query of a text. ``parity`` refuses OR, which the documented grammar lacks."""
    return Parser(source, parity).query()


class Plan:
    """DataFrames of one query."""

    def __init__(self, graph: Snapshot, query: Query, strict: bool = False):
        self.query, self.strict = query, strict
        self.graph = graph.seen_at(query.as_of, graph.axis) if query.as_of is not None else graph
        self.kinds: dict[str, str] = {}
        for p in query.patterns:
            for n in (p.head, *(h.target for h in p.hops)):
                self.kinds[n.var] = "node"
            for h in p.hops:
                if self.kinds.get(h.var) == "node" or (h.var in self.kinds):
                    raise CypherSyntaxError(f"{h.var} is bound twice")
                self.kinds[h.var] = "edge"
        refs = [i.ref for i in query.items] + [r for r, _ in query.order] + list(_refs(query.where))
        #: Variables that are returned, ordered by or tested.
        self.named = {ref.var for ref in refs}
        for ref in refs:
            if ref.var not in self.kinds:
                raise CypherSyntaxError(f"{ref.var} is not bound")

    def prop(self, var: str, name: str) -> Column:
        """A column of a variable, else a value of its attributes (text)."""
        columns = NODE_COLUMNS if self.kinds[var] == "node" else EDGE_COLUMNS
        if name in columns:
            return F.col(f"{var}__{name}")
        return F.get_json_object(F.col(f"{var}__attrs_json"), "$['" + name.replace("'", "\\'") + "']")

    def kind(self, var: str, name: str) -> str:
        columns = NODE_COLUMNS if self.kinds[var] == "node" else EDGE_COLUMNS
        return columns.get(name, "json")

    def value(self, x, beside=None) -> Column:
        """An operand; a literal takes the type of what stands beside it."""
        if isinstance(x, Ref):
            out = self.prop(x.var, x.prop or "id")
            if self.kind(x.var, x.prop or "id") == "json" and isinstance(beside, (int, float)) and not isinstance(beside, bool):
                out = out.cast("double")
            return out
        if isinstance(beside, Ref):
            kind = self.kind(beside.var, beside.prop or "id")
            if isinstance(x, str) and kind == "timestamp_ntz":
                return F.lit(x).cast("timestamp_ntz")
            if isinstance(x, bool) and kind == "json":
                return F.lit(str(x).lower())
        return F.lit(x)

    def test(self, t: Test) -> Column:
        if t.op in ("AND", "OR"):
            a, b = (self.test(x) for x in t.args)
            return a & b if t.op == "AND" else a | b
        if t.op == "NOT":
            return ~self.test(t.args[0])
        if t.op in ("IS NULL", "IS NOT NULL"):
            c = self.value(t.args[0])
            return c.isNull() if t.op == "IS NULL" else c.isNotNull()
        left, right = t.args
        if t.op == "IN":
            return self.value(left, right[0] if right else None).isin(*(self.value(x, left) for x in right)) if right else F.lit(False)
        a, b = self.value(left, right), self.value(right, left)
        if t.op in ("CONTAINS", "STARTS", "ENDS"):
            if not isinstance(right, str):
                raise CypherSyntaxError(f"{t.op} takes a text")
            if self.strict:
                return {"CONTAINS": a.contains, "STARTS": a.startswith, "ENDS": a.endswith}[t.op](right)
            pattern = like_pattern(right)
            return a.ilike({"CONTAINS": f"%{pattern}%", "STARTS": f"{pattern}%", "ENDS": f"%{pattern}"}[t.op])
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[t.op]

    def node(self, n: Node) -> DataFrame:
        df = self.graph.nodes().select(*(F.col(c).alias(f"{n.var}__{c}") for c in NODE_COLUMNS))
        return self.narrowed(df, n)

    def narrowed(self, df: DataFrame, n: Node) -> DataFrame:
        if n.label:
            df = df.where(F.col(f"{n.var}__type") == n.label)
        for key, value in n.props:
            ref = Ref(n.var, key)
            df = df.where(self.value(ref, value) == self.value(value, ref))
        return df

    def pattern(self, p: Pattern) -> DataFrame:
        df = self.node(p.head)
        bound = {p.head.var}
        at = p.head.var
        closed = len({p.head.var, *(h.target.var for h in p.hops)}) <= len(p.hops)
        for h in p.hops:
            e = self.graph.links().select(*(F.col(c).alias(f"{h.var}__{c}") for c in EDGE_COLUMNS))
            if h.relation:
                e = e.where(F.col(f"{h.var}__relation_type") == h.relation)
            near, far = ("source_id", "target_id") if h.forward else ("target_id", "source_id")
            if closed and h.var not in self.named:  # edges side by side would be paired with each other, and rows are distinct anyhow
                e = e.select(f"{h.var}__{near}", f"{h.var}__{far}").distinct()
            df = df.join(e, F.col(f"{at}__id") == F.col(f"{h.var}__{near}"))
            if h.target.var in bound:
                df = self.narrowed(df.where(F.col(f"{h.var}__{far}") == F.col(f"{h.target.var}__id")), h.target)
            else:
                df = df.join(self.node(h.target), F.col(f"{h.var}__{far}") == F.col(f"{h.target.var}__id"))
                bound.add(h.target.var)
            at = h.target.var
        return df

    def build(self) -> DataFrame:
        df, bound = None, set()
        for p in self.query.patterns:
            own = {p.head.var, *(h.target.var for h in p.hops)}
            part = self.pattern(p)
            if df is None:
                df = part
            elif shared := sorted(own & bound):
                hidden = {c: f"_r_{c}" for v in shared for c in part.columns if c.startswith(f"{v}__")}
                part = part.withColumnsRenamed(hidden)
                on = reduce(lambda a, b: a & b, (F.col(f"{v}__id") == F.col(f"_r_{v}__id") for v in shared))
                df = df.join(part, on).drop(*hidden.values())
            else:
                df = df.crossJoin(part)
            bound |= own
        if self.query.where is not None:
            df = df.where(self.test(self.query.where))
        out = df.select(*(self.returned(i).alias(i.name) for i in self.query.items), *(self.prop(r.var, r.prop or "id").alias(f"_o{k}") for k, (r, _) in enumerate(self.query.order)))
        out = out.distinct()
        if self.query.order:
            out = out.orderBy(*(F.desc(f"_o{k}") if down else F.asc(f"_o{k}") for k, (_, down) in enumerate(self.query.order)))
        elif self.query.skip or self.query.limit is not None:
            out = out.orderBy(*(F.col(f"`{i.name}`") for i in self.query.items))  # a page is always the same one
        if self.query.skip:
            out = out.offset(self.query.skip)
        if self.query.limit is not None:
            out = out.limit(self.query.limit)
        return out.drop(*(f"_o{k}" for k in range(len(self.query.order))))

    def returned(self, i: Item) -> Column:
        if i.ref.prop:
            return self.prop(i.ref.var, i.ref.prop)
        shown = ("id", "type", "name", "scope", "valid_from", "valid_until") if self.kinds[i.ref.var] == "node" else ("id", "source_id", "target_id", "relation_type", "confidence_score", "valid_from", "valid_until")
        return F.struct(*(F.col(f"{i.ref.var}__{c}").alias(c) for c in shown))


def _refs(t) -> list[Ref]:
    if isinstance(t, Ref):
        return [t]
    if isinstance(t, Test):
        return [r for x in t.args for r in _refs(x)]
    return []


def cypher(graph: Snapshot, source: str, *, strict: bool = False, parity: bool = False) -> DataFrame:
    """The rows of a query over a snapshot. ``strict`` makes string operators case-sensitive."""
    return Plan(graph, parse(source, parity), strict).build()
