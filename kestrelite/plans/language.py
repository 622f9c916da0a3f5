"""A small pattern query language and a command grammar, both built into DataFrames.

    MATCH (n:Label {k: v}) WHERE n.field > 1 AND TOROIDALDISTANCE(n.vector, 0.6) RETURN n.id, score ORDER BY score DESC LIMIT 5
    MATCH (n:Label) WHERE CONNECTEDTO(n, "REL") WITHIN 1 TO 2 HOPS RETURN n.id LIMIT 10
    MATCH (n:Label) RETURN n.kind, COUNT(*) AS n, AVG(n.price) AS mean GROUP BY n.kind HAVING n > 3
    MATCH (a:A)-[:R]->(b:B) WHERE a.size > 2 RETURN a.id, b.name      also <-[:R]-, -[:R]- and -[:R*1..3]->; columns a_id, b_name

Text is tokenized once, parsed into one small statement and turned into a DataFrame; everything after that is Catalyst's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions import vector as V
from kestrelite.operators import graph, relational, search

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(-?\d+(?:\.\d+)?)|([A-Za-z_][\w.]*)|(<>|!=|<=|>=|==|->|<-|\.\.|[-=<>(){}\[\]:,*$]))')
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


class QueryError(ValueError):
    """The query cannot be parsed or is refused."""


def validate(query: str) -> None:
    """Guards before parsing: empty, over a megabyte, or nested deeper than ten."""
    if not query.strip():
        raise QueryError("the query is empty")
    if len(query.encode()) > 1_000_000:
        raise QueryError("the query is longer than 1,000,000 bytes")
    depth = 0
    for c in query:
        depth += (c == "(") - (c == ")")
        if depth > 10:
            raise QueryError("parentheses are nested deeper than 10")


@dataclass
class Statement:
    label: str | None = None
    alias: str = "n"
    properties: dict = field(default_factory=dict)
    conditions: list[tuple] = field(default_factory=list)
    returns: list[tuple[str, str]] = field(default_factory=list)
    aggregates: dict[str, tuple[str, str]] = field(default_factory=dict)
    group: list[str] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    edge: tuple[str | None, str, int, int] | None = None
    other: tuple[str, str | None, dict] | None = None
    order: tuple[str, bool] | None = None
    limit: int | None = None
    explain: bool = False
    hints: dict = field(default_factory=dict)


class Parser:
    def __init__(self, query: str) -> None:
        validate(query)
        self.tokens: list[str] = []
        at, text = 0, query.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected text at {text[at:at + 20]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at, self.pair = 0, False

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or expected and t.upper() != expected:
            raise QueryError(f"expected {expected or 'more'}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def take(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False

    def value(self):
        t = self.next()
        if t[0] in "\"'":
            return t[1:-1]
        if t.upper() in ("TRUE", "FALSE"):
            return t.upper() == "TRUE"
        try:
            return float(t) if "." in t else int(t)
        except ValueError:
            raise QueryError(f"expected a value, found {t!r}") from None

    def name(self) -> str:
        """A field with its alias taken off, or put before it where a pattern has two."""
        return self.field(self.next())

    def field(self, t: str) -> str:
        return t.replace(".", "_") if self.pair else t.rpartition(".")[2]

    def node(self) -> tuple[str, str | None, dict]:
        self.next("(")
        alias, label, properties = self.next(), None, {}
        if self.take(":"):
            label = self.next()
        if self.take("{"):
            while not self.take("}"):
                key = self.next().rpartition(".")[2]
                self.next(":")
                properties[key] = self.value()
                self.take(",")
        self.next(")")
        return alias, label, properties

    def relation(self) -> tuple[str | None, str, int, int]:
        """An edge pattern: type, direction, least and most hops."""
        back = self.take("<-")
        back or self.next("-")
        self.next("[")
        kind = self.next() if self.take(":") else None
        low = high = 1
        if self.take("*"):
            low = int(self.value())
            high = int(self.value()) if self.take("..") else low
        self.next("]")
        forth = self.take("->")
        forth or self.next("-")
        if back and forth or not 1 <= low <= high:
            raise QueryError("an edge has one direction and 1 to n hops")
        return kind, "in" if back else "out" if forth else "both", low, high

    def parse(self) -> Statement:
        s = Statement()
        s.explain = self.take("EXPLAIN")
        self.take("DISTRIBUTED")
        self.next("MATCH")
        s.alias, s.label, s.properties = self.node()
        if self.peek() in ("-", "<-"):
            s.edge, s.other, self.pair = self.relation(), self.node(), True
            if s.other[0] == s.alias:
                raise QueryError("the two nodes of a pattern need different names")
        if self.take("WHERE"):
            s.conditions.append(self.condition())
            while self.take("AND"):
                s.conditions.append(self.condition())
        self.next("RETURN")
        while True:
            self.item(s)
            if not self.take(","):
                break
        if self.take("GROUP"):
            self.next("BY")
            s.group.append(self.name())
            while self.take(","):
                s.group.append(self.name())
        if self.take("HAVING"):
            s.having.append(self.asked(s))
            while self.take("AND"):
                s.having.append(self.asked(s))
        if self.take("ORDER"):
            self.next("BY")
            key = self.name()
            down = self.take("DESC")
            down or self.take("ASC")
            s.order = (key, down)
        if self.take("LIMIT"):
            s.limit = int(self.value())
        while self.take("USING") or self.take("PREFER") or self.take("PREFETCH") or self.take("SCATTER"):
            word = self.tokens[self.at - 1].upper()
            s.hints[word] = self.next()
            if word == "PREFETCH":
                s.hints[word] = self.value()
        if self.peek():
            raise QueryError(f"unexpected {self.peek()!r} at the end")
        return s

    def item(self, s: Statement) -> None:
        t = self.next()
        if t.upper() in AGGREGATES and self.take("("):
            arg = "*" if self.take("*") else self.name()
            self.next(")")
            alias = self.next() if self.take("AS") else f"{t.lower()}_{'all' if arg == '*' else arg}"
            s.aggregates[alias] = (t.lower(), arg)
        else:
            name = self.field(t)
            s.returns.append((name, self.next() if self.take("AS") else name))

    def asked(self, s: Statement) -> tuple:
        """A condition on a returned column or on an aggregate as it was returned."""
        t = self.next()
        if t.upper() in AGGREGATES and self.take("("):
            arg = "*" if self.take("*") else self.name()
            self.next(")")
            name = next((a for a, f in s.aggregates.items() if f == (t.lower(), arg)), None)
        else:
            name = t
        if name not in s.aggregates and name not in s.group:
            raise QueryError(f"HAVING needs a returned aggregate or a group, not {t!r}")
        return name, self.next(), self.value()

    def condition(self) -> tuple:
        t = self.peek().upper()
        if t in ("TOROIDALDISTANCE", "SIMILAR_TO", "COSINE_SIMILARITY"):
            self.next()
            self.next("(")
            self.name()
            self.next(",")
            if self.take("$"):
                self.name()
                self.next(")")
                self.next(">")
                return ("cosine", float(self.value()))
            limit = float(self.value())
            self.next(")")
            return ("torus" if t == "TOROIDALDISTANCE" else "cosine", limit)
        if t == "CONNECTEDTO":
            self.next()
            self.next("(")
            self.name()
            kind, where = None, None
            while self.take(","):
                if self.peek()[:1] in ('"', "'"):
                    kind = self.value()  # a second type takes the place of the first
                else:
                    where = (self.name(), self.next(",") and self.value())
            if kind is None:
                raise QueryError("CONNECTEDTO needs an edge type")
            self.next(")")
            self.next("WITHIN")
            low = int(self.value())
            low, high = (low, int(self.value())) if self.take("TO") else (1, low)
            self.next("HOPS")
            return ("hops", kind, min(low, high), max(low, high), where)
        name = self.name()
        op = self.next()
        if op.upper() not in ("=", "==", "<>", "!=", "<", "<=", ">", ">=", "LIKE", "ILIKE"):
            raise QueryError(f"unknown operator {op!r}")
        return ("property", name, op, self.value())


class Engine:
    """Runs statements over registered node tables and an edge table."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.nodes, self.edges = spark, {}, None
        self.key, self.vec = {}, {}

    def register(self, label: str, df: DataFrame, key: str = "id", vec: str | None = None) -> None:
        self.nodes[label], self.key[label], self.vec[label] = df, key, vec

    def pairs(self, s: Statement) -> DataFrame:
        """The node pairs of an edge pattern, columns ``alias_field``; filters are left to the optimizer to move to the scans."""
        ends = []
        for alias, label, properties in ((s.alias, s.label, s.properties), s.other):
            if label not in self.nodes:
                raise QueryError(f"unknown label {label!r}; known: {sorted(self.nodes)}")
            df = self.nodes[label]
            df = df.where(relational.all_of([relational.compare(k, "=", v) for k, v in properties.items()])) if properties else df
            own = [F.col(c).alias(f"{alias}_{c}") for c in df.columns if c != "id"]
            ends.append(df.select(F.col(self.key[label]).alias(f"{alias}_id"), *own))
        if self.edges is None:
            raise QueryError("no edges are registered")
        kind, direction, low, high = s.edge
        a, b = (end.select(F.col(end.columns[0]).alias("id")) for end in ends)
        if high == 1:
            found = graph.pattern(a, self.edges, b, kind, direction)
        else:
            e = graph.typed(self.edges, kind)
            e = graph.undirected(e) if direction == "both" else e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "in" else e
            far = graph.all_distances(e, a, high).where(F.col("dist").between(low, high) & (F.col("id") != F.col("source")))
            found = far.select(F.col("source").alias("a_id"), F.col("id").alias("b_id")).join(b.select(F.col("id").alias("b_id")), "b_id", "left_semi")
        found = found.select(F.col("a_id").alias("__a"), F.col("b_id").alias("__b"))
        found = found.join(ends[0], found["__a"] == ends[0][f"{s.alias}_id"]).join(ends[1], found["__b"] == ends[1][f"{s.other[0]}_id"]).drop("__a", "__b")
        plain = [relational.compare(c[1], c[2], c[3]) for c in s.conditions if c[0] == "property"]
        if len(plain) < len(s.conditions):
            raise QueryError("an edge pattern takes property conditions only")
        return found.where(relational.all_of(plain)) if plain else found

    def build(self, s: Statement, vector: list[float] | None = None, dim: int | None = None) -> DataFrame:
        if s.edge:
            return self.finish(s, self.pairs(s), f"{s.alias}_id", False)
        if s.label not in self.nodes:
            raise QueryError(f"unknown label {s.label!r}; known: {sorted(self.nodes)}")
        df, key, vec = self.nodes[s.label], self.key[s.label], self.vec[s.label]
        plain = [relational.compare(k, "=", v) for k, v in s.properties.items()]
        plain += [relational.compare(c[1], c[2], c[3]) for c in s.conditions if c[0] == "property"]
        df = df.where(relational.all_of(plain)) if plain else df  # cheap filters first, then distances
        for c in s.conditions:
            if c[0] in ("torus", "cosine"):
                if vector is None or vec is None:
                    raise QueryError("a vector condition needs a query vector and a label with vectors")
                n = dim or len(vector)
                df = search.prefix_search(df, vector, n, c[1], vec) if c[0] == "torus" else search.within(df, vector, c[1], "cosine", vec)
            elif c[0] == "hops":
                if self.edges is None:
                    raise QueryError("no edges are registered")
                hit = graph.within_hops(self.edges, self.nodes[s.label].select(F.col(key).alias("id")), c[2], c[3], c[1]).select(F.col("id").alias(key))
                df = df if c[4] is None else df.where(relational.compare(c[4][0], "=", c[4][1]))
                df = df.join(hit, key, "left_semi").withColumn("score", F.lit((c[2] + c[3]) / 2))
        alike = any(c[0] == "cosine" for c in s.conditions)
        return self.finish(s, df, key, alike, every=any(c[0] == "hops" for c in s.conditions))

    def finish(self, s: Statement, df: DataFrame, key: str, alike: bool, every: bool = False) -> DataFrame:
        """Aggregates, order, limit and columns. ``alike``: the best scores are the highest; ``every``: no limit unless asked."""
        if s.aggregates:
            keys = s.group or [n for n, _ in s.returns]
            asked = [relational.compare(*h) for h in s.having]
            df = relational.aggregate(df, s.aggregates, keys, relational.all_of(asked) if asked else None)
        if s.order:
            df = df.orderBy(F.col(s.order[0]).desc() if s.order[1] else F.col(s.order[0]).asc(), *([] if s.aggregates else [key]))
        elif "score" in df.columns and not s.aggregates:
            df = df.orderBy(F.col("score").desc() if alike else F.col("score").asc(), key)
        if s.limit is not None or not (s.aggregates or every):
            df = df.limit(10 if s.limit is None else s.limit)
        if not s.aggregates:
            id_ = lambda n: key if n == "id" and "id" not in df.columns else n
            df = df.select(*[F.col(id_(n)).alias(a) for n, a in s.returns])
        return df

    def run(self, query: str, vector: list[float] | None = None, dim: int | None = None) -> DataFrame:
        s = Parser(query).parse()
        if s.explain:
            return self.spark.createDataFrame(list(enumerate(steps(s), 1)), "step int, operation string")
        return self.build(s, vector, dim)

    def command(self, text: str) -> DataFrame:
        """toroidal_search("label", [v], t, d) | get_neighbors(id) | graph_search(id, depth) | add_edge(a, b, "R", w)."""
        m = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", text, re.S)
        if not m:
            raise QueryError("expected name(arguments)")
        args = [a.strip().strip("\"'") for a in re.split(r",(?![^\[]*\])", m.group(2))]
        if m.group(1) == "toroidal_search":
            v = [float(x) for x in args[1].strip("[]").split(",")]
            label = args[0]
            t = float(args[2]) if len(args) > 2 else 0.3
            d = int(args[3].lstrip("d")) if len(args) > 3 else len(v)
            return search.wrapped_search(self.nodes[label], v, d, t, self.vec[label]).orderBy("score", self.key[label])
        if m.group(1) == "get_neighbors":
            return self.edges.where(F.col("src") == int(args[0])).select(F.col("dst").alias("id")).distinct()
        if m.group(1) == "graph_search":
            start = self.spark.createDataFrame([(int(args[0]),)], "id long")
            return graph.bfs(self.edges, start, int(args[1]))
        if m.group(1) == "add_edge":
            new = self.spark.createDataFrame([(int(args[0]), int(args[1]), args[2], float(args[3]))], "src long, dst long, relation_type string, weight double")
            self.edges = new if self.edges is None else self.edges.unionByName(new, allowMissingColumns=True)
            return new
        raise QueryError(f"unknown command {m.group(1)!r}")


def steps(s: Statement) -> list[str]:
    """Numbered steps of a statement, in the order the builder applies them."""
    out = [f"scan {s.label}"]
    out += [f"pattern {s.edge[1]} {s.edge[0]}, {s.edge[2]} to {s.edge[3]} hops, to {s.other[1]}"] if s.edge else []
    out += [f"filter {k} = {v!r}" for k, v in s.properties.items()]
    out += [f"filter {c[1]} {c[2]} {c[3]!r}" for c in s.conditions if c[0] == "property"]
    out += [f"{c[0]} search, threshold {c[1]}" for c in s.conditions if c[0] in ("torus", "cosine")]
    out += [f"traverse {c[1]}, {c[2]} to {c[3]} hops" for c in s.conditions if c[0] == "hops"]
    out += [f"aggregate {', '.join(s.aggregates)}"] if s.aggregates else []
    out += [f"order by {s.order[0]}{' descending' if s.order[1] else ''}"] if s.order else []
    every = s.aggregates or any(c[0] == "hops" for c in s.conditions)
    return [*out, f"limit {10 if s.limit is None else s.limit}"] if s.limit is not None or not every else out
