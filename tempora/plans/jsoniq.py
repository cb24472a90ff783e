"""A text front end: a FLWOR subset of JSONiq, compiled to DataFrame composition.

    run(spark, {"orders": orders}, '''
        for $o in collection("orders")
        let $v := $o.price * $o.qty
        where $v gt 10 and $o.status = "open"
        group by $c := $o.customer
        order by sum($v) descending
        return {"customer": $c, "n": count($o), "total": sum($v)}''')

Clauses: ``for`` (over collections, queries in parentheses, or arrays with ``at``
and ``allowing empty``), ``let``, ``where``, ``group by``, ``count``, ``order
by``, ``return``; ``let`` and ``where`` after ``group by`` see the groups' aggregates.
``subsequence(<query>, s, n)`` and ``count|sum|avg|min|max(<query>)`` stand around
a query; quantifiers, conditionals, ``switch``, comparisons, arithmetic, object
constructors, FLWOR over arrays within expressions, member and array access,
predicates ``[?$$.x gt 1]``, unboxing ``[]``, members at any depth ``=>>name``, and
the function table below.  A prolog declares functions and external variables.
Two ``for`` clauses over collections join; a ``where`` must follow that relates
them by an equality, which becomes the join's key by Catalyst's own rewriting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<var>\$\$|\$[A-Za-z_][\w-]*)"""
    r"""|(?P<name>[A-Za-z_][\w-]*(?::[A-Za-z_][\w-]*)?)|(?P<op>:=|=>>|!=|<=|>=|\|\||[-+*=<>(){}\[\],:.?;]))"""
)

VALUE_COMPARE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": S.total, "avg": F.avg, "min": F.min, "max": F.max}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceiling": F.ceil, "floor": F.floor, "round": S.round_up_ties, "round-half-to-even": S.round_half_even, "number": S.number,
    "string": lambda x: x.cast("string"), "concat": S.concat, "string-length": F.char_length, "upper-case": F.upper, "lower-case": F.lower,
    "contains": lambda a, b: a.contains(b), "starts-with": lambda a, b: a.startswith(b), "ends-with": lambda a, b: a.endswith(b),
    "normalize-space": S.normalize_space, "substring": lambda s, a, n=None: S.substring(s, a, n), "substring-before": S.substring_before, "substring-after": S.substring_after,
    "matches": lambda a, b: F.regexp_like(a, b), "replace": lambda a, b, c: F.regexp_replace(a, b, c),
    "not": S.negate, "exists": lambda x: x.isNotNull(), "empty": lambda x: x.isNull(), "true": lambda: F.lit(True), "false": lambda: F.lit(False),
    "head": S.head, "tail": S.tail, "reverse": F.reverse, "distinct-values": S.distinct_values, "jn:size": F.size, "size": F.size, "keys": F.map_keys, "deep-equal": S.deep_equal,
}


class SyntaxProblem(ValueError):
    """Text that isn't in the subset."""


@dataclass
class Scope:
    """Variables: Columns, or the names of collection rows."""

    columns: dict[str, Column] = field(default_factory=dict)
    rows: dict[str, str] = field(default_factory=dict)
    grouped: bool = False

    def also(self, **columns: Column) -> Scope:
        """With further variables (keyed without their dollar; ``context`` is ``$$``)."""
        return Scope({**self.columns, **{("$$" if k == "context" else f"${k}"): v for k, v in columns.items()}}, self.rows, self.grouped)


def _getter(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _as_text(kind: T.DataType) -> Callable[[Column], Column]:
    return (lambda x: x.cast("string")) if isinstance(kind, T.AtomicType) else (lambda x: F.to_json(x))


def below(value: Column, kind: T.DataType, name: str) -> list[tuple[Column, T.DataType]]:
    """All members called ``name`` in a value of a known type, at any depth, as arrays with their items' type."""
    if isinstance(kind, T.ArrayType):
        out = []
        if isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                inner = F.transform(value, _getter(f.name))
                if f.name == name:
                    out.append((inner, f.dataType))
                for c, t in below(F.flatten(inner) if isinstance(f.dataType, T.ArrayType) else inner, f.dataType if isinstance(f.dataType, T.ArrayType) else T.ArrayType(f.dataType), name):
                    out.append((c, t))
        return out
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            inner = value[f.name]
            if f.name == name:
                out.append((F.array(inner), f.dataType))
            out += below(inner, f.dataType, name)
        return out
    return []


class Parser:
    def __init__(self, text: str, collections: Mapping[str, DataFrame], variables: Mapping[str, object] | None = None, functions: Mapping[str, Callable[..., Column]] | None = None):
        self.variables, self.natives, self.declared = dict(variables or {}), dict(functions or {}), {}
        self.literals: dict[int, tuple[Column, object]] = {}
        self.globals: dict[str, Column] = {}
        self.df: DataFrame | None = None
        self.tokens, at = [], 0
        text = re.sub(r"\(:.*?:\)", " ", text, flags=re.S).strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SyntaxProblem(f"unexpected text at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.collections, self.made = 0, collections, 0

    # tokens

    def peek(self, *values: str) -> bool:
        return self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise SyntaxProblem(f"{value!r} expected, not {self.tokens[self.at][1]!r}")

    def kind(self, kind: str) -> str:
        k, v = self.tokens[self.at]
        if k != kind:
            raise SyntaxProblem(f"a {kind} expected, not {v!r}")
        self.at += 1
        return v

    # queries

    def prolog(self) -> None:
        """``declare variable $x external;`` and ``declare function local:f($a, $b) { .. };``"""
        while self.take("declare"):
            if self.take("variable"):
                name = self.kind("var")
                if self.take("external"):
                    if name[1:] not in self.variables:
                        raise SyntaxProblem(f"{name} isn't bound by the caller")
                    self.globals[name] = F.lit(self.variables[name[1:]])
                else:
                    self.need(":=")
                    self.globals[name] = self.expr(Scope(dict(self.globals)))
            else:
                self.need("function")
                name, params = self.kind("name"), []
                self.need("(")
                while not self.take(")"):
                    params.append(self.kind("var"))
                    self.take(",")
                self.need("{")
                self.declared[name] = (params, self.at)
                depth = 1
                while depth:
                    depth += {"{": 1, "}": -1}.get(self.tokens[self.at][1] if self.tokens[self.at][0] == "op" else "", 0)
                    if self.tokens[self.at][0] == "end":
                        raise SyntaxProblem(f"the body of {name} doesn't end")
                    self.at += 1
            self.need(";")

    def query(self) -> DataFrame:
        if self.peek("for", "let"):
            return self.flwor()
        ahead = self.tokens[self.at][1]
        if ahead == "subsequence" or ahead in AGGREGATES:
            self.at += 1
            self.need("(")
            inner = self.query()
            if ahead == "subsequence":
                self.need(",")
                start = int(self.kind("num"))
                self.need(",")
                length = int(self.kind("num"))
                self.need(")")
                begin = max(start, 1)
                inner = inner.offset(begin - 1) if begin > 1 else inner
                return inner.limit(max(start + length - begin, 0))
            self.need(")")
            target = F.lit(1) if ahead == "count" else F.col(f"`{inner.columns[0]}`")
            return inner.agg(AGGREGATES[ahead](target).alias(ahead))
        raise SyntaxProblem(f"a query can't begin with {ahead!r}")

    def flwor(self) -> DataFrame:
        df, scope, having, outer_df = None, Scope(dict(self.globals)), [], self.df
        self.sources = 0
        joined = False
        while True:
            self.df = df
            if self.take("for"):
                df = self.for_clause(df, scope)
                while self.take(","):
                    df = self.for_clause(df, scope)
            elif self.take("let"):
                name = self.kind("var")
                self.need(":=")
                value = self.expr(scope)
                df, scope.columns[name] = (df, value) if scope.grouped or df is None else self.bind(df, value)
            elif self.take("where"):
                if scope.grouped:
                    having.append(S.known(self.expr(scope)))
                else:
                    df, joined = df.where(self.filter(scope)), True
            elif self.take("group"):
                self.need("by")
                df = self.group_clause(df, scope)
            elif self.take("count"):
                if scope.grouped:
                    raise SyntaxProblem("count after group by isn't in the subset")
                name = self.kind("var")
                df, scope.columns[name] = self.bind(df, F.row_number().over(W.orderBy(F.monotonically_increasing_id())))
            elif self.peek("order", "return", "stable"):
                break
            else:
                raise SyntaxProblem(f"a clause expected, not {self.tokens[self.at][1]!r}")
        order = []
        self.take("stable")
        if self.take("order"):
            self.need("by")
            while True:
                e = self.expr(scope)
                down = self.take("descending")
                self.take("ascending")
                order.append((e, down))
                if not self.take(","):
                    break
        self.need("return")
        out = self.returned(scope)
        if self.sources > 1 and not joined:
            raise SyntaxProblem("collections must be related by an equality in a where clause")
        self.df = outer_df
        if scope.grouped:
            aggs = [c.alias(f"_o{i}") for i, (c, _) in enumerate(order)] + [c.alias(n) for n, c in out] + [c.alias(f"_h{i}") for i, c in enumerate(having)]
            df = df.groupBy(*self.keys).agg(*aggs)
            for i in range(len(having)):
                df = df.where(F.col(f"_h{i}"))
            order = [(F.col(f"_o{i}"), d) for i, (_, d) in enumerate(order)]
            out = [(n, F.col(f"`{n}`")) for n, _ in out]
        if order:
            df = df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in order])
        return df.select(*[c.alias(n) for n, c in out])

    def filter(self, scope: Scope) -> Column:
        """A where clause's predicate; top-level conjunctions stay plain, so that Catalyst finds join keys and pushes filters."""
        here = self.at
        if not self.peek("if", "some", "every"):
            out = self.comparison(scope)
            while self.take("and"):
                out = out & self.comparison(scope)
            if not self.peek("or"):
                return out
        self.at = here
        return S.known(self.expr(scope))

    def bind(self, df: DataFrame, value: Column) -> tuple[DataFrame, Column]:
        self.made += 1
        name = f"_v{self.made}"
        return df.withColumn(name, value), F.col(name)

    def for_clause(self, df: DataFrame | None, scope: Scope) -> DataFrame:
        name = self.kind("var")
        outer = self.take("allowing")
        if outer:
            self.need("empty")
        place = self.kind("var") if self.take("at") else None
        self.need("in")
        nested = self.peek("(") and self.tokens[self.at + 1][1] in ("for", "let", "subsequence")
        if nested or self.tokens[self.at][1] in ("collection", "jn:doc"):
            if nested:
                self.need("(")
                held = self.sources
                rows = self.query()
                self.sources = held
                self.need(")")
            else:
                rows = self.collection()
            self.made += 1
            self.sources += 1
            alias = f"_r{self.made}"
            columns = [F.col(f"`{c}`") for c in rows.columns]
            part = rows.select((columns[0] if nested and rows.columns == ["value"] else F.struct(*columns)).alias(alias))
            scope.rows[name] = alias
            scope.columns[name] = F.col(alias)
            while self.peek("["):
                self.need("[")
                if self.take("?"):
                    self.df = part
                    part = part.where(S.known(self.expr(scope.also(context=F.col(alias)))))
                self.need("]")
            return part if df is None else df.crossJoin(part)
        self.df = df
        array = self.expr(scope)
        self.made += 1
        pos, item = f"_p{self.made}", f"_v{self.made}"
        df = df.select("*", (F.posexplode_outer if outer else F.posexplode)(array).alias(pos, item))
        scope.columns[name] = F.col(item)
        if place:
            scope.columns[place] = F.col(pos) + 1
        return df

    def collection(self) -> DataFrame:
        self.at += 1
        self.need("(")
        name = self.kind("str")[1:-1]
        while self.take(","):
            name = self.kind("str")[1:-1]
        self.need(")")
        if name not in self.collections:
            raise SyntaxProblem(f"no collection {name!r}")
        return self.collections[name]

    def group_clause(self, df: DataFrame, scope: Scope) -> DataFrame:
        self.keys = []
        while True:
            name = self.kind("var")
            value = self.expr(scope) if self.take(":=") else scope.columns[name]
            df, scope.columns[name] = self.bind(df, value)
            self.keys.append(scope.columns[name])
            if not self.take(","):
                break
        scope.grouped = True
        return df

    def returned(self, scope: Scope) -> list[tuple[str, Column]]:
        if not self.take("{"):
            return [("value", self.expr(scope))]
        out = []
        while not self.take("}"):
            k, v = self.tokens[self.at]
            self.at += 1
            name = v[1:-1] if k == "str" else v
            self.need(":")
            out.append((name, self.expr(scope)))
            if not self.peek("}"):
                self.need(",")
        return out

    # expressions, loosest first

    def predicate(self, scope: Scope, here: int) -> Callable[[Column], Column]:
        """The test that begins at ``here``, of an item as ``$$``."""

        def test(x: Column) -> Column:
            self.at = here
            return S.known(self.expr(scope.also(context=x)))

        return test

    def over_array(self, scope: Scope) -> Column:
        """``for $x in array [let ..] [where ..] return e`` within an expression: an array."""
        name = self.kind("var")
        self.need("in")
        array = self.operand(scope)
        clauses = self.at

        def run(x: Column, want: str) -> Column:
            self.at = clauses
            inner = scope.also(**{name[1:]: x})
            keep = F.lit(True)
            while not self.take("return"):
                if self.take("let"):
                    var = self.kind("var")
                    self.need(":=")
                    inner = inner.also(**{var[1:]: self.expr(inner)})
                else:
                    self.need("where")
                    keep = keep & S.known(self.expr(inner))
            out = self.expr(inner)
            return keep if want == "keep" else out

        return F.transform(F.filter(array, lambda x: run(x, "keep")), lambda x: run(x, "value"))

    def members_below(self, value: Column, name: str) -> Column:
        """``=>>name``: an array of all members called so, at any depth; as text where their types differ."""
        if self.df is None:
            raise SyntaxProblem("=>> needs a row to look into")
        found = below(value, self.df.select(value.alias("x")).schema["x"].dataType, name)
        if not found:
            return F.array().cast("array<string>")
        if len({t.simpleString() for _, t in found}) > 1:
            found = [(F.transform(c, _as_text(t)), t) for c, t in found]
        return F.filter(F.concat(*[F.coalesce(c, F.array()) for c, _ in found]), lambda x: x.isNotNull())

    def expr(self, scope: Scope) -> Column:
        if self.peek("for") and self.tokens[self.at + 1][0] == "var":
            self.need("for")
            return self.over_array(scope)
        if self.take("switch"):
            self.need("(")
            value = self.expr(scope)
            self.need(")")
            out = None
            while self.take("case"):
                case = self.expr(scope)
                self.need("return")
                result = self.expr(scope)
                out = (F if out is None else out).when(value.eqNullSafe(case), result)
            self.need("default")
            self.need("return")
            last = self.expr(scope)
            return last if out is None else out.otherwise(last)
        if self.take("if"):
            self.need("(")
            test = self.expr(scope)
            self.need(")")
            self.need("then")
            yes = self.expr(scope)
            self.need("else")
            return F.when(S.known(test), yes).otherwise(self.expr(scope))
        for word, test in (("some", S.some), ("every", S.every)):
            if self.take(word):
                name = self.kind("var")
                self.need("in")
                array = self.operand(scope)
                self.need("satisfies")
                here = self.at

                def body(x: Column, here=here, name=name) -> Column:
                    self.at = here
                    return self.expr(Scope({**scope.columns, name: x}, scope.rows, scope.grouped))

                return test(array, body)
        left = self.conjunction(scope)
        while self.take("or"):
            left = S.any_of(left, self.conjunction(scope))
        return left

    def conjunction(self, scope: Scope) -> Column:
        left = self.comparison(scope)
        while self.take("and"):
            left = S.all_of(left, self.comparison(scope))
        return left

    def comparison(self, scope: Scope) -> Column:
        left = self.sum(scope)
        for name in (*VALUE_COMPARE, *COMPARE):
            if self.take(name):
                return COMPARE[VALUE_COMPARE.get(name, name)](left, self.sum(scope))
        return left

    def sum(self, scope: Scope) -> Column:
        left = self.product(scope)
        while self.peek("+", "-", "||"):
            op = self.tokens[self.at][1]
            self.at += 1
            right = self.product(scope)
            left = left + right if op == "+" else left - right if op == "-" else S.concat(left, right)
        return left

    def product(self, scope: Scope) -> Column:
        left = self.operand(scope)
        while self.peek("*", "div", "idiv", "mod"):
            op = self.tokens[self.at][1]
            self.at += 1
            right = self.operand(scope)
            left = {"*": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b), "idiv": S.idiv, "mod": S.mod}[op](left, right)
        return left

    def operand(self, scope: Scope) -> Column:
        if self.take("-"):
            return -self.operand(scope)
        out = self.primary(scope)
        while True:
            if self.take("."):
                k, v = self.tokens[self.at]
                self.at += 1
                out = out.getField(v[1:-1] if k == "str" else v)
            elif self.take("=>>"):
                k, v = self.tokens[self.at]
                self.at += 1
                out = self.members_below(out, v[1:-1] if k == "str" else v)
            elif self.peek("["):
                self.at += 1
                if self.take("]"):
                    continue  # unboxed: members of an array's objects are taken from each
                if self.take("?"):
                    out = F.filter(out, self.predicate(scope, self.at))
                    self.need("]")
                    continue
                start = self.index()
                if self.take(":"):
                    out = S.cut(out, start or 0, None if self.peek("]") else self.index())
                else:
                    out = S.at(out, start)
                self.need("]")
            else:
                return out

    def index(self) -> int | None:
        if self.peek(":"):
            return None
        sign = -1 if self.take("-") else 1
        return sign * int(self.kind("num"))

    def primary(self, scope: Scope) -> Column:
        k, v = self.tokens[self.at]
        self.at += 1
        if k == "num":
            return F.lit(float(v) if re.search(r"[.eE]", v) else int(v))
        if k == "str":
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1])
            out = F.lit(text)
            self.literals[id(out)] = (out, text)
            return out
        if k == "var":
            if v not in scope.columns:
                raise SyntaxProblem(f"{v} isn't bound")
            return scope.columns[v]
        if v == "(":
            out = self.expr(scope)
            self.need(")")
            return out
        if v == "null":
            return F.lit(None)
        if k == "name" and self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.expr(scope))
                if not self.peek(")"):
                    self.need(",")
            if v in self.declared:
                params, body = self.declared[v]
                if len(params) != len(args):
                    raise SyntaxProblem(f"{v} takes {len(params)} arguments")
                here, self.at = self.at, body
                out = self.expr(Scope({**self.globals, **dict(zip(params, args, strict=True))}, grouped=scope.grouped))
                self.need("}")
                self.at = here
                return out
            if v in self.natives:
                return self.natives[v](*args)
            if v == "translate" and len(args) == 3 and all(id(x) in self.literals for x in args[1:]):
                return F.translate(args[0], *[self.literals[id(x)][1] for x in args[1:]])
            if v in AGGREGATES and scope.grouped:
                return AGGREGATES[v](*args)
            if v in FUNCTIONS:
                return FUNCTIONS[v](*args)
            raise SyntaxProblem(f"no function {v}")
        raise SyntaxProblem(f"unexpected {v!r}")


def run(spark: SparkSession, collections: Mapping[str, DataFrame], text: str, variables: Mapping[str, object] | None = None, functions: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Compile a query; nothing runs until the DataFrame does.

    ``variables``: values of ``declare variable $x external``; ``functions``: native functions, of Columns, by name.
    """
    p = Parser(text, collections, variables, functions)
    p.prolog()
    out = p.query()
    if p.tokens[p.at][0] != "end":
        raise SyntaxProblem(f"text after the query: {p.tokens[p.at][1]!r}")
    return out
