"""Tokens to clauses and expressions: recursive descent, with binding powers for operators."""

from __future__ import annotations

from .lexer import SyntaxProblem, Token, tokens
from .nodes import Call, Case, Clause, Comprehension, Expr, Index, IsNull, Item, ListOf, Lit, MapOf, Neg, NodeP, Not, Op, Param, Part, PatternValue, Prop, Quantified, Query, RelP, Similar, Slice, Var

#: Binding powers, loosest first. NOT binds between AND and the comparisons.
POWERS = {"OR": 1, "XOR": 2, "AND": 3, "=": 5, "<>": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "IN": 5, "CONTAINS": 5, "STARTS": 5, "ENDS": 5, "IS": 5, "SIMILAR": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 8}
QUANTIFIERS = ("ANY", "ALL", "NONE", "SINGLE")
PATHS = {"SHORTESTPATH": "shortest", "ALLSHORTESTPATHS": "all_shortest", "ALLSIMPLEPATHS": "all_simple", "EARLIESTPATH": "earliest"}
#: Names that start a clause, and so end an expression without one.
STARTS = {"MATCH", "OPTIONAL", "CREATE", "WHERE", "MERGE", "RETURN", "WITH", "SET", "DELETE", "DETACH", "REMOVE", "UNWIND", "FOREACH", "CALL", "AT", "EMBED", "SIMILAR", "UNION"}


def parse(text: str) -> Query:
    """The query of a text. Raises SyntaxProblem, with the place, if it is none."""
    return Parser(text).query()


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def sees(self, *words: str) -> bool:
        """Whether the next tokens are these keywords or symbols."""
        return all(self.ahead(i).upper == w and self.ahead(i).kind in ("name", "symbol") for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} at {self.now.start}, found {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise SyntaxProblem(f"expected a name at {self.now.start}, found {self.now.text!r}")
        self.at += 1
        return self.tokens[self.at - 1].text

    # clauses

    def query(self) -> Query:
        branches, flags = [self.clauses()], []
        while self.take("UNION"):
            flags.append(self.take("ALL"))
            branches.append(self.clauses())
        if self.now.kind != "end":
            raise SyntaxProblem(f"unexpected {self.now.text!r} at {self.now.start}")
        return Query(branches, flags)

    def clauses(self) -> list[Clause]:
        out = []
        while self.now.kind != "end" and not self.sees("UNION"):
            out.append(self.clause())
        if not out:
            raise SyntaxProblem(f"expected a clause at {self.now.start}")
        return out

    def clause(self) -> Clause:
        if self.take("OPTIONAL"):
            self.need("MATCH")
            return Clause("match", {"parts": self.parts(), "optional": True})
        if self.take("MATCH"):
            return Clause("match", {"parts": self.parts(), "optional": False})
        if self.take("WHERE"):
            return Clause("where", {"expr": self.expr()})
        if self.take("CREATE"):
            return Clause("create", {"parts": self.parts()})
        if self.take("MERGE"):
            part, on = self.part(), {"CREATE": [], "MATCH": []}
            while self.take("ON"):
                kind = "CREATE" if self.take("CREATE") else "MATCH"
                if kind == "MATCH":
                    self.need("MATCH")
                self.need("SET")
                on[kind] += self.assignments()
            return Clause("merge", {"part": part, "on_create": on["CREATE"], "on_match": on["MATCH"]})
        if self.take("RETURN"):
            return self.projection("return")
        if self.take("WITH"):
            return self.projection("with")
        if self.take("SET"):
            return Clause("set", {"items": self.assignments()})
        if self.sees("DETACH") or self.sees("DELETE"):
            detach = self.take("DETACH")
            self.need("DELETE")
            return Clause("delete", {"vars": self.several(self.name), "detach": detach})
        if self.take("REMOVE"):
            return Clause("remove", {"items": self.several(self.removal)})
        if self.take("UNWIND"):
            over = self.expr()
            self.need("AS")
            return Clause("unwind", {"over": over, "var": self.name()})
        if self.take("FOREACH"):
            self.need("(")
            var = self.name()
            self.need("IN")
            over = self.expr()
            self.need("|")
            self.need("SET")
            items = self.assignments()
            self.need(")")
            return Clause("foreach", {"var": var, "over": over, "items": items})
        if self.take("CALL"):
            return self.call()
        if self.take("AT"):
            self.need("TIME")
            return Clause("at_time", {"time": "earliest" if self.take("EARLIEST") else self.expr()})
        if self.take("EMBED"):
            var, prop, text = self.name(), None, None
            if self.take("."):
                prop = self.name()
            elif self.now.kind == "string":
                text, self.at = self.now.text, self.at + 1
            return Clause("embed", {"var": var, "prop": prop, "text": text})
        if self.take("SIMILAR"):
            self.need("TO")
            return self.similar()
        raise SyntaxProblem(f"expected a clause at {self.now.start}, found {self.now.text!r}")

    def several(self, one):
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def similar(self) -> Clause:
        query, mode, limit, threshold = self.expr(7), "current", None, None
        if self.take("DRIFT"):
            self.need("THROUGH", "TIME")
            mode = "drift"
        elif self.sees("VERSIONS") or self.sees("THROUGH"):
            self.take("VERSIONS")
            self.need("THROUGH", "TIME")
            mode = "versions"
        while self.sees("LIMIT") or self.sees("THRESHOLD"):
            if self.take("LIMIT"):
                limit = self.expr()
            else:
                self.need("THRESHOLD")
                threshold = self.expr()
        return Clause("similar", {"query": query, "mode": mode, "limit": limit, "threshold": threshold})

    def call(self) -> Clause:
        name, config = self.name(), ()
        if self.take("("):
            config = self.map().items if self.sees("{") else ()
            self.need(")")
        self.need("YIELD")
        yields = self.several(lambda: (self.name(), self.name() if self.take("AS") else None))
        through = self.take("THROUGH", "TIME")
        return Clause("call", {"name": name.lower(), "config": config, "yields": yields, "through": through})

    def projection(self, kind: str) -> Clause:
        distinct, star, items = self.take("DISTINCT"), False, []
        if self.take("*"):
            star = True
            if self.take(","):
                items = self.several(self.item)
        else:
            items = self.several(self.item)
        fields = {"distinct": distinct, "star": star, "items": items, "where": None, "order": [], "skip": None, "limit": None}
        # in any order, as long as they come first
        while True:
            if kind == "with" and self.take("WHERE"):
                fields["where"] = self.expr()
            elif self.take("ORDER"):
                self.need("BY")
                fields["order"] = self.several(self.order)
            elif self.take("SKIP"):
                fields["skip"] = self.expr()
            elif self.take("LIMIT"):
                fields["limit"] = self.expr()
            else:
                return Clause(kind, fields)

    def order(self) -> tuple[Expr, bool]:
        e = self.expr()
        descending = self.take("DESC") or self.take("DESCENDING")
        if not descending:
            self.take("ASC") or self.take("ASCENDING")
        return e, descending

    def item(self) -> Item:
        start = self.now.start
        e = self.expr()
        text = self.text[start : self.tokens[self.at - 1].end]
        return Item(e, self.name() if self.take("AS") else None, text)

    def assignments(self) -> list[tuple[str, str | None, str, Expr]]:
        """(variable, property or None for the whole map, "=" or "+=", value)"""

        def one():
            var, prop = self.name(), None
            if self.take("."):
                prop = self.name()
            how = "+=" if self.take("+=") else "="
            if how == "=":
                self.need("=")
            return var, prop, how, self.expr()

        return self.several(one)

    def removal(self) -> tuple[str, str, str]:
        var = self.name()
        if self.take("."):
            return var, "property", self.name()
        self.need(":")
        return var, "label", self.name()

    # patterns

    def parts(self) -> list[Part]:
        return self.several(self.part)

    def part(self) -> Part:
        var = None
        if self.now.kind == "name" and self.ahead().text == "=" and self.ahead().kind == "symbol":
            var = self.name()
            self.need("=")
        if self.now.kind == "name" and self.now.upper in PATHS:
            function = PATHS[self.name().upper()]
            self.need("(")
            inner = self.part()
            self.need(")")
            return Part(inner.nodes, inner.rels, var, function)
        nodes, rels = [self.node()], []
        while self.sees("-") or self.sees("<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Part(tuple(nodes), tuple(rels), var)

    def node(self) -> NodeP:
        self.need("(")
        var, labels, props = None, [], ()
        if self.now.kind == "name":
            var = self.name()
        while self.take(":"):
            labels.append(self.name())
        if self.sees("{"):
            props = self.map().items
        self.need(")")
        return NodeP(var, tuple(labels), props)

    def rel(self) -> RelP:
        left = self.take("<-")
        if not left:
            self.need("-")
        var, types, hops, props = None, [], None, ()
        if self.take("["):
            if self.now.kind == "name":
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                low = high = self.integer()
                if self.take(".."):
                    high = self.integer()
                hops = (low, high)
            if self.sees("{"):
                props = self.map().items
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        direction = "both" if left == right else "in" if left else "out"
        return RelP(var, tuple(types), direction, hops, props)

    def integer(self) -> int | None:
        if self.now.kind == "number" and self.now.text.isdigit():
            self.at += 1
            return int(self.tokens[self.at - 1].text)
        return None

    def map(self) -> MapOf:
        self.need("{")
        items = []
        while not self.take("}"):
            if items:
                self.need(",")
            key = self.name() if self.now.kind == "name" else self.string()
            self.need(":")
            items.append((key, self.expr()))
        return MapOf(tuple(items))

    def string(self) -> str:
        if self.now.kind != "string":
            raise SyntaxProblem(f"expected a string at {self.now.start}")
        self.at += 1
        return self.tokens[self.at - 1].text

    # expressions

    def expr(self, least: int = 0) -> Expr:
        left = self.prefix()
        while True:
            word = self.now.upper if self.now.kind in ("name", "symbol") else ""
            if word == "NOT" and self.ahead().upper == "IN" and least < 5:
                self.at += 2
                left = Not(Op("IN", left, self.expr(5)))
                continue
            # "a<-1" is a comparison with a negative number where an expression goes on
            power = 5 if word == "<-" else POWERS.get(word, 0)
            if power <= least or word == "SIMILAR" and not (isinstance(left, Var) and self.ahead().upper == "TO"):
                return left
            # (SIMILAR TO as a clause of its own follows a pattern or a whole condition, never a variable)
            self.at += 1
            if word == "<-":
                left = Op("<", left, Neg(self.expr(5)))
            elif word == "IS":
                negated = self.take("NOT")
                self.need("NULL")
                left = IsNull(left, negated)
            elif word in ("STARTS", "ENDS"):
                self.need("WITH")
                left = Op(word, left, self.expr(power))
            elif word == "IN" and self.take("NOT"):
                left = Not(Op("IN", left, self.expr(power)))
            elif word == "SIMILAR":
                self.need("TO")
                query = self.expr(power)
                left = Similar(left, query, self.expr(power) if self.take("THRESHOLD") else None)
            else:
                left = Op("<>" if word == "!=" else word, left, self.expr(power))

    def prefix(self) -> Expr:
        if self.take("NOT"):
            return Not(self.expr(4))
        if self.take("-"):
            return Neg(self.expr(8))
        if self.take("+"):
            return self.expr(8)
        e = self.primary()
        while True:
            if self.sees(".") and self.ahead().kind == "name":
                self.at += 1
                e = Prop(e, self.name())
            elif self.take("["):
                low = None if self.sees("..") else self.expr()
                if self.take(".."):
                    e = Slice(e, low, None if self.sees("]") else self.expr())
                else:
                    e = Index(e, low)
                self.need("]")
            else:
                return e

    def primary(self) -> Expr:
        t = self.now
        if t.kind == "number":
            self.at += 1
            return Lit(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "string":
            self.at += 1
            return Lit(t.text)
        if t.kind == "param":
            self.at += 1
            return Param(t.text)
        if self.sees("["):
            return self.bracket()
        if self.sees("{"):
            return self.map()
        if self.sees("("):
            saved = self.at
            try:  # a pattern where a condition may stand
                part = self.part()
                if part.rels:
                    return PatternValue(part, None, None)
            except SyntaxProblem:
                pass
            self.at = saved + 1
            e = self.expr()
            self.need(")")
            return e
        if t.kind != "name":
            raise SyntaxProblem(f"expected an expression at {t.start}, found {t.text!r}")
        word = t.upper
        if word in ("TRUE", "FALSE", "NULL") and not (self.ahead().text == "(" and self.ahead().kind == "symbol"):
            self.at += 1
            return Lit({"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self.ahead().text == "{":
            self.at += 2
            self.take("MATCH")
            part = self.part()
            where = self.expr() if self.take("WHERE") else None
            self.need("}")
            return PatternValue(part, where, None)
        if self.ahead().text == "(" and self.ahead().kind == "symbol":
            return self.function()
        return Var(self.name())

    def bracket(self) -> Expr:
        self.need("[")
        if self.now.kind == "name" and self.ahead().upper == "IN":
            saved = self.at
            var = self.name()
            self.need("IN")
            over = self.expr()
            where = self.expr() if self.take("WHERE") else None
            if self.take("|"):
                value = self.expr()
                self.need("]")
                return Comprehension(var, over, where, value)
            if where is not None:
                self.need("]")
                return Comprehension(var, over, where, Var(var))
            self.at = saved
        if self.sees("("):
            saved = self.at
            try:
                part = self.part()
                if part.rels and (self.sees("|") or self.sees("WHERE")):
                    where = self.expr() if self.take("WHERE") else None
                    self.need("|")
                    value = self.expr()
                    self.need("]")
                    return PatternValue(part, where, value)
            except SyntaxProblem:
                pass
            self.at = saved
        items = []
        while not self.take("]"):
            if items:
                self.need(",")
            items.append(self.expr())
        return ListOf(tuple(items))

    def case(self) -> Case:
        self.need("CASE")
        subject, whens, default = None if self.sees("WHEN") else self.expr(), [], None
        while self.take("WHEN"):
            condition = self.expr()
            self.need("THEN")
            whens.append((condition, self.expr()))
        if self.take("ELSE"):
            default = self.expr()
        self.need("END")
        return Case(subject, tuple(whens), default)

    def function(self) -> Expr:
        name = self.name()
        self.need("(")
        if name.upper() in QUANTIFIERS and self.now.kind == "name" and self.ahead().upper == "IN":
            var = self.name()
            self.need("IN")
            over = self.expr()
            if not self.take("|"):
                self.need("WHERE")
            where = self.expr()
            self.need(")")
            return Quantified(name.upper(), var, over, where)
        if self.take("*"):
            self.need(")")
            return Call(name.lower(), (), star=True)
        distinct, args = self.take("DISTINCT"), []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.expr())
        return Call(name.lower(), tuple(args), distinct)
