import pytest
from strandline.plans.lexer import SyntaxProblem, tokens
from strandline.plans.nodes import Call, Lit, Neg, Not, Op, PatternValue, Prop, Similar, Var
from strandline.plans.parser import Parser, parse


def expr(text):
    p = Parser(text)
    e = p.expr()
    assert p.now.kind == "end", p.now
    return e


def test_tokens():
    assert [(t.kind, t.text) for t in tokens("a.b = 'it\\'s' // note\n 1..5 $p <> 2.5e3")][:-1] == [("name", "a"), ("symbol", "."), ("name", "b"), ("symbol", "="), ("string", "it's"), ("number", "1"), ("symbol", ".."), ("number", "5"), ("param", "p"), ("symbol", "<>"), ("number", "2.5e3")]
    with pytest.raises(SyntaxProblem):
        tokens("a ; b")


def test_precedence():
    a, b, c = Var("a"), Var("b"), Var("c")
    assert expr("a OR b AND c") == Op("OR", a, Op("AND", b, c))
    assert expr("a XOR b OR c") == Op("OR", Op("XOR", a, b), c)
    assert expr("NOT a = b") == Not(Op("=", a, b))
    assert expr("a + b * c ^ 2") == Op("+", a, Op("*", b, Op("^", c, Lit(2))))
    assert expr("a - b - c") == Op("-", Op("-", a, b), c)
    assert expr("-a.x") == Neg(Prop(a, "x"))
    assert expr("a < -1") == expr("a<-1") == Op("<", a, Neg(Lit(1)))
    assert expr("NOT a IN [1]") == expr("a NOT IN [1]") == expr("a IN NOT [1]")
    assert expr("a STARTS WITH 'x' AND b") == Op("AND", Op("STARTS", a, Lit("x")), b)


def test_patterns_in_expressions():
    assert isinstance(expr("(a)-[:X]->(b)"), PatternValue)
    assert expr("(a) - (b)") == Op("-", Var("a"), Var("b"))
    assert expr("[(a)--(b) WHERE b.x > 1 | b.x]").value == Prop(Var("b"), "x")
    assert isinstance(expr("a SIMILAR TO 'q' THRESHOLD 0.5"), Similar)
    assert expr("count(DISTINCT a.x)") == Call("count", (Prop(Var("a"), "x"),), True)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a:P {x: 1})-[r:K|L*1..3 {y: $z}]->(b)<--(c)--() WHERE a.x > 1 RETURN *",
        "OPTIONAL MATCH (a) RETURN a UNION ALL MATCH (b) RETURN b UNION MATCH (c) RETURN c",
        "MATCH p = earliestPath((a)-[*]->(b)) RETURN p, arrival_time",
        "MERGE (n:L {a: 1}) ON CREATE SET n.x = 1, n.y = 2 ON MATCH SET n.x = 3 RETURN n",
        "MATCH (a) DETACH DELETE a AT TIME 1700000000",
        "MATCH (a) AT TIME EARLIEST RETURN a",
        "MATCH (a) SIMILAR TO 'x' DRIFT THROUGH TIME LIMIT 5 THRESHOLD 0.5 RETURN a",
        "MATCH (a) WHERE a.x > 3 SIMILAR TO 'x' LIMIT 5 RETURN a",
        "MATCH (a) FOREACH (x IN [1, 2] | SET a.v = x)",
        "CALL pagerank({label: 'P'}) YIELD node, score AS s THROUGH TIME RETURN node, s",
        "MATCH (a) EMBED a.text",
        "MATCH (a) REMOVE a.x, a:Label",
        "UNWIND [1, 2] AS x WITH DISTINCT x AS y WHERE y > 1 RETURN y ORDER BY y DESC SKIP 1 LIMIT 2",
        "MATCH (match:match) RETURN match.return AS with",
    ],
)
def test_texts_that_parse(text):
    parse(text)


@pytest.mark.parametrize("text", ["", "MATCH (a", "RETURN", "MATCH (a)-[:X->(b) RETURN a", "MATCH (a) RETURN a a", "RETURN 1 +", "MATCH (`a`) RETURN 1", "FROB (a)"])
def test_texts_that_do_not(text):
    with pytest.raises(SyntaxProblem):
        parse(text)
