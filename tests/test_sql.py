"""Lexer, parser, validator, folding and plans; no Spark needed but for EXPLAIN."""

import pytest

from brindle.catalog import Catalog, Column, Table
from brindle.errors import CatalogError, SqlSyntaxError, ValidationError
from brindle.plans import logical
from brindle.sql import ast, parse, parse_expression, parse_one, validate

T = Table("t", (Column("id", "BIGINT", False), Column("n", "INTEGER"), Column("f", "FLOAT"), Column("s", "TEXT"), Column("b", "BOOLEAN"), Column("ts", "TIMESTAMP")), ("id",))
TWO = Table("two", (Column("a", "BIGINT", False), Column("b", "TEXT", False), Column("c", "TEXT")), ("a", "b"))


@pytest.fixture
def catalog():
    return Catalog([T, TWO])


def test_not_binds_tighter_than_comparison():
    assert parse_expression("NOT a = 1") == ast.Binary("=", ast.Unary("NOT", ast.Identifier("a")), ast.Literal(1))


def test_precedence_and_chains():
    assert logical.show(parse_expression("1 + 2 * 3 < 4 AND a OR b = c = d")) == "((((1 + (2 * 3)) < 4) AND a) OR ((b = c) = d))"


def test_strings_keywords_and_operators():
    (s,) = parse("select 'it''s', x <> 1 from T;")
    assert s.items[0] == ast.Literal("it's")
    assert s.items[1].op == "!="
    assert s.table == "T"


def test_semicolons_are_optional():
    assert len(parse("BEGIN COMMIT;;ROLLBACK")) == 3


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("", "no statement found"),
        ("SELECT 1", "expected FROM"),
        ("SELECT *, id FROM t", "expected FROM"),
        ("SELECT id AS x FROM t", "expected FROM"),
        ("SELECT id FROM t LIMIT -1", "invalid LIMIT value"),
        ("SELECT id FROM t OFFSET 1", "expected a SQL statement"),
        ("SELECT 'x FROM t", "unterminated string starting at byte 7"),
        ("SELECT # FROM t", "unexpected character '#' at byte 7"),
        ("SELECT 9223372036854775808 FROM t", "invalid numeric literal"),
        ("CREATE TABLE t (id BIGINT)", "requires a PRIMARY KEY clause"),
        ("CREATE TABLE t (id BIGINT, PRIMARY KEY (id), PRIMARY KEY (id))", "more than once"),
        ("CREATE TABLE t (id BIGINT DEFAULT -1, PRIMARY KEY (id))", "a literal"),
        ("INSERT INTO t VALUES (1)", "'('"),
    ],
)
def test_syntax_errors(text, said):
    with pytest.raises(SqlSyntaxError, match=said.replace("(", r"\(")):
        parse(text)


def test_one_statement():
    with pytest.raises(SqlSyntaxError, match="expected exactly one statement"):
        parse_one("BEGIN; COMMIT")


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("SELECT x FROM t", "column 'x' not found in table 't'"),
        ("SELECT u.id FROM t", "table 'u' not found"),
        ("SELECT a.b.c FROM t", "unsupported compound identifier"),
        ("SELECT id FROM t WHERE NULL", "WHERE clause must evaluate to BOOLEAN"),
        ("SELECT NULL + 1 FROM t", "type mismatch"),
        ("SELECT -ts FROM t", "type mismatch"),
        ("SELECT ts + 1 FROM t", "type mismatch"),
        ("SELECT id FROM t ORDER BY expr_0", "not found"),
        ("INSERT INTO t (id, n) VALUES (1)", "columns=2, values=1"),
        ("INSERT INTO t (id, n) VALUES (1, 1.5)", "type mismatch for column 'n': expected INTEGER, found FLOAT"),
        ("UPDATE t SET n = id", "expected INTEGER, found BIGINT"),
        ("UPDATE t SET id = NULL", "NULL is not allowed for non-nullable column 'id'"),
        ("UPDATE t SET n = 1, n = 2", "duplicated in statement"),
        ("CREATE TABLE t (id BIGINT NOT NULL, PRIMARY KEY (id))", "already exists"),
        ("CREATE TABLE v (id BIGINT, PRIMARY KEY (id))", "invalid CREATE TABLE definition: primary key column 'id' cannot be nullable"),
        ("CREATE TABLE v (id BIGINT NOT NULL, id TEXT, PRIMARY KEY (id))", "column 'id' is duplicated"),
        ("CREATE TABLE v (id BIGINT NOT NULL DEFAULT NULL, PRIMARY KEY (id))", "NULL is not allowed"),
        ("CREATE TABLE v (id BIGINT NOT NULL, b BOOLEAN DEFAULT 1, PRIMARY KEY (id))", "type mismatch for column 'b'"),
        ("CREATE TABLE v (id BIGINT NOT NULL, n INTEGER DEFAULT 2147483648, PRIMARY KEY (id))", "type mismatch for column 'n'"),
    ],
)
def test_validation_errors(catalog, text, said):
    with pytest.raises(ValidationError) as e:
        validate(catalog, parse_one(text))
    assert said in str(e.value)


def test_where_may_be_a_boolean_column(catalog):
    validate(catalog, parse_one("SELECT id FROM t WHERE b"))


def test_folding():
    show = lambda s: logical.show(logical.fold(parse_expression(s)))
    assert show("1 + 2 * 3") == "7"
    assert show("-(5)") == "-5"
    assert show("6 / 4") == "1.5"
    assert show("1 / 0") == "(1 / 0)"
    assert show("NULL = NULL") == "NULL"
    assert show("FALSE AND NULL") == "FALSE"
    assert show("9223372036854775807 + 1") == "9223372036854775807"
    assert show("x + (1 + 1)") == "(x + 2)"


def plan(catalog, text):
    s = parse_one(text)
    return logical.physical(logical.optimize(logical.build(catalog.get_table(s.table), s)))


@pytest.mark.parametrize(
    ("text", "looked_up"),
    [
        ("SELECT * FROM t WHERE id = 1", True),
        ("SELECT * FROM t WHERE 1 = t.id", True),
        ("SELECT * FROM t WHERE id = -(1 + 2)", True),
        ("SELECT * FROM t WHERE id = 1 AND n = 2", False),
        ("SELECT * FROM t WHERE id = 1 AND id = 1", False),
        ("SELECT * FROM t WHERE id = n", False),
        ("SELECT * FROM two WHERE b = 'x' AND a = 1", True),
        ("SELECT * FROM two WHERE a = 1", False),
    ],
)
def test_primary_key_lookup(catalog, text, looked_up):
    assert isinstance(plan(catalog, text), logical.PrimaryKeyScan) == looked_up


def test_identity_projection_goes(catalog):
    assert plan(catalog, "SELECT a, b, c FROM two") == logical.Scan(TWO)


def test_filters_move_below_sorts_and_plain_projections():
    node = logical.Filter(logical.Sort(logical.Project(logical.Scan(T), (ast.Identifier("id"),)), (ast.OrderItem(ast.Identifier("id")),)), parse_expression("id > 1"))
    text = logical.tree(logical.optimize(node))
    assert [x.split()[0] for x in text.splitlines()] == ["Sort", "Project", "Filter", "SeqScan"]


def test_catalog():
    c = Catalog()
    c.create_table(Table(" t ", T.columns, T.primary_key))
    assert c.list_table_names() == ["t"]
    with pytest.raises(CatalogError, match="already exists"):
        c.create_table(T)
    c.drop_table("t")
    with pytest.raises(CatalogError, match="was not found"):
        c.drop_table("t")
    with pytest.raises(CatalogError, match="at least one column"):
        Table("x", (), ("a",)).check()
    assert Table.from_json(T.to_json()) == T
