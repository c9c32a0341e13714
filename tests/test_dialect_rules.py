"""Rules of the dialect, one statement at a time, on a table of stock and one of price changes."""

import pytest

from brindle.errors import EngineError
from brindle.session import AffectedRows, QueryResult, TransactionState

STOCK = "CREATE TABLE stock (site BIGINT NOT NULL, sku TEXT NOT NULL, qty INTEGER, price FLOAT DEFAULT 1.5, PRIMARY KEY (site, sku))"
CHANGES = "CREATE TABLE changes (at TIMESTAMP NOT NULL, note TEXT, done BOOLEAN DEFAULT false, PRIMARY KEY (at))"
FILL = [
    "INSERT INTO stock (site, sku, qty, price) VALUES (2, 'bolt', 40, 0.25)",
    "INSERT INTO stock (site, sku, qty) VALUES (1, 'nut', NULL)",
    "INSERT INTO stock (site, sku, qty, price) VALUES (1, 'gear', 7, 12.0)",
]


@pytest.fixture
def stock(db):
    for s in (STOCK, CHANGES, *FILL):
        db.sql(s)
    return db


@pytest.mark.parametrize(
    ("statement", "columns", "rows"),
    [
        ("SELECT sku, qty FROM stock ORDER BY qty DESC", ["sku", "qty"], [["nut", "NULL"], ["bolt", "40"], ["gear", "7"]]),
        ("SELECT price FROM stock WHERE sku = 'nut'", ["price"], [["1.5"]]),
        ("SELECT sku FROM stock WHERE qty > 5 OR qty <= 5", ["sku"], [["gear"], ["bolt"]]),
        ("SELECT sku FROM stock ORDER BY qty DESC, sku LIMIT 2", ["sku"], [["nut"], ["bolt"]]),
        ("SELECT qty * 2, -qty FROM stock WHERE site = 1 AND sku = 'gear'", ["expr_0", "expr_1"], [["14", "-7"]]),
        ("SELECT sku FROM stock WHERE NOT (site = 1) LIMIT 0", ["sku"], []),
    ],
)
def test_selects(stock, statement, columns, rows):
    out = stock.sql(statement)
    assert isinstance(out, QueryResult) and (out.columns, out.text()) == (columns, rows)


@pytest.mark.parametrize(
    ("statement", "count", "left"),
    [
        ("UPDATE stock SET qty = qty + 1, price = 2.0 WHERE site = 1", 2, [["bolt", "40", "0.25"], ["gear", "8", "2"], ["nut", "NULL", "2"]]),
        ("UPDATE stock SET site = site + 1 WHERE sku = 'bolt'", 1, [["bolt", "40", "0.25"], ["nut", "NULL", "1.5"], ["gear", "7", "12"]]),
        ("DELETE FROM stock WHERE qty = 7", 1, [["bolt", "40", "0.25"], ["nut", "NULL", "1.5"]]),
        ("DELETE FROM stock WHERE site = 9", 0, [["bolt", "40", "0.25"], ["nut", "NULL", "1.5"], ["gear", "7", "12"]]),
    ],
)
def test_changes(stock, statement, count, left):
    assert stock.sql(statement) == AffectedRows(count)
    assert stock.sql("SELECT sku, qty, price FROM stock ORDER BY price, sku").text() == left


def test_definitions_and_transactions(stock):
    assert stock.sql("DROP TABLE changes") == AffectedRows(0) and stock.sql(CHANGES) == AffectedRows(0)
    assert stock.sql("BEGIN") == TransactionState("begun")
    stock.sql("DELETE FROM stock")
    assert stock.sql("SELECT sku FROM stock").rows == []
    assert stock.sql("ROLLBACK") == TransactionState("rolled_back") and len(stock.sql("SELECT sku FROM stock").rows) == 3
    stock.sql("BEGIN ISOLATION LEVEL SNAPSHOT")
    stock.sql("INSERT INTO changes (at, note) VALUES (5, 'first')")
    assert stock.sql("COMMIT") == TransactionState("committed")
    assert stock.sql("SELECT note, done FROM changes").text() == [["first", "false"]]


# Parts of messages that clients rely on.
@pytest.mark.parametrize(
    ("statement", "message"),
    [
        ("DELETE FROM stock WHERE price * 2.0", "WHERE clause must evaluate to BOOLEAN"),
        ("MERGE INTO stock", "expected a SQL statement"),
        ("SELECT note FROM ledger", "table 'ledger' not found"),
        ("INSERT INTO changes (note, note) VALUES ('a', 'b')", "duplicated in statement"),
        ("INSERT INTO stock (site, sku) VALUES (4, NULL)", "NULL is not allowed"),
        ("INSERT INTO stock (site, sku, qty) VALUES (1, 'gear', 1)", "primary key conflict on table 'stock'"),
        ("UPDATE stock SET sku = 'gear' WHERE sku = 'nut'", "primary key conflict on table 'stock'"),
    ],
)
def test_errors_leave_the_table_alone(stock, statement, message):
    with pytest.raises(EngineError) as e:
        stock.sql(statement)
    assert message.lower() in str(e.value).lower()
    assert len(stock.sql("SELECT sku FROM stock").rows) == 3


def test_definitions_stay_out_of_transactions(stock):
    stock.sql("BEGIN")
    with pytest.raises(EngineError, match="DDL in explicit transaction is not supported yet"):
        stock.sql("DROP TABLE stock")
