"""Ties that an ORDER BY leaves open, against the SQL."""

import duckdb

import __spark_entry__ as entry_module
from tools.check_oracle import rows_of


def test_identity_gate_takes_the_first_of_equal_rows(spark, tmp_path):
    # (order, part, supplier, line, tax): the same part twice at the same price and tax, from two suppliers
    rows = [(1, 10, 3, 1, 0.04), (1, 10, 9, 2, 0.04), (1, 10, 4, 2, 0.02), (2, 11, 8, 5, 0.06), (2, 11, 2, 4, 0.06), (3, 12, 7, 1, 0.0), (3, 12, 6, 1, 0.0)]
    con = duckdb.connect()
    con.execute("set threads = 1")
    values = ", ".join(f"({o}::BIGINT, {p}::BIGINT, {s}::BIGINT, {n}, 1.0::DOUBLE, {100 - 7 * (t == 0.02)}::DOUBLE, 0.0::DOUBLE, {t}::DOUBLE)" for o, p, s, n, t in rows)
    con.execute(f"copy (from (values {values}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet'")
    con.execute(f"create table want as {entry_module.oracle_sql()['T11_identity_gate']}")
    for r in (3, 2, 1):  # the tops are the suppliers of the first line, 3, 2 and 6
        assert con.execute(f"select accepted from want where q = {r}").fetchone() == (True,)
    df = entry_module.queries()["T11_identity_gate"](spark, str(tmp_path))
    cursor = con.execute("from want")
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    # of two rows with the score of the top and different taxes the first is compared, not the largest supplier
    con.execute(f"copy (from lineitem union all values (4::BIGINT, 13::BIGINT, 5::BIGINT, 1, 1.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE, 0.08::DOUBLE), (4, 13, 9, 2, 1.0, 50.0, 0.0, 0.01)) to '{tmp_path}/more.parquet' (format parquet)")
    more = tmp_path / "b"
    more.mkdir()
    (tmp_path / "more.parquet").rename(more / "lineitem.parquet")
    got = {r.q: r.accepted for r in entry_module.queries()["T11_identity_gate"](spark, str(more)).collect()}
    assert got[4]  # supplier 5 tops both; supplier 9 would top the scores alone
