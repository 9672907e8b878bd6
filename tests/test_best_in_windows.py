"""The best row of each identity is chosen where the window is; the rows agree with listing every pair."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from ionweave.operators import lists


def test_best_of_each_identity(spark):
    users = [(u, 100.0 + u, [((u * 7 + k * 5) % 13 - 6) / 4.0 for k in range(64)] if u % 3 else None) for u in range(12)]
    rows = [(c, c % 5 if c % 11 else None, 100.0 + c / 10, (c * 2654435761) % 2**62) for c in range(1, 140)]
    queries = spark.createDataFrame(users, "u long, m double, z array<double>")
    bank = spark.createDataFrame(rows, "c long, n int, x double, w long").repartition(3)
    out = lists.best_in_windows(queries, bank, query="u", identity="n", row="c", logits="z", words="w", n_bits=64, digits=9, query_mass="m", bank_mass="x", narrow=4000.0, wide=20000.0, cap=9)
    above, _ = out._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "Exchange" not in above and "Join" not in above
    want = set()
    for u, m, z in users:
        inside = lambda ppm: [r for r in rows if m - m * (ppm / 1e6) <= r[2] <= m + m * (ppm / 1e6)]
        near = inside(4000.0) or inside(20000.0)
        best = {}
        for c, n, x, w in near if len(near) <= 9 else []:
            key = sum(v for k, v in enumerate(z) if w >> k & 1) if z else -round(abs(x - m), 9)
            if n is not None and (n not in best or (-key, c) < best[n]):
                best[n] = (-key, c)
        want |= {(u, c, n) for n, (_, c) in best.items()}
    assert want and {(r.u, r.c, r.n) for r in out.collect()} == want


def test_windows_over_4096_rows_are_not_held(spark, tmp_path):
    """The workflow lists what is in a window of any size, as its SQL does."""
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    # 3,000 rows share a mass, 3,000 lie close to it: a window holds all or none
    con.execute(f"""copy (select i as c_custkey, 'Customer#' || i as c_name, (i % 25)::integer as c_nationkey, case when i % 2 = 0 then 150.0 else 150 + i / 1e7 end as c_acctbal
        from (select unnest(range(1, 6001)) as i)) to '{tmp_path}/customer.parquet'""")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    got = {tuple(r) for r in entry_module.queries()["workflow_identify_molecules"](spark, str(tmp_path)).select("user_id", "items").collect()}
    assert any(len(items.split(";")) == 25 for _, items in got)
    assert got == set(con.execute(entry_module.oracle_sql()["workflow_identify_molecules"]).fetchall())


@pytest.mark.parametrize("cell_rows", [30, 10**6])
def test_pieces_of_a_window_hold_the_best_rows(spark, cell_rows):
    users = [(u, 100.0 + u / 50, [((u * 7 + k * 5) % 13 - 6) / 4.0 for k in range(64)] if u % 3 else None) for u in range(12)]
    rows = [(c, c % 5 if c % 11 else None, 100.0 if c % 2 else 100.0 + c / 500, (c * 2654435761) % 2**62) for c in range(1, 300)]
    queries = spark.createDataFrame(users, "u long, m double, z array<double>")
    bank = spark.createDataFrame(rows, "c long, n int, x double, w long").repartition(3)
    pieces = lists.best_in_windows(queries, bank, query="u", identity="n", row="c", logits="z", words="w", n_bits=64, digits=9, query_mass="m", bank_mass="x", narrow=1000.0, wide=20000.0, cap=None,
                                   cell_rows=cell_rows)
    got = {(r.u, r.c, r.n) for r in lists.distinct_topk(pieces, "u", "n", "key", "c", 25).collect()}
    want = set()
    for u, m, z in users:
        inside = lambda ppm: [r for r in rows if m - m * (ppm / 1e6) <= r[2] <= m + m * (ppm / 1e6)]
        best = {}
        for c, n, x, w in inside(1000.0) or inside(20000.0):
            key = round(sum(v for k, v in enumerate(z) if w >> k & 1), 9) if z else -round(abs(x - m), 9)
            if n is not None and (n not in best or (-key, c) < best[n]):
                best[n] = (-key, c)
        want |= {(u, c, n) for n, (_, c) in best.items()}
    assert want and got == want
