import duckdb
import pytest
from oracle import connect, rows_of, rows_of_sql

from tidewire import planted, queries

#: The searches that take longest stand for the others; the driver's gate runs them all.
LONG = {n for n in queries.KNOWN_SQL if n.startswith(("planted_te_", "planted_mi_"))} - {"planted_te_discrete", "planted_te_conditionals", "planted_mi_bivariate"}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(con, queries.SQL[name])


def test_neighbours_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    import datetime as dt

    import pandas as pd

    begin, rows = dt.datetime(2024, 1, 1), []
    for h in range(40):
        for kind, parts in (("a", [0.1, 0.2, 0.3]), ("b", [0.7, 0.1, 0.3])):
            for k, v in enumerate(parts if h % 2 else parts[::-1]):
                rows.append((len(rows), begin + dt.timedelta(hours=h, minutes=k), h % 5, kind, v * (1 + h * (3 + (kind == "b")) % 7), "{}"))
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    assert all(r[c] == round(r[c], 6) for r in queries._lagged_points(spark, str(tmp_path)).collect() for c in "xyz")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("knn_neighbour_counts", "kraskov_ais"):
        assert rows_of(queries.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.KNOWN_SQL) - LONG))
def test_known_answers(spark, con, name):
    assert rows_of(queries.KNOWN[name](spark, SF)) == rows_of_sql(con, queries.KNOWN_SQL[name])


def test_planted_series_hold_their_links(spark):
    x = planted.planted(spark, 200, 2, kind="binary", n_proc=3).to_array()
    for source, target, lag in planted.LINKS:
        assert (x[target, lag:] == x[source, :-lag]).mean() > 0.85


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 60


def test_entry_works_without_the_llm_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidewire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 60 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
