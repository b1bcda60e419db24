"""Every registered query runs, has a stable schema, and matches its DuckDB twin on the small tables."""

import math

import duckdb
import pytest

from lexmill.plans import registry
from lexmill.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.oracle_sql():
        assert columns
        return
    found = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_alternates_that_appear_at_once_are_in_the_order_of_their_rows(spark, tmp_path):
    c = duckdb.connect(config={"threads": 1})  # more threads leave the order of ties to chance
    (tmp_path / "lineitem.parquet").mkdir()
    for file in range(3):
        c.execute(f"""COPY (SELECT CASE WHEN p < 300 THEN p END AS l_partkey, CASE WHEN hash(p, q) % 5 > 0 THEN p // 2 END AS l_orderkey, 1 + (hash(q, p) % 2)::INT AS l_linenumber,
            chr(65 + (hash(p, q, 1) % 26)::INT) AS l_returnflag, CASE WHEN q > 0 THEN chr(65 + (hash(p, q, {file}) % 2)::INT) END AS l_linestatus
            FROM range(301) t(p), range(3) s(q) WHERE (p + q) % 3 <> {file}) TO '{tmp_path}/lineitem.parquet/{2 - file}.parquet'""")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = c.execute(registry.oracle_sql()["ordered_alternates"]).fetchall()
    got = registry.queries()["ordered_alternates"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_nothing_else_imports_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "lexmill.llm" not in path.read_text(encoding="utf-8"), path
