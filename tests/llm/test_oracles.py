"""Queries against their SQL, and rules that hold for all of them."""

import re
from pathlib import Path

import check
import duckdb
import pytest

from termsheet.llm import queries

SF = "/root/testdata/sf0.01"
FOLDER = Path(queries.__file__).parent


def rows(spark, name, sf):
    df = queries.QUERIES[name](spark, sf)
    return sorted(df.columns), sorted((tuple(check.plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query_matches_sql(spark, name, sf):
    if name.startswith("op7") and sf != SF:
        pytest.skip("the checksum in SQL is slow on longer texts")
    columns, mine = rows(spark, name, sf)
    found = check.connect(sf).execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted((tuple(check.plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_no_local_checkpoints_and_no_swallowed_imports():
    for path in [*FOLDER.glob("*.py"), FOLDER.parents[1] / "corpus_pipeline.py"]:
        text = path.read_text()
        assert "localCheckpoint" not in text and "ImportError" not in text and "crossJoin" not in text


def test_native_operators_run_no_python(spark):
    for name in ("op7_interleave", "op9_quality_rules"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    for name in ("shards", "rules"):
        assert not re.search(r"udf|InPandas|InArrow|\.rdd", (FOLDER / f"{name}.py").read_text())


def test_nothing_else_imports_the_folder():
    for path in FOLDER.parent.rglob("*.py"):
        if FOLDER not in path.parents:
            assert not re.search(r"(from|import) termsheet\.llm", path.read_text())
