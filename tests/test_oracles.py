"""Every query that SQL can express, against DuckDB."""

import pytest

from sonoframe import registry


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(name, spark, duck, sf_dir):
    ours, theirs = normal(registry.QUERIES[name](spark, sf_dir).toPandas()), normal(duck.sql(registry.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "start", "stop"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_text_operators():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "sonoframe.llm" not in path.read_text(), path
