"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from lodestar.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SOME = ("pattern_one_hop", "pattern_two_hop_chain", "pattern_varlen_1_3", "find_references", "file_dependencies", "type_filter_takes", "fuzzy_core_search", "fuzzy_cli_cascade", "stats_by_file_top10", "coupling", "circular_dependencies", "definition_chain", "extract_lines_regex", "detect_changes", "format_text")


def text(v):
    return "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = QUERIES[name](spark, FOLDER)
    want = c.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(found.toPandas()) == rows(want.df())


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 60
