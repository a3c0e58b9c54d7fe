"""Every query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from parley import catalog, catalog_more

assert catalog_more  # it registers its queries in catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 8) if isinstance(v, float) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, smallest, name):
    found = catalog.QUERIES[name](spark, smallest).toPandas()
    wanted = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_queries_without_sql_are_tested_in_python():
    """In test_plain.py, test_whole_jobs.py, test_neighbours.py, test_layout.py, test_geometry.py and test_resamples.py."""
    plain = {"str_clean_entities", "spl_assign_seeded", "smp_stratified", "prj_thread_prompt", "tree_greedy_pairs", "clu_kmeans_quality"}
    whole = {"clu_grid_search", "sim_matrix_all", "sim_match_threshold_all", "bst_ci", "clu_grid_tables", "clu_neighbour_graph", "clu_layout", "bst_exact_ci", "clu_coloured"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == plain | whole


def test_plans_have_no_nested_loops(spark, smallest):
    for name in ("tree_candidates", "agg_dedup_prefer_clean", "jon_hydrate_ids", "jon_semi_targets", "sim_matrix", "spl_assign_sha2"):
        plan = catalog.QUERIES[name](spark, smallest)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_top_k_limits_groups_before_the_shuffle(spark, smallest):
    plan = catalog.QUERIES["top_k_bucket"](spark, smallest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
