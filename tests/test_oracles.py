"""Every registered query of the library against its SQL, on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

from claimloom.plans import registry
from claimloom.sources import fixtures

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

#: The tests that hold the operators of queries without SQL against literal cases or brute force.
HELD_BY = {
    "q031_hyperplane_pairs": "test_functions.test_hyperplane_pairs_find_nine_of_ten",
    "q031_hyperplane_recall": "test_functions.test_hyperplane_pairs_find_nine_of_ten",
    "q111_gravity_topics": "test_functions.test_exclusive_topics_are_those_of_a_sorted_scan",
    "q112_constellations": "test_functions.test_constellations_are_pairs_that_occur_together",
    "q113_anchor_context": "test_functions.test_anchors_absorb_linked_claims_of_their_context",
    "q117_average_link": "test_functions.test_average_link_is_that_of_a_plain_loop",
    "q118_leader_clusters": "test_functions.test_leaders_are_those_of_a_loop",
    "q119_merged_units": "test_functions.test_merged_units_are_components_of_near_centroids",
    "q120_merged_events": "test_merges.test_events_merge_as_in_a_loop",
    "q122_layered_matching": "test_functions.test_layers_over_random_units_are_those_of_brute_force",
    "q122_entropy_matching": "test_functions.test_matching_by_entropy_is_that_of_brute_force",
    "q135_citations": "test_functions.test_roles_citations_and_markers",
    "q148_fuzzy_matches": "test_functions.test_fuzzy_matches_over_labels_and_aliases",
    "q149_identified": "test_functions.test_cascade_of_identification",
    "q163_main_texts": "test_functions.test_main_text_of_a_page",
    "q197_actions": "test_streams.test_actions",
    "q200_cooled_timeline": "test_timers.test_events_cool_between_claims",
    "q200_cooling_stream": "test_timers.test_events_cool_between_claims",
    "q200_lifecycle_batch": "test_streams.test_lifecycle_rules",
    "q200_lifecycle_stream": "test_streams.test_lifecycle_stream_is_the_batch",
    "q202_leader_stream": "test_timers.test_vector_leaders_are_those_of_a_loop",
    "q202_online_clusters": "test_streams.test_online_clusters_emit_each_kind_of_change",
    "q217_seed_clusters": "test_functions.test_seed_clusters_are_those_of_a_sorted_scan",
    "q222_energy_components": "test_functions.test_layers_of_components_are_those_of_brute_force",
    "q222_layered_components": "test_functions.test_layers_of_components_are_those_of_brute_force",
    "q223_best_pair_agglomeration": "test_functions.test_agglomeration_is_that_of_brute_force",
    "q223_unit_coherence": "test_merges.test_coherence_and_masses_of_merged_units",
    "q224_layered_masses": "test_merges.test_coherence_and_masses_of_merged_units",
    "q224_budgeted_agglomeration": "test_functions.test_budget_of_merges_is_that_of_brute_force",
}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(HELD_BY) == set(QUERIES) - set(ORACLES)
    for name in HELD_BY.values():
        module, test = name.split(".")
        assert callable(getattr(importlib.import_module(f"tests.{module}"), test))


@pytest.fixture(scope="module", autouse=True)
def kept_tables(spark):
    """The domain tables of the smallest scale, made once."""
    made = {}
    patch = pytest.MonkeyPatch()
    for name in [n for n in dir(fixtures) if n.startswith("kg_")]:
        def kept(s, d, f=getattr(fixtures, name), name=name, **more):
            if more:
                return f(s, d, **more)
            if (name, d) not in made:
                made[name, d] = f(s, d).cache()
            return made[name, d]

        patch.setattr(fixtures, name, kept)
    yield
    patch.undo()
    for df in made.values():
        df.unpersist()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 6)
        return str(v)

    out = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got), "the query finds nothing on these tables"
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
