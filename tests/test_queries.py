"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from linkwell.operators import features
from linkwell.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# queries that SQL cannot express (edit distances, trees), with columns that they have; their operators have goldens in test_linkage.py and test_functions.py
NO_SQL = {
    "candidate_lists": ["source1_entity_id", "candidate_entity_ids"],
    "full_features": features.FEATURES,
    "model_matches": ["source1_entity_id", "matched_entity_ids"],
    "name_similarities": ["indel", "token_set", "blocks"],
}


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in catalog.ORACLE_SQL:
        assert set(NO_SQL[name]) <= set(frame.columns) and rows
        return
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canon(rows, frame.columns) == canon(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
