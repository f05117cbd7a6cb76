import glob
import os

import duckdb
import pytest

from folioscan.functions.porter import family
from folioscan.plans.catalogue import index, queries, oracle_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


QUERIES, SQL = queries(), oracle_sql()


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted(str([None if x is None or x != x else x for x in r]) for r in df[cols].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rank_score", "segment_count"]
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    for name in ("occ_merged_udf", "located_sources"):
        e.queries()[name](spark, DATA).count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stems_written_out_in_sql_hold_all_corpus_words(spark):
    """SQL lists the words of a stem, the queries take them from the index: no word of the tables may be missing in a list."""
    for folder in (DATA, DATA.replace("0.001", "0.01")):
        known = index(spark, folder)
        for word in ("budget", "weekly", "reviewed", "register", "thermostat", "telescope", "boiler"):
            assert set(known.words_of(word)) <= set(family(word))
