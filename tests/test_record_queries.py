"""Each query over records against its SQL on a few customers whose fields meet in all ways."""

import duckdb
import pytest

from corvane import record_queries as Q
from corvane.queries import ORACLE_SQL, QUERIES

NAMES = [n for n, f in QUERIES.items() if f.__module__ == Q.__name__]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i,) for i in range(400)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i,) for i in range(10)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, "click") for i in range(12)], "event_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    texts = [f"the text of number {i // 3} is like the others in its group of {i // 3}" + "." * (i % 3) for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def plain(rows):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "events", "benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, tables).select(*columns).collect()
    assert plain(map(tuple, got)) == plain(want.fetchall()) and got
    if "messages" in columns:
        found = {r.messages for r in got}
        assert "" in found and len(found) > 1
