"""The SQL of the queries that have one gives their rows, on the driver's tables and on odd rows."""

import duckdb
import pytest

from atlasloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import odd_rows
from tests.test_catalogue import rows


def held(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if 'odd' in str(folder) else ''}'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_tables(spark, sf, name):
    held(spark, sf, name)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows(spark, tmp_path, name):
    folder = tmp_path / "odd"
    texts = [r[1] for r in odd_rows()]
    kinds = {"documents": "doc_id bigint, text string", "benchmark": "item_id bigint, text string", "conversations": "conv_id bigint, turn bigint, role string, text string"}
    made = {
        "documents": list(enumerate(texts)),
        "benchmark": [(1, "one two three four"), (2, texts[0]), (2, texts[0]), (3, None), (10, " ".join(texts[0].split()[20:45])), (4, "?!")],
        "conversations": [(k // 3, k % 3, ["user", "assistant", "a role"][k % 3], t) for k, t in enumerate(texts)] + [(99, 0, None, "x"), (99, None, "assistant", None)],
    }
    for table, data in made.items():
        spark.createDataFrame(data, kinds[table]).repartition(2).write.parquet(f"{folder}/{table}.parquet")
    held(spark, folder, name)
