import pytest

from tessera.llm.queries import QUERIES, SQL
from tests.compare import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    rows = spark_rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert rows == sql_rows(connect(sf), SQL[name])


def test_ids_are_ordered(spark, sf):
    for name, (a, b) in {"p1_found": ("slug_a", "slug_b"), "p2_found": ("id_a", "id_b"), "p3_found": ("id_a", "id_b")}.items():
        rows = QUERIES[name](spark, sf).collect()
        assert all(r[a] < r[b] for r in rows) and len(set(rows)) == len(rows)


def test_containers(spark, sf):
    rows = QUERIES["p7_containers"](spark, sf).collect()
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1
