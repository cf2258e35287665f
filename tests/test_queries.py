"""Every registered query runs; those with SQL give the same rows."""

import pytest

from coursemill.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name, tmp_path):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        compare(con, registry.ORACLES[name], df, str(tmp_path / "out"))
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_auto_tags_read_headings_anywhere(spark, tmp_path):
    long = "word " * 200
    docs = [(1, f"\n{long}\n## Grafos  \n{long}", "src1", "en"), (2, f"\n{'x ' * 40}grafos {long}", "src1", "en"), (3, f"\n{long}\n####### Grafos\n#Grafos", "src1", "en"), (4, None, "src1", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Grafos e arvores de busca")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.entry_id: r.auto_tags for r in registry.QUERIES["auto_tags"](spark, str(tmp_path)).collect()}
    assert got == {1: "topico:grafos; topico:grafos-e; tipo:prova", 2: "tipo:material-base", 3: "", 4: "tipo:lista"}
