"""Benchmark items with a null id, against op3's SQL."""

import duckdb
import pytest
from harness import compare

from marketgrain.llm.decontaminate import decontaminate
from marketgrain.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("windows", [1_000_000, 0])
def test_items_with_null_ids_are_hit(spark, tmp_path, windows):
    text = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {text} y"), (2, "nothing of it at all"), (3, "a short one in here"), (4, f"{text} and a short one"), (None, text)]
    items = [(None, text), (None, "short one"), (7, " ".join(f"w{i}" for i in range(3, 18)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    db = duckdb.connect()
    for name, df in (("documents", docs.where("doc_id is not null")), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    got = decontaminate(docs, items, broadcast_windows=windows)
    assert {r.doc_id: (r.n_items, r["items"], r.contaminated) for r in got.collect()} == {1: (2, ["7", None], True), 2: (0, [], False), 3: (1, [None], True), 4: (2, ["7", None], True), None: (2, ["7", None], True)}
    compare(got.where("doc_id is not null").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), db, ORACLE_SQL["op3_decontamination"])
