"""The pipeline's stages and queries, and their SQL on the small tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from ratewise.llm.oracles import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    rows = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in want.fetchall())
    assert sorted(tuple(canon(r[c]) for c in cols) for r in got.collect()) == rows


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert clean <= set(ids["toxicity"])
    assert set(ids["near_dedup"]) <= set(ids["toxicity"]) and max(ids["near_dedup"].values()) == 1
    assert ids["near_dedup"] == ids["personal_data"]
    assert set(ids["mixing"]) <= set(ids["personal_data"])
    assert set(ids["packing"]) == set(ids["mixing"])
    assert seen["personal_data"].where("n_chars <> char_length(text)").count() == 0
    text = " ".join(r.text or "" for r in seen["personal_data"].collect())
    assert "@mail" not in text and "[EMAIL]" in text


def test_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "packing"]
