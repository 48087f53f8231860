"""The driver contract: entry smoke, registry consistency and an oracle
comparison on the smallest data set."""

import duckdb

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150
    for name in q:
        assert name == name.lower() and " " not in name


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "rec_daily" in df.columns and "explanation_text" in df.columns
    assert all(r.rec_daily >= r.guardrail_min_price - 0.005 for r in rows)


def _canon(rows):
    out = []
    for r in rows:
        out.append(tuple("NULL" if v is None else (f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r))
    return sorted(out)


def test_oracle_sample(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name in ["agg_01", "agg_06", "win_08", "fct_01", "cmp_04", "agg_02"]:
        sdf = E.queries()[name](spark, SMALL)
        cols = sorted(sdf.columns)
        s_rows = _canon([tuple(r[c] for c in cols) for r in sdf.collect()])
        cur = con.execute(E.oracle_sql()[name])
        dcols = [c[0] for c in cur.description]
        d_rows = _canon([tuple(r[dcols.index(c)] for c in cols) for r in cur.fetchall()])
        assert s_rows == d_rows, name
