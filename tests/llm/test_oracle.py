"""The queries of the subpackage that have SQL, against it, on the smallest tables and on rows made to be hard."""

from __future__ import annotations

import random

import duckdb
import pytest

from factgraph.llm import registry

SF = "/root/testdata/sf0.001"


def same(spark, name, sf_dir, con):
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted((tuple(None if v is None else float(v) if isinstance(v, float) else v for v in r) for r in x), key=str)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(spark, name, SF, con)


@pytest.mark.parametrize("name", ["op3_minhash_neardup", "op5_substring_dedup", "op6_quality_rules"])
def test_matches_sql_on_hard_documents(spark, tmp_path, name):
    r = random.Random(11)
    words = [*[f"w{i}" for i in range(30)], "É", "梦x", "#*", "\u00a0", "A", "a"]
    texts = [None, "", " \n\t ", "one", "One", "x " * 200, "a b\n" * 60, "\n\n", "\u3000", "$% " * 90]
    line = " ".join(r.choice(words) for _ in range(24))
    for k in range(60):
        body = [r.choice(words) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice([0, 1, 1, 2])):
            body.insert(r.randrange(len(body) + 1), r.choice(["\n", line, f"\n{line}\n", "\v", "\r\n"]))
        texts += [" ".join(body)] * r.choice([1, 1, 2, 4])
        if k % 3 == 0:
            texts.append(" ".join(body[:-2] + ["end"]))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(spark, name, str(tmp_path), con)
