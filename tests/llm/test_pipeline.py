import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rastergrid.llm import secrets
from rastergrid.llm.encoding import TextEncoder, read_spec
from rastergrid.llm.queries import LLM_ORACLES, LLM_QUERIES

import edge
from test_simhash import brute_groups, brute_print


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secret_scan", "best_fit_packing"]
    rows = edge.documents(spark)
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "unused")
        if i < 3:
            assert out.columns == rows.columns
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        rows = spark.read.parquet(path)
        kept.append(rows.collect())
    language, single, clean, packed = kept
    assert not {5, 6, 7, 8} & {r.doc_id for r in language}
    prints = [brute_print(r.text) for r in language]
    assert len(single) == len(set(brute_groups(prints)))
    assert sorted(r.text for r in clean) == sorted(secrets.redacted(r.text) for r in single)
    _, sizes = TextEncoder(read_spec()).encode([r.text for r in clean])
    assert sum(r.length for r in packed) == int(sizes.sum()) + len(clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in single}


def test_run_equals_its_stages_by_hand(spark, sf):
    """All of a small table against brute force from the language stage on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    language = sorted(corpus_pipeline.language(spark, docs, sf).collect(), key=lambda r: r.doc_id)
    labels = brute_groups([brute_print(r.text) for r in language])
    single = [r for k, r in enumerate(language) if labels[k] == k]
    ids, sizes = TextEncoder(read_spec()).encode([secrets.redacted(r.text) for r in single])
    want = sorted((r.doc_id, p, min(2048, n + 1 - 2048 * p)) for r, n in zip(single, sizes.tolist())
                  for p in range(-(-(n + 1) // 2048)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == want
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(filled) <= 1.01 * sum(r.length for r in got) / 2048 + 1


def test_registry():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


def test_oracles(spark, sf):
    import duckdb

    for name, sql in LLM_ORACLES.items():
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        got = LLM_QUERIES[name](spark, sf)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name
        assert got.agg(F.count("*")).first()[0] > 0
