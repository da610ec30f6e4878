import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklore.llm import oracles, quality

SF = "/root/testdata/sf0.001"


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    return con.execute(sql).df()


def test_stages_against_sql(spark):
    """Each stage keeps exactly the rows that SQL on its own input keeps; the last gives the library's tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    want = {
        "near_dedup": lambda d: (r := by_sql(d, oracles.near_duplicates()))[r.kept].doc_id,
        "decontaminate": lambda d: (r := by_sql(d, oracles.contamination()))[~r.contaminated].doc_id,
        "mix": lambda d: (r := by_sql(d, oracles.mixture()))[r.kept].doc_id,
    }
    for name in ("quality", "near_dedup", "decontaminate", "mix"):
        out = stages[name](spark, docs, SF).cache()
        assert out.schema.names == schema.names, name
        kept = [r.doc_id for r in out.collect()]
        if name == "quality":
            model = quality.fitted(spark, docs, SF)
            assert sorted(kept) == sorted(r.doc_id for r in quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").collect())
            marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert np.mean([marks[k] for k in kept if k in marks]) > np.mean([*marks.values()]) + 0.1
        else:
            assert sorted(kept) == sorted(want[name](docs)), name
        assert 0 < len(kept) <= docs.count()
        docs = out
    encode, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 0]
        x = got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_odd_tables(spark, kind):
    """Empty tables, and nulls, repeated rows, ties and columns with names that stages use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as __length", "'x' as _source", "2.0D as _weight", "3 as __mix_p", "'s' as spans", "4 as score", "5 as component_id", "6 as turn")
    if kind == "empty":
        docs = docs.limit(0)
    else:
        odd = docs.limit(3)
        docs = docs.limit(120).unionByName(odd).unionByName(odd.selectExpr("doc_id + 900000 as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars", *docs.columns[5:]))
        docs = docs.unionByName(odd.selectExpr("doc_id + 800000 as doc_id", "'' as text", *docs.columns[2:]))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.schema.names == docs.schema.names, name
        assert out.count() <= docs.count() and (kind == "odd" or out.count() == 0), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
