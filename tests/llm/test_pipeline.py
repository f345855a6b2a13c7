import hashlib
import struct

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_decontamination import brute as contamination
from test_near import components

from quire.llm import bpe, pii


def test_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language_id(spark, docs, small).collect()}
    assert len(kept) > 0.8 * docs.where("text rlike '[a-z]'").count()
    group = components(kept)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    measured = {i: contamination(t, items) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not measured[i][1]}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        reader = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    expected = {}
    for i, t in kept.items():
        text = pii.redact_text(t)
        ids = reader.encode_ordinary(text)
        expected[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
    assert len(rows) == len(expected)


def test_stages_keep_the_columns_and_take_odd_tables(spark, odd, none, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, small).columns == odd.columns or name == "tokenize", name
        assert stage(spark, none, small).count() == 0, name
    assert corpus_pipeline.tokenize(spark, odd, small).count() == odd.count()
