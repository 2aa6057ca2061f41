"""Every stage of the pipeline on its predecessor's rows."""

import collections
import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from graftline.llm import bpe
from graftline.llm.common import stored


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, words = docs.columns, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen.append(docs.collect())
    start, passed, first, mixed, encoded = seen
    assert {r.doc_id for r in passed} <= {r.doc_id for r in start} and all(words(r.text) and r.n_chars == len(r.text) for r in passed)
    assert {r.doc_id for r in first} <= {r.doc_id for r in passed} and len({r.doc_id for r in first}) == len(first)
    size, taken = collections.Counter(), collections.Counter()
    for r in first:
        size[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size) and all(taken[s] <= 3 * size[s] for s in size)
    coder = bpe.Coder.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.n_tokens) for r in encoded) == sorted((r.doc_id, len(coder.encode(pa.array([r.text]))[0])) for r in mixed)
