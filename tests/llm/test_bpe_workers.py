"""Ids are made and digested in one Python worker."""

from __future__ import annotations

import public_tokenizers

from duskveil.llm import bpe, registry


def test_ids_and_digests_share_a_worker(docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert of(registry.bpe_tokens(spark, "/root/testdata/sf0.001")) == of(bpe.encoded(docs, path, 3)) == 2
    assert sorted(bpe.encoded_digests(docs, path, 3).collect(), key=str) == sorted(bpe.digests(bpe.encoded(docs, path, 3), path).collect(), key=str)
