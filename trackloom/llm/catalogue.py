"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, kmeans, licences, media, merkle, minhash, mixing, ngram, quality, simhash, topk, warc

MODULES = (mixing, bpe, simhash, media, chat, warc, topk, ngram, quality, licences, minhash, kmeans, merkle)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
