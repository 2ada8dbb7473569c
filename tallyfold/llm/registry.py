"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyfold.llm import (
    ball_clusters,
    bpe,
    chat,
    kd_search,
    kneser_ney,
    maxscore,
    mixing,
    near_vectors,
    ngram_join,
    pii,
    quality,
    token_counts,
    warc,
)

_MODULES = (near_vectors, warc, kd_search, quality, chat, pii, bpe, ngram_join, mixing, kneser_ney, token_counts, ball_clusters, maxscore)


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
