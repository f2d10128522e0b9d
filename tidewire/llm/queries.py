"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, licenses, manifest, media, mixing, quality, repair, secrets, simhash, token_files, toolchat, warc

MODULES = (token_files, quality, mixing, secrets, bpe, licenses, simhash, toolchat, media, exact_dedup, manifest, warc, repair)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
