"""Registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, fingerprints, langid, lm, minhash, mixing, quality, secrets, spans, trie, warc

MODULES = [minhash, quality, langid, decontam, mixing, spans, secrets, chat, lm, warc, align, fingerprints, trie]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
