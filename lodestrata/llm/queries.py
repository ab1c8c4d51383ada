"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

import importlib

#: Modules with a QUERIES table: name -> (query, SQL or None).
MODULES = ("chat", "urls", "mixing", "minhash", "embeddings", "quality", "toxicity", "secrets", "pieces", "html", "licenses", "whitening", "repair")


def _all() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"{__package__}.{m}").QUERIES)
    return out


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _all().items() if s}
