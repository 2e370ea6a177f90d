"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from fieldglass.llm import (  # noqa: F401  (registration)
    chat,
    credentials,
    decontaminate,
    filter_audit,
    lexical_search,
    media,
    near_dedup,
    packing,
    paragraph_dedup,
    quality,
    sharding,
    token_counts,
    toxicity,
)
from fieldglass.llm.register import ORACLES, QUERIES


def catalog() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
