"""All queries of this package."""

from siftloom.llm import (  # noqa: F401  (register their queries)
    byte_bpe,
    decontaminate,
    merkle,
    near_dedup,
    packing,
    quality,
    reputation,
    structure,
    substrings,
    suffixes,
    toxicity,
    warc,
    whitening,
)
from siftloom.llm.registry import ORACLES, QUERIES  # noqa: F401
