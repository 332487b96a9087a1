"""Every query of the subpackage."""

from mirrortab.llm import (  # noqa: F401
    byte_bpe, decontaminate, language, near_dup, quality, records, secrets, sharding, spelling, token_count, url_filter, warc, whitening)
from mirrortab.llm.registry import ORACLES, QUERIES  # noqa: F401
