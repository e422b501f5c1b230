"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .licenses import op7_licenses
from .media import op5_media
from .mixing import op4_mixing
from .packing import op6_packing
from .pfp_dedup import op3_repeats
from .pii import op1_pii
from .quality import op9_quality
from .secrets import op10_secrets
from .simhash import op2_simhash
from .warc import ORACLE as WARC_SQL
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_repeats": op3_repeats,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": WARC_SQL,
}
