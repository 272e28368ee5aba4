"""The corpus operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, overlaps
from .langid import op9_langid
from .mixing import op13_mixing
from .overlaps import op12_overlaps
from .packing import op3_packing
from .pieces import op2_pieces
from .quality import op6_quality
from .runs import op11_runs
from .sharding import op4_sharding
from .simhash import op1_simhash
from .syncmers import op8_syncmers
from .token_counts import op5_token_counts
from .toxicity import op10_toxicity
from .wavelet import op7_wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pieces": op2_pieces,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_wavelet": op7_wavelet,
    "op8_syncmers": op8_syncmers,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_overlaps": op12_overlaps,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {"op12_overlaps": overlaps.ORACLE, "op13_mixing": mixing.ORACLE}
