"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.byte_bpe import op8_byte_bpe
from lexiloom.llm import mixing
from lexiloom.llm.html_text import op10_html_text
from lexiloom.llm.license_scan import op9_license_scan
from lexiloom.llm.multiprobe import op5_multiprobe
from lexiloom.llm.order_minhash import op4_order_minhash
from lexiloom.llm.sharding import op3_sharding
from lexiloom.llm.simhash import op6_simhash
from lexiloom.llm.token_files import op1_token_files
from lexiloom.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_order_minhash": op4_order_minhash,
    "op5_multiprobe": op5_multiprobe,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_html_text": op10_html_text,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
}
