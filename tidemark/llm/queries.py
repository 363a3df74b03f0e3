"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .ann import op9_nearest
from .common import documents
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .langid import op1_language_id
from .license_scan import OP13_SQL, op13_license_scan
from .line_dedup import OP4_SQL, op4_line_dedup
from .minhash_join import OP7_SQL, op7_minhash
from .mixing import op2_mixing
from .sentencepiece_codec import op3_sentencepiece
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .tiff_media import op6_tiff_media
from .toxicity import op5_toxicity
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_language_id": lambda spark, d: op1_language_id(documents(spark, d)),
    "op2_mixing": lambda spark, d: op2_mixing(documents(spark, d)),
    "op3_sentencepiece": lambda spark, d: op3_sentencepiece(documents(spark, d)),
    "op4_line_dedup": lambda spark, d: op4_line_dedup(documents(spark, d)),
    "op5_toxicity": lambda spark, d: op5_toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op6_tiff_media": lambda spark, d: op6_tiff_media(documents(spark, d)),
    "op7_minhash": lambda spark, d: op7_minhash(documents(spark, d)),
    "op8_substring_dedup": lambda spark, d: op8_substring_dedup(documents(spark, d)),
    "op9_nearest": lambda spark, d: op9_nearest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op10_url_filter": lambda spark, d: op10_url_filter(spark.read.parquet(f"{d}/pages.parquet")),
    "op11_tokenizer_alignment": lambda spark, d: op11_tokenizer_alignment(documents(spark, d)),
    "op12_conversation_repair": lambda spark, d: op12_conversation_repair(spark.read.parquet(f"{d}/conversations.parquet")),
    "op13_license_scan": lambda spark, d: op13_license_scan(documents(spark, d)),
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op7_minhash": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op10_url_filter": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_license_scan": OP13_SQL}
