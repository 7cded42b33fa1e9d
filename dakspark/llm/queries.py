"""The queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, langid, linededup, minhash, packing, pii, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": minhash.near_duplicate_documents,
        "op2_chat": chat.formatted_conversations,
        "op3_packing": packing.packed_documents,
        "op4_language": langid.document_languages,
        "op5_warc": warc.warc_round_trip,
        "op6_pii": pii.pseudonymised_documents,
        "op7_toxicity": toxicity.document_toxicity,
        "op8_fingerprint": fingerprint.document_fingerprints,
        "op9_decontam": decontam.contaminated_documents,
        "op10_lines": linededup.deduped_documents,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.FORMAT_SQL}
