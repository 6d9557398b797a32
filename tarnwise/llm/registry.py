"""The text operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from tarnwise.llm import bpe, chat, decontaminate, jaccard, language, neighbours, oracles, sharding, substrings, url_filter, warc


def queries() -> dict[str, Callable]:
    found = [
        sharding.op1_consistent_hash_sharding,
        url_filter.op2_char_lm_url_filter,
        chat.op3_chat_round_trip,
        warc.op4_warc_index_merge,
        substrings.op5_gear_chunk_dedup,
        language.op6_segmentation_language_id,
        bpe.op7_prefix_bpe,
        neighbours.op8_int8_block_neighbours,
        jaccard.op9_jaccard_metric_join,
        decontaminate.op10_suffix_automaton_decontamination,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_round_trip": oracles.OP3,
        "op4_warc_index_merge": oracles.OP4,
        "op8_int8_block_neighbours": neighbours.OP8_SQL,
        "op9_jaccard_metric_join": oracles.OP9,
        "op10_suffix_automaton_decontamination": oracles.OP10,
    }
