"""Queries of this subpackage for the driver's entry point."""

from __future__ import annotations

from evidara.llm import chats, decontaminate, licenses, lines, mixing, near, nearest, periods, secrets, spelling, substrings, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op2_near_dedup": near.op2_near_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op5_nearest": nearest.op5_nearest,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_chat_collapse": chats.op7_chat_collapse,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op8_line_dedup": lines.op8_line_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_token_binary": tokens.op13_token_binary,
}
ORACLES = {
    "op2_near_dedup": near.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op7_chat_collapse": chats.OP7_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op8_line_dedup": lines.OP8_SQL,
}
