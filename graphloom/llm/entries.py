"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from graphloom.llm import chat, decontaminate, embeddings, langid, licenses, lm, packing, pii, simhash, token_files

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_chat": chat.op2_chat,
    "op3_packing": packing.op3_packing,
    "op4_pii": pii.op4_pii,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_simhash": simhash.op6_simhash,
    "op7_language": langid.op7_language,
    "op8_licenses": licenses.op8_licenses,
    "op9_lm": lm.op9_lm,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op10_proximity": decontaminate.op10_proximity,
}
ORACLE_SQL = {
    "op2_chat": chat.OP2_SQL,
    "op5_embeddings": embeddings.OP5_SQL,
    "op8_licenses": licenses.oracle(),
    "op9_lm": lm.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
}
