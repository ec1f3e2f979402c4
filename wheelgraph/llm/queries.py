"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, langid, omh, packing, pii, quality, simhash, sst, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language": langid.op2_language,
    "op3_order_minhash": omh.op3_order_minhash,
    "op4_simhash": simhash.op4_simhash,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_sst": sst.op8_sst,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat": chat.op10_chat,
}
ORACLES = {"op5_warc": warc.ORACLE, "op10_chat": chat.ORACLE}
