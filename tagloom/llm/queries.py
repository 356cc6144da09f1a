"""The queries ``opN_<name>`` and, where SQL can express them, their oracles."""

from __future__ import annotations

from tagloom.llm import exact_dedup, langid, minhash, mixing, packing, passages, secrets, sharding, vectors, warc


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_minhash": minhash.op2_minhash,
        "op3_warc": warc.op3_warc,
        "op4_sharding": sharding.op4_sharding,
        "op5_packing": packing.op5_packing,
        "op6_secrets": secrets.op6_secrets,
        "op7_vectors": vectors.op7_vectors,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_passages": passages.op10_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": minhash.OP2_SQL, "op3_warc": warc.OP3_SQL, "op7_vectors": vectors.OP7_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
