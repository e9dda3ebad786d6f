"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from weftline.llm import dac, decontam, langid, lm, mih, packing, pii, sharding, simhash, urlfilter

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing,
        simhash.op2_simhash,
        langid.op3_language_id,
        sharding.op4_sharding,
        mih.op5_nearest,
        lm.op6_lm_scoring,
        dac.op7_token_output,
        decontam.op8_decontamination,
        urlfilter.op9_url_filters,
        pii.op10_pii,
    )
}
ORACLES = {"op9_url_filters": urlfilter.ORACLE_SQL}
