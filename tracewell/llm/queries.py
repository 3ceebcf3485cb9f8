"""The queries of this subpackage by name, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, html, imatch, langid, lexical, neardup, packing, periodic, pii, rlz, vectors, warc

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_warc_revisits": warc.query,
    "op3_rlz": rlz.query,
    "op4_packing": packing.query,
    "op5_language": langid.query,
    "op6_chat": chat.query,
    "op7_pii": pii.query,
    "op8_imatch": imatch.query,
    "op9_site_tree": html.query,
    "op10_lsh_forest": neardup.query,
    "op11_lexical": lexical.query,
    "op12_stable_hashing": vectors.query,
    "op13_tandem": periodic.query,
    "pipeline": corpus_pipeline.run,
    "imatch_edits": imatch.edits,
}
ORACLES = {
    "op2_warc_revisits": warc.ORACLE,
    "op3_rlz": rlz.ORACLE,
    "op6_chat": chat.ORACLE,
    "op7_pii": pii.ORACLE,
    "op10_lsh_forest": neardup.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_stable_hashing": vectors.ORACLE,
    "op13_tandem": periodic.ORACLE,
    "imatch_edits": imatch.EDITS_ORACLE,
}
