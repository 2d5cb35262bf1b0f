"""Named queries of the training-data operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from . import alignment, chat, fillmiddle, licenses, linecrf, mixing, packing, quality, secrets, simhash, tiff, treebpe, urlrules

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_pack": packing.op2_pack,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_chat_format": chat.op4_chat_format,
    "op5_quality_score": linecrf.op5_quality_score,
    "op6_media_tiff": tiff.op6_media_tiff,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_url_filter": urlrules.op9_url_filter,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_fill_middle": fillmiddle.op11_fill_middle,
    "op12_align_tokenizers": alignment.op12_align_tokenizers,
    "op13_bpe_roundtrip": treebpe.op13_bpe_roundtrip,
}
ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op9_url_filter": urlrules.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_fill_middle": fillmiddle.OP11_SQL,
}
