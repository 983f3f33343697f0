"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from orrery.llm import decontaminate, fingerprints, language_id, licenses, near_dedup, packing, pitman_yor, secrets, sharding, simple8b

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_simple8b": simple8b.op2_simple8b,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_pitman_yor": pitman_yor.op4_pitman_yor,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_sharding": sharding.op6_sharding,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_sharding": sharding.ORACLE,
}
