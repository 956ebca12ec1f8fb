"""The driver queries of this package and their SQL."""

from . import chat, classlm, decontaminate, minhash, passages, phrases, quality, resample, secrets, sharding, spm, suffix_dedup, toxicity

QUERIES = {
    "op1_feistel_sharding": sharding.op1_feistel_sharding,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_probminhash": minhash.op3_probminhash,
    "op4_qgram_decontamination": decontaminate.op4_qgram_decontamination,
    "op5_sentencepiece": spm.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_compact_windows": passages.op9_compact_windows,
    "op10_chat_windows": chat.op10_chat_windows,
    "op11_brown_class_lm": classlm.op11_brown_class_lm,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

ORACLES = {
    "op1_feistel_sharding": sharding.oracle(),
    "op2_quality_rules": quality.oracle(),
    "op7_secret_scan": secrets.oracle(),
    "op10_chat_windows": chat.oracle(),
    "op12_phrase_collocations": phrases.oracle(),
    "op13_importance_resampling": resample.oracle(),
}
