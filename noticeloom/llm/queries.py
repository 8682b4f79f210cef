"""The queries of this subpackage, and their SQL where SQL can express them."""

from noticeloom.llm import attribution, chat, decontam, filteraudit, langid, mpegts, nearjoin, packing, repair, sharding, streamdedup, tokenfile, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_mpeg_transport_streams": mpegts.op3_mpeg_transport_streams,
    "op4_language_id": langid.op4_language_id,
    "op5_warc_boundary_chains": warc.op5_warc_boundary_chains,
    "op6_wavelet_token_files": tokenfile.op6_wavelet_token_files,
    "op7_token_attribution": attribution.op7_token_attribution,
    "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_ngram_jaccard_join": nearjoin.op10_ngram_jaccard_join,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_streaming_exact_dedup": streamdedup.op12_streaming_exact_dedup,
    "op13_filter_interaction_audit": filteraudit.op13_filter_interaction_audit,
}

ORACLE_SQL = {
    "op2_chat_formatting": chat.SQL,
    "op5_warc_boundary_chains": warc.SQL,
    "op8_rendezvous_sharding": sharding.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_streaming_exact_dedup": streamdedup.SQL,
    "op13_filter_interaction_audit": filteraudit.SQL,
}
