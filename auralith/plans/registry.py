"""All registered queries (``queries()``) and their DuckDB twins (``oracle_sql()``)."""

from __future__ import annotations

from auralith.plans import audit, cleaning, evaluation, labelling, leaderboard, manifests, profile, reports, scoring, shards, streams, tars, timing

QUERIES = {
    "eval_metrics": evaluation.eval_metrics,
    "corpus_wer_by_lang": evaluation.corpus_wer_by_lang,
    "corpus_cer_by_lang": evaluation.corpus_cer_by_lang,
    "wer_filter_keep": evaluation.wer_filter_keep,
    "wer_filter_token_ids": evaluation.wer_filter_token_ids,
    "label_qa_report": evaluation.label_qa_report,
    "clean_ted": cleaning.clean_ted,
    "clean_giga": cleaning.clean_giga,
    "clean_earnings": cleaning.clean_earnings,
    "clean_cv": cleaning.clean_cv,
    "strip_markup_norm": cleaning.strip_markup_norm,
    "chunk_rows": shards.chunk_rows,
    "merge_groups": shards.merge_groups,
    "dense_reindex": shards.dense_reindex,
    "missing_shards": shards.missing_shards,
    "retention": shards.retention,
    "latest_snapshot": shards.latest_snapshot,
    "shard_plan": shards.shard_plan,
    "seeded_shuffle": shards.seeded_shuffle,
    "resume_skip": shards.resume_skip,
    "paired_batches": shards.paired_batches,
    "step_schedule": shards.step_schedule,
    "manifest_join": manifests.manifest_join,
    "orphans": manifests.orphans,
    "strict_lookup": manifests.strict_lookup,
    "split_semi": manifests.split_semi,
    "metric_dedup": leaderboard.metric_dedup,
    "metric_log_versions": leaderboard.metric_log_versions,
    "leaderboard_pivot": leaderboard.leaderboard_pivot,
    "leaderboard_cer_raw": leaderboard.leaderboard_of("cer_raw"),
    "leaderboard_wer_raw": leaderboard.leaderboard_of("wer_raw"),
    "leaderboard_cer_norm": leaderboard.leaderboard_of("cer_norm"),
    "leaderboard_long": leaderboard.leaderboard_long,
    "sorted_metric_log": leaderboard.sorted_metric_log,
    "trial_times": leaderboard.trial_times,
    "trial_stats": leaderboard.trial_stats,
    "runtime_pivot": leaderboard.runtime_pivot,
    "optional_eq": leaderboard.optional_eq,
    "prompt_labels": labelling.prompt_labels,
    "token_round_trip": labelling.token_round_trip,
    "drop_timestamps": labelling.drop_timestamps,
    "batch_pad": labelling.batch_pad,
    "packed_labels": labelling.packed_labels,
    "fill_timestamps": timing.fill_timestamps,
    "regroup_segments": timing.regroup_segments,
    "long_recording_overlap": timing.long_recording_overlap,
    "long_recording_regroup": timing.long_recording_regroup,
    "long_recording_lookahead": timing.long_recording_lookahead,
    "silence_overlap": timing.silence_overlap,
    "lookahead_times": timing.lookahead_times,
    "median_durations": timing.median_durations,
    "corpus_profile": profile.corpus_profile,
    "slice_by_seconds": profile.slice_by_seconds,
    "chunk_explode": profile.chunk_explode,
    "spaced_index": profile.spaced_index,
    "punct_repair": profile.punct_repair,
    "model_ratio": profile.model_ratio,
    "pseudo_label_scores": scoring.pseudo_label_scores,
    "cascade": scoring.cascade,
    "logmel": scoring.logmel,
    "logmel_frames": scoring.logmel_frames,
    "japanese_metrics": evaluation.japanese_metrics,
    "english_numbers": evaluation.english_numbers,
    "ami_lines": cleaning.ami_lines,
    "librispeech_lines": cleaning.librispeech_lines,
    "manifest_lines": cleaning.manifest_lines,
    "spgispeech_rows": cleaning.spgispeech_rows,
    "voxpopuli_rows": cleaning.voxpopuli_rows,
    "common_voice_rows": cleaning.common_voice_rows,
    "gigaspeech_rows": cleaning.gigaspeech_rows,
    "earnings_rows": cleaning.earnings_rows,
    "routed_corpora": cleaning.routed_corpora,
    "config_rewrite": cleaning.config_rewrite,
    "report_refresh": reports.report_refresh,
    "learned_labels": reports.learned_labels,
    "tar_round_trip": tars.tar_round_trip,
    "tar_audit": tars.tar_audit,
    "incremental_ingest": streams.incremental_ingest,
    "stream_join": streams.stream_join,
    "stream_buffered_join": streams.stream_buffered_join,
    "stream_metrics": streams.stream_metrics,
    "missing_chunks": audit.missing_chunks,
    "segment_audio": audit.segment_audio,
    "duration_filter": audit.duration_filter,
    "multi_column_clean": audit.multi_column_clean,
    "member_routing": audit.member_routing,
}

ORACLE_SQL = {}
for _mod in (evaluation, cleaning, shards, manifests, leaderboard, labelling, timing, profile, scoring, streams, audit, tars, reports):
    ORACLE_SQL.update(_mod.SQL)

_unknown = set(ORACLE_SQL) - set(QUERIES)
if _unknown:  # every DuckDB twin must belong to a registered query
    raise RuntimeError(f"oracle SQL without a registered query: {sorted(_unknown)}")
