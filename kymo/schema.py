"""Schemas, as DDL, of the tables that the operators exchange. Times are seconds from a recording's start, as doubles."""

# Predictor families in canonical order, and those that null draws shift.
FAMILIES = "acoustic", "prosodic", "phonetic", "word", "onset"
SUBSTANTIVE = "prosodic", "phonetic", "word"
CAPACITY = "acoustic", "prosodic", "phonetic", "word"
# Spellings of the tiers that hold phones and words.
PHONE_TIERS = "phone", "phones", "phoneme", "phonemes"
WORD_TIERS = "word", "words"

INTERVALS = "recording_id string, interval_idx int, tier string, start double, end double, label string"
MANIFEST = "recording_id string, story_id string, audio_path string, alignment_path string, audio_matches int, alignment_matches int, audio_filename string, alignment_filename string"
AUDIO = "recording_id string, sample_rate int, n_samples bigint, duration_seconds double, samples array<float>"
FEATURES = "recording_id string, frame int, t double, x array<double>"
FEATURE_SCHEMA = "feature_idx int, name string, family string"
ACTIVATIONS = "model string, layer string, recording_id string, grid string, frame int, t double, y array<float>"
SCORES = (
    "split_kind string, outer_fold int, recording_id string, family string, full_alpha double, reduced_alpha double, full_r2 double, reduced_r2 double, delta_r2 double, frames bigint, "
    "duration_seconds double, train_recording_ids array<string>, test_recording_ids array<string>, full_inner_cv_scores map<double,double>, reduced_inner_cv_scores map<double,double>"
)
FOLD_RESULTS = "layer string, outer_fold int, feature_family string, alpha double, full_r2 double, reduced_r2 double, conditional_delta_r2 double, conditional_proportion double"
EFFECTS = "model string, layer string, recording_id string, family string, effect double, duration_seconds double"
UNIT_STATUS = "model string, layer string, variant string, null_index int, state string, schema_version int, metadata string, config_hash string, source_hashes map<string,string>, artifact_hashes map<string,string>"
