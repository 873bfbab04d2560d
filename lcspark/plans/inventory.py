"""SURVEY section 2, line by line: operator id -> (function, queries).

``check`` is D (DuckDB oracle) or R (rows only), as registered.
"""

INVENTORY = {
    # 2.1 scans, sources, sinks
    "S1": ("sources.io.read_table", ["scan_projection", "scan_filter"]),
    "S2": ("sources.io.read_observations_csv / read_metadata_csv / read_with_rejects",
           ["read_observations_csv", "read_metadata_csv", "read_with_rejects"]),
    "S3": ("sources.io.read_delimited", ["read_delimited"]),
    "S4": ("sources.io.write_table / append_run", ["write_table", "append_run"]),
    "S5": ("sources.io.create_if_absent", ["create_if_absent"]),
    "S6": ("sources.io.compact_files", ["compact_files"]),
    "S7": ("sources.io.log_run", ["log_run"]),
    # 2.2 projections, filters, predicates, conditionals
    "C1": ("operators.project.typed_features", ["typed_features"]),
    "C2": ("functions.expr.map_target", ["map_target"]),
    "C3": ("operators.project.default_target", ["default_target"]),
    "C4": ("functions.expr.received_wavelength", ["received_wavelength"]),
    "C5": ("functions.expr.source_wavelength", ["source_wavelength"]),
    "C6": ("functions.expr.received_frequency", ["received_frequency"]),
    "C7": ("functions.expr.photoz_positive", ["photoz_positive"]),
    "C8": ("operators.project.pad_fill", ["pad_fill", "grid_left_join"]),
    "C9": ("operators.project.galactic_filter", ["galactic_filter_extragalactic", "galactic_filter_galactic"]),
    "C10": ("operators.project.use_specz", ["use_specz", "samples_baseline_specz_extragalactic"]),
    "C11": ("operators.project.limit_objects", ["limit_objects"]),
    "C12": ("operators.project.object_lookup / store_for_lookup", ["object_lookup", "object_lookup_stored"]),
    "C13": ("operators.project.hist_channel", ["hist_channel"]),
    "C14": ("operators.project.zero_channels_matrix", ["zero_channels", "network_input"]),
    "C15": ("functions.expr.band_index", ["band_index"]),
    "C16": ("operators.project.kv_observation", ["kv_observation"]),
    "C17": ("operators.project.meta_vector", ["meta_vector_baseline", "meta_vector_sql", "meta_vector_raw5",
                                              "meta_vector_raw6"]),
    # 2.3 joins
    "J1": ("operators.join.join_metadata", ["join_metadata"]),
    "J2": ("operators.join.join_modifiers", ["join_modifiers"]),
    "J3": ("operators.join.enrich_metadata", ["enrich_metadata"]),
    "J4": ("operators.join.padding_grid", ["padding_grid"]),
    "J5": ("operators.join.grid_left_join", ["grid_left_join"]),
    "J6": ("operators.join.rank_join", ["rank_join"]),
    "J7": ("operators.join.join_pivot_metadata", ["join_pivot_metadata"]),
    "J8": ("operators.join.align_pivots", ["align_pivots"]),
    # 2.4 aggregations and pivots
    "A1": ("operators.aggregate.observation_counts", ["observation_counts"]),
    "A2": ("operators.aggregate.max_observation_count", ["max_observation_count"]),
    "A3": ("operators.aggregate.flux_modifiers", ["flux_modifiers"]),
    "A4": ("operators.aggregate.pivot_feature", ["pivot_feature"]),
    "A5": ("operators.aggregate.pivot_all_features / pivot_all_wide", ["pivot_all_features"]),
    "A6": ("operators.aggregate.unpivot_feature", ["unpivot_feature"]),
    "A7": ("operators.aggregate.collect_arrays", ["collect_arrays"]),
    "A8": ("operators.aggregate.nested_arrays", ["nested_arrays"]),
    "A9": ("operators.aggregate.hist_struct", ["hist_struct"]),
    "A10": ("operators.aggregate.distinct_objects", ["distinct_objects"]),
    "A11": ("operators.aggregate.group_by_meta", ["group_by_meta"]),
    "A12": ("operators.aggregate.class_shares", ["class_shares"]),
    "A13": ("operators.aggregate.split_counts", ["split_counts"]),
    # 2.5 windows and time features
    "W1": ("operators.window.rank_asc", ["rank_asc", "rank_asc_event"]),
    "W2": ("operators.window.rank_desc", ["rank_desc"]),
    "W3": ("operators.window.global_rank", ["global_rank"]),
    "W4": ("operators.window.elapsed_time", ["elapsed_time", "elapsed_time_scaled"]),
    "W5": ("operators.window.delta_time", ["delta_time"]),
    "W6": ("operators.window.lead_time", ["lead_time"]),
    "W7": ("operators.window.reverse_elapsed", ["reverse_elapsed_aligned", "reverse_elapsed_mirrored"]),
    "W8": ("operators.window.interval_features", ["interval_features"]),
    "W9": ("operators.window.keep_last", ["keep_last", "keep_last_supp"]),
    "W10": ("operators.window.range_normalise", ["range_normalise"]),
    # 2.6 sorts, limits, set operations
    "O1": ("operators.order.order_observations", ["order_observations"]),
    "O2": ("operators.order.preview", ["preview"]),
    "O3": ("operators.order.append_replicas", ["append_replicas"]),
    # 2.7 scalar, array and vector functions
    "F1": ("functions.expr.log2_pow", ["flux_modifiers"]),
    "F2": ("functions.arrays.pad_array", ["pad_array"]),
    "F3": ("functions.arrays.forward_diff", ["forward_diff"]),
    "F4": ("functions.arrays.backward_diff", ["backward_diff"]),
    "F5": ("functions.arrays.one_hot", ["one_hot_offset0", "one_hot_offset1"]),
    "F6": ("functions.arrays.to_vector", ["to_vector"]),
    "F7": ("functions.arrays.to_dense", ["to_dense"]),
    "F8": ("functions.arrays.concat_features + to_vector", ["assemble_features"]),
    "F9": ("functions.arrays.slice_features", ["slice_features"]),
    "F10": ("functions.arrays.hist_matrix", ["hist_matrix"]),
    "F11": ("functions.expr.clip", ["clip"]),
    "F12": ("functions.arrays.argmax", ["argmax"]),
    # 2.8 padding and vector tables
    "V1": ("operators.vectors.pad_observations / pad_observations_relational",
           ["pad_observations", "pad_observations_relational", "pad_observations_supp"]),
    "V2": ("operators.vectors.vectors_raw", ["vectors_raw"]),
    "V3": ("operators.vectors.vectors_meta", ["vectors_meta"]),
    "V4": ("operators.vectors.vectors_calculated", ["vectors_calculated"]),
    "V5": ("operators.vectors.vectors_padded / vectors_padded_relational",
           ["vectors_padded", "vectors_padded_supp", "vectors_padded_augmented",
            "vectors_padded_augmented_object", "vectors_padded_relational",
            "vectors_padded_augmented_relational"]),
    "V6": ("operators.vectors.vectors_flat", ["vectors_flat_train", "vectors_flat_test"]),
    "V7": ("operators.vectors.samples_baseline",
           ["samples_baseline", "samples_baseline_specz_extragalactic", "samples_baseline_galactic"]),
    "V8": ("operators.vectors.network_input / network_input_from_obs", ["network_input"]),
    # 2.9 augmentation, balancing, split
    "G1": ("operators.augment.replicate", ["replicate"]),
    "G2": ("operators.augment.jitter_flux", ["jitter_flux_uniform", "jitter_flux_normal"]),
    "G3": ("operators.augment.dilate_time", ["dilate_time_obs", "dilate_time_object", "dilate_time_normal"]),
    "G4": ("operators.augment.jitter_metadata", ["jitter_metadata"]),
    "G5": ("operators.augment.drop_observations", ["drop_observations"]),
    "G6": ("operators.augment.augment", ["augment", "augment_by_galactic"]),
    "G7": ("operators.augment.augmented_vectors", ["augmented_vectors"]),
    "G8": ("operators.augment.balance_classes", ["balance_classes", "balance_classes_augmented"]),
    "G9": ("operators.augment.split", ["split_811", "split_721", "split_631", "split_91"]),
    # 2.10 ML preparation, scoring and evaluation
    "M1": ("operators.ml.standard_scale / standard_scale_groups", ["standard_scale", "standard_scale_groups"]),
    "M2": ("operators.ml.index_labels", ["index_labels"]),
    "M3": ("operators.ml.encode_labels", ["encode_labels"]),
    "M4": ("operators.ml.fit_classifier / fit_network", ["fit_classifier", "fit_network"]),
    "M5": ("operators.ml.score", ["score"]),
    "M6": ("operators.ml.precision", ["precision"]),
    "M7": ("operators.ml.weighted_log_loss", ["weighted_log_loss"]),
    "M8": ("operators.ml.training_loss", ["training_loss"]),
}
