from .annotate import annotate_cells, annotate_tables, annotate_tagged_cells, rejected_pages
from .cluster import best_k, choose_k, cluster_tables, kmeans, silhouette, silhouette_scores, silhouettes
from .context import neighbour_words, words_above, words_below, words_left, words_right
from .encode import (
    assemble,
    categories,
    encode_entities,
    entity_categories,
    entity_codes,
    fit_pca,
    fit_scaler,
    fit_scaling,
    grid_extent,
    label_codes,
    label_encode,
    label_encoder,
    one_hot,
    padded_grid,
    pca,
    standard_scale,
)
from .context_bags import ContextBags, SparseCodes, context_bags, context_term_counts, fit_context_tfidf, sparse_vector, square_terms, store_tables
from .extract import (
    block_edges,
    block_report,
    blocks_of_type,
    cell_geometry,
    cell_words,
    cells_from_blocks,
    cells_of_type,
    first_entity,
    normalize_indices,
    table_cells,
)
from .joins import attach_table_class, attach_tags, cells_of_tables, unmatched
from .learn import (
    cluster_features,
    fit_sample,
    hash_split,
    load_model,
    predict_cell_role,
    predict_table_class,
    save_model,
    split_bucket,
    train_cell_classifier,
    train_cell_role_svm,
    train_table_classifier,
)
from .merge import covered_cells, merged_text, overlay_merged_cells, overlay_writes
from .quality import (
    classification_report,
    columns_with_nulls,
    confusion_counts,
    dataset_profile,
    schema_diff,
)
from .shape import (
    cell_predictions,
    drop_columns,
    feature_columns,
    features_by_prefix,
    fill_missing,
    in_cell_order,
    in_page_order,
    preview,
    table_predictions,
)
from .skew import hot_groups, split_hot
from .tables import summarize_tables, table_content, table_counts, table_entities
from .text_features import (
    corpus_stats,
    english_stop_words,
    fit_tfidf,
    tfidf_model,
    tokens,
    top_terms,
    transform_tfidf,
    vector_columns,
    weights_long,
)
from .titles import attach_page_title, best_titles, layout_titles, mark_best_titles
