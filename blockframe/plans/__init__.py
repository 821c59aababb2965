from .documents import Documents, cell_features, prepare_documents, score_cells, score_tables
