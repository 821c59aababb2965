"""Document-table analytics on Spark DataFrames."""

from .functions import *  # noqa: F401,F403
from .operators import *  # noqa: F401,F403
from .plans import Documents, cell_features, prepare_documents, score_cells, score_tables
from .session import RECOMMENDED, configure, cut_lineage, shared_folder
from .sources import *  # noqa: F401,F403
from .streaming import *  # noqa: F401,F403
