from .ingest import batch_cells, stream_blocks, write_stream
from .notifications import decode_notifications, first_notifications, follow_jobs, match_notifications
from .responses import complete_responses, stream_responses
