from contentfit.streaming.pages_stream import (  # noqa: F401
    pages_stream, score_batch, start_section_scoring,
)
