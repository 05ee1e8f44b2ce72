"""contentfit: content-to-search fit analytics as Spark DataFrame jobs.

Pages become typed text sections, sections are scored against priority
queries and intents, promising pairs are rewritten by ordered rule packs or
by choosing among supplied candidate texts, and the change is reported.
"""

from contentfit.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
