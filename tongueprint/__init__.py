"""Language-identification analytics as Spark jobs.

Corpora are DataFrames ``(row_id, sentence, lang, ...)`` with ISO-639-3 labels; models, metrics
and runs are DataFrames too, so every step is a plan Spark can partition.
"""

from tongueprint.sources.codes import CodeTable
from tongueprint.session import get_session

__all__ = ["CodeTable", "get_session"]
