"""Compare two releases of a genome annotation on Spark.

Annotations are plain DataFrames (:class:`annodelta.annotation.Annotation`); every
operator is a function from DataFrames to a DataFrame, so Catalyst sees the whole plan.
"""

from annodelta.annotation import Annotation
from annodelta.session import build_session

__all__ = ["Annotation", "build_session"]
__version__ = "0.1.0"
