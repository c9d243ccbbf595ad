"""Table functions for Spark SQL, used in lateral joins: chunks, date mentions and entities of a text.

    SELECT d.doc_id, c.* FROM d, LATERAL chunks_of(d.text, size => 400) c

``analyze`` checks the arguments that must be constants when a query is analysed, and gives the columns. A null text has no
rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from recollect.functions import temporal as D
from recollect.functions import text as X


def _constant(argument: AnalyzeArgument | None, name: str, kind: type, default):
    """An argument that all rows share."""
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


def _text(argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, T.StringType | T.NullType):
        raise ValueError("the text must be a string")


@udtf
class ChunksOf:
    """chunks_of(text, size => 800, overlap => 100): chunk_index, content."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text)
        n, m = _constant(size, "size", int, 800), _constant(overlap, "overlap", int, 100)
        if not 0 <= m < n:
            raise ValueError("the overlap must be less than the size")
        return AnalyzeResult(T.StructType().add("chunk_index", T.IntegerType()).add("content", T.StringType()))

    def eval(self, text: str, size: int = 800, overlap: int = 100):
        for k, chunk in enumerate(X.split_chunks(text, size, overlap) if text is not None else ()):
            yield k, chunk


@udtf
class MentionsOf:
    """mentions_of(text, day, language => 'en'): text, kind, resolved, resolved_end, offset of each date mention, seen from a day."""

    @staticmethod
    def analyze(text: AnalyzeArgument, day: AnalyzeArgument, language: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text)
        if not isinstance(day.dataType, T.DateType | T.NullType):
            raise ValueError("the day must be a date")
        if _constant(language, "language", str, "en") not in ("en", "ar"):
            raise ValueError("mentions are found in en and ar")
        return AnalyzeResult(D.MENTION.elementType)

    def eval(self, text: str, day: dt.date, language: str = "en"):
        for m in D.found_mentions(text, day, D.Locale(language=language)) if text is not None else ():
            yield m["text"], m["kind"], m["resolved"], m["resolved_end"], m["offset"]


@udtf
class EntitiesOf:
    """entities_of(text): entity, each once."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        return AnalyzeResult(T.StructType().add("entity", T.StringType()))

    def eval(self, text: str):
        for entity in X.find_entities(text) if text is not None else ():
            yield (entity,)


def register(spark: SparkSession) -> None:
    for name, function in (("chunks_of", ChunksOf), ("mentions_of", MentionsOf), ("entities_of", EntitiesOf)):
        spark.udtf.register(name, function)
