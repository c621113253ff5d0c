"""Declared schemas of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.functions.casts import safe_int

INTEGER_TYPES = (T.ByteType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class DumpTable:
    """One file of a forum dump: its name, its columns and the columns defaulting to 0."""

    file_name: str
    table: str
    schema: T.StructType
    zero_default: frozenset[str] = frozenset()

    def attribute_schema(self) -> T.StructType:
        """The same columns as text, which is how XML attributes arrive."""
        return T.StructType([T.StructField("_" + f.name, T.StringType()) for f in self.schema])

    def typed(self, attributes: DataFrame) -> DataFrame:
        """Typed columns from a frame of text attributes named ``_<column>``."""
        return attributes.select(*[self._column(f) for f in self.schema])

    def _column(self, field: T.StructField) -> Column:
        raw = F.col("_" + field.name)
        if isinstance(field.dataType, INTEGER_TYPES):
            default = 0 if field.name in self.zero_default else None
            raw = safe_int(raw, field.dataType.simpleString(), default)
        return raw.alias(field.name)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LONG, INT, BYTE, TEXT = T.LongType(), T.IntegerType(), T.ByteType(), T.StringType()

POSTS = DumpTable(
    "Posts.xml",
    "posts",
    _struct(
        Id=LONG, PostTypeId=BYTE, ParentId=LONG, Body=TEXT, Title=TEXT, Tags=TEXT, CreationDate=TEXT,
        Score=INT, AnswerCount=INT, ViewCount=INT,
    ),
    frozenset({"PostTypeId", "Score", "AnswerCount", "ViewCount"}),
)
COMMENTS = DumpTable(
    "Comments.xml",
    "comments",
    _struct(Id=LONG, PostId=LONG, Text=TEXT, CreationDate=TEXT, Score=INT),
    frozenset({"Score"}),
)
TAGS = DumpTable(
    "Tags.xml",
    "tags",
    _struct(Id=INT, TagName=TEXT, Count=INT),
    frozenset({"Count"}),
)
DUMP_TABLES = (POSTS, COMMENTS, TAGS)


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns and types of ``schema``; a value that does not fit fails the job."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
