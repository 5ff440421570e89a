"""The one relation, reads, and what a stored set of reads says about itself."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("flag", T.DecimalType(20, 0)),
        T.StructField("s_header", T.StringType()),
        T.StructField("s_seq", T.StringType(), False),
        T.StructField("s_qual", T.StringType()),
        T.StructField("x_header", T.StringType()),
        T.StructField("x_seq", T.StringType()),
        T.StructField("x_qual", T.StringType()),
    ]
)
COLUMNS = READS.fieldNames()
VARIANTS = ("bq", "vbq", "cbq")


@dataclass(frozen=True)
class Meta:
    """Properties of a stored set. variant decides what is kept: bq is of fixed length without qualities and headers."""

    variant: str = "cbq"
    paired: bool = False
    quality: bool = True
    headers: bool = True
    flags: bool = False
    bits: int = 4
    block_size: int = 128 << 10
    level: int = 3
    compressed: bool = True
    slen: int | None = None
    xlen: int | None = None

    def __post_init__(self):
        if self.variant not in VARIANTS:
            raise ValueError(f"unknown variant {self.variant!r}")
        if self.bits not in (2, 4):
            raise ValueError("bits must be 2 or 4")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Meta:
        return Meta(**json.loads(text))

    def with_(self, **changes) -> Meta:
        return replace(self, **changes)


@dataclass
class ReadSet:
    df: DataFrame
    meta: Meta


def conform(df: DataFrame) -> DataFrame:
    """``df`` with all columns of READS, in order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in READS])


def is_paired(df: DataFrame) -> bool:
    """Whether the columns alone say that there are extended reads."""
    return "x_seq" in df.columns
