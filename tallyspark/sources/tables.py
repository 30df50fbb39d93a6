"""Named tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "floats": T.ArrayType(T.FloatType()),
}


def _schema(spec: str) -> T.StructType:
    fields = [item.split(":") for item in spec.split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema("r_regionkey:int r_name:string"),
    "nation": _schema("n_nationkey:int n_name:string n_regionkey:int"),
    "customer": _schema(
        "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"
    ),
    "supplier": _schema("s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double"),
    "part": _schema(
        "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double"
    ),
    "orders": _schema(
        "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double "
        "o_orderdate:timestamp o_orderpriority:string"
    ),
    "lineitem": _schema(
        "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
        "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string "
        "l_linestatus:string l_shipdate:timestamp"
    ),
    "events": _schema(
        "event_id:bigint ts:timestamp user_id:bigint event_type:string value:double props:string"
    ),
    "documents": _schema("doc_id:bigint text:string lang:string source:string n_chars:bigint"),
    "embeddings": _schema("vec_id:bigint embedding:floats label:int"),
    "pages": _schema("page_id:bigint url:string html:string"),
    "benchmark": _schema("item_id:bigint text:string"),
    "labels": _schema("doc_id:bigint quality:int toxic:int"),
    "conversations": _schema("conv_id:bigint turn:bigint role:string text:string"),
}


class SchemaMismatch(ValueError):
    """A table lacks a declared column or holds another type there."""


def check_schema(df: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """Keep the declared columns; fail when one is missing or of another type."""
    actual = {field.name: field.dataType.simpleString() for field in df.schema}
    wrong = []
    for field in expected:
        found = actual.get(field.name)
        if found != field.dataType.simpleString():
            wrong.append(f"{field.name}: expected {field.dataType.simpleString()}, found {found}")
    if wrong:
        raise SchemaMismatch(f"{name}: " + "; ".join(wrong))
    return df.select(*expected.fieldNames())


def load(
    spark: SparkSession,
    directory: str | None,
    name: str,
    *,
    schema: T.StructType | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """A named table checked against its declared schema.

    From Parquet under ``directory``; from the catalog when ``directory`` is
    None (``name`` may have two parts); from a database when ``jdbc`` holds
    the options of Spark's JDBC source. Give ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` there for a parallel
    read of a large table.
    """
    if jdbc is not None:
        df = spark.read.format("jdbc").options(**{"dbtable": name, **jdbc}).load()
    elif directory is None:
        df = spark.table(name)
    else:
        df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    expected = schema if schema is not None else SCHEMAS.get(name)
    return check_schema(df, expected, name) if expected is not None else df


class Tables:
    """The tables of one data folder, loaded when first named."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = load(self.spark, self.directory, name)
        setattr(self, name, df)
        return df
