"""The nested schema inventory as flat frames.

The inventory describes stores, tables, columns and references. It is metadata:
its size follows the number of declared tables, never the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN = (
    "struct<name:string,type:string,notnull:boolean,is_pk:boolean,pk_position:int,"
    "default_value:string,is_generated:boolean,generation_type:string>"
)
REFERENCE = (
    "struct<id:int,from_columns:array<string>,target_table:string,to_columns:array<string>,"
    "on_update:string,on_delete:string,is_composite:boolean>"
)
UNIQUE = "struct<name:string,columns:array<string>,partial:boolean>"
INDEX = (
    "struct<name:string,columns:array<string>,unique:boolean,partial:boolean,predicate:string,"
    "sql:string>"
)
TABLE = (
    f"struct<name:string,group:string,group_title:string,is_strict:boolean,"
    f"primary_key:array<string>,columns:array<{COLUMN}>,foreign_keys:array<{REFERENCE}>,"
    f"unique_constraints:array<{UNIQUE}>,indexes:array<{INDEX}>>"
)
LOGICAL = (
    "struct<id:string,source_store:string,source_table:string,source_columns:array<string>,"
    "target_store:string,target_table:string,target_columns:array<string>,description:string,"
    "is_derivation:boolean>"
)
INVENTORY = (
    f"profile string, stores map<string,struct<title:string,db_filename:string,"
    f"schema_version:int,ddl_sha256:string,tables:map<string,{TABLE}>>>, "
    f"logical_dependencies array<{LOGICAL}>"
)

# The three declared column types.
SPARK_TYPES = {"text": T.StringType(), "integer": T.LongType(), "blob": T.BinaryType()}


@dataclass
class Inventory:
    tables: DataFrame
    columns: DataFrame
    references: DataFrame
    uniques: DataFrame
    indexes: DataFrame
    logical: DataFrame

    def schema_of(self, store: str, table: str) -> T.StructType:
        """Declared schema of one table, for readers that take no inferred one."""
        rows = (
            self.columns.filter((F.col("store") == store) & (F.col("table") == table))
            .orderBy("position")
            .select("name", "type", "notnull")
            .collect()
        )
        if not rows:
            raise ValueError(f"No table {store}.{table} in the inventory")
        return T.StructType(
            [T.StructField(r["name"], SPARK_TYPES[r["type"].lower()], not r["notnull"]) for r in rows]
        )


def read_inventory(spark: SparkSession, path: str) -> Inventory:
    """Load an inventory file. Any profile but the normal one is refused."""
    raw = spark.read.schema(INVENTORY).option("multiLine", "true").json(path)
    profile = F.coalesce("profile", F.lit("normal"))
    if not raw.filter(profile != "normal").isEmpty():
        raise ValueError("The inventory must have the normal profile")
    stores = raw.select(F.explode("stores").alias("store", "s"))
    tables = stores.select("store", F.explode("s.tables").alias("table", "t"))
    keys = tables.select(
        "store", "table", F.col("t.primary_key").alias("primary_key")
    )
    refs = (
        tables.select("store", "table", F.explode("t.foreign_keys").alias("f"))
        .select("store", "table", "f.*")
        .join(
            keys.select("store", F.col("table").alias("target_table"), F.col("primary_key").alias("_pk")),
            ["store", "target_table"],
            "left",
        )
        # A parent named without columns means its whole primary key.
        .withColumn(
            "to_columns",
            F.when(F.forall("to_columns", lambda c: c.isNull()), F.col("_pk")).otherwise(F.col("to_columns")),
        )
        .select(
            "store", "table", "id", "from_columns", "target_table", "to_columns", "on_update", "on_delete",
            (F.size("from_columns") > 1).alias("is_composite"),
        )
    )
    return Inventory(
        tables=tables.select(
            "store", "table", F.col("t.group").alias("group"), F.col("t.group_title").alias("group_title"),
            F.col("t.primary_key").alias("primary_key"), F.col("t.is_strict").alias("is_strict"),
            F.col("t.columns.name").alias("column_names"),
        ),
        columns=tables.select("store", "table", F.posexplode("t.columns").alias("position", "c")).select(
            "store", "table", "position", "c.*"
        ),
        references=refs,
        uniques=tables.select("store", "table", F.explode("t.unique_constraints").alias("u")).select(
            "store", "table", "u.*"
        ),
        indexes=tables.select("store", "table", F.explode("t.indexes").alias("i")).select(
            "store", "table", "i.*"
        ),
        logical=raw.select(F.explode("logical_dependencies").alias("l")).select("l.*"),
    )


def store_totals(inv: Inventory) -> DataFrame:
    """Tables, columns, key columns and references per store."""
    tables = inv.tables.groupBy("store").agg(F.count("*").alias("n_tables"))
    columns = inv.columns.groupBy("store").agg(
        F.count("*").alias("n_columns"), F.count_if(F.col("is_pk")).alias("n_key_columns")
    )
    refs = inv.references.groupBy("store").agg(
        F.count("*").alias("n_references"), F.count_if("is_composite").alias("n_composite")
    )
    return (
        tables.join(columns, "store", "left").join(refs, "store", "left").na.fill(0).orderBy("store")
    )


def declared_cardinality(inv: Inventory) -> DataFrame:
    """Each reference with what its declaration allows on either side.

    The parent side is exactly one when every reference column is not null. The
    child side is at most one when the columns are the primary key or an
    unconditional unique set, in the same order.
    """
    facts = inv.references.alias("r")
    notnull = inv.columns.groupBy("store", "table").agg(
        F.array_agg(F.when(F.col("notnull"), F.col("name"))).alias("_notnull")
    )
    sets = (
        inv.uniques.filter(~F.coalesce("partial", F.lit(False)))
        .groupBy("store", "table")
        .agg(F.array_agg("columns").alias("_sets"))
    )
    keys = inv.tables.select("store", "table", "primary_key")
    return (
        facts.join(notnull, ["store", "table"], "left")
        .join(sets, ["store", "table"], "left")
        .join(keys, ["store", "table"], "left")
        .select(
            "store", "table", "id", "from_columns", "target_table", "to_columns",
            F.when(F.size(F.array_except("from_columns", "_notnull")) == 0, "exactly one")
            .otherwise("zero or one")
            .alias("parent_side"),
            F.when(
                (F.col("from_columns") == F.col("primary_key"))
                | F.array_contains(F.coalesce("_sets", F.array().cast("array<array<string>>")), F.col("from_columns")),
                "zero or one",
            )
            .otherwise("many")
            .alias("child_side"),
        )
    )
