"""Fixture views over the driver's tables, in two forms from one place.

Each fixture has a Spark builder (DataFrame API, what the library runs) and the equivalent
DuckDB SQL text used by the oracle. They map the reference's customer tables onto the
TPC-H-like test tables (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.operators.packs import SOURCE_COLUMNS
from contactlift.session import reliable_checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A task widens so many narrow rows.
SPREAD_ROWS = 16384


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly to the tasks that widen them. A column of keys is so small in its file that one task would read
    and widen it all; a table of few rows stays as it is, and there are no more tasks than the cluster runs at a time. The dealt
    rows are kept, as a job reads them about ten times and each time one task would read and deal them all."""
    tasks = min(-(-df.count() // SPREAD_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return reliable_checkpoint(df.repartition(tasks)) if tasks > 1 else df


# --- f_scored: (id, grp, prob, target) -------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str, multiplier: int = 7919) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        (((F.col("o_orderkey") * multiplier) % 1000).cast("double") / F.lit(10000)).alias("prob"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("target"),
    )


def scored_sql(multiplier: int = 7919) -> str:
    return f"""select o_orderkey as id, o_orderpriority as grp,
       cast((o_orderkey * {multiplier}) % 1000 as double) / 10000 as prob,
       case when o_orderstatus = 'F' then 1 else 0 end as target
from orders"""


# --- f_cards: two-card customer table ---------------------------------------------------------

def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    f = F.col("o_orderstatus") == "F"
    op = F.col("o_orderstatus") == "O"
    price = F.col("o_totalprice")
    # aggregate orders per customer before the join: the shuffle moves one row per customer
    # prices have two decimals: rounding a sum to 2 places gives the exact decimal sum, the same in
    # every engine whatever the summation order
    per_cust = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum(F.when(f, price)), 2).alias("Master_msaldototal"),
        F.count(F.when(f, 1)).alias("Master_tconsumos"),
        F.max(F.when(f, price)).alias("Master_mlimitecompra"),
        F.min(F.when(f, price)).alias("Master_mpagominimo"),
        F.round(F.sum(F.when(op, price)), 2).alias("Visa_msaldototal"),
        F.count(F.when(op, 1)).alias("Visa_tconsumos"),
        F.max(F.when(op, price)).alias("Visa_mlimitecompra"),
        F.min(F.when(op, price)).alias("Visa_mpagominimo"),
    )
    j = c.select("c_custkey", "c_acctbal").join(per_cust, "c_custkey", "left")
    return j.select(
        F.col("c_custkey").alias("id_cliente"),
        F.when(F.col("c_acctbal") < 0, F.lit("SI")).otherwise(F.lit("NO")).alias("clase"),
        "Master_msaldototal",
        F.coalesce(F.col("Master_tconsumos"), F.lit(0)).alias("Master_tconsumos"),
        "Master_mlimitecompra", "Master_mpagominimo", "Visa_msaldototal",
        F.coalesce(F.col("Visa_tconsumos"), F.lit(0)).alias("Visa_tconsumos"),
        "Visa_mlimitecompra", "Visa_mpagominimo",
    )


CARDS_SQL = """select c_custkey as id_cliente,
       case when max(c_acctbal) < 0 then 'SI' else 'NO' end as clase,
       round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as Master_msaldototal,
       count(case when o_orderstatus = 'F' then 1 end)          as Master_tconsumos,
       max(case when o_orderstatus = 'F' then o_totalprice end) as Master_mlimitecompra,
       min(case when o_orderstatus = 'F' then o_totalprice end) as Master_mpagominimo,
       round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as Visa_msaldototal,
       count(case when o_orderstatus = 'O' then 1 end)          as Visa_tconsumos,
       max(case when o_orderstatus = 'O' then o_totalprice end) as Visa_mlimitecompra,
       min(case when o_orderstatus = 'O' then o_totalprice end) as Visa_mpagominimo
from customer left join orders on c_custkey = o_custkey
group by c_custkey"""


# --- f_wide: all 139 feature inputs, values from the key --------------------------------------

def _wide_exprs() -> list[str]:
    return [f"case when (c_custkey + {j}) % 7 = 0 or c_custkey % 13 = 0 then null "
            f"else cast((c_custkey * 31 + {j} * 17) % 50 as double) end as `{name}`"
            for j, name in enumerate(SOURCE_COLUMNS)]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.selectExpr("c_custkey as id_cliente", *_wide_exprs())


def wide_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wide`` plus the class of ``cards`` (negative balance = 'SI'), both read from ``customer``."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    return c.selectExpr("c_custkey as id_cliente", "case when c_acctbal < 0 then 'SI' else 'NO' end as clase",
                        *_wide_exprs())


def wide_sql() -> str:
    parts = ["c_custkey as id_cliente"]
    for j, name in enumerate(SOURCE_COLUMNS):
        parts.append(
            f"case when (c_custkey + {j}) % 7 = 0 or c_custkey % 13 = 0 then null "
            f'else cast((c_custkey * 31 + {j} * 17) % 50 as double) end as "{name}"'
        )
    return "select " + ",\n       ".join(parts) + "\nfrom customer"


# --- f_snapshot: months and dates ---------------------------------------------------------------

def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.select(
        F.col("o_custkey").alias("numero_de_cliente"),
        F.col("o_orderkey"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("foto_mes"),
        (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.dayofmonth("l_shipdate")).alias("fecha"),
    )


SNAPSHOT_SQL = """select o_custkey as numero_de_cliente, o_orderkey,
       cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) as foto_mes,
       cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as integer) as fecha
from orders join lineitem on l_orderkey = o_orderkey"""


# --- f_cvlog: long CV log (seed, iter, fold, profit) ----------------------------------------------

def cvlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("seed"),
        (F.col("event_id") % 60).alias("iter"),
        F.floor((F.col("event_id") % 300) / 60).cast("int").alias("fold"),
        F.col("value").alias("profit"),
    )


CVLOG_SQL = """select user_id % 5 as seed, event_id % 60 as iter,
       cast(floor((event_id % 300) / 60) as int) as fold, value as profit
from events"""


# --- f_vectors: embeddings as a model table (FIXTURES 2.7) ---------------------------------------

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_cliente = vec_id, embedding array, clase01 = label is 0)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id_cliente"), "embedding",
                    (F.col("label") == 0).cast("int").alias("clase01"))


def with_views(sql: str, **views: str) -> str:
    """Prefix ``sql`` with ``with name as (...)`` for each fixture view it reads."""
    if not views:
        return sql
    ctes = ",\n".join(f"{name} as (\n{body}\n)" for name, body in views.items())
    head = sql.lstrip()
    if head[:5].lower() == "with ":
        return f"with {ctes},\n{head[5:]}"
    return f"with {ctes}\n{sql}"
