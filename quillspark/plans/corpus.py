"""A structured corpus made of the relational tables: one markdown document per customer, a section per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import structure as S
from quillspark.functions import text as T
from quillspark.session import table


def _path(number, year):
    return F.concat(F.lit("CUS/"), year, F.lit("/CUS-"), T.padded(number), F.lit("-"), year, F.lit(".md"))


def corpus(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """(path, type, number, year, summary, nation, balance, text); of the customers in `chosen` (c_custkey) only, if given."""
    customers, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    if chosen is not None:
        customers = customers.join(chosen, "c_custkey", "left_semi")
        orders = orders.join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    row = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), money("l_quantity"), F.lit(" | "), money("l_extendedprice"), F.lit(" |"))
    lines = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", row.alias("r")))), lambda s: s["r"]), "\n").alias("rows"))
    orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    section = F.concat_ws(
        "\n", F.concat(F.lit("## ANEXO "), key), F.concat(F.lit("Art. "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" Priority "), "o_orderpriority", F.lit(" with status "), "o_orderstatus", F.lit(".")),
        F.when(F.col("o_orderkey") % 7 == 0, "(transcricao)"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Anexo OCR "), key)), F.lit("| line | qty | price |\n| --- | --- | --- |"), F.col("rows"),
    )
    per = orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", section.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    docs = customers.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    number, year = F.col("c_custkey").cast("string"), F.coalesce("y", F.lit(1992)).cast("string")
    return docs.select(_path(number, year).alias("path"), F.col("c_mktsegment").alias("type"), number.alias("number"), year.alias("year"), F.col("c_name").alias("summary"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("balance"), F.concat_ws("\n", F.concat(F.lit("# Customer "), number), "body").alias("text"))


def blocks(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """The corpus by structural blocks, with chunk numbers."""
    rows = corpus(spark, sf_dir, chosen).withColumn("bs", S.blocks(F.col("text"))).select("*", F.posexplode("bs").alias("n", "b"))
    return rows.withColumns({"chunk": F.col("n") + 1, "total_chunks": F.size("bs"), "text": F.col("b")}).drop("n", "b", "bs")


def _quality(rows: DataFrame) -> DataFrame:
    return rows.withColumn("quality", S.source_quality(F.col("text"), F.lit(""), F.lit(None).cast("string")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their source class."""
    return _quality(blocks(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """A ranked list of chunks for each nation: those of its richest customers first.

    Every customer has a chunk or more, so only a nation's first k customers can matter: they are ranked by their keys, and
    texts are built for them alone.
    """
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"))
    named = table(spark, sf_dir, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left")
    path = _path(F.col("c_custkey").cast("string"), F.coalesce("y", F.lit(1992)).cast("string"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), path))
    chosen = named.withColumn("n", place).where(F.col("n") <= k).select("c_custkey")
    rows = blocks(spark, sf_dir, chosen).withColumnRenamed("nation", "query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("balance"), "path", "chunk"))).where(F.col("rank") <= k)
    number = F.col("number").cast("long")
    return _quality(rows).withColumns({"priority": number % 11 == 0, "source_id": T.source_id(F.col("type"), F.col("number"), F.col("year")), "key": T.chunk_key(F.col("path"), F.col("chunk"))})
