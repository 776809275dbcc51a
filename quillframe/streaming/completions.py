"""An optional extension: completions that arrive as files become lines and running month sums. The batch operators are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillframe.functions import exprs as x
from quillframe.operators import semistructured


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """(doc_id, completion) of JSON lines {doc_id, completion} in the files that arrive in a folder."""
    return spark.readStream.schema("doc_id string, completion string").option("maxFilesPerTrigger", files_a_batch).json(path)


def sales(stream: DataFrame) -> DataFrame:
    """(doc_id, code_produit, month, quantity) of each sale, without state; quantities of a month are not summed yet."""
    raw = stream.select("doc_id", semistructured.completion(F.col("completion")).alias("v"))
    products = semistructured.elements(raw, semistructured.items(F.col("v"), "$.products"), ["doc_id"], "product", "line_no")
    products = products.select("doc_id", x.code_digits(semistructured.as_text(F.col("product"), "$.code_produit")).alias("code_produit"), "product").filter(x.is_code(F.col("code_produit")))
    found = semistructured.elements(products, semistructured.items(F.col("product"), "$.sales"), ["doc_id", "code_produit"], "sale", "sale_no")
    out = found.select("doc_id", "code_produit", x.month_prefix(semistructured.as_text(F.col("sale"), "$.month")).alias("month"), x.truncated(semistructured.as_text(F.col("sale"), "$.quantity")).alias("quantity"))
    return out.filter("month is not null and quantity is not null")


def month_totals(stream: DataFrame) -> DataFrame:
    """(code_produit, month, quantity) over all that has arrived: state grows with products and months only."""
    return sales(stream).groupBy("code_produit", "month").agg(F.sum("quantity").alias("quantity"))


def write_sales(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sales appended as Parquet by month, each file taken once; the caller stops or awaits the query."""
    return sales(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("month").outputMode("append").trigger(availableNow=True).start()
