"""SQL access: result tables as views of the session, functions to use in SQL, statements with bound parameters.

    publish(spark, accounts=typed_accounts(...), mails=mails)
    ask(spark, "SELECT m.id, a.plan_name FROM mails m, LATERAL account_of(m.sender) a WHERE a.plan_price >= :least", least=10)

Everything stays a lazy plan: a view is the DataFrame's plan, a SQL function is inlined into the statement and planned with it (the lateral
call above becomes a join), and a parameter is bound as a literal, so it reaches the scan as a pushed filter and is never
text of a statement. `split_text` cuts the texts of a table argument into pieces; the rows of the table are dealt as its PARTITION BY says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from deskspark.operators.chunking import SEPARATORS, pieces

#: Signature and body of each function; account_of needs the view `accounts`.
FUNCTIONS = {
    "days_until": "(day TIMESTAMP_NTZ, now TIMESTAMP_NTZ) RETURNS BIGINT RETURN "
                  "floor((unix_micros(cast(day AS TIMESTAMP)) - unix_micros(cast(now AS TIMESTAMP))) / 86400000000)",
    "score_band": "(score DOUBLE) RETURNS STRING RETURN CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'middle' "
                  "WHEN score IS NOT NULL THEN 'low' END",
}
TABLE_FUNCTIONS = {
    "account_of": "(address STRING) RETURNS TABLE (customer_id STRING, name STRING, plan_name STRING, plan_price DOUBLE, "
                  "next_billing_date TIMESTAMP_NTZ) RETURN SELECT customer_id, name, plan_name, cast(plan_price AS DOUBLE), "
                  "cast(next_billing_date AS TIMESTAMP_NTZ) FROM accounts WHERE accounts.email = account_of.address",
}


class SplitText:
    """split_text(TABLE(t) PARTITION BY (key), 'column', size, overlap): the other columns, piece number and piece."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.names:
            raise ValueError("split_text needs a table and the name of one of its columns")
        if not 0 <= overlap.value < size.value:
            raise ValueError("split_text needs 0 <= overlap < size")
        rest = [f for f in rows.dataType.fields if f.name != column.value]
        return AnalyzeResult(T.StructType([*rest, T.StructField("piece", T.IntegerType()), T.StructField(column.value, T.StringType())]))

    def eval(self, row: T.Row, column: str, size: int, overlap: int) -> Iterator[tuple]:
        rest = [v for n, v in zip(row.__fields__, row) if n != column]
        for i, text in enumerate(pieces(row[column], size, overlap, SEPARATORS)):
            yield (*rest, i, text)


def publish(spark: SparkSession, **views: DataFrame) -> None:
    """Make the frames views of their names, and the functions known to the session's SQL."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    if spark.catalog.tableExists("accounts"):
        for name, body in TABLE_FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    from pyspark.sql.functions import udtf

    spark.udtf.register("split_text", udtf(SplitText))


def ask(spark: SparkSession, statement: str, **parameters: object) -> DataFrame:
    """The result of a statement with :name parameters."""
    return spark.sql(statement, args=parameters)
