"""Mail-shaped views over the given tables, in Spark and as SQL fragments.

Sources hold no mail headers, so sender, ids and times are derived from keys by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.session import spread

CTES = {
    "mails": r"""mails AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id,
    CASE doc_id % 5
      WHEN 0 THEN 'User ' || (doc_id % 97) || ' <user' || (doc_id % 97) || '@' || source || '.example.com>'
      WHEN 1 THEN 'user' || (doc_id % 97) || '@' || source || '.example.com'
      WHEN 2 THEN 'via list: user' || (doc_id % 97) || '@' || source || '.example.com (bulk)'
      WHEN 3 THEN 'noreply@' || source || '.example.com'
      ELSE 'desk ' || source END AS sender_raw,
    'user' || (doc_id % 97) || '.' || lang || '_x@' || source || '.example.com' AS sender,
    substr(string_split(text, chr(10))[1], 1, 60) AS subject, text AS body,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS received_at, lang, source
  FROM documents)""",
    "msgs": r"""msgs AS (
  SELECT conv_id, turn, role, text, CAST(conv_id AS VARCHAR) AS thread_id,
    CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS id,
    CASE role WHEN 'user' THEN ' <' || conv_id || '.' || turn || '@mail.example.com> '
              WHEN 'assistant' THEN conv_id || '.' || turn || '@desk.example.com'
              ELSE '<<' || conv_id || '.' || turn || '@sys.example.com' END AS raw_id
  FROM conversations)""",
    "drafts": r"""drafts AS (
  SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS id, conv_id, turn,
    CASE conv_id % 3 WHEN 0 THEN 'Dear customer,' || chr(10) WHEN 1 THEN 'Hi,' || chr(10) ELSE '' END
    || CASE WHEN conv_id % 7 = 0 THEN 'We forward this to a specialist. ' ELSE '' END
    || CASE WHEN turn % 3 = 1 THEN 'Thank you for writing. ' ELSE '' END
    || text
    || CASE WHEN conv_id % 11 = 3 THEN ' [TODO fill in]' ELSE '' END
    || CASE WHEN conv_id % 13 = 5 THEN ' Call 555-123-4567 now.' ELSE '' END
    || CASE WHEN conv_id % 17 = 2 THEN ' Card 4111-1111-1111-1111 and 123-45-6789.' ELSE '' END
    || CASE WHEN conv_id % 5 = 4 THEN ' This is stupid and useless.' ELSE '' END
    || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Hope you have a great day!' ELSE '' END
    || CASE WHEN turn % 4 = 0 THEN chr(10) || 'Best regards,' || chr(10) || 'Sam' ELSE '' END AS reply,
    text
  FROM conversations)""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n"


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails_of(table(spark, sf_dir, "documents"))


def mails_of(d: DataFrame) -> DataFrame:
    user = F.concat(F.lit("user"), F.col("doc_id") % 97)
    host = F.concat(F.col("source"), F.lit(".example.com"))
    address = F.concat(user, F.lit("@"), host)
    kind = F.col("doc_id") % 5
    sender_raw = (
        F.when(kind == 0, F.concat(F.lit("User "), F.col("doc_id") % 97, F.lit(" <"), address, F.lit(">")))
        .when(kind == 1, address)
        .when(kind == 2, F.concat(F.lit("via list: "), address, F.lit(" (bulk)")))
        .when(kind == 3, F.concat(F.lit("noreply@"), host))
        .otherwise(F.concat(F.lit("desk "), F.col("source")))
    )
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        sender_raw.alias("sender_raw"),
        F.concat(user, F.lit("."), F.col("lang"), F.lit("_x@"), host).alias("sender"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("subject"),
        F.col("text").alias("body"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
         ).alias("received_at"),
        "lang", "source",
    )


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    mid = F.concat(F.col("conv_id"), F.lit("."), F.col("turn"))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit(" <"), mid, F.lit("@mail.example.com> ")))
        .when(F.col("role") == "assistant", F.concat(mid, F.lit("@desk.example.com")))
        .otherwise(F.concat(F.lit("<<"), mid, F.lit("@sys.example.com")))
    )
    return c.select(
        "conv_id", "turn", "role", "text", F.col("conv_id").cast("string").alias("thread_id"),
        mid.alias("id"), raw.alias("raw_id"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply drafts: message texts with the wordings that quality rules look for."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")

    def add(cond, text):
        return F.when(cond, F.lit(text)).otherwise(F.lit(""))

    reply = F.concat(
        F.when(conv % 3 == 0, F.lit("Dear customer,\n")).when(conv % 3 == 1, F.lit("Hi,\n")).otherwise(F.lit("")),
        add(conv % 7 == 0, "We forward this to a specialist. "),
        add(turn % 3 == 1, "Thank you for writing. "),
        F.col("text"),
        add(conv % 11 == 3, " [TODO fill in]"),
        add(conv % 13 == 5, " Call 555-123-4567 now."),
        add(conv % 17 == 2, " Card 4111-1111-1111-1111 and 123-45-6789."),
        add(conv % 5 == 4, " This is stupid and useless."),
        add(turn % 2 == 0, "\n\nHope you have a great day!"),
        add(turn % 4 == 0, "\nBest regards,\nSam"),
    )
    return c.select(
        F.concat(conv, F.lit("."), turn).alias("id"), "conv_id", "turn", reply.alias("reply"), "text"
    )


def values_list(terms) -> str:
    """SQL list literal of strings."""
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def any_contains(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
