"""The driver's tables seen as logs, so that every operator has data: once in Spark, once in SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timeops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, timestamp, user, pc, kind, value, k, and the calendar."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("PC-"), (k % 20).cast("string")).alias("pc"), F.col("event_type").alias("kind"), "value", k.alias("k"),
    )
    return timeops.calendar(raw)


def of_kinds(df: DataFrame, names: dict[str, str]) -> DataFrame:
    activity = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.where(F.col("kind").isin(*names)).withColumn("activity", activity[F.col("kind")])


def logon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kinds(events(spark, sf_dir), {"view": "Logon", "click": "Logoff"})


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kinds(events(spark, sf_dir), {"signup": "Connect", "error": "Disconnect"})


def file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as file events: folder by k, extension and operation by id, size by value."""
    extension = F.element_at(F.array(*map(F.lit, ("doc", "PDF", "zip", "exe"))), (F.col("id") % 4 + 1).cast("int"))
    folder = F.when(F.col("k") < 20, "R:\\").when(F.col("k") < 40, "C:\\Windows\\").otherwise("C:\\Users\\")
    operation = F.element_at(F.array(*map(F.lit, ("Write", "copy", "delete", "open"))), (F.col("k") % 4 + 1).cast("int"))
    return (
        events(spark, sf_dir).where("kind = 'purchase'")
        .withColumn("filename", F.concat(folder, F.lit("f"), F.col("k").cast("string"), F.lit("."), extension))
        .withColumns({"is_removable": text.is_removable(F.col("filename")), "file_extension": text.file_extension(F.col("filename")), "operation_type": operation, "size": F.col("value") * 100_000})
    )


def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request for a page: of all pages in turn (their ids count from 0)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.broadcast(pages.agg(F.count(F.lit(1)).alias("pages")))  # one row
    asked = events(spark, sf_dir).crossJoin(number).withColumn("page_id", F.col("id") % F.col("pages")).drop("pages").join(pages, "page_id")
    return asked.withColumns({"domain": text.url_domain(F.col("url")), "url_path": text.url_path(F.col("url"))})


def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mail: from the customer, to addresses by key, size by price."""
    c = F.col
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    inside = F.when(c("c_nationkey") % 2 == 0, "@dtaa.com").otherwise(F.concat(F.lit("@Mail"), c("c_nationkey").cast("string"), F.lit(".example.com")))
    to = F.concat(
        F.lit("a"), (c("o_orderkey") % 7).cast("string"), F.lit("@dtaa.com"),
        F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("; b"), (c("o_orderkey") % 11).cast("string"), F.lit("@x.example.org;"))).otherwise(F.lit("")),
    )
    mail = (
        table(spark, sf_dir, "orders").join(customers, c("o_custkey") == c("c_custkey"))
        .select(
            c("o_orderkey").alias("id"), c("o_orderdate").cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("user"),
            to.alias("to"), F.when(c("o_orderkey") % 5 == 0, to).alias("cc"), F.concat(F.lit("c"), c("o_custkey").cast("string"), inside).alias("from"),
            F.floor("o_totalprice").alias("size"), (c("o_orderkey") % 4).alias("attachments"),
        )
    )
    mail = mail.withColumns(
        {
            "sender_domain": text.sender_domain(c("from")), "is_internal_sender": text.is_internal(c("from")), "has_attachments": c("attachments") > 0,
            "has_external_recipient": text.has_external_recipient(c("to")), "to_count": text.recipient_count(c("to")).cast("long"),
            "cc_count": F.coalesce(text.recipient_count(c("cc")), F.lit(0)).cast("long"),
        }
    )
    return timeops.calendar(mail)


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month in which a customer ordered, as a snapshot of that employee."""
    c = F.col
    months = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("snapshot_month"), (c("o_orderkey") % 6).cast("int").alias("n"))
    months = months.groupBy("c_custkey", "snapshot_month").agg(F.max("n").alias("n"))
    roles = F.array(*map(F.lit, ("ITAdmin", "Manager", "Engineer", "Analyst", "Salesman", "Specialist")))
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).join(months, "c_custkey")
        .select(
            F.concat(F.lit("C"), c("c_custkey").cast("string")).alias("user"), "snapshot_month", F.element_at(roles, c("n") + 1).alias("role"),
            c("n_name").alias("department"), c("c_mktsegment").alias("team"),
        )
    )


def psychometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    trait = lambda m: (c("p_partkey") * m % 51).alias
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("user"), trait(7)("O"), trait(11)("C"), trait(13)("E"), trait(17)("A"), trait(19)("N"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user with errors of value over 90, the days from the first to the last."""
    bad = events(spark, sf_dir).where("kind = 'error' AND value > 90")
    return bad.groupBy("user").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.max(F.col("k") % 3 + 1).alias("scenario"))


#: The same views for DuckDB, as common table expressions; each needs those before it.
CTES = {
    "ev": r"""ev AS (SELECT event_id AS id, ts AS timestamp, 'U' || user_id AS "user", 'PC-' || (CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 20) AS pc, event_type AS kind, value,
  CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(ts AS DATE) AS date, isodow(ts) >= 6 AS weekend,
  NOT (hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) <= 5) AS after_hours FROM events)""",
    "logon": "logon AS (SELECT *, CASE kind WHEN 'view' THEN 'Logon' ELSE 'Logoff' END AS activity FROM ev WHERE kind IN ('view', 'click'))",
    "device": "device AS (SELECT *, CASE kind WHEN 'signup' THEN 'Connect' ELSE 'Disconnect' END AS activity FROM ev WHERE kind IN ('signup', 'error'))",
    "file": r"""file AS (SELECT *, list_extract(['Write', 'copy', 'delete', 'open'], k % 4 + 1) AS operation_type, k < 20 AS is_removable,
  list_extract(['doc', 'pdf', 'zip', 'exe'], CAST(id % 4 + 1 AS INTEGER)) AS file_extension, value * 100000 AS size,
  CASE WHEN k < 20 THEN 'R:\' WHEN k < 40 THEN 'C:\Windows\' ELSE 'C:\Users\' END || 'f' || k || '.' || list_extract(['doc', 'PDF', 'zip', 'exe'], CAST(id % 4 + 1 AS INTEGER)) AS filename
  FROM ev WHERE kind = 'purchase')""",
    "http": "http AS (SELECT ev.*, url, lower(nullif(regexp_extract(url, '^https?://([^/]+)', 1), '')) AS domain FROM ev JOIN pages ON id % (SELECT count(*) FROM pages) = page_id)",
    "mail": r"""mail AS (SELECT *, to_ AS "to", CASE WHEN id % 5 = 0 THEN to_ END AS cc, lower(nullif(regexp_extract(from_, '@([a-zA-Z0-9.-]+)$', 1), '')) AS sender_domain, contains(from_, 'dtaa.com') AS internal,
  id % 3 = 0 AS external, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS to_count, CASE WHEN id % 5 <> 0 THEN 0 WHEN id % 3 = 0 THEN 2 ELSE 1 END AS cc_count,
  CAST(timestamp AS DATE) AS date, NOT (hour(timestamp) >= 8 AND hour(timestamp) < 18 AND isodow(timestamp) <= 5) AS after_hours
  FROM (SELECT o_orderkey AS id, o_orderdate AS timestamp, 'C' || o_custkey AS "user", 'a' || (o_orderkey % 7) || '@dtaa.com' || CASE WHEN o_orderkey % 3 = 0 THEN '; b' || (o_orderkey % 11) || '@x.example.org;' ELSE '' END AS to_,
    'c' || o_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '@dtaa.com' ELSE '@Mail' || c_nationkey || '.example.com' END AS from_, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 4 AS attachments
    FROM orders JOIN customer ON o_custkey = c_custkey))""",
    "directory": """directory AS (SELECT 'C' || c_custkey AS "user", snapshot_month, list_extract(['ITAdmin', 'Manager', 'Engineer', 'Analyst', 'Salesman', 'Specialist'], n + 1) AS role, n_name AS department, c_mktsegment AS team
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_month, CAST(max(o_orderkey % 6) AS INTEGER) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey)""",
    "psycho": """psycho AS (SELECT 'P' || p_partkey AS "user", p_partkey * 7 % 51 AS O, p_partkey * 11 % 51 AS C, p_partkey * 13 % 51 AS E, p_partkey * 17 % 51 AS A, p_partkey * 19 % 51 AS N FROM part)""",
    "truth": """truth AS (SELECT "user", min(date) AS s, max(date) AS e, max(k % 3 + 1) AS scenario FROM ev WHERE kind = 'error' AND value > 90 GROUP BY 1)""",
}


def with_views(names: str, sql: str) -> str:
    return f"WITH {', '.join(CTES[n] for n in names.split())} {sql}"
