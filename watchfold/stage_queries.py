"""Registered queries of whole stages: raw CSV through readers and normalisation, graph tables, user matrix, messages, scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .functions import hashing, text
from .operators import graph, labels, people, scoring, sequences, shaping, user_day
from .plans import pipelines
from .registry import SQL, query
from .session import checkpoint_folder
from .sources import adapters as views
from .sources import logs as readers
from .sources import schemas, sinks
from .streaming import live, state

# Raw tables: the given ones written as CSV into the shared folder, and read as any raw log


def us() -> Column:
    return F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss").alias("date")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each raw table by its declared columns. Users are in lower case, so that normalisation shows."""
    c, none = F.col, F.lit(None).cast("string")
    who = [c("id").cast("string").alias("id"), us(), F.lower("user").alias("user")]
    at_pc = [*who, F.lower("pc").alias("pc")]
    person = [c("user").alias("employee_name"), F.lower("user").alias("user_id")]
    return {
        "logon": views.logon(spark, sf_dir).select(*at_pc, "activity"), "device": views.device(spark, sf_dir).select(*at_pc, "activity"),
        "file": views.file(spark, sf_dir).select(*at_pc, "filename", F.concat(F.lit("D0-CF "), F.repeat(F.lit("x"), c("k"))).alias("content")),
        "email": views.email(spark, sf_dir).select(*who, F.lit("pc-1").alias("pc"), "to", "cc", none.alias("bcc"), F.concat(F.lit(" "), c("from")).alias("from"), "size", "attachments", F.lit('said "so", then').alias("content")),
        "http": views.http(spark, sf_dir).select(*at_pc, "url", F.lit("words").alias("content")),
        "ldap": views.directory(spark, sf_dir).select(
            *person, F.concat(F.lit(" "), c("user"), F.lit("@dtaa.com")).alias("email"), "role", none.alias("projects"), none.alias("business_unit"), none.alias("functional_unit"), "department", "team", none.alias("supervisor"),
            F.date_format("snapshot_month", "yyyy-MM").alias("month"),
        ),
        "psychometric": views.psychometric(spark, sf_dir).select(*person, *"OCEAN"),
        "ground_truth": views.intervals(spark, sf_dir).select(
            F.when(c("scenario") < 3, 4.2).otherwise(5.2).alias("dataset"), "scenario", F.lit("r").alias("details"), "user", F.date_format("start", "MM/dd/yyyy HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end")
        ),
    }


def raw_folder(spark: SparkSession, sf_dir: str, *names: str) -> str:
    folder = f"{checkpoint_folder(spark)}/raw-{uuid.uuid4().hex}"
    tables = raw_tables(spark, sf_dir)
    for name in names or tables:
        writer = tables[name].write.option("header", True).option("escape", '"')
        (writer.partitionBy("month").csv(f"{folder}/ldap") if name == "ldap" else writer.csv(f"{folder}/{name}.csv"))
    return folder


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail log as text, in which every seventh line is cut off behind its user, and every eleventh names its size in words."""
    c = F.col
    order = c("id").cast("long")
    whole = F.concat_ws(",", "id", "date", "user", F.lit("pc-1"), F.concat(F.lit('"'), "to", F.lit('"')), F.lit(""), F.lit(""), "from", F.when(order % 11 == 0, F.lit("much")).otherwise(c("size").cast("string")), c("attachments").cast("string"), F.lit('"a, b"'))
    lines = raw_tables(spark, sf_dir)["email"].select(F.when(order % 7 == 0, F.concat_ws(",", "id", "date", "user")).otherwise(whole).alias(",".join(schemas.SOURCES["email"].schema.names)))
    folder = f"{checkpoint_folder(spark)}/raw-{uuid.uuid4().hex}"
    # one column under the header's name, and lines as they stand: a file for each task, with the header at its top
    as_is = {"sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.write.options(header="true", **as_is).csv(folder)
    return readers.read_csv(spark, folder, "email", keep_raw=True)


MAIL_LINE = """SELECT id, CASE WHEN id % 7 = 0 THEN 'fields: 3' WHEN id % 11 = 0 THEN 'values: size' END AS reason, strftime(timestamp, '%m/%d/%Y %H:%M:%S') AS d, * EXCLUDE (id) FROM mail"""


@query("mail", f"""SELECT CASE WHEN id % 7 = 0 THEN id || ',' || d || ',' || lower("user") ELSE id || ',' || d || ',' || lower("user") || ',pc-1,"' || "to" || '",,, ' || from_ || ',much,' || attachments || ',"a, b"' END AS line, reason FROM ({MAIL_LINE}) WHERE reason IS NOT NULL""")
def raw_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.rejects(planted(spark, sf_dir), "email").select("line", "reason")


@query("mail", f"""SELECT CAST(id AS VARCHAR) AS id, lower("user") AS "user", "to", size, attachments, 'a, b' AS content FROM ({MAIL_LINE}) WHERE reason IS NULL""")
def raw_without_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.without_rejects(planted(spark, sf_dir)).select("id", "user", "to", "size", "attachments", "content")


def through(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table read, hashed and normalised, as stage 1 does it."""
    folder = raw_folder(spark, sf_dir, name)
    read = {"ldap": lambda: readers.read_ldap(spark, f"{folder}/ldap"), "psychometric": lambda: readers.read_psychometric(spark, f"{folder}/psychometric.csv")}
    df = read.get(name, lambda: readers.read_log(spark, f"{folder}/{name}.csv", name))()
    schemas.column_check(df, name, strict=True)
    return pipelines.normalised(readers.hashed({name: df})[name], name)


def hash_sql(value: str, kind: str) -> str:
    return f"substr(sha256({value} || '{hashing.SALT}_{kind.upper()}'), 1, {hashing.LENGTHS[kind]})"


WHEN = """CAST(id AS VARCHAR) AS id, upper("user") AS "user", date_trunc('second', timestamp) AS timestamp, CAST(day(timestamp) AS INTEGER) AS day_of_month, date_trunc('hour', timestamp) AS time_bucket"""
TIMED = ["id", "user", "timestamp", "day_of_month", "time_bucket"]


@query("ev logon", f"""SELECT {WHEN}, upper(pc) AS pc, activity, upper("user") || '_' || upper(pc) AS session_key, hour, dow AS day_of_week, weekend AS is_weekend, after_hours AS is_after_hours, {hash_sql('"user"', 'user')} AS user_hash, {hash_sql('pc', 'pc')} AS pc_hash FROM logon""")
def stage1_logon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "logon").select(*TIMED, "pc", "activity", "session_key", "hour", "day_of_week", "is_weekend", "is_after_hours", "user_hash", "pc_hash")


@query("ev device", f"SELECT {WHEN}, upper(pc) AS pc, upper(activity) AS activity FROM device")
def stage1_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "device").select(*TIMED, "pc", "activity")


@query("ev file", f"""SELECT {WHEN}, is_removable, file_extension, 'D0-CF' AS file_header, CASE WHEN k < 20 THEN 'REMOVABLE_WRITE' WHEN k < 40 THEN 'SYSTEM_ACCESS' ELSE 'FILE_ACCESS' END AS operation_type, 6 + k > 50 AS is_large FROM file""")
def stage1_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "file").select(*TIMED, "is_removable", "file_extension", "file_header", "operation_type", text.is_large(F.col("content"), 50).alias("is_large"))


@query("mail", f"""SELECT {WHEN}, from_ AS sender, sender_domain, internal AS is_internal_sender, attachments > 0 AS has_attachments, external AS has_external_recipient, CAST(to_count AS BIGINT) AS to_count, CAST(cc_count AS BIGINT) AS cc_count, CAST(0 AS BIGINT) AS bcc_count,
  CASE WHEN external THEN 3 ELSE 1 END AS recipient_count, external AS has_outside_address, regexp_matches(lower(from_), '@gmail|@yahoo|@hotmail|@outlook|@mail[.]') AS is_webmail FROM mail""")  # fmt: skip
def stage1_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.col(f"{x}_count").cast("long").alias(f"{x}_count") for x in ("to", "cc", "bcc")]
    names = ["sender", "sender_domain", "is_internal_sender", "has_attachments", "has_external_recipient", *counts, "recipient_count", "has_outside_address"]
    return through(spark, sf_dir, "email").select(*TIMED, *names, text.is_webmail(F.col("from")).alias("is_webmail"))


@query("ev http", f"""SELECT {WHEN}, domain, regexp_extract(url, '^https?://[^/]+(/.*)', 1) AS url_path, CASE WHEN regexp_matches(domain, 'facebook|linkedin|twitter') THEN 'social_media' WHEN regexp_matches(domain, 'dropbox|googledrive|onedrive|box[.]com') THEN 'cloud_storage'
  WHEN regexp_matches(domain, 'indeed|monster|glassdoor') THEN 'job_search' WHEN regexp_matches(domain, 'wikileaks|mega[.]nz|mediafire') THEN 'file_sharing' ELSE 'other' END AS domain_category FROM http""")  # fmt: skip
def stage1_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "http").select(*TIMED, "domain", "url_path", "domain_category")


@query("directory", f"""SELECT upper("user") AS user_id, lower("user") || '@dtaa.com' AS email, snapshot_month, role, department, team, CASE role WHEN 'ITAdmin' THEN 5 WHEN 'Manager' THEN 4 WHEN 'Engineer' THEN 3 WHEN 'Analyst' THEN 3 WHEN 'Specialist' THEN 2 ELSE 1 END AS role_sensitivity,
  role = 'ITAdmin' AS is_it_admin, role = 'Manager' AS is_manager, {hash_sql('"user"', 'user')} AS user_hash FROM directory""")  # fmt: skip
def stage1_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "ldap").select("user_id", "email", "snapshot_month", "role", "department", "team", "role_sensitivity", "is_it_admin", "is_manager", "user_hash")


@query("directory", """SELECT lower("user") AS user_id, snapshot_month, role = 'ITAdmin' AS is_it_admin, role = 'Manager' AS is_manager FROM directory""")
def read_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_ldap(spark, f"{raw_folder(spark, sf_dir, 'ldap')}/ldap").select("user_id", "snapshot_month", "is_it_admin", "is_manager")


@query("psycho", """SELECT upper("user") AS user_id, O, C, E, A, N, N > 35 AND C < 25 AS is_high_risk, A < 25 AND O > 40 AS is_disagreeable, least(greatest(N / 50.0 + (50 - C) / 50.0 + (50 - A) / 50.0, 0), 3) / 3 AS personality_risk FROM psycho""", "personality_risk")
def stage1_psychometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, "psychometric").select("user_id", *"OCEAN", "is_high_risk", "is_disagreeable", "personality_risk")


@query("psycho", f"SELECT {', '.join(f'count(*) FILTER ({x} < 5 OR {x} > 45) AS {x}' for x in 'OCEAN')} FROM psycho")
def trait_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.range_check(readers.read_psychometric(spark, f"{raw_folder(spark, sf_dir, 'psychometric')}/psychometric.csv"), list("OCEAN"), 5, 45)


@query("ev truth", """SELECT "user", scenario, CAST(s AS TIMESTAMP) AS start, CAST(e AS TIMESTAMP) AS "end" FROM truth WHERE scenario < 3""")
def read_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = readers.read_ground_truth(spark, f"{raw_folder(spark, sf_dir, 'ground_truth')}/ground_truth.csv", release=4.2)
    return truth.select("user", F.col("scenario").cast("int").alias("scenario"), "start", "end")


@query("ev logon device file http mail directory psycho", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in (("logon", "logon"), ("device", "device"), ("file", "file"), ("email", "mail"), ("http", "http"), ("ldap", "directory"), ("psychometric", "psycho"))))
def stage1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 from raw CSV to Parquet, and the rows of what it wrote."""
    folder = raw_folder(spark, sf_dir)
    pipelines.stage1(spark, folder, f"{folder}/out")
    return sinks.graph_report(spark, f"{folder}/out", "logon device file email http ldap psychometric".split()).select("name", "n")


@query("ev logon device file http mail", """SELECT 'logon' AS source, count(*) AS "rows", count(DISTINCT "user") AS users, count(*) FILTER (after_hours) AS special FROM logon UNION ALL SELECT 'device', count(*), count(DISTINCT "user"), count(*) FILTER (after_hours) FROM device
  UNION ALL SELECT 'file', count(*), count(DISTINCT "user"), count(*) FILTER (is_removable) FROM file UNION ALL SELECT 'email', count(*), count(DISTINCT "user"), count(*) FILTER (external) FROM mail UNION ALL SELECT 'http', count(*), count(DISTINCT "user"), count(DISTINCT domain) FROM http""")  # fmt: skip
def load_statistics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = {"logon": "n_is_after_hours", "device": "n_is_after_hours", "file": "n_is_removable", "email": "n_has_external_recipient", "http": "domains"}
    each = [readers.load_statistics(getattr(views, name)(spark, sf_dir).withColumn("pc", F.lit("p")), name).select(F.lit(name).alias("source"), "rows", "users", F.col(x).alias("special")) for name, x in special.items()]
    return shaping.diagonal(each)


@query("ev logon device", """SELECT id, 'logon.parquet' AS file FROM logon UNION ALL SELECT id, 'device.parquet' FROM device""")
def concat_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"logon.parquet": views.logon(spark, sf_dir), "device.parquet": views.device(spark, sf_dir)}
    return readers.with_source(frames).select("id", F.col("_source_file").alias("file"))


# Features of a user-day


@query("mail", """SELECT "user", date, count(*) AS emails_sent, count(*) FILTER (NOT external) AS internal_emails, count(*) FILTER (external) AS external_emails, count(*) FILTER (attachments > 0) AS emails_with_attachments, avg(size) AS avg_email_size, max(size) AS max_email_size,
  CAST(sum(size) AS BIGINT) AS total_email_size, avg(to_count) AS avg_recipients, avg(cc_count) AS avg_cc FROM mail GROUP BY 1, 2""", "avg_email_size avg_recipients avg_cc")  # fmt: skip
def email_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.email_totals(views.email(spark, sf_dir))


#: Words that the given pages' hosts hold, by the rule of the words with search sites.
SEARCH_WORDS = {"job": "blog", "search": "org net"}


@query("ev http", """SELECT "user", date, count(*) AS http_request_count, count(*) FILTER (regexp_matches(domain, 'blog')) AS job_visits, count(*) FILTER (regexp_matches(domain, 'org|net')) AS search_visits FROM http GROUP BY 1, 2""")
def search_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.http_counts(views.http(spark, sf_dir), words=SEARCH_WORDS).select("user", "date", "http_request_count", "job_visits", "search_visits")


def rapid_sql(rows: str) -> str:
    return f"""SELECT "user", date, count(*) FILTER (gap < 3000 AND activity = 'Logon') AS rapid_logons FROM (SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM {rows}) GROUP BY 1, 2"""


@query("ev logon", rapid_sql("logon"))
def rapid_with_logoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rapid_logons(views.logon(spark, sf_dir), seconds=3000, logons_only=False)


@query("ev logon", """SELECT "user", date, count(*) FILTER (gap < 300) AS rapid_logons FROM (SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM logon WHERE activity = 'Logon') GROUP BY 1, 2""")
def rapid_logons_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rapid_logons(views.logon(spark, sf_dir))


PAIRED = """(SELECT *, date_sub('second', prev_ts, timestamp) AS seconds FROM (SELECT *, lag(activity) OVER w AS prev, lag(timestamp) OVER w AS prev_ts FROM logon WINDOW w AS (PARTITION BY "user", pc ORDER BY timestamp, id)) WHERE activity = 'Logoff' AND prev = 'Logon')"""


@query("ev logon", f"""SELECT "user", date, avg(seconds) AS avg_session, median(seconds) AS median_session, count(*) AS sessions FROM {PAIRED} GROUP BY 1, 2""", "avg_session median_session")
def sessions_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.session_durations(views.logon(spark, sf_dir), positive=False).select("user", "date", "avg_session", "median_session", "sessions")


@query("ev logon", f"""SELECT d."user", d.date, logon_count, logoff_count, unique_pcs, rapid_logons, hour_9, day_of_week_0, coalesce(sessions, 0) AS sessions, avg_session, CAST(sum_session AS BIGINT) AS sum_session FROM (
  SELECT "user", date, count(*) FILTER (activity = 'Logon') AS logon_count, count(*) FILTER (activity = 'Logoff') AS logoff_count, count(DISTINCT pc) FILTER (activity = 'Logon') AS unique_pcs, count(*) FILTER (hour = 9) AS hour_9, count(*) FILTER (dow = 0) AS day_of_week_0 FROM logon GROUP BY 1, 2) d
  LEFT JOIN (SELECT "user", date, count(*) AS rapid_logons FROM (SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM logon WHERE activity = 'Logon') WHERE gap < 36000 GROUP BY 1, 2) r USING ("user", date)
  LEFT JOIN (SELECT "user", date, count(*) AS sessions, avg(seconds) AS avg_session, sum(seconds) AS sum_session FROM {PAIRED} WHERE seconds > 0 GROUP BY 1, 2) s USING ("user", date)""".replace("rapid_logons, hour_9", "coalesce(rapid_logons, 0) AS rapid_logons, hour_9", 1), "avg_session")  # fmt: skip
def logon_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "user date logon_count logoff_count unique_pcs rapid_logons hour_9 day_of_week_0 sessions avg_session sum_session".split()
    return user_day.logon_day(views.logon(spark, sf_dir), seconds=36_000).select(*names)


@query("ev", """SELECT "user", date, least(count(*) / 100.0, 10) AS volume_change_ratio FROM ev GROUP BY 1, 2""", "volume_change_ratio")
def volume_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.volume_proxy(views.events(spark, sf_dir).groupBy("user", "date").agg(F.count(F.lit(1)).alias("n")), "n").select("user", "date", F.col("volume_change_ratio").cast("double").alias("volume_change_ratio"))


@query("ev logon http", """SELECT "user", date, logon_count, coalesce(new_pcs, 0) AS new_pcs, coalesce(new_domains, 0) AS new_domains, degree, pc_degree, unique_pcs_7d, avg(logon_count) OVER (PARTITION BY "user" ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS baseline FROM (
  SELECT "user", date, count(*) FILTER (activity = 'Logon') AS logon_count, count(*) AS degree, count(DISTINCT pc) AS pc_degree FROM logon GROUP BY 1, 2) d
  LEFT JOIN (SELECT "user", date, count(*) AS new_pcs FROM (SELECT "user", pc, min(date) AS date FROM logon GROUP BY 1, 2) GROUP BY 1, 2) USING ("user", date)
  LEFT JOIN (SELECT "user", date, count(*) AS new_domains FROM (SELECT "user", domain, min(date) AS date FROM http WHERE domain IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2) USING ("user", date)
  LEFT JOIN (SELECT a."user", a.date, count(DISTINCT b.pc) AS unique_pcs_7d FROM (SELECT DISTINCT "user", date FROM logon) a JOIN (SELECT DISTINCT "user", date, pc FROM logon) b ON a."user" = b."user" AND b.date <= a.date AND b.date > a.date - INTERVAL 7 DAY GROUP BY 1, 2) USING ("user", date)""", "baseline")  # fmt: skip
def user_day_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"logon": views.logon(spark, sf_dir), "http": views.http(spark, sf_dir)}
    out = pipelines.with_context(pipelines.daily_features({"logon": tables["logon"]}), tables)
    return out.select("user", "date", "logon_count", "new_pcs", "new_domains", "degree", "pc_degree", "unique_pcs_7d", "baseline")


# Shaping


@query("ev psycho", """SELECT "user", n, O, coalesce(CAST(O AS DOUBLE), -1.0) AS filled FROM (SELECT "user", count(*) AS n FROM ev GROUP BY 1) LEFT JOIN (SELECT replace("user", 'P', 'U') AS "user", O FROM psycho) USING ("user")""")
def left_on_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.events(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    traits = traits_of_users(spark, sf_dir).select("user", "O", F.lit(0).alias("n"))
    joined = shaping.left_without_overlap(counts, traits, ["user"])
    return joined.withColumn("filled", F.coalesce(F.col("O").cast("double"), F.lit(-1.0)))


@query("ev", """SELECT id, CASE WHEN id % 5 = 0 THEN 0.0 ELSE value END AS value, 'none' AS threat_type, k AS k_7d, k AS k_30d FROM ev""", "value")
def columns_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are missing get defaults, NaN becomes 0, a static column goes on under each window's name; then columns by suffix."""
    rows = views.events(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "k")
    full = shaping.repeated_for(shaping.without_nan(schemas.with_defaults(rows, {"threat_type": F.lit("none"), "k": F.lit(0)})), ["k"], ["7d", "30d"])
    return full.select("id", "value", "threat_type", *shaping.select_by(full, ("_7d", "_30d")))


@query("directory", """SELECT "user", least(greatest(sens + team_size, 1), 10) AS access_level_small FROM (SELECT "user", CASE role WHEN 'ITAdmin' THEN 5 WHEN 'Engineer' THEN 4 WHEN 'Manager' THEN 3 WHEN 'Analyst' THEN 2 WHEN 'Specialist' THEN 2 ELSE 1 END AS sens, count(*) OVER (PARTITION BY team) AS team_size
  FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY snapshot_month DESC) AS rn FROM directory) WHERE rn = 1)""")  # fmt: skip
def access_level_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.organisation(views.directory(spark, sf_dir)).select("user", F.col("access_level_small").cast("long").alias("access_level_small"))


DEPARTMENTS = ("Sales", "R&D Engineering", "Administration", "Security", "Assembly", "HR", "Legal")


@query(None, f"""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 4 WHEN 6 THEN 6 WHEN 7 THEN 7 ELSE 0 END AS department_id FROM customer""")
def department_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, DEPARTMENTS)), (F.col("c_custkey") % 8 - 1).cast("int"))
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.department_id(F.when(F.col("c_custkey") % 8 > 0, name)).alias("department_id"))


# Sequences with mail and web


UNI = """uni AS (SELECT 'e' || id AS id, "user", timestamp, date, hour, dow, weekend, NOT after_hours AS working, CASE WHEN kind = 'view' THEN 0 WHEN kind = 'click' THEN 1 END AS code, NULL AS site FROM logon
  UNION ALL SELECT 'w' || id, "user", timestamp, date, hour, dow, weekend, NOT after_hours, 9, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 6 ELSE 0 END FROM http
  UNION ALL SELECT 'm' || id, replace("user", 'C', 'U'), timestamp, date, CAST(hour(timestamp) AS INTEGER), CAST(isodow(timestamp) - 1 AS INTEGER), isodow(timestamp) >= 6, NOT after_hours, 8, NULL FROM mail),
  seq AS (SELECT *, row_number() OVER (PARTITION BY "user", date ORDER BY timestamp, id) AS place FROM uni)"""


@query("ev logon http mail", f"""SELECT * FROM (WITH {UNI} SELECT id, CAST(place AS INTEGER) AS place, CAST(code AS DOUBLE) AS f_event_type, round(dow / 6.0, 6) AS f_day_of_week, CAST(hour >= 8 AND hour < 18 AS DOUBLE) AS f_working_hours, CAST(weekend AS DOUBLE) AS f_weekend,
  CAST(hour >= 22 OR hour < 6 AS DOUBLE) AS f_after_hours, CAST(code = 8 AS DOUBLE) AS f_email_sent, CAST(coalesce(site, 0) AS DOUBLE) AS f_url_category FROM seq WHERE place <= 512)""")  # fmt: skip
def sequence_mail_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.element_at(F.array(F.lit("business"), F.lit("shopping"), F.lit("other")), (F.col("k") % 3 + 1).cast("int"))
    named = lambda df, letter: df.withColumn("id", F.concat(F.lit(letter), F.col("id").cast("string")))
    mail = views.email(spark, sf_dir).withColumns({"user": F.replace("user", F.lit("C"), F.lit("U")), "pc": F.lit(None).cast("string")})
    events = sequences.unified({"logon": named(views.logon(spark, sf_dir), "e"), "http": named(views.http(spark, sf_dir).withColumn("domain_category", site), "w"), "email": named(mail, "m")})
    out = sequences.features(events)
    return out.select("id", "place", "f_event_type", F.round("f_day_of_week", 6).alias("f_day_of_week"), "f_working_hours", "f_weekend", "f_after_hours", "f_email_sent", "f_url_category")


@query("ev truth", """SELECT d."user", date, CAST(least(n, 512) AS INTEGER) AS seq_len, CAST(n AS INTEGER) AS event_count, session_count, d."user" || '_' || strftime(date, '%Y%m%d') AS window_id, CAST(t."user" IS NOT NULL AS INTEGER) AS label, codes, 512 AS padded FROM (
  SELECT "user", date, count(*) AS n, CAST(max(session) AS INTEGER) AS session_count, CAST(sum(code) FILTER (place <= 512) AS DOUBLE) AS codes FROM (SELECT *, sum(opens) OVER (PARTITION BY "user", date ORDER BY timestamp, id) AS session FROM (
    SELECT *, CAST(id AS VARCHAR) AS sid, CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS code, row_number() OVER w AS place, CASE WHEN kind = 'view' OR date_sub('second', lag(timestamp) OVER w, timestamp) > 1800 THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, CAST(id AS VARCHAR) AS ids FROM ev WHERE kind IN ('view', 'click', 'signup', 'error')) WINDOW w AS (PARTITION BY "user", date ORDER BY timestamp, ids))) GROUP BY 1, 2) d LEFT JOIN (SELECT DISTINCT "user" FROM truth) t ON d."user" = t."user" """)  # fmt: skip
def sequence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded days: lengths, labels, and of the padded sequence its length and the sum of its event types."""
    out = sequences.encoded(sequences.unified({"logon": views.logon(spark, sf_dir), "device": views.device(spark, sf_dir)}), views.intervals(spark, sf_dir))
    codes = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0)))
    return out.select("user", "date", "seq_len", "event_count", "session_count", "window_id", "label", codes.alias("codes"), F.size("sequence").alias("padded"))


CELLS = {
    "event_type": "code", "pc": "pc_code", "hour": "hour(timestamp) / 23.0", "day_of_week": "(isodow(timestamp) - 1) / 6.0", "working_hours": "CAST(hour(timestamp) >= 8 AND hour(timestamp) < 18 AS INT)", "weekend": "CAST(isodow(timestamp) >= 6 AS INT)",
    "after_hours": "CAST(hour(timestamp) >= 22 OR hour(timestamp) < 6 AS INT)",
    "session_progress": "CASE WHEN n = 1 THEN 0 ELSE least(1.0, elapsed / 14400.0) END", "device_connected": "connected", "file_operation": "op", "email_sent": "0", "removable_access": "removable", "url_category": "0",
    "activity_density": "(n - 1) / greatest(1.0, elapsed / 60.0)", "temporal_entropy": base.entropy_sql(), "session_event_count": "n",
}


def sums_sql() -> str:
    """Over the events as sequence_features' SQL has them: of each feature its sum, and its sum weighed by place, in a day's first 512 events."""
    events = SQL["sequence_features"].rpartition("SELECT id,")[0]
    sums = ", ".join(f"round(sum({x}), 4) AS s_{name}, round(sum(place * ({x})), 4) AS w_{name}" for name, x in CELLS.items())
    return f"""{events} SELECT "user", date, CAST(count(*) AS INTEGER) AS seq_len, {sums}, CAST((512 - count(*)) * 16 AS BIGINT) AS zeros FROM timed WHERE place <= 512 GROUP BY "user", date"""


SQL["sequence_sums"] = sums_sql()


@query()
def sequence_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded days' 512 x 16 numbers: every column's sum, and weighed by place, and the zeros of the padding."""
    out = sequences.encoded(base.unified(spark, sf_dir))
    cells = out.select("user", "date", "seq_len", F.posexplode("sequence").alias("at", "x"))
    names = [(k, x) for k, x in enumerate(sequences.FEATURES)]
    # as SQL rounds: the scaled binary sum, not its shortest decimal (0.028749999999999998 goes to 0.0288, and its decimals to 0.0287)
    total = lambda value, name: (F.round(F.sum(value) * 10_000) / 10_000).alias(name)
    blank = F.when(F.col("at") >= F.col("seq_len"), sum((F.col("x")[k] == 0).cast("long") for k, _ in names))
    return cells.groupBy("user", "date", "seq_len").agg(
        *[total(F.col("x")[k], f"s_{x}") for k, x in names], *[total((F.col("at") + 1) * F.col("x")[k], f"w_{x}") for k, x in names], F.coalesce(F.sum(blank), F.lit(0).cast("long")).alias("zeros")
    )


@query("ev", """SELECT count(*) AS days, avg(least(n, 512)) AS mean_len, CAST(max(least(n, 512)) AS INTEGER) AS max_len, CAST(0 AS BIGINT) AS positive FROM (SELECT "user", date, count(*) AS n FROM ev WHERE kind IN ('view', 'click') GROUP BY 1, 2)""", "mean_len")
def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.summary(sequences.encoded(sequences.unified({"logon": views.logon(spark, sf_dir)})))


# Graph


def traits_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.psychometric(spark, sf_dir).withColumn("user", F.replace("user", F.lit("P"), F.lit("U")))


def directory_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.directory(spark, sf_dir).withColumn("user", F.replace("user", F.lit("C"), F.lit("U")))


def graph_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {x: getattr(views, x)(spark, sf_dir) for x in ("logon", "device", "email", "http")}
    return out | {"http": out["http"].withColumns({"domain_category": text.domain_category(F.col("domain")), "is_sensitive": F.contains("domain", F.lit("org"))})}


def snap(table: str) -> str:
    return f"(SELECT *, CAST(s AS DATE) AS snapshot FROM (SELECT *, unnest([last_day(date), last_day(CAST(last_day(date) + INTERVAL 1 DAY AS DATE))]) AS s FROM {table}) WHERE date <= s AND date_diff('day', date, s) <= 30)"


EDGES = f"""u AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS node FROM (SELECT "user" FROM {snap('logon')} UNION SELECT "user" FROM {snap('device')} UNION SELECT "user" FROM {snap('mail')} UNION SELECT "user" FROM {snap('http')} UNION SELECT "user" FROM psycho)),
  p AS (SELECT pc, row_number() OVER (ORDER BY pc) - 1 AS node FROM (SELECT DISTINCT pc FROM {snap('logon')})),
  d AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS node FROM (SELECT domain FROM {snap('http')} WHERE domain IS NOT NULL UNION SELECT sender_domain FROM {snap('mail')} WHERE sender_domain IS NOT NULL)),
  used AS (SELECT DISTINCT snapshot, "user", pc FROM {snap('logon')}),
  edges AS (SELECT 'used_pc' AS kind, snapshot, u.node AS a, p.node AS b, count(*) AS weight FROM {snap('logon')} x JOIN u USING ("user") LEFT JOIN p USING (pc) GROUP BY ALL
    UNION ALL SELECT 'device_on', snapshot, u.node, p.node, count(*) FROM {snap('device')} x JOIN u USING ("user") LEFT JOIN p USING (pc) GROUP BY ALL
    UNION ALL SELECT 'browsed', snapshot, u.node, d.node, count(*) FROM {snap('http')} x JOIN u USING ("user") JOIN d USING (domain) GROUP BY ALL
    UNION ALL SELECT 'sent_email', snapshot, u.node, d.node, count(*) FROM {snap('mail')} x JOIN u USING ("user") JOIN d ON sender_domain = d.domain GROUP BY ALL
    UNION ALL SELECT 'shared_pc', l.snapshot, u.node, v.node, count(*) FROM used l JOIN used r ON l.snapshot = r.snapshot AND l.pc = r.pc AND l."user" <> r."user" JOIN u ON l."user" = u."user" JOIN u v ON r."user" = v."user" GROUP BY ALL)"""


@query("ev logon device http mail psycho", f"SELECT * FROM (WITH {EDGES} SELECT kind, snapshot, a, b, weight FROM edges)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of edges by month, between node numbers; users of the traits are nodes too."""
    _, edges = pipelines.graph_tables(graph_logs(spark, sf_dir), traits=views.psychometric(spark, sf_dir))
    ends = {"used_pc": ("user", "pc"), "device_on": ("user", "pc"), "browsed": ("user", "domain"), "sent_email": ("user", "sender_domain"), "shared_pc": ("user", "user2")}
    return shaping.diagonal([edges[k].select(F.lit(k).alias("kind"), "snapshot", F.col(f"{a}_node").alias("a"), F.col(f"{b}_node").alias("b"), "weight") for k, (a, b) in ends.items()])


@query("ev logon device http mail psycho", f"""SELECT * FROM (WITH {EDGES} SELECT 'edges_' || kind AS name, CAST(snapshot AS VARCHAR) AS snapshot, count(*) AS n FROM edges GROUP BY 1, 2
  UNION ALL SELECT 'nodes_user', CAST(snapshot AS VARCHAR), count(DISTINCT "user") FROM {snap('logon')} GROUP BY 1, 2 UNION ALL SELECT 'nodes_pc', CAST(snapshot AS VARCHAR), count(DISTINCT pc) FROM {snap('logon')} GROUP BY 1, 2
  UNION ALL SELECT 'nodes_domain', NULL, count(*) FROM d)""")  # fmt: skip
def graph_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's tables written by snapshot, and their rows read back."""
    folder = f"{checkpoint_folder(spark)}/graph-{uuid.uuid4().hex}"
    nodes, edges = pipelines.graph_tables(graph_logs(spark, sf_dir), traits=views.psychometric(spark, sf_dir))
    sinks.write_graph(nodes, edges, folder)
    return sinks.graph_report(spark, folder, [f"nodes_{x}" for x in nodes] + [f"edges_{x}" for x in edges])


@query("ev http mail", """SELECT domain, count(DISTINCT u) AS contacts, ln(1 + count(DISTINCT u)) / 10 AS contact_weight FROM (SELECT domain, "user" AS u FROM http UNION ALL SELECT sender_domain, "user" FROM mail) WHERE domain IS NOT NULL GROUP BY 1""", "contact_weight")
def domain_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the web and of mail's senders as nodes."""
    both = views.http(spark, sf_dir).select("domain", "user").unionByName(views.email(spark, sf_dir).select(F.col("sender_domain").alias("domain"), "user"))
    return graph.domain_nodes(both).select("domain", "contacts", "contact_weight")


STATS = [
    *[f"avg(CAST(hour = {h} AS INT))" for h in range(24)], *[f"avg(CAST(dow = {d} AS INT))" for d in range(7)], "avg(CAST(hour >= 18 OR hour < 8 AS INT))", "avg(CAST(weekend AS INT))", "any_value(n_pcs)", "count(*)", "count(*) / any_value(days_active)", "any_value(pc_entropy)",
    "coalesce(avg(gap), 0)", "coalesce(stddev_pop(gap), 0)", "coalesce(median(gap), 0)", "any_value(daily_mean)", "any_value(daily_std)", "any_value(days_active)", "any_value(max_pc_share)", "any_value(repeat_pcs)",
    "avg(CAST(hour < 12 AS INT))", "avg(CAST(hour >= 12 AND hour < 18 AS INT))", "avg(CAST(hour >= 18 AS INT))", *["0"] * 16,
]
MATRIX = f"""base AS (SELECT "user", [{', '.join(f'CAST({x} AS DOUBLE)' for x in STATS)}] AS a FROM (SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM ev)
    JOIN (SELECT "user", avg(n) AS daily_mean, stddev_pop(n) AS daily_std, count(*) AS days_active FROM (SELECT "user", date, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1) USING ("user")
    JOIN (SELECT "user", count(*) AS n_pcs, sum(-s * ln(s + 1e-8)) AS pc_entropy, max(s) AS max_pc_share, count(*) FILTER (days > 1) AS repeat_pcs FROM (SELECT "user", pc, count(*) / sum(count(*)) OVER (PARTITION BY "user") AS s, count(DISTINCT date) AS days FROM ev GROUP BY 1, 2) GROUP BY 1) USING ("user") GROUP BY 1),
  traits AS (SELECT replace("user", 'P', 'U') AS "user", [CAST(x AS DOUBLE) FOR x IN [O, C, E, A, N]] AS b FROM psycho),
  org AS (SELECT "user", [CAST(x AS DOUBLE) FOR x IN [s, admin, manager, CAST(s >= 3 AS INT), CAST(s >= 4 AS INT), CAST(s >= 5 AS INT), admin * s / 5, manager * s / 5]] AS c FROM (
    SELECT replace("user", 'C', 'U') AS "user", CASE role WHEN 'ITAdmin' THEN 5 WHEN 'Engineer' THEN 4 WHEN 'Manager' THEN 3 WHEN 'Analyst' THEN 2 WHEN 'Specialist' THEN 2 ELSE 1 END AS s, CAST(role = 'ITAdmin' AS INT) AS admin, CAST(role = 'Manager' AS INT) AS manager
    FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY snapshot_month DESC) AS rn FROM directory) WHERE rn = 1)),
  acts AS (SELECT "user", 'logon' AS source, pc, NULL AS domain, NULL AS sensitive, date FROM logon UNION ALL SELECT "user", 'http', pc, domain, contains(domain, 'org'), date FROM http),
  act AS (SELECT "user", [CAST(x AS DOUBLE) FOR x IN [ln(1 + count(*)), (max(CAST(source = 'logon' AS INT)) + max(CAST(source = 'http' AS INT))) / 3, ln(1 + count(DISTINCT domain)), ln(1 + count(DISTINCT pc)), 0,
    coalesce(count(*) FILTER (sensitive) / nullif(count(*) FILTER (source = 'http'), 0), 0), coalesce(count(*) FILTER (source = 'logon' AND date_diff('day', date, l) <= 7) / nullif(count(*) FILTER (source = 'logon'), 0), 0), count(*) FILTER (source = 'logon') / count(*)]] AS d
    FROM acts, (SELECT max(date) AS l FROM acts) GROUP BY 1)"""


@query("ev logon http psycho directory", f"""SELECT * FROM (WITH {MATRIX} SELECT "user", CAST(place - 1 AS INTEGER) AS place, v[place] AS value FROM (SELECT "user", a || coalesce(b, [0.0 FOR i IN range(5)]) || coalesce(c, [0.0 FOR i IN range(8)]) || coalesce(d, [0.0 FOR i IN range(8)]) AS v
  FROM base LEFT JOIN traits USING ("user") LEFT JOIN org USING ("user") LEFT JOIN act USING ("user")), (SELECT unnest(range(1, 86)) AS place))""", "value")  # fmt: skip
def user_matrix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 85 entries of each user: statistics, traits, directory and activity."""
    web = views.http(spark, sf_dir).withColumn("is_sensitive", F.contains("domain", F.lit("org")))
    activity = graph.user_activity({"logon": views.logon(spark, sf_dir), "http": web})
    matrix = graph.user_matrix(graph.user_nodes(views.events(spark, sf_dir)), traits_of_users(spark, sf_dir), people.organisation(directory_of_users(spark, sf_dir)), activity)
    return matrix.select("user", F.posexplode("vector").alias("place", "value"))


# Scores and messages


@query(None, """SELECT vec_id AS id, CAST(place - 1 AS INTEGER) AS place, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS value FROM (SELECT vec_id, place, x, avg(x) OVER (PARTITION BY place) AS m, stddev_pop(x) OVER (PARTITION BY place) AS s
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))""", "value")  # fmt: skip
def scaled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return scoring.scaled_vectors(rows, vector="embedding").select("id", F.posexplode("scaled").alias("place", "value"))


@query("ev", """SELECT "user", n AS iso, iso_norm, ensemble, (row_number() OVER (ORDER BY ensemble, "user") - 1) / count(*) OVER () AS rank_percentile FROM (SELECT *, round(.3 * iso_norm + .3 * pca_norm + .4 * svdd_norm, 9) AS ensemble FROM (
  SELECT "user", n, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER () + 1e-8) AS iso_norm, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER () + 1e-8) AS pca_norm, (n * .8 - min(n * .8) OVER ()) / (max(n * .8) OVER () - min(n * .8) OVER () + 1e-8) AS svdd_norm
  FROM (SELECT "user", CAST(count(*) AS DOUBLE) AS n, CAST(sum(floor(value)) AS DOUBLE) AS total FROM ev GROUP BY 1)))""", "iso_norm ensemble rank_percentile")  # fmt: skip
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxies, weighted sum of the normalised scores, and its ranking, over two numbers of each user."""
    rows = views.events(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.floor("value")).cast("double").alias("total"))
    scored = scoring.ensemble(rows.withColumns({"iso_forest_score": F.col("n"), "pca_recon_error": F.col("total")}))
    return shaping.min_max(scored, ["n"]).select("user", F.col("n").alias("iso"), F.col("n_norm").alias("iso_norm"), F.col("ensemble_anomaly_score").alias("ensemble"), "rank_percentile")


@query("ev", """SELECT 'LOG-' || date || '-' || substr(md5("user"), 1, 8) AS id, CAST(date AS TIMESTAMP) AS timestamp, 'logon' AS "logType", substr("user", 1, 12) AS "userId", 'User_' || substr("user", 1, 6) AS "userName", 'unknown' AS department,
  '192.168.' || (CAST('0x' || substr(md5("user"), 1, 2) AS INTEGER) % 255) || '.' || (CAST('0x' || substr(md5("user"), 3, 2) AS INTEGER) % 255) AS "sourceIp", 'SES-' || (CAST('0x' || substr(md5("user"), 5, 6) AS INTEGER) % 1000000) AS "sessionId", 'workstation' AS resource,
  concat_ws(',', CASE WHEN n > 10 THEN 'high_volume=' || n || '.00' END, CASE WHEN d > 2 THEN 'device=' || d || '.00' END) AS "anomalyFactors",
  CASE WHEN n > 10 THEN 'Unusually many logons (' || (1 + CAST(d > 2 AS INT)) || ' rules)' WHEN d > 2 THEN 'Removable devices in use (1 rules)' ELSE 'Normal behavior pattern (0 rules)' END AS details
  FROM (SELECT "user", date, count(*) AS n, count(*) FILTER (kind IN ('signup', 'error')) AS d FROM ev GROUP BY 1, 2)""")  # fmt: skip
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.count(F.when(F.col("kind").isin("signup", "error"), 1))
    rows = views.events(spark, sf_dir).groupBy("user", "date").agg(F.count(F.lit(1)).alias("logon_count"), device.alias("device_events"))
    said = scoring.messages(scoring.alerts(rows), "features")
    return said.select("id", "timestamp", "logType", "userId", "userName", "department", "sourceIp", "sessionId", "resource", F.array_join("anomalyFactors", ",").alias("anomalyFactors"), "details")


@query("ev", """SELECT 'LOG-' || date || '-' || substr(md5("user"), 1, 8) AS id, unnest(['user', 'date', 'logon_count', 'device_events', 'log_type', 'primary_alert']) AS name, unnest(["user", CAST(date AS VARCHAR), CAST(n AS VARCHAR), CAST(d AS VARCHAR), 'logon',
  CASE WHEN n > 10 THEN 'Unusually many logons' WHEN d > 2 THEN 'Removable devices in use' ELSE 'Normal behavior pattern' END]) AS value FROM (SELECT "user", date, count(*) AS n, count(*) FILTER (kind IN ('signup', 'error')) AS d FROM ev GROUP BY 1, 2)""")  # fmt: skip
def message_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw feature of every message."""
    device = F.count(F.when(F.col("kind").isin("signup", "error"), 1))
    rows = views.events(spark, sf_dir).groupBy("user", "date").agg(F.count(F.lit(1)).alias("logon_count"), device.alias("device_events"))
    said = scoring.messages(scoring.alerts(rows), "features").select("id", F.explode("rawFeatures").alias("name", "value"))
    return said.where("name <> 'alerts'")


@query("ev logon device", """SELECT kind, "user", date FROM (SELECT 'union' AS kind, * FROM (SELECT "user", date FROM logon UNION SELECT "user", date FROM device) UNION ALL SELECT 'intersection', * FROM (SELECT "user", date FROM logon INTERSECT SELECT "user", date FROM device)
  UNION ALL SELECT 'difference', * FROM (SELECT "user", date FROM logon EXCEPT SELECT "user", date FROM device) UNION ALL SELECT 'either', * FROM ((SELECT "user", date FROM logon EXCEPT SELECT "user", date FROM device) UNION (SELECT "user", date FROM device EXCEPT SELECT "user", date FROM logon)))""")  # fmt: skip
def row_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days with logons and with devices, as sets."""
    a, b = (df.select("user", "date") for df in (views.logon(spark, sf_dir), views.device(spark, sf_dir)))
    return shaping.diagonal([shaping.row_set(a, b, kind).select(F.lit(kind).alias("kind"), "user", "date") for kind in ("union", "intersection", "difference", "either")])


# Streams


@query("ev", """SELECT CAST(id AS VARCHAR) AS id, "user", timestamp, date, event_type, CAST(sum(opens) OVER w AS INTEGER) AS session, CAST(row_number() OVER w AS INTEGER) AS place FROM (
  SELECT *, CASE WHEN event_type = 'Logon' OR date_sub('second', lag(timestamp) OVER w, timestamp) > 1800 THEN 1 ELSE 0 END AS opens FROM (SELECT *, CASE kind WHEN 'view' THEN 'Logon' ELSE kind END AS event_type FROM ev)
  WINDOW w AS (PARTITION BY "user", date ORDER BY timestamp, CAST(id AS VARCHAR))) WINDOW w AS (PARTITION BY "user", date ORDER BY timestamp, CAST(id AS VARCHAR) ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream of all events, which comes in three parts and is stopped and started again between them."""
    kind = F.when(F.col("kind") == "view", "Logon").otherwise(F.col("kind"))
    rows = views.events(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "user", F.col("timestamp").cast("timestamp").alias("timestamp"), kind.alias("event_type"))
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    day = F.dayofmonth("timestamp")
    last = rows.agg(F.timestamp_add("DAY", F.lit(9), F.max("timestamp")).alias("timestamp"))
    # a last row of no user's moves the watermark behind all others
    end = last.select(F.lit("end").alias("id"), F.lit("~").alias("user"), "timestamp", F.lit(None).cast("string").alias("event_type"))
    for part in (rows.where(day < 11), rows.where((day >= 11) & (day < 21)), rows.where(day >= 21), end):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = state.day_sessions(live.replay(spark, f"{folder}/in", rows.schema, files_per_trigger=1000))
        live.write_available(stream, f"{folder}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def stream_folder(spark: SparkSession, rows: DataFrame) -> str:
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    return folder


@query("ev", """SELECT "user", date, CASE WHEN n > 10 AND d > 2 THEN 30 WHEN n > 10 OR d > 2 THEN 15 ELSE 0 END AS risk_score, CASE WHEN n > 10 AND d > 2 THEN 'low' ELSE 'normal' END AS threat_level FROM (SELECT "user", date, count(*) AS n, count(*) FILTER (kind IN ('signup', 'error')) AS d FROM ev GROUP BY 1, 2)""")
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days replayed as a stream and scored as they come."""
    device = F.count(F.when(F.col("kind").isin("signup", "error"), 1))
    rows = views.events(spark, sf_dir).groupBy("user", "date").agg(F.count(F.lit(1)).alias("logon_count"), device.alias("device_events"))
    folder = stream_folder(spark, rows)
    stream = live.enrich(live.replay(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
    live.write_available(stream, f"{folder}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user", "date", "risk_score", "threat_level")


@query("ev", """SELECT id, timestamp FROM ev ORDER BY timestamp DESC, id DESC LIMIT 100""")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 latest events of a stream, kept up to date by each of its batches."""
    rows = views.events(spark, sf_dir).select("id", "timestamp", F.struct("timestamp", "id").alias("place"))
    folder = stream_folder(spark, rows.repartition(3))
    stream = live.replay(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    last: list[int] = []
    keep = live.recent(f"{folder}/recent", "place", 100)

    def batch(df: DataFrame, number: int) -> None:
        keep(df, number)
        last.append(number)

    live.write_available(stream, f"{folder}/state").foreachBatch(batch).start().awaitTermination()
    return spark.read.parquet(f"{folder}/recent/{last[-1] % 2}").select("id", "timestamp")


@query("ev truth", """SELECT "user", date FROM (SELECT "user", CAST(d AS DATE) AS date FROM (SELECT "user", unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM truth))""")
def threat_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = labels.labelled(labels.spine(views.events(spark, sf_dir), over=views.events(spark, sf_dir)), views.intervals(spark, sf_dir))
    return live.threats(days.withColumn("is_threat", F.col("is_insider") == 1)).select("user", "date")
