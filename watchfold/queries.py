"""Registered queries of the analytics library over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, text, timeops
from .operators import axes, forest, graph, labels, people, scoring, sequences, shaping, user_day
from .plans import pipelines
from .registry import QUERIES, SQL, query  # noqa: F401
from .session import checkpoint_folder
from .sources import adapters as views
from .sources import logs as readers
from .streaming import live

# Logon, device, file, mail and web by user and day


@query("ev logon", """SELECT "user", date, count(*) FILTER (activity = 'Logon') AS logon_count, count(*) FILTER (activity = 'Logoff') AS logoff_count, count(*) FILTER (activity = 'Logon' AND after_hours) AS after_hours_logons,
  count(*) FILTER (activity = 'Logon' AND weekend) AS weekend_logons, count(DISTINCT pc) FILTER (activity = 'Logon') AS unique_pcs,
  count(*) FILTER (activity = 'Logon') / (count(*) + 1.0) AS logon_ratio FROM logon GROUP BY ALL""", "logon_ratio")  # fmt: skip
def logon_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.logon_counts(views.logon(spark, sf_dir))


@query("ev", """SELECT "user", date, count(*) AS logon_count, CAST(sum(CAST(after_hours AS INT)) AS BIGINT) AS after_hours_count, CAST(sum(CAST(weekend AS INT)) AS BIGINT) AS weekend_count,
  CAST(sum(CAST(NOT after_hours AS INT)) AS BIGINT) AS working_hours_count, count(DISTINCT pc) AS unique_pcs, min(hour) AS first_hour, max(hour) AS last_hour, count(*) / (count(*) + 1.0) AS logon_intensity,
  least(1.0, sum(CAST(after_hours AS INT)) / (count(*) + 1.0)) AS after_hours_ratio FROM ev GROUP BY ALL""", "logon_intensity after_hours_ratio")  # fmt: skip
def logon_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.logon_intensity(views.events(spark, sf_dir))


PAIRS = """SELECT *, date_sub('second', prev_ts, timestamp) AS seconds FROM (
  SELECT *, lag(activity) OVER w AS prev, lag(timestamp) OVER w AS prev_ts FROM {0} WINDOW w AS (PARTITION BY "user", pc ORDER BY timestamp, id)) WHERE activity = '{2}' AND prev = '{1}'"""
DURATIONS = """SELECT "user", date, avg(seconds) AS avg_session, max(seconds) AS max_session, coalesce(stddev_samp(seconds), 0) AS std_session, median(seconds) AS median_session,
  CAST(sum(seconds) AS BIGINT) AS sum_session, count(*) AS sessions FROM ({0}) WHERE seconds > 0 GROUP BY ALL"""


@query("ev logon", DURATIONS.format(PAIRS.format("logon", "Logon", "Logoff")), "avg_session std_session median_session")
def session_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.session_durations(views.logon(spark, sf_dir))


@query("ev device", DURATIONS.format(PAIRS.format("device", "Connect", "Disconnect")), "avg_session std_session median_session")
def device_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.session_durations(views.device(spark, sf_dir), start="connect", end="disconnect")


@query("ev logon", """SELECT "user", date, count(*) FILTER (gap < 36000) AS rapid_logons FROM (
  SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM logon WHERE activity = 'Logon') GROUP BY ALL""")  # fmt: skip
def rapid_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rapid_logons(views.logon(spark, sf_dir), seconds=36_000)


@query("ev device", """SELECT "user", date, count(*) FILTER (activity = 'Connect') AS connect_count, count(*) FILTER (activity = 'Disconnect') AS disconnect_count, count(*) FILTER (activity = 'Connect' AND after_hours) AS after_hours_connects,
  count(*) FILTER (activity = 'Connect' AND weekend) AS weekend_connects, count(DISTINCT pc) AS unique_devices, count(*) AS device_events,
  greatest(count(*) FILTER (activity = 'Connect') - count(*) FILTER (activity = 'Disconnect'), 0) AS missing_disconnect_count FROM device GROUP BY ALL""")  # fmt: skip
def device_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.device_counts(views.device(spark, sf_dir))


@query("ev file", """SELECT "user", date, count(*) AS file_event_count, count(*) FILTER (lower(operation_type) = 'write') AS file_write_count, count(*) FILTER (operation_type = 'copy') AS file_copy_count,
  count(*) FILTER (operation_type = 'delete') AS file_delete_count, count(*) FILTER (is_removable) AS removable_media_writes, count(DISTINCT file_extension) AS file_type_diversity,
  count(*) FILTER (after_hours) AS after_hours_files, count(*) FILTER (lower(operation_type) = 'write' AND size > 5000000) AS large_file_writes FROM file GROUP BY ALL""")  # fmt: skip
def file_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.file_counts(views.file(spark, sf_dir), large=F.col("size") > text.LARGE_FILE)


@query("mail", """SELECT "user", date, count(*) FILTER (internal) AS emails_sent, count(*) FILTER (NOT internal) AS emails_received, coalesce(avg(size) FILTER (internal), 0) AS avg_email_size,
  coalesce(max(size) FILTER (internal), 0) AS max_email_size, CAST(coalesce(sum(attachments) FILTER (internal), 0) AS BIGINT) AS attachment_count, count(*) FILTER (internal AND attachments > 0) AS emails_with_attachments,
  count(*) FILTER (internal AND after_hours) AS after_hours_emails, count(*) FILTER (internal AND external) AS external_emails_sent, count(DISTINCT sender_domain) FILTER (internal AND external) AS unique_external_domains,
  count(DISTINCT "to") FILTER (external) AS external_contacts, coalesce(avg(to_count) FILTER (internal), 0) AS avg_recipients, coalesce(avg(cc_count) FILTER (internal), 0) AS avg_cc,
  least(coalesce(avg(cc_count) FILTER (internal), 0) / (count(*) FILTER (internal) + 1), 1.0) AS cc_usage_rate FROM mail GROUP BY ALL""", "avg_email_size avg_recipients avg_cc cc_usage_rate")  # fmt: skip
def email_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.email_counts(views.email(spark, sf_dir))


def visits(words: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER (regexp_matches(domain, '{'|'.join(own.split()).replace('.', '[.]')}')) AS {name}_visits" for name, own in words.items())


#: Site words that hit the given pages' hosts, with the same rule as production words.
GIVEN_WORDS = {"job": "blog tion", "social": "m. thth", "cloud": "org box", "fileshare": "net"}


@query("ev http", f"""SELECT "user", date, count(*) AS http_request_count, count(DISTINCT domain) AS unique_domains, count(*) FILTER (after_hours) AS after_hours_http, count(*) FILTER (weekend) AS weekend_http,
  {visits(GIVEN_WORDS)} FROM http GROUP BY ALL""")  # fmt: skip
def http_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.http_counts(views.http(spark, sf_dir), words=GIVEN_WORDS)


HOURS = ", ".join(f"count(*) FILTER (hour = {h}) AS hour_{h}" for h in range(24))
DAYS = ", ".join(f"count(*) FILTER (dow = {d}) AS day_of_week_{d}" for d in range(7))


@query("ev", f'SELECT "user", {HOURS} FROM ev GROUP BY 1')
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.hour_profile(views.events(spark, sf_dir), ["user"])


@query("ev", f'SELECT "user", {DAYS} FROM ev GROUP BY 1')
def dow_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.day_profile(views.events(spark, sf_dir), ["user"])


@query("ev", f'SELECT "user", date, {HOURS}, {DAYS} FROM ev GROUP BY 1, 2')
def temporal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.temporal_profile(views.events(spark, sf_dir))


@query("ev", f'SELECT "user", {DAYS} FROM ev GROUP BY 1')
def dow_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.pivoted(views.events(spark, sf_dir), ["user"], "day_of_week", list(range(7)), "day_of_week")


# Windows over days


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).groupBy("user", "date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pc").alias("pcs"), F.sum(F.floor("value").cast("long")).alias("total"))


DAILY = """(SELECT "user", date, count(*) AS n, count(DISTINCT pc) AS pcs, CAST(sum(floor(value)) AS BIGINT) AS total FROM ev GROUP BY 1, 2)"""
BACK = """(PARTITION BY "user" ORDER BY date RANGE BETWEEN INTERVAL {0} DAY PRECEDING AND CURRENT ROW)"""


@query("ev", f'SELECT "user", date, n, total, CAST(sum(n) OVER {BACK.format(6)} AS BIGINT) AS n_7d, CAST(sum(total) OVER {BACK.format(6)} AS BIGINT) AS total_7d FROM {DAILY}')
def rolling_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rolling(daily_counts(spark, sf_dir).drop("pcs"), ["n", "total"], 7)


@query("ev", f'SELECT "user", date, n, CAST(sum(n) OVER {BACK.format(29)} AS BIGINT) AS n_30d, CAST(sum(n) OVER {BACK.format(89)} AS BIGINT) AS n_90d FROM {DAILY}')
def rolling_30d_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rolling(user_day.rolling(daily_counts(spark, sf_dir).select("user", "date", "n"), ["n"], 30), ["n"], 90)


@query("ev", """SELECT a."user", a.date, count(DISTINCT b.pc) AS unique_pcs_7d FROM (SELECT DISTINCT "user", date FROM ev) a
  JOIN (SELECT DISTINCT "user", date, pc FROM ev) b ON a."user" = b."user" AND b.date <= a.date AND b.date > a.date - INTERVAL 7 DAY GROUP BY 1, 2""")  # fmt: skip
def rolling_distinct_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.rolling_distinct(views.events(spark, sf_dir), "pc", 7)


@query("ev", f"""SELECT *, (n - baseline) / (baseline + 1) AS volume_change FROM (SELECT "user", date, n, avg(n) OVER {BACK.format(29)} AS baseline FROM {DAILY})""", "baseline volume_change")
def volume_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.volume_drift(daily_counts(spark, sf_dir).select("user", "date", "n"), "n")


@query("ev", f"""SELECT *, .5 * volume_change_ratio + .25 * least(pcs, 5) + .25 * least(total, 5) AS drift_score FROM (
  SELECT *, CASE WHEN avg(n) OVER (PARTITION BY "user") > 0 THEN least(n / avg(n) OVER (PARTITION BY "user"), 10.0) ELSE 1.0 END AS volume_change_ratio FROM {DAILY})""", "volume_change_ratio drift_score")  # fmt: skip
def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.baseline_drift(daily_counts(spark, sf_dir), "n", "pcs", "total")


@query("ev", """SELECT "user", date, count(*) AS new_pcs FROM (SELECT "user", pc, min(date) AS date FROM ev GROUP BY 1, 2) GROUP BY 1, 2""")
def new_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.new_entities(views.events(spark, sf_dir), "pc")


DRIFT = "(" + " + ".join(f"coalesce(stddev_samp({c}), 0) / (avg({c}) + 1)" for c in ("n", "pcs", "total")) + ") / 3"


@query("ev", f'SELECT "user", {DRIFT} AS behavioral_drift_score FROM {DAILY} GROUP BY 1', "behavioral_drift_score")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.behavioural_drift(daily_counts(spark, sf_dir), ["n", "pcs", "total"])


@query("ev", f"SELECT {DRIFT} AS behavioral_drift_score FROM {DAILY}", "behavioral_drift_score")
def drift_score_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.behavioural_drift(daily_counts(spark, sf_dir), ["n", "pcs", "total"], globally=True)


@query("ev", """SELECT "user", date, count(id) AS degree, count(DISTINCT pc) AS pc_degree, least(greatest(count(id) / 100.0, 0), 1) AS pagerank_proxy FROM ev GROUP BY 1, 2""", "pagerank_proxy")
def degree_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.degree_proxies(views.events(spark, sf_dir))


@query("ev", """SELECT "user", avg(gap) AS gap_mean, stddev_pop(gap) AS gap_std, median(gap) AS gap_median FROM (
  SELECT "user", date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM ev) GROUP BY 1""", "gap_mean gap_std gap_median")  # fmt: skip
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.event_gaps(views.events(spark, sf_dir))


@query("ev", f'SELECT "user", avg(n) AS mean_n, avg(pcs) AS mean_pcs, avg(total) AS mean_total FROM {DAILY} GROUP BY 1', "mean_n mean_pcs mean_total")
def user_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.user_means(daily_counts(spark, sf_dir), ["n", "pcs", "total"])


@query("ev logon device file", """SELECT "user", date, count(*) AS event_count, least(count(*), 512) AS seq_len, 1 AS session_count, 0 AS label
  FROM (SELECT "user", date FROM logon UNION ALL SELECT "user", date FROM device UNION ALL SELECT "user", date FROM file) GROUP BY 1, 2""")  # fmt: skip
def sequence_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.sequence_metadata({"logon": views.logon(spark, sf_dir), "device": views.device(spark, sf_dir), "file": views.file(spark, sf_dir)})


@query("ev", "SELECT kind, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM ev GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day.value_counts(views.events(spark, sf_dir), "kind")


@query("ev logon", """SELECT count(*) AS "rows", count(DISTINCT "user") AS users, count(DISTINCT pc) AS pcs, count(*) FILTER (after_hours) AS n_is_after_hours, count(*) FILTER (weekend) AS n_is_weekend FROM logon""")
def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load_statistics(views.logon(spark, sf_dir), "logon")


# Time, text and pseudonyms


@query("ev", """SELECT id, hour, dow AS day_of_week, CAST(week(timestamp) AS INTEGER) AS week, CAST(month(timestamp) AS INTEGER) AS month, CAST(year(timestamp) AS INTEGER) AS year, date, weekend AS is_weekend, NOT after_hours AS is_working_hours,
  after_hours AS is_after_hours, hour >= 22 OR hour < 5 AS late_night, hour >= 18 OR hour < 8 AS off_hours, hour >= 22 OR hour < 6 AS night, hour / 23.0 AS hour_share, dow / 6.0 AS day_share, date_trunc('hour', timestamp) AS bucket,
  isodow(timestamp) >= 5 AS weekend_as_written FROM ev""", "hour_share day_share")  # fmt: skip
def calendar_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("timestamp")
    return views.events(spark, sf_dir).select(
        "id", "hour", "day_of_week", "week", "month", "year", "date", "is_weekend", "is_working_hours", "is_after_hours", timeops.is_late_night(t).alias("late_night"), timeops.is_off_hours(t).alias("off_hours"),
        timeops.is_night(t).alias("night"), timeops.hour_share(t).alias("hour_share"), timeops.day_share(t).alias("day_share"), timeops.time_bucket(t).alias("bucket"), timeops.is_weekend(t, as_written=True).alias("weekend_as_written"),
    )


@query(None, """SELECT event_id AS id, ts AS us, date_trunc('minute', ts) AS minutes, ts AS iso, CAST(NULL AS TIMESTAMP) AS junk FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.date_trunc("second", "timestamp")
    form = lambda f: F.date_format(t, f)
    return views.events(spark, sf_dir).select(
        "id", timeops.parse_timestamp(form("M/d/yyyy H:mm:ss")).alias("us"), timeops.parse_timestamp(form("MM/dd/yyyy HH:mm")).alias("minutes"),
        timeops.parse_any(form("yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), timeops.parse_timestamp(F.concat(F.lit("x"), F.col("kind"))).alias("junk"),
    )


@query(None, r"""SELECT page_id, lower(nullif(regexp_extract(url, '^https?://([^/]+)', 1), '')) AS domain, nullif(regexp_extract(url, '^https?://[^/]+(/.*)', 1), '') AS url_path FROM pages""")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return views.table(spark, sf_dir, "pages").select("page_id", text.url_domain(u).alias("domain"), text.url_path(u).alias("url_path"))


CATEGORY = """CASE WHEN contains(site, 'facebook') OR contains(site, 'linkedin') OR contains(site, 'twitter') THEN 'social_media'
  WHEN contains(site, 'dropbox') OR contains(site, 'googledrive') OR contains(site, 'onedrive') OR contains(site, 'box.com') THEN 'cloud_storage'
  WHEN contains(site, 'indeed') OR contains(site, 'linkedin.com') OR contains(site, 'monster') OR contains(site, 'glassdoor') THEN 'job_search'
  WHEN contains(site, 'wikileaks') OR contains(site, 'mega.nz') OR contains(site, 'mediafire') THEN 'file_sharing' ELSE 'other' END"""
#: Hosts of real sites stand in for some of the given hosts.
SITES = ("linkedin.com", "www.dropbox.com", "jobs.indeed.com", "mega.nz", "facebook.com", "mybox.com", "wikipedia.org", "instagram.com", "m.twitter.com", "wikileaks.org")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, SITES)), (F.col("page_id") % len(SITES) + 1).cast("int"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, named).otherwise(text.url_domain(F.col("url"))).alias("site"))


SITE_VIEW = f"(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN list_extract({list(SITES)}, CAST(page_id % {len(SITES)} + 1 AS INTEGER)) ELSE lower(nullif(regexp_extract(url, '^https?://([^/]+)', 1), '')) END AS site FROM pages)"


@query(None, f"SELECT page_id, category, category IN ('cloud_storage', 'file_sharing', 'job_search') AS is_sensitive FROM (SELECT page_id, {CATEGORY} AS category FROM {SITE_VIEW})")
def domain_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.domain_category(F.col("site"))
    return sites(spark, sf_dir).select("page_id", c.alias("category"), text.is_sensitive(c).alias("is_sensitive"))


def flag_sql(words: dict[str, str], suffix: str) -> str:
    return ", ".join(f"coalesce(regexp_matches(site, '{'|'.join(own.split()).replace('.', '[.]')}'), false) AS {name}{suffix}" for name, own in words.items())


@query(None, f"SELECT page_id, {flag_sql(text.SITE_WORDS, '_1')}, {flag_sql(text.SITE_WORDS_WITH_SEARCH, '_2')} FROM {SITE_VIEW}")
def domain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("site")
    one, two = text.site_flags(s), text.site_flags(s, text.SITE_WORDS_WITH_SEARCH)
    return sites(spark, sf_dir).select("page_id", *[v.alias(k.removeprefix("is_") + "_1") for k, v in one.items()], *[v.alias(k.removeprefix("is_") + "_2") for k, v in two.items()])


@query("mail", """SELECT id, to_count, len(string_split("to", ';')) AS as_written, len(list_distinct([trim(x) FOR x IN string_split("to", ';')])) AS distinct_count, cc_count, external, sender_domain, internal AS is_internal,
  regexp_matches(regexp_replace("to", '@dtaa[.]com', '', 'g'), '@') AS outside FROM mail""")  # fmt: skip
def list_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.col("to")
    return views.email(spark, sf_dir).select(
        "id", F.col("to_count").cast("int").alias("to_count"), text.recipient_count(to, as_written=True).cast("long").alias("as_written"), text.distinct_recipients(to).cast("long").alias("distinct_count"),
        F.col("cc_count").cast("int").alias("cc_count"), F.col("has_external_recipient").alias("external"), "sender_domain", F.col("is_internal_sender").alias("is_internal"), text.has_outside_address(to).alias("outside"),
    )


@query("ev file", r"""SELECT id, filename, file_extension, CASE WHEN k < 20 THEN 'REMOVABLE_WRITE' WHEN k < 40 THEN 'SYSTEM_ACCESS' ELSE 'FILE_ACCESS' END AS operation, is_removable,
  list_extract(string_split(filename, '\'), -1) AS base, list_extract(string_split(filename, '.'), 1) AS header, substr(filename, 1, 6) AS short FROM file""")  # fmt: skip
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("filename")
    return views.file(spark, sf_dir).select(
        "id", "filename", "file_extension", text.operation(f).alias("operation"), text.is_removable(f, ignore_case=True).alias("is_removable"), text.basename(f).alias("base"),
        text.file_header(F.replace(f, F.lit("."), F.lit(" "))).alias("header"), text.shortened(f, 6).alias("short"),
    )


def digest_sql(value: str, kind: str) -> str:
    return f"substr(sha256({value} || '{hashing.SALT}_{kind.upper()}'), 1, {hashing.LENGTHS[kind]})"


@query(None, f"""SELECT c_custkey AS id, {digest_sql('upper(trim(c_name))', 'user')} AS user_hash, {digest_sql('upper(trim(c_mktsegment))', 'pc')} AS pc_hash,
  {digest_sql("lower(c_mktsegment) || '.example'", 'email')} AS email_hash, {digest_sql('lower(trim(c_mktsegment))', 'domain')} AS domain_hash, {digest_sql('upper(trim(c_name))', 'join')} AS join_hash,
  substr(sha256(upper(trim(c_mktsegment))), 1, 16) AS plain_hash FROM customer""")  # fmt: skip
def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_name"), F.col("c_mktsegment")
    mail = F.concat(F.lit("x@"), s, F.lit(".example"))
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), c.alias("user"), s.alias("pc"), mail.alias("email"), s.alias("domain"), c.alias("join"), hashing.hash_pc(s).alias("plain_hash"))
    return hashing.pseudonymise(rows, {k: k for k in hashing.LENGTHS}).drop(*hashing.LENGTHS)


@query(None, """SELECT c_custkey AS id, regexp_matches(upper(substr(c_mktsegment, 1, 3)) || lpad(CAST(c_custkey % 12000 AS VARCHAR), 4, '0'), '^[A-Z]{3}[0-9]{4}$') AS user_ok,
  regexp_matches('PC-' || c_nationkey, '^PC-[0-9-]*[0-9][0-9-]*$') AS pc_ok, 'U' || c_custkey || '_' || 'PC' AS session_key FROM customer""")  # fmt: skip
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    digits = F.when(c("c_custkey") % 12000 > 9999, F.substring((c("c_custkey") % 12000).cast("string"), 1, 4)).otherwise(F.lpad((c("c_custkey") % 12000).cast("string"), 4, "0"))
    return views.table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("id"), text.valid_user(F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), digits)).alias("user_ok"),
        text.valid_pc(F.concat(F.lit("PC-"), c("c_nationkey").cast("string"))).alias("pc_ok"), text.session_key(F.concat(F.lit("U"), c("c_custkey").cast("string")), F.lit("PC")).alias("session_key"),
    )


# People


LATEST = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY snapshot_month DESC) AS rn FROM directory) WHERE rn = 1)"""


@query("directory", f'SELECT "user", snapshot_month, role, department, team FROM {LATEST}')
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.latest_snapshot(views.directory(spark, sf_dir))


@query("directory", f"""SELECT *, sens * 10 + dept_size / 100.0 + team_size / 50.0 AS access_level FROM (SELECT "user", role, department, team,
  CASE role WHEN 'ITAdmin' THEN 5 WHEN 'Engineer' THEN 4 WHEN 'Manager' THEN 3 WHEN 'Analyst' THEN 2 WHEN 'Specialist' THEN 2 ELSE 1 END AS sens, CASE role WHEN 'ITAdmin' THEN 5 WHEN 'Manager' THEN 4 WHEN 'Engineer' THEN 3 WHEN 'Analyst' THEN 3 WHEN 'Specialist' THEN 2 ELSE 1 END AS role_level,
  role = 'ITAdmin' AS is_it_admin, role = 'Manager' AS is_manager, role = 'ITAdmin' AS is_security_role, role = 'Manager' AS is_management, 7 AS department_id, count(*) OVER (PARTITION BY department) AS dept_size, count(*) OVER (PARTITION BY team) AS team_size FROM {LATEST})""", "access_level")  # fmt: skip
def role_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = people.organisation(views.directory(spark, sf_dir)).withColumnRenamed("role_sensitivity", "sens")
    return out.select("user", "role", "department", "team", "sens", "role_level", "is_it_admin", "is_manager", "is_security_role", "is_management", "department_id", "dept_size", "team_size", "access_level")


@query("directory", """SELECT "user", snapshot_month, dept_size, team_size FROM directory JOIN (SELECT department, count(DISTINCT "user") AS dept_size FROM directory GROUP BY 1) USING (department)
  JOIN (SELECT team, count(DISTINCT "user") AS team_size FROM directory GROUP BY 1) USING (team)""")  # fmt: skip
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.with_group_sizes(views.directory(spark, sf_dir)).select("user", "snapshot_month", "dept_size", "team_size")


@query("directory", """SELECT "user", count(DISTINCT role) - 1 AS role_changes, count(DISTINCT department) - 1 AS department_changes FROM directory GROUP BY 1""")
def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.changes(views.directory(spark, sf_dir))


@query("directory", "SELECT role, CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS role_id FROM (SELECT DISTINCT role FROM directory)")
def role_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.role_codes(views.directory(spark, sf_dir))


@query("directory", 'SELECT avg(n) AS mean_users, count(*) AS snapshots FROM (SELECT snapshot_month, count(DISTINCT "user") AS n FROM directory GROUP BY 1)', "mean_users")
def users_per_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.users_per_snapshot(views.directory(spark, sf_dir))


@query("psycho", """SELECT "user", N > 35 AND C < 25 AS is_high_risk, A < 25 AND O > 40 AS is_disagreeable, O > 35 AND A < 25 AS is_disagreeable_wide, least(greatest(O / 50.0, 0), 1) AS O_share,
  least(greatest(N / 50.0 + (50 - C) / 50.0 + (50 - A) / 50.0, 0), 3) / 3 AS personality_risk,
  least(greatest(.5 * least(N / 50.0, 1) - .25 * least(C / 50.0, 1) - .25 * least(A / 50.0, 1) + .5, 0), 1) AS trait_risk FROM psycho""", "O_share personality_risk trait_risk")  # fmt: skip
def personality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.personality(views.psychometric(spark, sf_dir)).select("user", "is_high_risk", "is_disagreeable", "is_disagreeable_wide", "O_share", "personality_risk", "trait_risk")


@query("psycho", "SELECT avg(O) AS mean_O, avg(C) AS mean_C, avg(E) AS mean_E, avg(A) AS mean_A, avg(N) AS mean_N FROM psycho", "mean_O mean_C mean_E mean_A mean_N")
def trait_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.trait_means(views.psychometric(spark, sf_dir))


# Labels, sets, filling


SPINE = '(SELECT "user", CAST(d AS DATE) AS date FROM (SELECT DISTINCT "user" FROM ev), (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM ev))'


@query("ev", f'SELECT "user", date FROM {SPINE}')
def user_day_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events(spark, sf_dir)
    return labels.spine(ev, over=ev)


LABELLED = f"""SELECT d."user", d.date, CAST(t."user" IS NOT NULL AS SMALLINT) AS is_insider, coalesce(CAST(t.scenario AS VARCHAR), 'none') AS threat_type FROM {SPINE} d LEFT JOIN truth t ON d."user" = t."user" AND d.date BETWEEN t.s AND t.e"""


@query("ev truth", LABELLED)
def label_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events(spark, sf_dir)
    return labels.labelled(labels.spine(ev, over=ev), views.intervals(spark, sf_dir))


@query("ev truth", LABELLED)
def label_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events(spark, sf_dir)
    return labels.labelled_by_range(labels.spine(ev, over=ev), views.intervals(spark, sf_dir))


@query("ev logon file", """SELECT "user", date, activity, NULL AS operation_type, id FROM logon UNION ALL SELECT "user", date, NULL, operation_type, id FROM file""")
def diagonal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.diagonal([views.logon(spark, sf_dir).select("user", "date", "activity", "id"), views.file(spark, sf_dir).select("user", "date", "operation_type", "id")])


@query("ev logon device", 'SELECT "user", date FROM logon UNION SELECT "user", date FROM device')
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.distinct_keys([views.logon(spark, sf_dir), views.device(spark, sf_dir)], ["user", "date"])


@query("ev", """SELECT "user", id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY timestamp DESC, id DESC) AS rn FROM ev) WHERE rn <= 50""")
def latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.latest_k(views.events(spark, sf_dir), ["user"], [F.desc("timestamp"), F.desc("id")], 50).select("user", "id", "timestamp")


@query("ev", "SELECT id, timestamp FROM ev ORDER BY timestamp DESC, id DESC LIMIT 200")
def recent_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.latest_k(views.events(spark, sf_dir), [], [F.desc("timestamp"), F.desc("id")], 200).select("id", "timestamp")


@query("ev", """SELECT id, coalesce(v, (SELECT quantile_cont(v, .5) FROM h)) AS v, coalesce(w, (SELECT quantile_cont(w, .5) FROM h)) AS w FROM h""".replace("FROM h", "FROM (SELECT id, CASE WHEN id % 7 <> 0 THEN value END AS v, CASE WHEN id % 3 <> 0 THEN CAST(k AS DOUBLE) END AS w FROM ev)"), "v w")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = views.events(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("id") % 3 != 0, F.col("k").cast("double")).alias("w"))
    return shaping.median_imputed(holes, ["v", "w"])


@query("ev logon device", """SELECT "user", date, coalesce(a, 0) AS logons_7d, coalesce(b, 0) AS connects_7d FROM (SELECT "user", date, count(*) AS a FROM logon GROUP BY 1, 2) FULL JOIN (SELECT "user", date, count(*) AS b FROM device GROUP BY 1, 2) USING ("user", date)""")
def full_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, name: df.groupBy("user", "date").agg(F.count(F.lit(1)).alias(name))
    merged = shaping.merge([count(views.logon(spark, sf_dir), "logons"), count(views.device(spark, sf_dir), "connects")], ["user", "date"])
    return shaping.suffixed(shaping.filled(merged), "7d")


@query("ev", f"""SELECT *, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER () + 1e-8) AS n_norm, (row_number() OVER (ORDER BY n, "user", date) - 1) / count(*) OVER () AS rank_percentile FROM (SELECT "user", date, n FROM {DAILY})""", "n_norm rank_percentile")
def minmax_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = shaping.min_max(daily_counts(spark, sf_dir).select("user", "date", "n"), ["n"])
    tied = scaled.withColumn("tie", F.struct("user", "date"))
    return shaping.rank_percentile(tied, "n", "tie").drop("tie")


@query("ev", f'SELECT "user", date, n, pcs FROM {DAILY}')
def zero_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.without_zero_columns(daily_counts(spark, sf_dir).drop("total").withColumn("nothing", (F.col("n") > 1_000_000).cast("int")))


@query("ev logon device file", f"""SELECT "user", date, {", ".join(f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" for c in ("logon_count", "device_events", "file_event_count"))},
  CAST(sum(coalesce(sum(logon_count), 0)) OVER (PARTITION BY "user" ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS logon_count_7d,
  CAST(sum(coalesce(sum(device_events), 0)) OVER (PARTITION BY "user" ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS device_events_30d FROM (
  SELECT "user", date, CASE activity WHEN 'Logon' THEN 1 ELSE 0 END AS logon_count, 0 AS device_events, 0 AS file_event_count FROM logon UNION ALL SELECT "user", date, 0, 1, 0 FROM device UNION ALL SELECT "user", date, 0, 0, 1 FROM file) GROUP BY 1, 2""")  # fmt: skip
def user_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pipelines.daily_features({"logon": views.logon(spark, sf_dir), "device": views.device(spark, sf_dir), "file": views.file(spark, sf_dir)})
    return pipelines.windowed_features(daily).select("user", "date", "logon_count", "device_events", "file_event_count", "logon_count_7d", "device_events_30d")


@query("ev logon file", """SELECT id, timestamp, 'logon' AS source_type, activity AS action FROM logon UNION ALL SELECT id, timestamp, 'file', filename FROM file""")
def chronological_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.chronological({"logon": views.logon(spark, sf_dir), "file": views.file(spark, sf_dir)}).select("id", "timestamp", "source_type", "action")


# Sequences


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unified({"logon": views.logon(spark, sf_dir), "device": views.device(spark, sf_dir), "file": views.file(spark, sf_dir)})


SESSIONS = """uni AS (SELECT CAST(id AS VARCHAR) AS id, "user", pc, timestamp, date, hour, dow, CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE list_extract([5, 6, 7, 4], k % 4 + 1) END AS code, kind = 'purchase' AND k < 20 AS rem,
    CASE WHEN kind = 'purchase' THEN list_extract([2, 3, 4, 1], k % 4 + 1) ELSE 0 END AS op FROM ev),
  opened AS (SELECT *, CASE WHEN code = 0 OR date_sub('second', lag(timestamp) OVER w, timestamp) > 1800 THEN 1 ELSE 0 END AS opens, row_number() OVER w AS place FROM uni WINDOW w AS (PARTITION BY "user", date ORDER BY timestamp, id)),
  sess AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY "user", date ORDER BY timestamp, id) AS INTEGER) AS session FROM opened)"""
SQL["sessionize"] = f'WITH {views.CTES["ev"]}, {SESSIONS} SELECT "user", date, id, session, CAST(place AS INTEGER) AS place FROM sess'


@query()
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sessions(unified(spark, sf_dir)).select("user", "date", "id", "session", "place")


def entropy_sql() -> str:
    terms = " + ".join(f"CASE WHEN n_{k} > 0 THEN -(n_{k} / CAST(n AS DOUBLE)) * log2(n_{k} / CAST(n AS DOUBLE)) ELSE 0 END" for k in range(12))
    return f"CASE WHEN n > 1 THEN {terms} ELSE 0 END"


SQL["sequence_features"] = f"""WITH {views.CTES["ev"]}, {SESSIONS},
  pcs AS (SELECT pc, row_number() OVER (ORDER BY u, d, t, i, pc) - 1 AS pc_code FROM (SELECT pc, "user" AS u, date AS d, timestamp AS t, id AS i, row_number() OVER (PARTITION BY pc ORDER BY "user", date, timestamp, id) AS rn FROM sess) WHERE rn = 1),
  run AS (SELECT *, row_number() OVER w AS n, min(timestamp) OVER w AS began, max(CAST(rem AS INT)) OVER w AS removable, {", ".join(f"sum(CAST(code = {k} AS INT)) OVER w AS n_{k}" for k in range(12))},
    coalesce(last_value(CASE code WHEN 2 THEN 1 WHEN 3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY "user", date, pc ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 0) AS connected
    FROM sess JOIN pcs USING (pc) WINDOW w AS (PARTITION BY "user", date, session ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)),
  timed AS (SELECT *, CASE WHEN session > 0 THEN date_sub('second', began, timestamp) ELSE 0 END AS elapsed FROM run)
  SELECT id, CAST(place AS INTEGER) AS place, session, CAST(code AS DOUBLE) AS f_event_type, CAST(pc_code AS DOUBLE) AS f_pc, round(hour / 23.0, 6) AS f_hour, CAST(connected AS DOUBLE) AS f_device_connected, CAST(op AS DOUBLE) AS f_file_operation,
    CAST(removable AS DOUBLE) AS f_removable_access, round(CASE WHEN n = 1 THEN 0 ELSE least(1.0, elapsed / 14400.0) END, 6) AS f_session_progress, round((n - 1) / greatest(1.0, elapsed / 60.0), 6) AS f_activity_density,
    round({entropy_sql()}, 6) AS f_temporal_entropy, CAST(n AS DOUBLE) AS f_session_event_count FROM timed WHERE place <= 512"""


@query(rounds="f_hour f_session_progress f_activity_density f_temporal_entropy")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "event_type pc hour device_connected file_operation removable_access session_progress activity_density temporal_entropy session_event_count".split()
    return sequences.features(unified(spark, sf_dir)).select("id", "place", "session", *[f"f_{x}" for x in names])


@query()
def sequence_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.encoded(unified(spark, sf_dir), views.intervals(spark, sf_dir))


# Graph


SNAP = """(SELECT *, CAST(s AS DATE) AS snapshot FROM (SELECT *, unnest([last_day(date), last_day(CAST(last_day(date) + INTERVAL 1 DAY AS DATE))]) AS s FROM ev) WHERE date <= s AND date_diff('day', date, s) <= 30)"""


@query("ev", f"""SELECT snapshot, "user", pc, ln(1 + count(*)) AS log_n, (30 - least(greatest(date_diff('day', max(date), snapshot), 0), 30)) / 30.0 AS recency, avg(CAST(after_hours AS INT)) AS off_hours, avg(CAST(weekend AS INT)) AS weekend,
  ln(1 + date_sub('second', min(timestamp), max(timestamp))) AS log_seconds, count(*) AS weight FROM {SNAP} GROUP BY 1, 2, 3""", "log_n recency off_hours weekend log_seconds")  # fmt: skip
def edges_used_pc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_used_pc(graph.snapshots(views.events(spark, sf_dir)))


@query("ev", f"""SELECT snapshot, "user", user2, weight, ln(1 + weight) AS log_weight FROM (SELECT a.snapshot, a."user", b."user" AS user2, count(*) AS weight FROM (SELECT DISTINCT snapshot, "user", pc FROM {SNAP}) a
  JOIN (SELECT DISTINCT snapshot, "user", pc FROM {SNAP}) b ON a.snapshot = b.snapshot AND a.pc = b.pc AND a."user" <> b."user" GROUP BY 1, 2, 3)""", "log_weight", rounded=True)  # fmt: skip
def edges_shared_pc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_shared_pc(graph.snapshots(views.events(spark, sf_dir)), digits=6)


@query("mail", """SELECT "user", sender_domain, ln(1 + count(*)) AS log_n, ln(1 + sum(size)) / 20 AS log_size, ln(1 + sum(attachments)) / 15 AS log_attachments, avg(CAST(external AS INT)) AS external,
  avg(CAST(hour(timestamp) >= 18 OR hour(timestamp) < 8 AS INT)) AS off_hours, count(*) AS weight FROM mail GROUP BY 1, 2""", "log_n log_size log_attachments external off_hours")  # fmt: skip
def edges_sent_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_sent_email(views.email(spark, sf_dir))


@query("ev http", """SELECT "user", domain, ln(1 + count(*)) AS log_n, avg(CAST(contains(domain, 'org') AS INT)) AS sensitive, avg(CAST(hour >= 18 OR hour < 8 AS INT)) AS off_hours, count(*) AS weight FROM http GROUP BY 1, 2""", "log_n sensitive off_hours")
def edges_browsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_browsed(views.http(spark, sf_dir).withColumn("is_sensitive", F.contains("domain", F.lit("org"))))


@query("ev device", """SELECT "user", pc, ln(1 + count(*)) AS log_n, ln(1 + date_sub('second', min(timestamp), max(timestamp))) / 10 AS log_seconds, count(*) AS weight FROM device GROUP BY 1, 2""", "log_n log_seconds")
def edges_device_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_device_on(views.device(spark, sf_dir))


@query("ev", """SELECT CAST(date_trunc('month', date) AS DATE) AS month, "user", pc FROM ev""")
def edges_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_monthly(views.events(spark, sf_dir))


@query("mail", """SELECT month, least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, trim(from_) AS a, trim(unnest(string_split("to", ';'))) AS b FROM mail) WHERE b <> '' AND a <> b GROUP BY 1, 2, 3""")
def email_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.email_graph(views.email(spark, sf_dir))


@query("ev", """SELECT pc, row_number() OVER (ORDER BY pc) - 1 AS node FROM (SELECT DISTINCT pc FROM ev)""")
def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_index(views.events(spark, sf_dir), "pc")


@query("ev", """SELECT pc, n_events, n_users, days_active, off_hours_ratio, weekend_ratio, hour_mean, hour_std, gap_mean, gap_std, night_ratio, n_events / n_users AS events_per_user, n_events / days_active AS events_per_day,
  CAST(n_users > 1 AS INTEGER) AS is_shared, CAST(n_users = 1 AS INTEGER) AS is_dedicated, CAST(n_events > quantile_cont(n_events, .75) OVER () AS INTEGER) AS is_busy, CAST(n_events < quantile_cont(n_events, .25) OVER () AS INTEGER) AS is_quiet FROM (
  SELECT pc, count(*) AS n_events, count(DISTINCT "user") AS n_users, count(DISTINCT date) AS days_active, avg(CAST(after_hours AS INT)) AS off_hours_ratio, avg(CAST(weekend AS INT)) AS weekend_ratio, avg(hour) AS hour_mean, stddev_pop(hour) AS hour_std,
  coalesce(avg(gap), 0) AS gap_mean, coalesce(stddev_pop(gap), 0) AS gap_std, avg(CAST(hour >= 22 OR hour < 5 AS INT)) AS night_ratio FROM (
  SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY pc ORDER BY timestamp, id), timestamp) AS gap FROM ev) GROUP BY 1)""", "off_hours_ratio weekend_ratio hour_mean hour_std gap_mean gap_std night_ratio events_per_user events_per_day")  # fmt: skip
def pc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pc_nodes(views.events(spark, sf_dir))


@query("ev", """SELECT b.*, daily_mean, daily_std, days_active, n_pcs, pc_entropy, max_pc_share, repeat_pcs FROM (
  SELECT "user", count(*) AS n_events, avg(CAST(hour = 9 AS INT)) AS hour_9, avg(CAST(dow = 0 AS INT)) AS dow_0, avg(CAST(hour >= 18 OR hour < 8 AS INT)) AS off_hours_ratio, avg(CAST(weekend AS INT)) AS weekend_ratio, coalesce(avg(gap), 0) AS gap_mean, coalesce(median(gap), 0) AS gap_median FROM (
    SELECT *, date_sub('second', lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id), timestamp) AS gap FROM ev) GROUP BY 1) b
  JOIN (SELECT "user", avg(n) AS daily_mean, stddev_pop(n) AS daily_std, count(*) AS days_active FROM (SELECT "user", date, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1) USING ("user")
  JOIN (SELECT "user", count(*) AS n_pcs, sum(-s * ln(s + 1e-8)) AS pc_entropy, max(s) AS max_pc_share, count(*) FILTER (days > 1) AS repeat_pcs FROM (
    SELECT "user", pc, count(*) / sum(count(*)) OVER (PARTITION BY "user") AS s, count(DISTINCT date) AS days FROM ev GROUP BY 1, 2) GROUP BY 1) USING ("user")""", "hour_9 dow_0 off_hours_ratio weekend_ratio gap_mean gap_median daily_mean daily_std pc_entropy max_pc_share")  # fmt: skip
def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "user n_events hour_9 dow_0 off_hours_ratio weekend_ratio gap_mean gap_median daily_mean daily_std days_active n_pcs pc_entropy max_pc_share repeat_pcs".split()
    return graph.user_nodes(views.events(spark, sf_dir)).select(*names)


@query()
def user_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = views.http(spark, sf_dir).withColumn("is_sensitive", text.is_sensitive(text.domain_category(F.col("domain"))))
    activity = graph.user_activity({"logon": views.logon(spark, sf_dir), "http": web})
    return graph.user_matrix(graph.user_nodes(views.events(spark, sf_dir)), activity=activity)


@query("ev http", f"""SELECT domain, ln(1 + count(DISTINCT "user")) / 10 AS contact_weight, count(DISTINCT "user") AS contacts, min(CASE WHEN contains(domain, 'blog') THEN 'blog' WHEN contains(domain, 'org') THEN 'news' ELSE 'webmail' END) AS category,
  min(CASE WHEN contains(domain, 'blog') THEN {graph.DOMAIN_CATEGORIES.index("blog")} WHEN contains(domain, 'org') THEN {graph.DOMAIN_CATEGORIES.index("news")} ELSE -1 END) AS category_place FROM http GROUP BY 1""", "contact_weight")  # fmt: skip
def domain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = views.http(spark, sf_dir).select("domain", "user", F.when(F.contains("domain", F.lit("blog")), "blog").when(F.contains("domain", F.lit("org")), "news").otherwise("webmail").alias("category"))
    return graph.domain_nodes(web, web)


# Scores and alerts


def risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events(spark, sf_dir)
    of = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    rows = ev.groupBy("user", "date").agg(
        of("view").alias("logon_count"), of("signup", "error").alias("device_events"), (of("click") * 4).alias("emails_sent"), (of("purchase") * 40).alias("http_requests"),
        F.avg(F.col("is_after_hours").cast("int")).alias("after_hours_ratio"), (F.max("k") > 95).alias("is_security_role"),
    )
    return scoring.late_flags(rows)


RISK = """(SELECT *, round(least(1.0, CASE WHEN after_hours_ratio > .3 THEN .2 ELSE 0 END + CASE WHEN logon_count > 10 THEN .15 ELSE 0 END + CASE WHEN device_events > 2 THEN .15 ELSE 0 END + CASE WHEN emails_sent > 15 THEN .1 ELSE 0 END
  + CASE WHEN is_security_role THEN .1 ELSE 0 END + CASE WHEN after_hours_ratio > .3 THEN .2 ELSE 0 END), 10) AS threat_score FROM (
  SELECT "user", date, count(*) FILTER (kind = 'view') AS logon_count, count(*) FILTER (kind IN ('signup', 'error')) AS device_events, count(*) FILTER (kind = 'click') * 4 AS emails_sent, count(*) FILTER (kind = 'purchase') * 40 AS http_requests,
  avg(CAST(after_hours AS INT)) AS after_hours_ratio, max(k) > 95 AS is_security_role FROM ev GROUP BY 1, 2))"""
LEVEL = "CASE WHEN threat_score > .8 THEN 'critical' WHEN threat_score > .6 THEN 'high' WHEN threat_score > .4 THEN 'medium' WHEN threat_score > .2 THEN 'low' ELSE 'normal' END"


@query("ev", f"""SELECT "user", date, CAST(threat_score AS DOUBLE) AS threat_score, CAST(round(threat_score * 100) AS INTEGER) AS risk_score, {LEVEL} AS threat_level, threat_score > .5 AS is_threat FROM {RISK}""", "threat_score")
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk(risk_rows(spark, sf_dir)).select("user", "date", "threat_score", "risk_score", "threat_level", "is_threat")


HELD = [f"CASE WHEN {condition} THEN '{name}' END" for name, condition in (("after_hours", "after_hours_ratio > .3"), ("high_volume", "logon_count > 10"), ("device", "device_events > 2"), ("email", "emails_sent > 15"), ("http", "http_requests > 100"), ("security", "is_security_role"), ("sequence", "after_hours_ratio > .3"))]


@query("ev", f"""SELECT "user", date, concat_ws(',', {", ".join(HELD)}) AS alerts, coalesce({", ".join(h.replace(f"'{n}'", f"'{scoring.ALERTS[n]}'") for h, n in zip(HELD, scoring.ALERTS, strict=True))}, 'Normal behavior pattern') AS primary_alert,
  CASE WHEN logon_count > 0 THEN 'logon' WHEN device_events > 0 THEN 'device' WHEN emails_sent > 0 THEN 'email' WHEN http_requests > 0 THEN 'http' ELSE 'process' END AS log_type FROM {RISK}""")  # fmt: skip
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.alerts(risk_rows(spark, sf_dir)).select("user", "date", F.array_join("alerts", ",").alias("alerts"), "primary_alert", "log_type")


@query("ev", f"""SELECT {", ".join(f"count(*) FILTER ({LEVEL} = '{x}') AS n_{x}" for x in ("critical", "high", "medium", "low", "normal"))}, count(*) FILTER (threat_score > .5) AS new_alerts, CAST(round(avg(round(threat_score * 100))) AS BIGINT) AS avg_risk FROM {RISK}""")
def ui_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.level_counts(scoring.risk(risk_rows(spark, sf_dir)))


@query()
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.messages(scoring.alerts(risk_rows(spark, sf_dir)), "features").withColumn("rawFeatures", F.to_json("rawFeatures")).withColumn("alerts", F.array_join("alerts", ","))


@query("ev", f"""SELECT "user", date, CASE WHEN b > 0 THEN (raw_score - a) / (b - a + 1e-8) ELSE raw_score END AS score FROM (SELECT *, min(raw_score) OVER () AS a, max(raw_score) OVER () AS b FROM (SELECT "user", date, .3 * n + .3 * pcs + .4 * total AS raw_score FROM {DAILY}))""", "score")
def weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted_ensemble(daily_counts(spark, sf_dir), ("n", "pcs", "total")).select("user", "date", "score")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user"), "embedding")
    return scoring.scaled_vectors(rows, vector="embedding")


@query(None, """SELECT vec_id AS "user", sum(CASE WHEN s > 0 THEN ((x - m) / s) * ((x - m) / s) ELSE 0 END) AS energy FROM (SELECT vec_id, x, avg(x) OVER (PARTITION BY place) AS m, stddev_pop(x) OVER (PARTITION BY place) AS s
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) GROUP BY 1""", "energy")  # fmt: skip
def pca_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together turn the scaled vectors, and so keep their lengths."""
    return axes.embedding(vectors(spark, sf_dir), k=64, out="components").select("user", F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x).alias("energy"))


@query()
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = forest.isolation_scores(axes.reconstruction_error(vectors(spark, sf_dir)))
    names = "iso_forest_score pca_recon_error autoencoder_recon_error deep_svdd_distance ensemble_anomaly_score rank_percentile".split()
    return scoring.ensemble(scored).select("user", *names)


@query("ev", f"""SELECT "user", date, CAST(after_hours_ratio > .3 AS INTEGER) AS high_after_hours, least(emails_sent / (logon_count + 1.0), 100.0) AS email_per_logon FROM {RISK}""", "email_per_logon")
def late_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rows(spark, sf_dir).select("user", "date", "high_after_hours", "email_per_logon")


# Calendars over orders, and event-time sessions


ORDER_HOLIDAYS = tuple(f"{year}-{day}" for year in range(1990, 2001) for day in ("01-01", "07-04", "12-25"))


@query(None, f"""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') IN {ORDER_HOLIDAYS} AS is_holiday, CAST(day(o_orderdate) AS INTEGER) AS day_of_month, CAST(last_day(o_orderdate) AS DATE) AS month_end,
  hour(o_orderdate) < 18 AND isodow(o_orderdate) <= 5 AND NOT strftime(o_orderdate, '%Y-%m-%d') IN {ORDER_HOLIDAYS} AS works, CAST(strftime(o_orderdate, '%Y-%m-01') AS DATE) AS month FROM orders""")  # fmt: skip
def holiday_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), timeops.is_holiday(t, ORDER_HOLIDAYS).alias("is_holiday"), F.dayofmonth(t).alias("day_of_month"), F.last_day(t).alias("month_end"),
        timeops.is_working_hours(t, start=0, holidays=ORDER_HOLIDAYS).alias("works"), timeops.parse_month(F.date_format(t, "yyyy-MM")).alias("month"),
    )


@query(None, """SELECT o_custkey AS id, CAST(last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))) AS DATE) AS snapshot FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)""")
def month_end_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return timeops.month_ends(spans, "a", "b").select("id", "snapshot")


@query("ev truth", f"""SELECT d."user", d.date, n, CAST(coalesce(is_insider, 0) AS SMALLINT) AS is_insider, coalesce(threat_type, 'none') AS threat_type FROM {DAILY} d LEFT JOIN (SELECT "user", CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date, 1 AS is_insider, CAST(scenario AS VARCHAR) AS threat_type FROM truth) t ON d."user" = t."user" AND d.date = t.date""")
def attached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = labels.expanded(views.intervals(spark, sf_dir)).withColumn("is_insider", F.lit(1).cast("smallint"))
    return labels.attached(daily_counts(spark, sf_dir).select("user", "date", "n"), days)


@query("ev", """SELECT min(timestamp) AS start, max(timestamp) + INTERVAL 30 MINUTE AS "end", "user", count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY "user" ORDER BY timestamp, id) AS g FROM (
  SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY "user" ORDER BY timestamp, id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM ev)) GROUP BY "user", g""")  # fmt: skip
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.events(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return live.session_windows(events).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("ev http", f"""SELECT domain, CAST(place AS INTEGER) AS place, CAST(place = CASE WHEN contains(domain, 'blog') THEN {graph.DOMAIN_CATEGORIES.index("blog")} ELSE -1 END AS DOUBLE) AS hot FROM (SELECT DISTINCT domain FROM http), (SELECT unnest(generate_series(0, 30)) AS place)""")
def category_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.contains("domain", F.lit("blog")), F.lit(graph.DOMAIN_CATEGORIES.index("blog"))).otherwise(F.lit(-1))
    rows = views.http(spark, sf_dir).select("domain").distinct().withColumn("v", graph.one_hot(place))
    return rows.select("domain", F.posexplode("v").alias("place", "hot"))


# Streams: the given events replayed, until all of them are through


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream of all files at hand yields, written by its batches to a shared folder."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{folder}/out")
    live.write_available(stream, f"{folder}/state", mode).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = live.replay(spark, f"{path[:-1]}[t]", spark.read.parquet(path).schema)  # as a glob, it may be a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(None, """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = drained(live.windowed_counts(stream_of(spark, sf_dir), "ts", ("event_type",)), "complete")
    return counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(None, """SELECT event_id, event_type, value > 90 AS is_high FROM events WHERE event_type IN ('error', 'purchase')""")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    return drained(events.select("event_id", "event_type", (F.col("value") > 90).alias("is_high")), "append")


from . import model_queries, stage_queries  # noqa: E402, F401  (register more)
