"""Stage 1 (raw logs to normalised, pseudonymised Parquet) and stage 2 (features, labels, sequences, graph, scores)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timeops
from ..functions.hashing import SALT
from ..operators import axes, forest, graph, labels, people, rank, scoring, sequences, shaping, user_day
from ..sources import logs as readers
from ..sources import sinks
from ..sources.schemas import LOGS, column_check

UD = user_day.UD
#: Daily columns that add up over days.
SUMMED = (
    "logon_count logoff_count after_hours_logons weekend_logons connect_count disconnect_count after_hours_connects device_events file_event_count file_write_count file_copy_count "
    "file_delete_count removable_media_writes large_file_writes emails_sent emails_received external_emails_sent attachment_count emails_with_attachments http_request_count "
    "after_hours_http job_visits social_visits cloud_visits fileshare_visits rapid_logons sessions sum_session"
).split()


def normalised(df: DataFrame, source: str) -> DataFrame:
    """Standard forms of one source's columns."""
    c = F.col
    out = timeops.calendar(df, holiday_rule=True) if "timestamp" in df.columns else df
    out = out.withColumns({x: text.entity(c(x)) for x in ("user", "pc", "user_id") if x in df.columns})
    more = {
        "logon": lambda: {"session_key": text.session_key(c("user"), c("pc"))}, "device": lambda: {"activity": F.upper("activity")},
        "file": lambda: {"operation_type": text.operation(c("filename")), "file_extension": text.file_extension(c("filename")), "is_removable": text.is_removable(c("filename"))},
        "email": lambda: {"sender_domain": text.sender_domain(c("from")), "recipient_count": text.distinct_recipients(c("to")), "has_outside_address": text.has_outside_address(c("to"))},
        "http": lambda: {"domain_category": text.domain_category(c("domain")), "is_sensitive": text.is_sensitive(text.domain_category(c("domain"))), "url_path": text.url_path(c("url"), empty=True)},
        "ldap": lambda: {"email": F.lower(F.trim("email")), "role_sensitivity": text.role_level(c("role"))} | text.role_flags(c("role")),
        "psychometric": lambda: {"personality_risk": text.personality_risk(c("C"), c("A"), c("N"))},
    }
    return out.withColumns(more[source]()) if source in more else out


def stage1(
    spark: SparkSession, raw: str, out: str, salt: str = SALT, http: bool = True, http_sample: int | None = None, audit: sinks.Audit | None = None,
    directory: bool = True, traits: bool = True, multi_line: bool = False,
) -> None:
    """Reads, checks, normalises (with the holiday rule), hashes and writes the five logs, the directory and the traits.

    Lines that do not fit their table go to rejects/<table>. They are counted while the others are written; only a table
    that has some is read again for them.
    """
    for name, df in readers.hashed(readers.read_all(spark, raw, http, http_sample, directory, traits, multi_line, True), salt).items():
        good, seen = readers.without_rejects(df), Observation(f"{name} lines")
        column_check(good, name, strict=True)
        counted = df.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(readers.RAW_LINE).alias("rejected"))
        sinks.write_parquet(normalised(readers.without_rejects(counted), name), f"{out}/{name}")
        lines, rejected = seen.get["lines"], seen.get["rejected"]
        if rejected:
            sinks.write_parquet(readers.rejects(df, name), f"{out}/rejects/{name}")
        if audit:
            audit.log("write", table=name, path=f"{out}/{name}", rows=lines - rejected, rejected=rejected)


def daily_features(tables: dict[str, DataFrame]) -> DataFrame:
    """All sources' features of each user and day, missing ones 0."""
    frames = []
    if (x := tables.get("logon")) is not None:
        frames.append(user_day.logon_day(x))
    if (x := tables.get("device")) is not None:
        frames.append(user_day.device_counts(x))
    if (x := tables.get("file")) is not None:
        frames.append(user_day.file_counts(x, large=None if "content" in x.columns else F.col("size") > text.LARGE_FILE))
    if (x := tables.get("email")) is not None:
        frames.append(user_day.email_counts(x))
    if (x := tables.get("http")) is not None:
        frames.append(user_day.http_counts(x))
    return shaping.filled(shaping.stacked(frames, UD))


def with_context(daily: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """daily with what depends on other days and users: volume change, new machines and domains, degrees, drift of each user."""
    out = daily
    if (x := tables.get("logon")) is not None:
        more = [user_day.new_entities(x, "pc"), user_day.degree_proxies(x), user_day.rolling_distinct(x, "pc", 7)]
        more += [user_day.new_entities(tables["http"], "domain")] if "http" in tables else []
        out = out.join(shaping.stacked(more, UD), UD, "left")
        out = user_day.volume_proxy(user_day.volume_drift(out, "logon_count"), "logon_count")
        out = out.join(user_day.behavioural_drift(daily, [c for c in ("logon_count", "unique_pcs", "emails_sent") if c in daily.columns]), "user", "left")
    return shaping.filled(out)


def indexed(edges: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """edges with the node numbers of their ends: nodes gives for each end's column its values' numbers (value column, node)."""
    out = edges
    for column, numbers in nodes.items():
        value = next(c for c in numbers.columns if c != "node")
        out = out.join(numbers.select(F.col(value).alias(column), F.col("node").alias(f"{column}_node")), column, "left")
    return out


def graph_tables(tables: dict[str, DataFrame], directory: DataFrame | None = None, traits: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Nodes (user, pc, domain) and edges (used_pc, shared_pc, sent_email, browsed, device_on), by month; edges with node numbers.

    Users of the directory and of the traits are nodes too.
    """
    own = {name: graph.snapshots(df) for name, df in tables.items() if name in LOGS}
    users = shaping.distinct_keys([*own.values(), *[x for x in (directory, traits) if x is not None]], ["user"])
    number = {"user": graph.node_index(users, "user"), "pc": graph.node_index(own["logon"], "pc")}
    nodes = {"user": graph.user_nodes(own["logon"]), "pc": graph.pc_nodes(own["logon"])}
    edges = {"used_pc": indexed(graph.edges_used_pc(own["logon"]), {x: number[x] for x in ("user", "pc")})}
    edges["shared_pc"] = graph.edges_shared_pc(own["logon"], numbers=number["user"])  # numbered before they are paired
    if "device" in own:
        edges["device_on"] = indexed(graph.edges_device_on(own["device"]), {x: number[x] for x in ("user", "pc")})
    contacts = []
    if "email" in own:
        contacts.append(own["email"].select(F.col("sender_domain").alias("domain"), "user"))
    if "http" in own:
        contacts.append(own["http"].select("domain", "user"))
    if contacts:
        both = shaping.diagonal(contacts)
        number["domain"] = graph.node_index(both, "domain")
        kinds = own["http"].select("domain", F.col("domain_category").alias("category")) if "http" in own and "domain_category" in own["http"].columns else None
        nodes["domain"] = indexed(graph.domain_nodes(both, kinds), {"domain": number["domain"]})
    if "email" in own:
        edges["sent_email"] = indexed(graph.edges_sent_email(own["email"]), {"user": number["user"], "sender_domain": number["domain"]})
    if "http" in own:
        flagged = own["http"] if "is_sensitive" in own["http"].columns else own["http"].withColumn("is_sensitive", text.is_sensitive(text.domain_category(F.col("domain"))))
        edges["browsed"] = indexed(graph.edges_browsed(flagged), {"user": number["user"], "domain": number["domain"]})
    return nodes, edges


def windowed_features(daily: DataFrame, windows: tuple[str, ...] = ("24h", "7d", "30d")) -> DataFrame:
    """daily, with its sums over each true trailing window; all windows share one sort."""
    columns = [c for c in SUMMED if c in daily.columns]
    return reduce(lambda df, w: user_day.rolling(df, columns, user_day.window_days(w), suffix=w), [w for w in windows if w != "24h"], daily)


def window_table(features: DataFrame, window: str, windows: tuple[str, ...]) -> DataFrame:
    """A window's columns of windowed_features, by user and day, without the window's name behind theirs."""
    if window == "24h":
        others = tuple(f"_{w}" for w in windows if w != "24h")
        return features.select(*[c for c in features.columns if not (others and c.endswith(others))])
    own = [c for c in features.columns if c.endswith(f"_{window}")]
    return features.select(*UD, *[F.col(c).alias(c.removesuffix(f"_{window}")) for c in own])


def ranked_nodes(edges: dict[str, DataFrame]) -> DataFrame:
    """Rank of users, machines and domains, over the edges of all months: to machines and back, and to domains."""
    ends = {"used_pc": ("user", "pc"), "browsed": ("user", "domain"), "sent_email": ("user", "sender_domain")}
    parts = [edges[x].select(F.col(a).alias("src"), F.col(b).alias("dst"), "weight") for x, (a, b) in ends.items() if x in edges]
    back = edges["used_pc"].select(F.col("pc").alias("src"), F.col("user").alias("dst"), "weight")
    return rank.page_rank(reduce(DataFrame.unionByName, [*parts, back]), "src", "dst", tolerance=1e-4)


def stage2(spark: SparkSession, tables: dict[str, DataFrame], out: str, intervals: DataFrame | None = None, directory: DataFrame | None = None, traits: DataFrame | None = None, windows: tuple[str, ...] = ("24h", "7d", "30d", "90d")) -> None:
    """Writes features (all windows in one table, and a table for each), labels, sequences, graph tables with ranks, the mail graph and anomaly scores."""
    features = windowed_features(with_context(daily_features(tables), tables), windows)
    if directory is not None:
        organisation = people.organisation(directory)
        features = shaping.left_without_overlap(features, organisation.drop("snapshot_month"), ["user"])
    if traits is not None:
        features = shaping.left_without_overlap(features, people.personality(traits), ["user"])
    if intervals is not None:
        features = labels.labelled(features, intervals)
    sinks.write_parquet(features, f"{out}/features")
    features = spark.read.parquet(f"{out}/features")
    sinks.write_windows({w: window_table(features, w, windows) for w in windows}, out)
    own = {k: v for k, v in tables.items() if k in LOGS}
    sinks.write_parquet(sequences.encoded(sequences.unified(own), intervals), f"{out}/sequences")
    nodes, edges = graph_tables(tables, directory, traits)
    sinks.write_graph(nodes, edges, f"{out}/graph")
    written = {name: spark.read.schema(df.schema).parquet(f"{out}/graph/edges_{name}") for name, df in edges.items()}  # one without edges has no files
    sinks.write_parquet(ranked_nodes(written), f"{out}/graph/ranks")
    if "email" in tables:
        sinks.write_parquet(graph.email_graph(tables["email"]), f"{out}/graph/mail")
    columns = [c for c in shaping.numbers(features, ("user", "date", "is_insider"))]
    people_ = user_day.user_means(features, columns)
    vectors = scoring.scaled_vectors(people_, [f"mean_{c}" for c in columns])
    scores = scoring.ensemble(forest.isolation_scores(axes.reconstruction_error(vectors)))
    sinks.write_parquet(scores.select("user", "iso_forest_score", "pca_recon_error", "autoencoder_recon_error", "deep_svdd_distance", "ensemble_anomaly_score", "rank_percentile"), f"{out}/scores")
