"""A graph of users, machines and domains for each month: node vectors and weighted edges as tables.

A snapshot holds the events of its last WINDOW_DAYS days. All snapshots are built in one job: events are exploded to the
snapshots whose window holds them (two at most), and everything is grouped by snapshot too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops

WINDOW_DAYS = 30
#: Users of a block, where the edges of shared machines are counted.
BLOCK_USERS = 1024
# Places of the one-hot domain categories; later ones are all zero.
DOMAIN_CATEGORIES = (
    "advertising blog business cdn chat climate cloudprovider commercial cryptocurrency dating download drugs education entertainment file_transfer "
    "financial forum gambling government hacking health humor infrastructure job_search legal mail military museum news nudity online_storage"
).split()
# End of fixed values.


def snapshots(events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Events with each month's end (snapshot) whose closed window of days holds them."""
    this = F.last_day("date")
    ends = F.array(this, F.last_day(F.date_add(this, 1)))
    near = F.filter(ends, lambda s: (F.col("date") <= s) & (F.datediff(s, F.col("date")) <= days))
    return events.withColumn("snapshot", F.explode(near))


def node_index(values: DataFrame, column: str, name: str = "node") -> DataFrame:
    """Distinct values numbered from 0 in order, across range partitions."""
    from .shaping import rank_percentile  # the same numbering, without the division

    distinct = values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().withColumn("one", F.lit(0))
    ranked = rank_percentile(distinct, "value", "one", "share")
    n = distinct.agg(F.count(F.lit(1)).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).select(F.col("value").alias(column), F.round(F.col("share") * F.col("n")).cast("long").alias(name))  # n: one row


def keyed(events: DataFrame, *columns: str) -> list[str]:
    return [*(["snapshot"] if "snapshot" in events.columns else []), *columns]


def off_hours(as_flag: bool) -> Column:
    return (F.col("is_after_hours") if as_flag else timeops.is_off_hours(F.col("timestamp"))).cast("double")


def event_share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def user_nodes(events: DataFrame) -> DataFrame:
    """For each user: hour and day shares, off-hours and weekend shares, machines, events, gaps, daily counts and machine use."""
    by = keyed(events, "user")
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    w = Window.partitionBy(*by).orderBy("timestamp", "id")
    rows = events.withColumn("gap", timeops.seconds_between(F.lag("timestamp").over(w), F.col("timestamp")))
    n = F.count(F.lit(1))
    base = rows.groupBy(*by).agg(
        n.alias("n_events"), *[event_share(hour == h).alias(f"hour_{h}") for h in range(24)], *[event_share(day == d).alias(f"dow_{d}") for d in range(7)],
        event_share(timeops.is_off_hours(F.col("timestamp"))).alias("off_hours_ratio"), event_share(day >= 5).alias("weekend_ratio"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_std"), F.coalesce(F.median("gap"), F.lit(0.0)).alias("gap_median"),
        event_share(hour < 12).alias("ge0_ratio"), event_share((hour >= 12) & (hour < 18)).alias("afternoon_ratio"), event_share(hour >= 18).alias("evening_ratio"),
    )
    # days and machines come from one table of counts
    cells = events.groupBy(*by, "date", "pc").agg(n.alias("n"))
    daily = cells.groupBy(*by, "date").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.avg("n").alias("daily_mean"), F.stddev_pop("n").alias("daily_std"), n.alias("days_active"))
    pcs = cells.groupBy(*by, "pc").agg(F.sum("n").alias("n"), F.count("date").alias("days"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    pcs = pcs.withColumn("share", share).groupBy(*by).agg(
        n.alias("n_pcs"), F.sum(-F.col("share") * F.log(F.col("share") + 1e-8)).alias("pc_entropy"), F.max("share").alias("max_pc_share"), F.count(F.when(F.col("days") > 1, 1)).alias("repeat_pcs")
    )
    out = base.join(daily, by).join(pcs, by)
    return out.withColumn("events_per_day", F.col("n_events") / F.col("days_active"))


USER_STATS = (
    [f"hour_{h}" for h in range(24)] + [f"dow_{d}" for d in range(7)]
    + "off_hours_ratio weekend_ratio n_pcs n_events events_per_day pc_entropy gap_mean gap_std gap_median daily_mean daily_std days_active max_pc_share repeat_pcs ge0_ratio afternoon_ratio evening_ratio".split()
)


def user_activity(logs: dict[str, DataFrame]) -> DataFrame:
    """Graph statistics of each user over the logs: 8 numbers, logs absent count as 0."""
    c = F.col
    tagged = None
    for name, df in logs.items():
        own = df.select("user", F.lit(name).alias("source"), *[(c(x) if x in df.columns else F.lit(None).cast(kind)).alias(x) for x, kind in (("pc", "string"), ("domain", "string"), ("has_external_recipient", "boolean"), ("is_sensitive", "boolean"), ("date", "date"))])
        tagged = own if tagged is None else tagged.unionByName(own)
    last = tagged.agg(F.max("date").alias("last"))
    rows = tagged.crossJoin(F.broadcast(last))  # one row
    of = lambda s: F.count(F.when(c("source") == s, 1))
    recent = F.count(F.when((c("source") == "logon") & (F.datediff("last", "date") <= 7), 1))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    kinds = sum(F.max((c("source") == s).cast("int")) for s in ("logon", "email", "http"))
    return rows.groupBy("user").agg(
        F.log1p(F.count(F.lit(1))).alias("log_total"), (kinds / 3).alias("kinds"), F.log1p(F.countDistinct("domain")).alias("log_domains"), F.log1p(F.countDistinct("pc")).alias("log_pcs"),
        safe(F.count(F.when(c("has_external_recipient"), 1)), of("email")).alias("external_ratio"), safe(F.count(F.when(c("is_sensitive"), 1)), of("http")).alias("sensitive_ratio"),
        safe(recent, of("logon")).alias("recent_logon_ratio"), safe(of("logon"), F.count(F.lit(1))).alias("logon_fraction"),
    )


def user_matrix(stats: DataFrame, traits: DataFrame | None = None, organisation: DataFrame | None = None, activity: DataFrame | None = None) -> DataFrame:
    """user and its 85 numbers: 48 statistics padded to 64, 5 traits, 8 of the directory, 8 of activity; zeros where one is missing."""
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    doubles = lambda names: F.array(*[F.col(x).cast("double") for x in names])
    out = stats.select("user", F.concat(doubles(USER_STATS), zeros(64 - len(USER_STATS))).alias("a"))
    parts = [(traits, list("OCEAN"), 5, "b"), (organisation, None, 8, "c"), (activity, "log_total kinds log_domains log_pcs external_ratio sensitive_ratio recent_logon_ratio logon_fraction".split(), 8, "d")]
    for df, names, n, alias in parts:
        if df is None:
            out = out.withColumn(alias, zeros(n))
            continue
        if names is None:
            s, admin, manager = F.col("role_sensitivity").cast("double"), F.col("is_it_admin").cast("double"), F.col("is_manager").cast("double")
            vector = F.array(s, admin, manager, *[(s >= k).cast("double") for k in (3, 4, 5)], admin * s / 5, manager * s / 5)
        else:
            vector = doubles(names)
        out = out.join(df.select("user", vector.alias(alias)), "user", "left").withColumn(alias, F.coalesce(alias, zeros(n)))
    return out.select("user", F.concat("a", "b", "c", "d").alias("vector"))


def machine_gaps(events: DataFrame, by: list[str]) -> DataFrame:
    """by, days_active, and gap_mean and gap_std of the seconds between a machine's successive events.

    Gaps within a day are taken in windows of machine and day, so that a busy machine is spread over its days; the gap
    from a day's last event to the next one's first comes from one row a day. Sums are of whole seconds, and exact.
    """
    gap = timeops.seconds_between(F.lag("timestamp").over(Window.partitionBy(*by, "date").orderBy("timestamp", "id")), F.col("timestamp")).cast("decimal(18,0)")
    days = events.withColumn("gap", gap).groupBy(*by, "date").agg(
        F.count("gap").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).cast("decimal(38,0)").alias("q"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    over = timeops.seconds_between(F.lag("last").over(Window.partitionBy(*by).orderBy("first")), F.col("first")).cast("decimal(18,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    sums = days.withColumn("over", over).groupBy(*by).agg(
        F.count("date").alias("days_active"), (F.sum("n") + F.count("over")).cast("decimal(19,0)").alias("n"), (F.coalesce(F.sum("s"), zero) + F.coalesce(F.sum("over"), zero)).cast("decimal(19,0)").alias("s"),
        (F.coalesce(F.sum("q"), zero) + F.coalesce(F.sum(F.col("over") * F.col("over")), zero)).cast("decimal(19,0)").alias("q"),
    )
    n, spread = F.col("n").cast("double"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    known = lambda x: F.when(F.col("n") > 0, x).otherwise(0.0)
    return sums.select(*by, "days_active", known(F.col("s").cast("double") / n).alias("gap_mean"), known(F.sqrt(spread) / n).alias("gap_std"))


def pc_nodes(events: DataFrame) -> DataFrame:
    """For each machine: 12 numbers of access and 4 of its kind (shared, dedicated, busy, quiet)."""
    by = keyed(events, "pc")
    hour = F.hour("timestamp")
    base = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("user").alias("n_users"), event_share(F.col("is_after_hours")).alias("off_hours_ratio"),
        event_share(F.col("is_weekend")).alias("weekend_ratio"), F.avg(hour).alias("hour_mean"), F.stddev_pop(hour).alias("hour_std"), event_share(timeops.is_late_night(F.col("timestamp"))).alias("night_ratio"),
    )
    base = base.join(machine_gaps(events, by), by)
    base = base.withColumns({"events_per_user": F.col("n_events") / F.col("n_users"), "events_per_day": F.col("n_events") / F.col("days_active")})
    marks = [F.percentile("n_events", F.lit(p)).alias(x) for p, x in ((0.75, "p75"), (0.25, "p25"))]
    if "snapshot" in base.columns:
        out = base.join(base.groupBy("snapshot").agg(*marks), "snapshot")
    else:
        out = base.crossJoin(F.broadcast(base.agg(*marks)))  # one row
    flag = lambda x: x.cast("int")
    return out.withColumns(
        {"is_shared": flag(F.col("n_users") > 1), "is_dedicated": flag(F.col("n_users") == 1), "is_busy": flag(F.col("n_events") > F.col("p75")), "is_quiet": flag(F.col("n_events") < F.col("p25"))}
    ).drop("p75", "p25")


def domain_nodes(contacts: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """For each domain: log1p(users) / 10, and its most frequent category (ties to the first by name) with its place, -1 beyond the 31.

    contacts: (domain, user) of mail and web; categories: (domain, category).
    """
    users = contacts.where("domain IS NOT NULL").groupBy("domain").agg((F.log1p(F.countDistinct("user")) / 10).alias("contact_weight"), F.countDistinct("user").alias("contacts"))
    if categories is None:
        return users.withColumns({"category": F.lit(None).cast("string"), "category_place": F.lit(-1)})
    counts = categories.where("category IS NOT NULL").groupBy("domain", "category").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("domain").agg(F.min(F.struct(-F.col("n"), "category"))["category"].alias("category"))
    place = F.array_position(F.array(*map(F.lit, DOMAIN_CATEGORIES)), F.col("category")) - 1
    return users.join(top, "domain", "left").withColumn("category_place", F.coalesce(place, F.lit(-1)).cast("int"))


def one_hot(place: Column, size: int = len(DOMAIN_CATEGORIES)) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == place).cast("double"))


def edges_used_pc(events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """User to machine: log1p(n), recency, off-hours, weekend, log1p(seconds between first and last); weight n."""
    by = keyed(events, "user", "pc")
    if "snapshot" not in events.columns:
        events = events.crossJoin(F.broadcast(events.agg(F.max("date").alias("snapshot"))))  # one row
    out = events.groupBy(*by, *([] if "snapshot" in by else ["snapshot"])).agg(
        F.count(F.lit(1)).alias("n"), F.datediff("snapshot", F.max("date")).alias("age"), event_share(F.col("is_after_hours")).alias("off_hours"), event_share(F.col("is_weekend")).alias("weekend"),
        F.log1p(timeops.seconds_between(F.min("timestamp"), F.max("timestamp")).cast("double")).alias("log_seconds"),
    )
    recency = (days - F.least(F.greatest("age", F.lit(0)), F.lit(days))) / days
    return out.select(*by, F.log1p(F.col("n").cast("double")).alias("log_n"), recency.alias("recency"), "off_hours", "weekend", "log_seconds", F.col("n").alias("weight"))


def edges_sent_email(mail: DataFrame) -> DataFrame:
    by = keyed(mail, "user", "sender_domain")
    return mail.where("sender_domain IS NOT NULL").groupBy(*by).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("log_n"), (F.log1p(F.sum("size").cast("double")) / 20).alias("log_size"), (F.log1p(F.sum("attachments").cast("double")) / 15).alias("log_attachments"),
        event_share(F.col("has_external_recipient")).alias("external"), F.avg(off_hours(False)).alias("off_hours"), F.count(F.lit(1)).alias("weight"),
    )


def edges_browsed(web: DataFrame) -> DataFrame:
    by = keyed(web, "user", "domain")
    return web.where("domain IS NOT NULL").groupBy(*by).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("log_n"), event_share(F.col("is_sensitive")).alias("sensitive"), F.avg(off_hours(False)).alias("off_hours"), F.count(F.lit(1)).alias("weight")
    )


def edges_device_on(device: DataFrame) -> DataFrame:
    by = keyed(device, "user", "pc")
    seconds = timeops.seconds_between(F.min("timestamp"), F.max("timestamp")).cast("double")
    return device.groupBy(*by).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("log_n"), (F.log1p(seconds) / 10).alias("log_seconds"), F.count(F.lit(1)).alias("weight"))


def edges_shared_pc(events: DataFrame, block_users: int = BLOCK_USERS, numbers: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """User to user, both ways: machines that both used, and log1p of that (rounded to so many digits).

    numbers: (user, node), for the node numbers of both as user_node and user2_node; users without one have null.

    The product of the sparse user-by-machine matrix with its transpose, in blocks of users. A machine's users are listed
    by block, and each list goes to the pairs of blocks of which the machine has users. A task holds whole pairs of
    blocks: it numbers the machines that a pair of blocks shares, makes 64 of them a word of each user's bits, and counts
    the bits that two users share. Only where a pair of blocks shares more machines are counts of words added up. So
    pairs of users are never shuffled, and hardly ever grouped; a machine of many users is spread over as many tasks as
    it has pairs of blocks.
    """
    spark = events.sparkSession
    by, place = keyed(events, "pc"), keyed(events, "i", "j")
    used = events.select(*by, "user").where("pc IS NOT NULL AND user IS NOT NULL").distinct()
    blocks = max(1, -(-used.agg(F.approx_count_distinct("user")).first()[0] // block_users))
    if numbers is not None:
        used = used.join(numbers.select("user", F.col("node").alias("user_node")), "user", "left")
    user = F.struct(*used.drop(*by).columns)
    cells = used.withColumn("block", F.pmod(F.xxhash64("user"), F.lit(blocks))).groupBy(*by, "block").agg(F.collect_list(user).alias("users"))
    met = cells.groupBy(*by).agg(F.collect_list("block").alias("blocks"))
    sent = cells.join(met, by).withColumn("other", F.explode("blocks"))
    lower = F.col("block") <= F.col("other")
    sent = sent.select(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(lower, F.col("users")).alias("left"), F.when(F.col("block") >= F.col("other"), F.col("users")).alias("right"))
    # few rows are sent, and many come of them: not fewer tasks than partitions, and not many pairs of blocks in one
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * blocks // 16)
    tiles = sent.repartition(parts, *place).groupBy(*place, "pc").agg(F.first("left", True).alias("left"), F.first("right", True).alias("right"))
    one = Window.partitionBy(*place)
    tiles = tiles.withColumns({"n": F.row_number().over(one.orderBy("pc")) - 1, "machines": F.count(F.lit(1)).over(one)})

    def counted(some: DataFrame, *keys: str) -> DataFrame:
        """Pairs of users of a pair of blocks (and word), with the number of its machines that both used."""
        sides = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("left").alias("users")), F.struct(F.lit(False).alias("first"), F.col("right").alias("users"))))
        bits = some.select(*place, *keys, F.expr("shiftleft(1L, n % 64)").alias("bit"), sides.alias("side")).select(*place, *keys, "bit", "side.first", F.explode("side.users").alias("who"))
        masks = bits.groupBy(*place, *keys, "first", "who").agg(F.bit_or("bit").alias("mask"))
        member = F.struct("who.*", "mask")
        lists = masks.groupBy(*place, *keys).agg(F.collect_list(F.when(F.col("first"), member)).alias("left"), F.collect_list(F.when(~F.col("first"), member)).alias("right"))
        turned = F.when(F.expr("i = j"), F.array(F.struct("left", "right"))).otherwise(F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"))))
        # generated code holds all rows that come of one given row: a higher-order function ends it, so that these are one user's pairs
        lefts = F.explode(F.filter("t.left", lambda a: a["mask"] != 0))
        both = lists.select(*place, *keys, F.explode(turned).alias("t")).select(*place, *keys, "t.right", lefts.alias("a")).select(*place, *keys, "a", F.explode("right").alias("b"))
        return both.where("a.mask & b.mask <> 0 AND (i <> j OR a.user <> b.user)").withColumn("weight", F.bit_count(F.col("a.mask").bitwiseAND(F.col("b.mask"))))

    def told(pairs: DataFrame, log: Column) -> DataFrame:
        nodes = [] if numbers is None else [F.col("a.user_node").alias("user_node"), F.col("b.user_node").alias("user2_node")]
        return pairs.select(*keyed(events), F.col("a.user").alias("user"), F.col("b.user").alias("user2"), F.col("weight").cast("long").alias("weight"), log.alias("log_weight"), *nodes)

    rounded = lambda x: x if digits is None else F.round(x, digits)
    logs = F.array(*[rounded(F.log1p(F.lit(float(k)))) for k in range(65)])  # a constant: looked up, not worked out for each pair
    few = told(counted(tiles.where("machines <= 64")), F.get(logs, F.col("weight")))
    words = counted(tiles.where("machines > 64").withColumn("word", F.expr("n DIV 64")), "word")
    plain = [F.struct(*[F.col(f"{x}.{c}") for c in used.drop(*by).columns]).alias(x) for x in "ab"]
    summed = words.select(*place, *plain, "weight").groupBy(*place, "a", "b").agg(F.sum("weight").alias("weight"))
    return few.unionByName(told(summed, rounded(F.log1p(F.col("weight").cast("double")))))


def edges_monthly(events: DataFrame) -> DataFrame:
    """One used_pc edge an event, by month."""
    return events.select(F.trunc("date", "month").alias("month"), "user", "pc")


def email_graph(mail: DataFrame) -> DataFrame:
    """By month, undirected: sender and each recipient, with the number of mails. Recipients are split at ;"""
    from ..functions.text import recipients

    sent = mail.select(F.trunc("date", "month").alias("month"), F.trim("from").alias("a"), F.explode(recipients(F.col("to"))).alias("b")).where("a != b")
    return sent.groupBy("month", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
