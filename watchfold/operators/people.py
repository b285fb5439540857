"""Directory and personality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpointed
from .shaping import latest


def latest_snapshot(directory: DataFrame) -> DataFrame:
    """Each user's last monthly row."""
    return latest(directory, "user", "snapshot_month", [c for c in directory.columns if c != "user"])


def with_group_sizes(directory: DataFrame) -> DataFrame:
    """Members of each department and team, by one aggregation each (not a row for each member in one window)."""
    dept = directory.groupBy("department").agg(F.countDistinct("user").alias("dept_size"))
    team = directory.groupBy("team").agg(F.countDistinct("user").alias("team_size"))
    return directory.join(dept, "department", "left").join(team, "team", "left")


def organisation(directory: DataFrame) -> DataFrame:
    """Organisational features of each user's last snapshot."""
    role = F.col("role")
    rows = with_group_sizes(checkpointed(latest_snapshot(directory))).withColumns(
        {"role_sensitivity": text.role_sensitivity(role), "role_level": text.role_level(role), "is_security_role": text.security_role(role), "is_management": text.management(role), "department_id": text.department_id(F.col("department"))}
        | text.role_flags(role)
    )
    s = F.col("role_sensitivity")
    return rows.withColumns({"access_level": text.access_level(s, F.col("dept_size"), F.col("team_size")), "access_level_small": text.access_level_small(s, F.col("team_size"))})


def changes(directory: DataFrame) -> DataFrame:
    """Different roles and departments of each user, less one."""
    return directory.groupBy("user").agg((F.countDistinct("role") - 1).alias("role_changes"), (F.countDistinct("department") - 1).alias("department_changes"))


def role_codes(directory: DataFrame) -> DataFrame:
    """role and its number in alphabetical order; roles are few."""
    from pyspark.sql import Window

    return directory.select("role").distinct().withColumn("role_id", F.dense_rank().over(Window.orderBy("role")) - 1)


def users_per_snapshot(directory: DataFrame) -> DataFrame:
    """The mean number of users of a month."""
    return directory.groupBy("snapshot_month").agg(F.countDistinct("user").alias("n")).agg(F.avg("n").alias("mean_users"), F.count(F.lit(1)).alias("snapshots"))


def personality(traits: DataFrame) -> DataFrame:
    """Trait shares, flags and both risks."""
    o, c, a, n = (F.col(x) for x in "OCAN")
    shares = text.trait_shares({f"{x}_share": F.col(x) for x in "OCEAN"})
    out = traits.withColumns(text.personality_flags(o, c, a, n) | shares | {"personality_risk": text.personality_risk(c, a, n)})
    return out.withColumn("trait_risk", text.trait_risk(F.col("C_share"), F.col("A_share"), F.col("N_share")))


def trait_means(traits: DataFrame) -> DataFrame:
    return traits.agg(*[F.avg(x).alias(f"mean_{x}") for x in "OCEAN"])
