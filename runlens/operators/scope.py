"""Who may see which workflow: membership resolution and the semi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roles that see every workflow.
UNRESTRICTED_ROLES = ["global:owner", "global:admin"]


@dataclass(frozen=True)
class Scope:
    """Visible workflow ids, or no restriction when ``visible`` is None."""

    visible: DataFrame | None = None
    reason: str = "unrestricted"

    @property
    def restricted(self) -> bool:
        return self.visible is not None

    def narrow(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose workflow the user may see.

        A semi-join: the set of one user is normally small enough for Spark to
        broadcast by its own size estimate; if it is not, the join shuffles and
        adaptive execution splits a hot workflow.
        """
        if self.visible is None:
            return df
        return df.join(self.visible, df[key] == self.visible["visible_workflow_id"], "left_semi")

    def allowed(self, ids: DataFrame, key: str = "workflow_id") -> DataFrame:
        """Visibility of a set of requested ids; an absent id is never visible."""
        if self.visible is None:
            return ids.withColumn("visible", F.lit(True))
        marked = self.visible.distinct().withColumn("_seen", F.lit(True))
        return (ids.join(marked, ids[key] == marked["visible_workflow_id"], "left")
                .withColumn("visible", F.coalesce("_seen", F.lit(False)))
                .drop("_seen", "visible_workflow_id"))


EVERYTHING = Scope()


def visible_workflows(shared_workflow: DataFrame, project_relation: DataFrame,
                      user_id: str) -> DataFrame:
    """Workflow ids reachable from a user through project membership, possibly more
    than once: semi-joins do not mind and are spared a shuffle."""
    mine = project_relation.filter(F.col("user_id") == user_id).select("project_id")
    return (shared_workflow.join(mine, "project_id", "left_semi")
            .select(F.col("workflow_id").alias("visible_workflow_id")))


def resolve_scope(shared_workflow: DataFrame, project_relation: DataFrame, *,
                  user_id: str | None, role: str | None = None) -> Scope:
    """Scope of one user.

    Global owners and admins see everything. So does everybody while no
    membership rows exist at all, because then there is nothing to enforce. In
    every other case membership decides, and a user without projects sees nothing.
    """
    if role in UNRESTRICTED_ROLES:
        return Scope(None, "global-role")
    if project_relation.limit(1).isEmpty():
        return Scope(None, "no-membership-data")
    return Scope(visible_workflows(shared_workflow, project_relation, user_id or ""),
                 "project-membership")


def access_graph(project: DataFrame | None, project_relation: DataFrame | None,
                 shared_workflow: DataFrame) -> dict[str, DataFrame] | None:
    """One shape for both source shapes of the access graph.

    Sources that share with a project are copied. Older sources share with a
    user directly; each such user gets a project of their own. None when the
    source has neither column, in which case the stored graph must be kept.
    """
    columns = set(shared_workflow.columns)
    if "project_id" in columns:
        graph = {
            "project": project.select("id", "name", "type"),
            "project_relation": project_relation.select("project_id", "user_id", "role"),
            "shared_workflow": shared_workflow.select("workflow_id", "project_id", "role"),
        }
    elif "user_id" in columns:
        users = shared_workflow.select("user_id").distinct()
        own = F.concat(F.lit("user:"), F.col("user_id"))
        graph = {
            "project": users.select(
                own.alias("id"),
                F.concat(F.lit("Personal ("), F.col("user_id"), F.lit(")")).alias("name"),
                F.lit("personal").alias("type")),
            "project_relation": users.select(
                own.alias("project_id"), "user_id",
                F.lit("project:personalOwner").alias("role")),
            "shared_workflow": shared_workflow.select(
                "workflow_id", own.alias("project_id"), "role"),
        }
    else:
        return None
    graph["project_relation"] = first_by_key(graph["project_relation"], ["project_id", "user_id"], "role")
    graph["shared_workflow"] = first_by_key(graph["shared_workflow"], ["workflow_id", "project_id"], "role")
    return graph


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order`` value. An aggregate,
    so repeats are folded before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))
