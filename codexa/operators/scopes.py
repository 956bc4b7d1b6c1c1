"""Users' own corpora: stamping, isolation, indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.session import cut


def scope_key(user: Column, project: Column) -> Column:
    return F.when(F.coalesce(user, F.lit("")) == "", "shared").otherwise(F.concat(F.lit("user:"), user, F.lit(":project:"), F.coalesce(project, F.lit(""))))


class Scoped:
    """The snapshot as one user's project sees it: every read is filtered, every write is stamped, whatever its rows say."""

    def __init__(self, nodes: DataFrame, user_id: str, project_id: str):
        self.nodes, self.user_id, self.project_id = nodes, user_id, project_id

    @property
    def mine(self) -> Column:
        return F.coalesce((F.col("user_id") == self.user_id) & (F.col("project_id") == self.project_id), F.lit(False))

    def read(self, where: Column | None = None) -> DataFrame:
        own = self.nodes.where(self.mine)
        return own if where is None else own.where(where)

    def upsert(self, new: DataFrame) -> DataFrame:
        stamped = new.withColumns({"user_id": F.lit(self.user_id), "project_id": F.lit(self.project_id)})
        return self.nodes.where(~self.mine).unionByName(self.read().join(stamped.select("id"), "id", "left_anti")).unionByName(stamped.select(*self.nodes.columns))

    def delete(self, where: Column) -> DataFrame:
        return self.nodes.where(~(self.mine & F.coalesce(where, F.lit(False))))


def index_counts(indices: DataFrame, nodes: DataFrame) -> DataFrame:
    """indices (user_id, project_id) with document_count, the number of their nodes."""
    n = nodes.where("user_id is not null").groupBy(F.col("user_id").alias("_u"), F.col("project_id").alias("_p")).agg(F.count("*").alias("document_count"))
    return indices.join(n, (F.col("user_id") == F.col("_u")) & (F.col("project_id") == F.col("_p")), "left").drop("_u", "_p").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def chains(links: DataFrame, longest: int = 32) -> DataFrame:
    """links (id, parent_id) -> (id, chain): the ids above, itself first, the nearest next, `longest` of them at most; a cycle ends where it closes. An id with several parents has the greatest.

    Chains are doubled: of 1, 2, 4 ... steps, each round joining every chain with the one that starts where it ends, so n steps take log n joins, and no recursion counts rows.
    """
    known = links.groupBy("id").agg(F.max("parent_id").alias("parent_id"))
    out = cut(known.select("id", F.array("id").alias("chain"), F.col("parent_id").alias("above")))
    size = 1
    while size < longest and not out.where("above is not null").isEmpty():
        upper = out.select(F.col("id").alias("_id"), F.col("chain").alias("_chain"), F.col("above").alias("_above"))
        out = cut(out.join(upper, F.col("above") == F.col("_id"), "left").select("id", F.concat("chain", F.coalesce("_chain", F.array().cast(upper.schema["_chain"].dataType))).alias("chain"), F.col("_above").alias("above")))
        size *= 2
    # up to the first id that has come before
    new = F.filter(F.sequence(F.lit(1), F.size("chain")), lambda k: F.array_position("chain", F.element_at("chain", k)) < k)
    upto = F.coalesce(F.array_min(new) - 1, F.size("chain"))
    return out.select("id", F.slice("chain", 1, F.least(upto, F.lit(longest))).alias("chain"))


def would_cycle(links: DataFrame, child: str, parent: str) -> bool:
    """Whether putting child below parent would close a circle."""
    return child == parent or not chains(links).where((F.col("id") == parent) & F.array_contains("chain", child)).isEmpty()


def merge_legacy(registry: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """Both registries, the newer one's entry where they share a key; merging again changes nothing."""
    return registry.unionByName(legacy.join(registry.select(*keys), keys, "left_anti").dropDuplicates(keys))


def project_of_scenarios(requests: DataFrame, scenarios: DataFrame) -> DataFrame:
    """requests (.., scenario_id string) with found_project, by scenarios (scenario_id, project_id), and scenario_error: a scenario must be a positive integer, be known and have a project. A request without a scenario has neither."""
    sid = F.btrim(F.coalesce("scenario_id", F.lit("")))
    number = F.when(sid.rlike("^[0-9]+$"), F.expr("try_cast(btrim(scenario_id) as bigint)"))
    s = scenarios.select(F.col("scenario_id").cast("bigint").alias("_s"), F.col("project_id").cast("string").alias("_p"), F.lit(True).alias("_known"))
    j = requests.withColumn("_n", number).join(s, F.col("_n") == F.col("_s"), "left")
    error = F.when(F.col("scenario_id").isNull(), None).when(F.coalesce(F.col("_n") <= 0, F.lit(True)), "scenario_id must be a positive integer").when(F.col("_known").isNull(), "no such scenario").when(F.col("_p").isNull(), "the scenario has no project")
    return j.select(*requests.columns, F.col("_p").alias("found_project"), error.alias("scenario_error"))


def validated(requests: DataFrame, scenarios: DataFrame, caller: str | None = "caller") -> DataFrame:
    """requests (user_id, project_id, scenario_id, and the authenticated caller) with owner, project and error: user data needs a caller, whom the body can't override, and a project or a scenario, whose project must be the one that is given."""
    r = project_of_scenarios(requests, scenarios)
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mine = given("user_id") | given("project_id") | given("scenario_id")
    who = F.col(caller) if caller is not None else F.col("user_id")
    error = (
        F.when(~mine, None)
        .when(F.coalesce(who, F.lit("")) == "", "user data needs an authenticated user")
        .when(given("user_id") & (F.col("user_id") != who), "another user's data can't be searched")
        .when(~given("project_id") & ~given("scenario_id"), "a user's documents are searched by project or scenario")
        .when(F.col("scenario_error").isNotNull(), F.col("scenario_error"))
        .when(given("project_id") & given("scenario_id") & (F.col("project_id") != F.col("found_project")), "project_id is not the scenario's project")
    )
    fine = mine & error.isNull()
    return r.withColumns({"owner": F.when(fine, who), "project": F.when(fine, F.coalesce("found_project", "project_id")), "error": error}).drop("found_project", "scenario_error")
