"""Rows behind pages and tools: entities, search with refs, clusters, admin lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.functions.text import clean_path, owner_of, short_display, source_url
from codeseam.operators import deps, graph, names, refs
from codeseam.operators.search import page
from codeseam.plans.querylang import valid_regex


def entity_rows(entities: DataFrame, repos: DataFrame, repo: str | None = None) -> DataFrame:
    """Entities with a clean path, the URL of their place (at the repository's
    branch, else main), a short form of it, and rank 0 where there is none; by path
    and line.  repos: (repo, url, branch)."""
    rows = entities if repo is None else entities.filter(F.col("repo") == repo)
    r = repos.select(F.col("repo").alias("r"), "url", F.coalesce("branch", F.lit("main")).alias("b"))
    rows = rows.join(r, rows.repo == r.r, "left").withColumn("path", clean_path(F.col("path")))
    url = source_url(F.col("url"), F.col("b"), F.col("path"), F.col("start_line"))
    out = rows.withColumn("source_url", url).withColumn("source_display", F.coalesce(short_display(url, F.col("repo")), F.col("repo")))
    return out.withColumn("rank", F.coalesce("rank", F.lit(0.0))).drop("r", "url", "b").orderBy("path", "start_line", "stable_id")


def by_id(entities: DataFrame, stable_id) -> DataFrame:
    return entities.filter(F.col("stable_id") == stable_id)


def methods_of(entities: DataFrame, parent: str, repo: str | None = None) -> DataFrame:
    """Methods of a class by its name, by line and name."""
    rows = entities.filter((F.col("parent") == parent) & F.col("kind").isin("function", "method"))
    rows = rows if repo is None else rows.filter(F.col("repo") == repo)
    return rows.orderBy("start_line", "name")


def lookup(entities: DataFrame, stable_id=None, name: str | None = None, repo: str | None = None) -> DataFrame:
    """One entity: by id, else the first of the name (in the repository)."""
    if stable_id is not None:
        return by_id(entities, stable_id).limit(1)
    rows = names.exact(entities, name or "")
    rows = rows if repo is None else rows.filter(F.col("repo") == repo)
    return rows.orderBy("path", "start_line", "stable_id").limit(1)


def hydrated(ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of ranked ids (stable_id, score), best first, ties by id."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "stable_id")  # the ranked ids are a top-k
    return entities.join(ranked.select("stable_id", "score").withColumn("position", F.row_number().over(w)), "stable_id").orderBy("position")


def counted(entities: DataFrame, repo: str | None = None, commit: str | None = None, kind: str | None = None, lang: str | None = None, least_chars: int | None = None) -> DataFrame:
    """The number (n) of those that all given filters leave."""
    rows = entities
    for column, value in (("repo", repo), ("commit", commit), ("kind", kind), ("lang", lang)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if least_chars is not None:
        rows = rows.filter(F.length("source_content") >= least_chars)
    return rows.agg(F.count("*").alias("n"))


def default_commits(branch_refs: DataFrame, repos: DataFrame) -> DataFrame:
    """repo, commit at the head of each default branch: the repository's own, else
    the first there is of main, master and trunk.  branch_refs: (repo, branch, target)."""
    names_ = F.array(F.col("branch"), F.lit("main"), F.lit("master"), F.lit("trunk"))
    cand = repos.select("repo", F.posexplode(names_).alias("p", "branch")).filter("branch IS NOT NULL")
    hits = cand.join(branch_refs, ["repo", "branch"])
    return hits.groupBy("repo").agg(F.min_by("target", "p").alias("commit"))


def on_default_branch(snapshots: DataFrame, commits: DataFrame) -> DataFrame:
    """Snapshots at a default branch's commit; the others are no targets of
    similarity across repositories."""
    return snapshots.join(commits.select("repo", "commit"), ["repo", "commit"], "left_semi")


def search_entities(entities: DataFrame, query: str, asked_refs: DataFrame, branch_refs: DataFrame, commits: DataFrame, snapshots: DataFrame, start: int = 0, limit: int = 50) -> DataFrame:
    """Name search in repositories, each at a ref (asked_refs: repo, raw_ref): the
    entities of the resolved snapshot, with resolved_commit and resolved_snapshot;
    entities without snapshot_id where none is known.  By rank; has_more."""
    at = refs.resolve_refs(asked_refs, branch_refs, commits, snapshots)
    at = at.select(F.col("repo").alias("r"), F.col("commit").alias("resolved_commit"), F.col("snapshot_id").alias("resolved_snapshot"))
    hits = entities.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    rows = hits.join(at, hits.repo == at.r).drop("r")
    rows = rows.filter(F.col("resolved_snapshot").isNull() | (F.col("snapshot_id") == F.col("resolved_snapshot")))
    return page(rows, [F.desc_nulls_last("rank"), "stable_id"], start, limit)


def cluster_listing(clusters: DataFrame, limit: int = 1000) -> DataFrame:
    return clusters.select("stable_id", "label", "summary", "member_repos").orderBy("stable_id").limit(limit)


def cluster_members(clusters: DataFrame, entities: DataFrame, stable_id: str) -> DataFrame:
    """member, type (cluster, entity or unknown), label, repo, commit of a cluster."""
    m = clusters.filter(F.col("stable_id") == stable_id).select(F.explode("members").alias("member"))
    c = clusters.select(F.col("stable_id").alias("member"), "label", F.lit("cluster").alias("c_type"))
    e = entities.select(F.col("stable_id").cast("string").alias("member"), "repo", "commit", F.lit("entity").alias("e_type")).dropDuplicates(["member"])
    rows = m.join(c, "member", "left").join(e, "member", "left")
    return rows.select("member", F.coalesce("c_type", "e_type", F.lit("unknown")).alias("type"), "label", "repo", "commit").orderBy("member")


def entity_page(entities: DataFrame, edges: DataFrame, stable_id, limit: int = 50) -> dict[str, DataFrame]:
    """An entity, its methods and its neighbours."""
    own = by_id(entities, stable_id)
    e = entities.join(own.select(F.col("repo").alias("o_repo"), F.col("path").alias("o_path"), F.col("name").alias("o_name")), (F.col("repo") == F.col("o_repo")) & (F.col("path") == F.col("o_path")) & (F.col("parent") == F.col("o_name")))
    return {"entity": own, "methods": e.drop("o_repo", "o_path", "o_name").orderBy("start_line", "name"), "graph": graph.entity_graph(edges, entities, stable_id, limit)}


def repo_page(entities: DataFrame, repos: DataFrame, repo: str) -> dict[str, DataFrame]:
    return {"summary": names.repo_summaries(entities.filter(F.col("repo") == repo)), "entities": entity_rows(entities, repos, repo)}


def call_graph(entities: DataFrame, edges: DataFrame, stable_id=None, name: str | None = None, repo: str | None = None, limit: int = 50) -> DataFrame:
    """relation, stable_id, name around the entity that ``lookup`` finds; one row
    decides, so its id is read on the driver."""
    hit = lookup(entities, stable_id, name, repo).select("stable_id").first()
    return graph.entity_graph(edges, entities, hit[0] if hit else None, limit)


def dependency_page(declared: DataFrame, components: DataFrame, asked: DataFrame, start: int = 0, limit: int = 100) -> DataFrame:
    rows = deps.repository_dependencies(declared, components, asked)
    return page(rows.withColumn("low", F.lower("name")), ["repo", "low", "version"], start, limit).drop("low")


# admin


def repo_listing(registry: DataFrame, branch_meta: DataFrame) -> DataFrame:
    """(name, url, branches, frequency) with branch_details, an array of (branch,
    last_indexed, last_duration_ms, status)."""
    b = branch_meta.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("branch", "last_indexed", "last_duration_ms", "status"))).alias("branch_details"))
    return registry.join(b, "name", "left").orderBy("name")


def lease_listing(leases: DataFrame, now) -> DataFrame:
    """(key: base64 of name|url|branch, holder, ttl seconds) -> repository, branch,
    holder, expires; keys that say something else are none."""
    parts = F.split(F.decode(F.unbase64(F.translate("key", "-_", "+/")), "UTF-8"), r"\|")
    ok = F.col("key").rlike("^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-]{2}==|[A-Za-z0-9_-]{3}=)?$")
    rows = leases.filter(ok).withColumn("p", parts).filter("size(p) >= 3")
    end = F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) + F.col("ttl"))
    return rows.select(F.col("p")[0].alias("repository"), F.col("p")[2].alias("branch"), "holder", F.when(F.col("ttl") > 0, F.date_format(end, "yyyy-MM-dd HH:mm:ss 'UTC'")).otherwise("Unknown").alias("expires")).orderBy("repository", "branch")


def node_listing(beats: DataFrame, now, max_age_seconds: int = 120) -> DataFrame:
    """(node_id, endpoint, ts) -> each node's last endpoint, and whether it is alive."""
    last = beats.groupBy("node_id").agg(F.max_by("endpoint", "ts").alias("endpoint"), F.max("ts").alias("last"))
    return last.select("node_id", "endpoint", "last", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") <= max_age_seconds).alias("alive")).orderBy("node_id")


def builder_listing(builders: DataFrame) -> DataFrame:
    return builders.withColumn("owner", owner_of(F.col("base_repo"))).orderBy("id")


def created(registry: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (name, url, branches, frequency): rows to add, with defaults (branches
    main, frequency 60), and refused ones with the reason: no name or url, a name
    or a URL that is taken, by the registry or by an earlier asked row."""
    a = asked.withColumn("nth", F.monotonically_increasing_id()).withColumn("name", F.trim("name")).withColumn("url", F.trim("url"))
    blank = F.coalesce(F.col("name"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("url"), F.lit("")).eqNullSafe("")
    first = lambda c: F.min(F.when(~blank, F.col("nth"))).over(Window.partitionBy(c)) != F.col("nth")
    a = a.withColumn("n2", first("name")).withColumn("u2", first("url"))
    a = a.join(registry.select("name", F.lit(True).alias("n1")).distinct(), "name", "left").join(registry.select("url", F.lit(True).alias("u1")).distinct(), "url", "left")
    yes = lambda *cs: F.coalesce(F.col(cs[0]), F.lit(False)) | F.coalesce(F.col(cs[1]), F.lit(False))
    why = F.when(blank, "name and url are needed").when(yes("n1", "n2"), "the name is taken").when(yes("u1", "u2"), "the url is taken")
    a = a.withColumn("error", why)
    branches = F.when(F.trim(F.coalesce("branches", F.lit(""))) == "", "main").otherwise(F.trim("branches"))
    ok = a.filter("error IS NULL").select("name", "url", branches.alias("branches"), F.coalesce("frequency", F.lit(60)).alias("frequency"))
    return ok, a.filter("error IS NOT NULL").select("name", "url", "error")


def deleted(registry: DataFrame, branches: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    """The registry and the branch rows without repositories of the names."""
    keep: Column = ~F.col("name").isin(*gone) if gone else F.lit(True)
    return registry.filter(keep), branches.filter(keep)


def valid_builder(builder: dict) -> list[str]:
    """What is wrong with a builder: a base repository is needed, its patterns are
    globs or regexes, its limit a positive number."""
    from codeseam.plans.querylang import is_glob

    out = [] if (builder.get("base_repo") or "").strip() else ["base_repo is needed"]
    for k in ("include_branches", "exclude_branches", "include_tags", "exclude_tags", "include_owner", "exclude_owner"):
        out += [f"{k}: {p!r} is no pattern" for p in builder.get(k) or () if not is_glob(p) and not valid_regex(p)]
    if not isinstance(builder.get("max_tags", 200), int) or builder.get("max_tags", 200) < 1:
        out.append("max_tags is a positive number")
    return out


def metrics_summary(files: DataFrame) -> DataFrame:
    """(name, json) of files db_metrics_<capacity>_<timeout>_<mode>.json -> a row each;
    a total that isn't given is the mean times the batches."""
    name = r"^db_metrics_(\d+)_(\d+)(?:_([^_.]+).*)?\.json$"
    part = lambda i: F.regexp_extract("name", name, i)
    m = F.from_json("json", "batches_sent long, entities_sent long, avg_batch_ms double, min_batch_ms double, max_batch_ms double, total_time_ms double, batch_failures long")
    rows = files.filter(F.col("name").rlike(name)).select("name", part(1).cast("int").alias("capacity"), part(2).cast("int").alias("timeout_ms"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("unknown")).alias("mode"), m.alias("m"))
    return rows.filter("m IS NOT NULL").select("name", "capacity", "timeout_ms", "mode", "m.*").withColumn("total_time_ms", F.coalesce("total_time_ms", F.col("avg_batch_ms") * F.col("batches_sent"))).orderBy("name")
