"""Whole-site crawls: many budgeted breadth-first traversals at once, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.urls import normalize_url, url_netloc
from sitegraph.operators.links import link_table
from sitegraph.operators.running import Running, number_rows, running
from sitegraph.session import bucketed, cut
from sitegraph.sources.snapshot import fetch, only

DEFAULT_BUDGET = 50
# Parents per numbering bucket; a bucket then holds the new links of at most this many pages.
_PARENTS = 1024
# Levels are unioned to know what was seen; after this many they are rewritten as one, so that plans stay short.
_COMPACT_EVERY = 16


def crawl_budget(max_pages: Column) -> Column:
    """NULL and 0 mean the default; a negative budget visits nothing."""
    return F.coalesce(F.nullif(max_pages, F.lit(0)), F.lit(DEFAULT_BUDGET)).cast("int")


def crawl_starts(tasks: DataFrame) -> DataFrame:
    """task_id, canonical start URL, host and budget of `tasks(task_id, url, max_pages)`."""
    return tasks.select(
        "task_id",
        normalize_url(F.col("url")).alias("start"),
        url_netloc(F.col("url")).alias("host"),
        crawl_budget(F.col("max_pages")).alias("budget"),
    )


def first_occurrence(candidates: DataFrame, keys: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """Earliest (parent_rank, pos) per key; `same` are numbers equal within a key.

    The place is one decimal with room for any two LONGs (38 digits), so the aggregate hashes instead
    of sorting.
    """
    half = "10000000000000000000BD"
    kind = candidates.schema["pos"].dataType.simpleString()
    place = f"cast(parent_rank AS decimal(19, 0)) * {half} + cast(pos AS decimal(19, 0))"
    first = candidates.groupBy(*keys).agg(
        F.expr(f"min({place})").alias("_place"), *[F.expr(f"min({c})").alias(c) for c in same]
    )
    return first.selectExpr(
        *keys, *same, f"_place div {half} AS parent_rank", f"cast(_place % {half} AS {kind}) AS pos"
    )


def frontier_minus_seen(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(seen.select(*keys), keys, "left_anti")


def bfs_rank(new: DataFrame) -> DataFrame:
    """Enqueue rank of the new URLs of each crawl, behind the `total` it has ranked so far.

    A single crawl could fill one task, so each is numbered in buckets of parents.
    """
    bucket = F.floor(F.col("parent_rank") / _PARENTS)
    placed = number_rows(new, ["start"], bucket, [F.col("parent_rank"), F.col("pos")], "_place")
    added = new.groupBy("start").agg(F.count(F.lit(1)).alias("_added"))
    return placed.join(added, "start").selectExpr(
        "start", "budget", "total + _added AS total", "url", "parent_rank", "total + _place AS rank", "depth"
    )


def expand_level(level: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate links of the affordable pages of a level, one row per crawl and URL.

    Pages are looked up once however many crawls reached them; only their links are then fanned
    out, which leaves AQE free to split a page that all crawls link to. The look-up finds the link
    table bucketed and sorted by URL, so only the wanted URLs are shuffled; either side may spill.
    """
    frontier = level.where("rank <= budget").select(
        "start", url_netloc(F.col("start")).alias("host"), "budget", "total", "url", F.col("rank").alias("parent_rank")
    )
    wanted = frontier.selectExpr("url AS src_url").distinct()
    links = edges.join(wanted, "src_url", "left_semi")
    reached = frontier.join(links, F.expr("url = src_url AND host = dst_host"))
    candidates = reached.selectExpr("start", "budget", "total", "dst_url AS url", "parent_rank", "pos")
    return first_occurrence(candidates, ["start", "url"], ("budget", "total"))


def rank_sites(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every URL each `start` discovers within its `budget`: start, url, rank, depth, parent_rank.

    Level-synchronous; the driver only learns how many rows a level has. Each level is ranked once
    and checkpointed with its ranks, so a lost executor costs at most the current level and no level
    is computed twice.
    """
    first = starts.selectExpr("start", "budget", "0L AS total", "start AS url", "0L AS parent_rank", "0 AS pos", "0 AS depth")
    # each level is ranked once; its checkpoint carries the ranks to the next level and to the result
    level = cut(bfs_rank(first))
    rows = level.count()
    seen = level.select("start", "url")
    done: list[DataFrame] = [level]
    depth = 0
    while rows > 0:
        depth += 1
        new = frontier_minus_seen(expand_level(level, edges), seen, ["start", "url"])
        level = cut(bfs_rank(cut(new.withColumn("depth", F.lit(depth)))))
        rows = level.count()
        if rows:
            done.append(level)
            seen = seen.union(level.select("start", "url"))
        if depth % _COMPACT_EVERY == 0:
            seen = cut(seen)  # the levels themselves are checkpoints already: their union stays a short plan
    return reduce(DataFrame.union, done).select("start", "url", "rank", "depth", "parent_rank")


def discover(
    tasks: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """Every URL each task discovers, with its enqueue rank; `visited` marks those in the budget.

    Tasks with one start differ only in how far they get, so each start is crawled once, with the
    largest budget asked for, and a task keeps what pages within its own budget discovered.
    """
    wanted = crawl_starts(tasks)
    starts = wanted.groupBy("start").agg(F.max("budget").alias("budget"))
    hosts = wanted.select(F.col("host").alias("dst_host")).distinct()
    if edges is None:
        # a crawl stays on its host, so only pages of the hosts asked for are read for links
        edges = link_table(only(snapshot, url_netloc(F.col("url")), hosts), unique)
    with bucketed(edges.join(hosts, "dst_host", "left_semi"), "edges", "src_url") as in_scope:
        ranked = rank_sites(starts, in_scope)
    mine = wanted.join(ranked, "start").where("parent_rank <= greatest(budget, 0)")
    return mine.selectExpr(
        "task_id", "url", "rank", "depth", "parent_rank", "budget", "rank <= budget AS visited"
    )


def default_hook(pages: DataFrame) -> DataFrame:
    """Per-page verdict without a server: every page with text is saved, empty ones are not offered."""
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("content_length") > 0, "saved")
    return pages.withColumns({"outcome": outcome, "reason": F.col("error")})


def visit(discovered: DataFrame, snapshot: DataFrame, unique: bool = False, hook=default_hook) -> DataFrame:
    return hook(fetch(discovered.where("visited").drop("visited"), snapshot, unique))


def crawl_all(
    tasks: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, unique: bool = False, hook=default_hook
) -> DataFrame:
    """Visited pages of budgeted whole-site crawls, in visit order by `rank`."""
    return visit(discover(tasks, snapshot, edges, unique), snapshot, unique, hook)


def crawl_totals(visited: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per task: pages crawled (errors included) and saved, errors, links found, elapsed time."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    pages = visited.select(
        "task_id",
        one.alias("pages_crawled"),
        F.when(F.col("outcome") == "saved", one).otherwise(zero).alias("pages_saved"),
        F.when(F.col("error").isNotNull(), one).otherwise(zero).alias("errors"),
        zero.alias("links_found"),
        F.coalesce(F.col("elapsed_ms"), zero).alias("elapsed_ms"),
    )
    links = discovered.select(
        "task_id",
        zero.alias("pages_crawled"),
        zero.alias("pages_saved"),
        zero.alias("errors"),
        one.alias("links_found"),
        zero.alias("elapsed_ms"),
    )
    names = ["pages_crawled", "pages_saved", "errors", "links_found", "elapsed_ms"]
    return (
        pages.unionByName(links)
        .groupBy("task_id")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("elapsed_seconds", elapsed_seconds(F.col("elapsed_ms")))
    )


def elapsed_seconds(ms: Column) -> Column:
    """Half-up to two places on the integer milliseconds."""
    return F.floor((ms + 5) / 10) / 100


def distinct_links(discovered: DataFrame) -> DataFrame:
    """Distinct same-host links per task, the start included; (task_id, url) is already unique."""
    return discovered.groupBy("task_id").agg(F.count("url").alias("links_found"))


def crawl_depth(visited: DataFrame) -> DataFrame:
    return visited.groupBy("task_id", "depth").agg(F.count(F.lit(1)).alias("pages"))


def undiscovered(discovered: DataFrame) -> DataFrame:
    """Links a task found but had no budget left to visit."""
    return discovered.where(~F.col("visited")).select("task_id", "url", "rank")


def discovered_union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).dropDuplicates(["task_id", "url"])


def progress_total(discovered: DataFrame) -> DataFrame:
    """After each visited page: done = its rank, total = what was found so far, within the budget."""
    parents = cut(discovered.groupBy("task_id", "parent_rank").agg(F.count(F.lit(1)).alias("_new")))
    bucket = (F.col("parent_rank") / _PARENTS).cast("long")
    so_far = running(parents, ["task_id"], bucket, [F.col("parent_rank")], [Running("_found", F.col("_new"))])
    # Pages without new links have no row of their own, so each row covers ranks up to the next.
    pages = discovered.where("visited").select("task_id", "url", "rank", "budget")
    marks = so_far.select("task_id", F.col("parent_rank").alias("rank"), "_found")
    both = cut(pages.join(marks, ["task_id", "rank"], "left").unionByName(
        marks.where("rank = 0"), allowMissingColumns=True
    ))
    filled = running(
        both,
        ["task_id"],
        (F.col("rank") / _PARENTS).cast("long"),
        [F.col("rank")],
        [Running("found", F.col("_found"), "max")],
    )
    return filled.where("rank > 0").select(
        "task_id",
        "url",
        F.col("rank").alias("done"),
        F.least(F.col("budget").cast("long"), F.col("found")).alias("total"),
    )
