"""Statistics, catalogues and histories of the stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import segment_title

#: Page categories by the first part of the path; a deployment brings its own rules, (category, words) in order.
CATEGORIES = (
    ("Departments & Academics", ("department", "engineering", "academic", "syllabus", "curriculum")),
    ("Admissions & Fees", ("admission", "fee", "eligibility", "quota", "seat")),
    ("Placements & Careers", ("placement", "recruit", "career", "training", "internship", "hiring")),
    ("Hostel & Campus Facilities", ("hostel", "mess", "library", "sport", "campus", "canteen", "transport")),
    ("Research & Conferences", ("research", "project", "conference", "publication", "patent", "journal")),
    ("Governance & About Us", ("govern", "trust", "principal", "leadership", "administration", "about")),
)
OTHER_CATEGORY = "General & Portals"


def store_stats(chunks: DataFrame, active: str) -> DataFrame:
    """One row: ``chunks, sources, spaces, tokens, stale``; stale chunks are those outside the active space."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct("source_id").alias("sources"),
        F.countDistinct("embed_provider").alias("spaces"),
        F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"),
        F.count_if(~F.col("embed_provider").eqNullSafe(F.lit(active))).alias("stale"),
    )


def source_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.countDistinct("item_key").alias("items"))


def registry_stats(registry: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tracked, chunks, tokens, failed, last_embedded`` of the registry, in all or by columns."""
    aggs = [
        F.count("*").alias("tracked"),
        F.sum(F.coalesce("chunk_count", F.lit(0))).cast("bigint").alias("chunks"),
        F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("last_embedded").alias("last_embedded"),
    ]
    return registry.groupBy(*by).agg(*aggs) if by else registry.agg(*aggs)


def provider_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce("embed_provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"))


def knowledge_stats(items: DataFrame, source: str, text: str) -> DataFrame:
    return items.agg(F.countDistinct(source).alias("sources"), F.count("*").alias("items"), F.sum(F.length(text)).alias("chars"))


def first_of_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def catalogue(chunks: DataFrame, samples: int = 5) -> DataFrame:
    """``source, items, chunks, chars, sample_ids``: the store by source, with its first chunks.

    A chunk without a source goes by its source's name, else by its key. Samples are limited before they are
    gathered; counting and sampling don't shuffle texts.
    """
    source = F.coalesce("source_id", "source_name", "item_key").alias("source")
    rows = chunks.select(source, "id", "item_key", F.length("text").alias("chars"))
    totals = rows.groupBy("source").agg(F.countDistinct("item_key").alias("items"), F.count("*").alias("chunks"), F.sum("chars").alias("chars"))
    first = first_of_group(rows.select("source", "id").distinct(), ["source"], [F.col("id")], samples)
    sample = first.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    return totals.join(sample, "source", "left")


def grand_totals(chunks: DataFrame) -> DataFrame:
    """Counts by provider and source type with all subtotals: ``provider, source_type, level, chunks``."""
    rows = chunks.select(F.coalesce("embed_provider", F.lit("unknown")).alias("provider"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"))
    return rows.rollup("provider", "source_type").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("chunks"))


def category(url: Column, title: Column, rules=CATEGORIES) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    chosen = None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(both, F.lit(w)) for w in words])
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise(OTHER_CATEGORY)


def page_categories(pages: DataFrame, rules=CATEGORIES) -> DataFrame:
    """``category, place, pages, chars`` in the rules' order; empty categories are left out."""
    order = F.array(*[F.lit(n) for n, _ in rules], F.lit(OTHER_CATEGORY))
    rows = pages.select(category(F.col("url"), F.col("title"), rules).alias("category"), F.col("length"))
    return rows.groupBy("category").agg(F.count("*").alias("pages"), F.sum(F.coalesce("length", F.lit(0))).cast("bigint").alias("chars")).withColumn("place", F.array_position(order, F.col("category")).cast("int"))


def clean_title(title: Column, url: Column, suffixes: tuple[str, ...] = (), generic: tuple[str, ...] = ("", "none", "null", "unknown", "about us", "about", "home", "welcome")) -> Column:
    """A page's title without site suffixes; for a generic one, what the last part of the URL says."""
    out = F.trim(F.coalesce(title, F.lit("")))
    for s in suffixes:
        out = F.when(out.endswith(s), F.trim(F.substring(out, F.lit(1), F.length(out) - len(s)))).otherwise(out)
    from_url = segment_title(url)
    return F.when(~F.lower(out).isin(*generic), out).when(from_url != "", from_url).otherwise(F.lit("Page"))


def chunk_estimate(n_chunks: Column, chars: Column) -> Column:
    """Chunks of a page, or an estimate from its length where none are counted."""
    return F.when(F.coalesce(n_chunks, F.lit(0)) > 0, n_chunks).otherwise(F.greatest(F.lit(1), F.floor(F.coalesce(chars, F.lit(0)) / 500).cast("int")))


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, of one key only those of the first source that has it, with ``priority``."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)])
    best = tagged.groupBy(key).agg(F.min("priority").alias("priority"))
    return tagged.join(best, [key, "priority"], "left_semi")


def merged_documents(sources: list[DataFrame]) -> DataFrame:
    """Documents (``id, name``) of several sources in order; a later one is dropped if its id or, without regard to
    case, its name is already there."""
    merged = sources[0].withColumn("priority", F.lit(0))
    for i, rows in enumerate(sources[1:], 1):
        new = rows.join(merged.select("id").distinct(), "id", "left_anti").withColumn("_name", F.lower("name"))
        new = new.join(merged.select(F.lower("name").alias("_name")).distinct(), "_name", "left_anti").drop("_name")
        merged = merged.unionByName(new.withColumn("priority", F.lit(i)))
    return merged


def document_listing(sources: list[DataFrame]) -> DataFrame:
    """``id, name, origin, unlisted``: documents of several sources in order of trust.

    Ids and names are one set of keys, trimmed and without case: a document is left out if either of its keys is one of an
    earlier source's, or of an earlier document of its own. ``origin`` is the number of its source, and ``unlisted`` says that the
    first source, the list that is kept, lacks it and is to get it. Documents with neither id nor name are none.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    listed: DataFrame | None = None
    keys: DataFrame | None = None
    for i, rows in enumerate(sources):
        new = rows.select("id", F.coalesce("name", "id").alias("name")).withColumn("_id", key("id")).withColumn("_name", key("name")).where("_id <> '' or _name <> ''")
        for c in ("_id", "_name"):
            if keys is not None:
                new = new.join(keys.select(F.col("k").alias(c)), c, "left_anti")
            first = Window.partitionBy(c).orderBy("_id", "id", "name")
            new = new.withColumn("_n", F.row_number().over(first)).where((F.col(c) == "") | (F.col("_n") == 1)).drop("_n")
        own = new.select(F.explode(F.array("_id", "_name")).alias("k")).where("k <> ''").distinct()
        out = new.select("id", "name", F.lit(i).alias("origin"), F.lit(i > 0).alias("unlisted"))
        listed, keys = (out, own) if listed is None else (listed.unionByName(out), keys.unionByName(own).distinct())
    return listed


def page_listing(sources: list[DataFrame], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``url, title, chars, chunks, category, origin``: pages of several sources in order of trust, as one list.

    ``sources``: ``url, title, chars, n_chunks``, any number of rows for a page. The first source that has a page gives its title;
    its length is the first there is; chunks are added up over all, and estimated from the length where none are counted.
    """
    tagged = reduce(DataFrame.unionByName, [s.select("url", "title", F.col("chars").cast("long").alias("chars"), F.col("n_chunks").cast("long").alias("n_chunks"), F.lit(i).alias("origin")) for i, s in enumerate(sources)])
    rows = tagged.where("url is not null and url <> ''")
    merged = rows.groupBy("url").agg(
        F.min(F.struct("origin", F.coalesce("title", F.lit("")).alias("t"))).alias("first"),
        F.min(F.when(F.col("chars") > 0, F.struct("origin", (-F.col("chars")).alias("c")))).alias("length"),
        F.sum(F.coalesce("n_chunks", F.lit(0))).alias("n"),
    )
    chars = F.coalesce(-F.col("length.c"), F.lit(0)).cast("long")
    title = clean_title(F.col("first.t"), F.col("url"), suffixes)
    listed = merged.select("url", title.alias("title"), chars.alias("chars"), F.when(F.col("n") > 0, F.col("n")).when(chars > 0, F.greatest(F.lit(1), F.floor(chars / 500))).otherwise(F.lit(0)).cast("long").alias("chunks"), F.col("first.origin").alias("origin"))
    return listed.withColumn("category", category(F.col("url"), F.col("title")))


def found_pages(pages: DataFrame, words: str) -> DataFrame:
    """Pages of a list whose title or URL holds the words asked for, without regard to case; all of them for none."""
    asked = F.lower(F.trim(F.lit(words)))
    return pages.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), asked) | F.contains(F.lower(F.coalesce("url", F.lit(""))), asked))


def last_runs(runs: DataFrame, pages: DataFrame, limit: int = 5) -> DataFrame:
    """``id, ts, n``: the last runs, latest first; where none is on record, one made up of the pages seen last."""
    legacy = pages.agg(F.max("last_seen").alias("ts"), F.count("*").alias("n")).where("ts is not null").select(F.lit("crawl-legacy").alias("id"), "ts", "n")
    known = runs.select(F.col("id").cast("string").alias("id"), "ts", "n").orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    nothing = known.agg(F.count("*").alias("_known"))  # one row
    return known.unionByName(legacy.crossJoin(F.broadcast(nothing)).where("_known = 0").drop("_known"))


def origin_counts(settings: DataFrame) -> DataFrame:
    """``origin, n``: how many settings come from each place."""
    return settings.groupBy("origin").agg(F.count("*").alias("n"))


def regrouped_text(chunks: DataFrame) -> DataFrame:
    """Texts of items from their chunks in the order of the ids' ordinals: ``source_id, item_key, text``.

    Repeated ids count once. Only items are gathered, whose chunks are few; a source never is.
    """
    ordinal = F.expr("try_cast(regexp_extract(id, '::([0-9]{1,9})::[^:]*$', 1) as int)")
    rows = chunks.where("item_key is not null and text is not null").select("source_id", "item_key", "id", "text").dropDuplicates(["source_id", "item_key", "id"])
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce(ordinal, F.lit(0)).alias("n"), "id", "text")))
    return rows.groupBy("source_id", "item_key").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def page_of(rows: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1, clamped to what there is) of the ordered rows, with ``position``."""
    total = max(1, -(-rows.count() // size))
    at = (min(max(1, number), total) - 1) * size
    cut = rows.orderBy(*order).offset(at).limit(size)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*order)) + at)


def run_log(runs: DataFrame, keep: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def repaired_status(history: DataFrame, running: DataFrame) -> DataFrame:
    """Rows left ``Processing`` by a run that is gone become ``Indexed`` or ``Interrupted``."""
    live = running.select("id").distinct().withColumn("_on", F.lit(True))
    stale = (F.col("status") == "Processing") & F.col("_on").isNull()
    return history.join(live, "id", "left").withColumn("status", F.when(stale, F.when(F.coalesce("chunk_count", F.lit(0)) > 0, "Indexed").otherwise("Interrupted")).otherwise(F.col("status"))).drop("_on")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int = 0) -> DataFrame:
    """``url, depth``: pages reached from ``seeds`` (``url``) over ``edges`` (``src, dst``) in at most ``max_depth`` steps.

    Breadth first, a join for each level; the visited set is written out between levels, so that lineage doesn't
    grow. ``limit`` stops before a level once that many pages are known.
    """
    from quern.session import materialise

    links = edges.where("src is not null and dst is not null").distinct()
    visited = materialise(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        frontier = visited.where(F.col("depth") == depth - 1)
        new = links.join(frontier, links["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        step = materialise(new.withColumn("depth", F.lit(depth)), "frontier")
        n = step.count()
        if not n:
            break
        visited = visited.unionByName(step)
        if limit and visited.count() >= limit:
            break
    return visited
