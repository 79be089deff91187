"""Chunking, planning, stores, retrieval filters and sessions."""

import hashlib
import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.operators import chunking, cleaning, embedding, retrieval, sessions, store
from quern.operators import answers as said
from quern.operators.delta import crawl_diff, decide
from quern.plans.slices import commit_slices, first_misses, request_batches
from tests.compare import compare, connect
from tests.conftest import rows

LONG = "\n\n".join(f"Paragraph {i} " + "speaks of many things; and of others. " * (i % 23) for i in range(120))


def test_recursive_pieces():
    pieces = chunking.split_recursively(LONG, 2850, 418)
    assert all(len(p) <= 2850 for p in pieces)
    assert [w for w in LONG.split() if w not in " ".join(pieces).split()] == []
    at = 0
    for p in pieces:  # in order
        found = LONG.find(p[:60], max(0, at - 500))
        assert found >= 0
        at = found
    assert chunking.split_recursively("x" * 7000, 2850, 418)[0] == "x" * 2850


def test_chunks_have_no_small_tail():
    for cut in (chunking.recursive_chunks, chunking.packed_chunks):
        out = cut(LONG)
        assert len(out) > 5 and all(n >= 80 for _, n in out[1:])
        assert cut("") == [] and cut(None) == [] and cut(" \n") == []
    assert all(n <= 750 + 80 for _, n in chunking.packed_chunks(LONG))


def test_slices(spark):
    df = spark.createDataFrame([("a", 200), ("b", 100), ("c", 60), ("d", 40), ("e", 0), (None, 5)], "item_key string, n_chunks int")
    plan = lambda cap: {r["item_key"]: (r["slice"], r["state"]) for r in commit_slices(df, 150, cap).collect()}
    assert plan(0) == {"a": (0, "planned"), "b": (1, "planned"), "c": (1, "planned"), "d": (2, "planned"), "e": (None, "empty")}
    assert plan(250) == {"a": (0, "planned"), "b": (None, "deferred"), "c": (None, "deferred"), "d": (1, "planned"), "e": (None, "empty")}
    assert {k for k, v in plan(50).items() if v[1] == "deferred"} == {"b", "c", "d"}
    assert commit_slices(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [0, 1, 600, 20_000])
def test_slices_carry_the_count_through_all_items(spark, cap):
    g = random.Random(cap)
    sizes = [(f"k{i:05}", max(0, g.choice([0, 1, 2, 3, 7, g.randrange(1, 400)]))) for i in range(12_000)]
    want, at, held, used = {}, 0, 0, 0
    for key, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not n or (cap and used and used + n > cap):
            want[key] = (None, "deferred" if n else "empty")
            continue
        want[key], held, used = (at, "planned"), held + n, used + n
        if held >= 150:
            at, held = at + 1, 0
    got = commit_slices(spark.createDataFrame(sizes, "item_key string, n_chunks int"), 150, cap)
    assert {r["item_key"]: (r["slice"], r["state"]) for r in got.collect()} == want


@pytest.mark.parametrize(("n", "tokens", "sizes"), [(12, 2000, [10, 2]), (150, 10, [100, 50]), (10, 5000, [9, 1])])
def test_batches(spark, n, tokens, sizes):
    df = spark.createDataFrame([(i, tokens) for i in range(n)], "pos int, n_tokens int")
    assert [r["count"] for r in request_batches(df).groupBy("batch").count().orderBy("batch").collect()] == sizes


def test_input_hashes_see_all_that_is_embedded(spark, tmp_path):
    texts = ["é" * 400, "é" * 400 + "a", "é" * 8191 + "a", "é" * 8191 + "ab", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, x and hashlib.md5(x[:8192].encode()).hexdigest()) for i, x in enumerate(texts)]
    assert rows(entry.queries()["input_hashes"](spark, str(tmp_path))) == want


def test_misses(spark):
    texts = spark.createDataFrame([(0, "x", 5), (0, "x", 5), (1, "x", 5), (1, "y", 7), (1, "z", 9)], "slice int, fp string, n_tokens int")
    assert rows(first_misses(texts, spark.createDataFrame([("z",)], "fp string"))) == [(0, 10), (1, 7)]


def test_reasons(spark):
    fresh = spark.createDataFrame([("s", k, "h") for k in "abcdef"], "source_id string, item_key string, content_hash string")
    registry = spark.createDataFrame(
        [("s", "b", "old", ["i"], "indexed", "p"), ("s", "c", "h", [], "indexed", "p"), ("s", "d", "h", ["i"], "failed", "p"), ("s", "e", "h", ["i"], "indexed", "q"), ("s", "f", "h", ["i"], "unchanged", "p")],
        "source_id string, item_key string, content_hash string, chunk_ids array<string>, status string, embed_provider string",
    )
    got = dict(rows(decide(fresh, registry, "p"), "item_key", "reason"))
    assert got == {"a": "new", "b": "changed", "c": "no-vectors", "d": "previous-run-incomplete", "e": "embedding-model-changed", "f": "unchanged"}


def test_an_unreached_page_is_retained(spark):
    schema = "url string, title string, hash string"
    old = spark.createDataFrame([("u1", "t", "h"), ("u2", None, "h")], schema)
    probes = spark.createDataFrame([("u2", 410)], "url string, status int")
    assert rows(crawl_diff(old, old.limit(0), probes), "url", "change_type") == [("u1", "RETAINED"), ("u2", "DELETED")]
    assert crawl_diff(old, old.limit(0), probes.limit(0)).where("change_type = 'DELETED'").count() == 0


@pytest.mark.parametrize(("pages", "threshold"), [(10, 6), (100, 30)])
def test_boilerplate_threshold(spark, pages, threshold):
    body = "own words of the page " * 20
    data = [(i, f"{body}{i}\n" + ("Menu\n" if i < threshold else "") + ("Rare\n" if i < threshold - 1 else "")) for i in range(pages)]
    df = spark.createDataFrame(data, "k int, text string")
    assert rows(cleaning.boilerplate_lines(df, "k", "text")) == [("menu", threshold)]
    clean = dict(rows(cleaning.without_boilerplate(df, "k", "text"), "k", "clean"))
    assert "Menu" not in clean[0] and "Rare" in clean[0]
    assert cleaning.boilerplate_lines(df.limit(3), "k", "text").count() == 0


def test_store_append_modes(spark):
    schema = "id string, source_id string, item_key string, text string"
    live = spark.createDataFrame([("1", "a", "k", "Hello  World"), ("2", "b", "k", "other")], schema)
    new = spark.createDataFrame([("3", "a", "k", "hello world"), ("4", "a", "k", "new"), ("5", "a", "k", "NEW "), ("2", "b", "k", "changed")], schema)
    order = [F.col("id")]
    assert rows(store.append_update(live, new, order), "id") == [("1",), ("2",), ("4",)]
    assert rows(store.append_update(live, new, order, "replace", new.where("source_id = 'a'")), "id") == [("2",), ("3",), ("4",)]
    with pytest.raises(ValueError):
        store.append_update(live, new, order, "x")


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/t", keep=2)
    data = lambda: {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")}
    assert s.read() is None and s.version() == 0
    for n in (3, 4, 5):
        s.write(spark.range(n))
    assert s.read().count() == 5 and s.version() == 3 and s.versions() == [2, 3] and len(data()) == 2 and s.read(2).count() == 4
    s.delete(F.col("id") > 1)
    assert s.read().count() == 2
    before = data()
    s.append(spark.range(10, 12).withColumn("x", F.lit("new")))  # nothing is rewritten, and a new column is null before
    assert len(data() - before) == 1 and rows(s.read()) == [(0, None), (1, None), (10, "new"), (11, "new")]
    before = data()
    s.upsert(spark.createDataFrame([(11, "y"), (12, "z")], "id long, x string"), ["id"])
    assert rows(s.read()) == [(0, None), (1, None), (10, "new"), (11, "y"), (12, "z")]
    assert len(data() & before) >= 1  # the folder without these keys stayed
    s.delete(F.col("id") > 99)
    at = s.version()
    for _ in range(2):  # a batch that is repeated changes nothing
        s.append(spark.range(50, 51), batch=7)
    assert s.version() == at + 1 and s.read().count() == 6 and s.batch() == 7
    s.reset()
    assert s.read().count() == 0
    other = store.VersionedStore(spark, f"file://{tmp_path}/t")
    other.version = lambda: s.version() - 1  # a writer that has not seen the last version
    with pytest.raises(RuntimeError):
        other.append(spark.range(1))
    monkey = store.VersionedStore(spark, f"file://{tmp_path}/u")
    monkey.MOST_FOLDERS = 3
    for n in range(5):
        monkey.append(spark.range(n, n + 1))
    assert monkey.read().count() == 5 and len(monkey._manifest(5)["folders"]) < 4


def test_only_lexical_hits_give_an_empty_pool(spark):
    q = spark.createDataFrame([(1, "hostel fees")], "query_id long, query string")
    chunks = spark.createDataFrame([("c", "s", "hostel fees", "k", "hostel fees", "hostel fees")], "id string, source_id string, source_name string, item_key string, text string, title string")
    found = retrieval.hybrid_candidates(q, chunks, spark.createDataFrame([], "query_id long, id string, dense double"))
    assert found.count() == 1 and retrieval.pool(found).count() == 0


def _matched(spark):
    import random

    g = random.Random(5)
    stems = ["hostel", "fees", "library", "placement", "alumni", "robotics"]
    queries = spark.createDataFrame([(i, " ".join(g.sample(stems, g.randint(1, 4)) + ["fees"] * (i % 2))) for i in range(12)], "query_id long, query string")
    data = [(f"c{i:04}", f"s{i % 3}", "hostel house" if i % 7 == 0 else None, f"k{i % 40}" if i % 9 else None, " ".join(w + g.choice(["", "s", "x"]) for w in g.sample(stems, g.randint(0, 6))), g.choice(stems + [None])) for i in range(1500)]
    chunks = spark.createDataFrame(data, "id string, source_id string, source_name string, item_key string, text string, title string").repartition(3)
    dense = spark.createDataFrame([(q, f"c{g.randrange(1500):04}", g.choice([0.2, 0.3, 0.5])) for q in range(11) for _ in range(30)], "query_id long, id string, dense double").dropDuplicates(["query_id", "id"])
    return queries, chunks, dense


def test_pool_of_cut_candidates(spark, monkeypatch):
    """Tasks that give only their best candidates lead to the same pool; few are held at once, and queries come in blocks."""
    queries, chunks, dense = _matched(spark)
    whole = retrieval.hybrid_candidates(queries, chunks, dense)
    want = rows(retrieval.pool(whole))
    for held, block in ((400_000, 100), (300, 5)):
        monkeypatch.setattr(retrieval, "HELD", held)
        monkeypatch.setattr(retrieval, "STEM_BLOCK", block)
        cut = retrieval.hybrid_candidates(queries, chunks, dense, retrieval.TOP_K)
        assert cut.count() < whole.count() / 5
        assert rows(retrieval.pool(cut)) == want and len(want) > 200


@pytest.mark.parametrize("name", ["hybrid_score", "retrieve_capped", "synthesis", "retrieve_dense_text"])
def test_texts_of_unique_chunks_are_not_shuffled_for_their_scores(spark, small, monkeypatch, name):
    """The chunks of the queries are unique when they are written; rows that aren't known to be are still made so."""
    given, whole = [], retrieval.text_scores
    monkeypatch.setattr(retrieval, "text_scores", lambda *a, **kw: given.append((a, whole(*a, **kw))) or given[-1][1])
    entry.queries()[name](spark, small)
    ((args, found),) = given
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()
    queries, chunks, *rest = args
    assert rows(found) == rows(whole(queries, chunks.unionByName(chunks), *rest)) != []


@pytest.mark.parametrize("near, items", [((0.5, 0.6), 40), ((0.16, 0.17, 0.19, 0.2, 0.21, 0.4), 40), ((0.16, 0.2, 0.5), 4)])
def test_dense_hits_keep_others_from_being_passed_on(spark, near, items):
    """What the dense hits of a query keep out of its pool isn't given: nothing but them, if the last that counts has 0.17. Few items fill no pool."""
    queries, chunks, _ = _matched(spark)
    g = random.Random(8)
    chunks = chunks.withColumn("item_key", F.concat(F.lit("k"), F.pmod(F.hash("id"), F.lit(items))))
    dense = spark.createDataFrame([(q, f"c{i:04}", g.choice(near)) for q in range(12) for i in g.sample(range(1500), 25 + 15 * (q % 2) - 20 * (q == 11))], "query_id long, id string, dense double")
    whole, cut = (retrieval.hybrid_candidates(queries, chunks, dense, k) for k in (None, retrieval.TOP_K))
    assert rows(retrieval.pool(cut)) == rows(retrieval.pool(whole)) != []
    if near == (0.5, 0.6):
        others = cut.where("dense = 0").groupBy("query_id").count()
        full = {q for q in range(12) if q % 2 and q != 11}  # 40 hits in 40 items: three of an item at most are 25 or more
        assert not full & {r["query_id"] for r in others.collect()}


def test_candidates_by_brute_force(spark):
    """All pairs, by plain Python, and none of them is shuffled."""
    import re

    queries, chunks, dense = _matched(spark)
    near = {(r[0], r[1]): r[2] for r in dense.collect()}
    want = []
    asked = queries.select("query_id", retrieval.query_stems(F.col("query"))).collect()
    for c in chunks.collect():
        words = re.findall(r"\w+", c["text"].lower())
        title = f"{c['source_name'] or ''} {c['title'] or ''}".lower()
        for q, stems in asked:
            kw, hits, d = sum(any(w.startswith(s) for w in words) for s in stems), sum(s in title for s in stems), near.get((q, c["id"]), 0.0)
            if d > 0 or hits or kw >= 2 or (kw and len(stems) == 1 and len(stems[0]) >= 4):
                want.append((q, c["id"], kw, hits, d, round(d * 0.85 + min(kw * 0.025, 0.1) + min(hits * 0.035, 0.07), 4)))
    found = retrieval.hybrid_candidates(queries, chunks, dense)
    got = rows(found, "query_id", "id", "kw", "title_hits", "dense", "score")
    assert [x[:5] for x in got] == sorted((x[:5] for x in want), key=repr)
    assert {x[:2]: x[5] for x in got} == pytest.approx({x[:2]: x[5] for x in want}, abs=1.01e-4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan


@pytest.mark.parametrize("name", ["hybrid_score", "retrieve_capped", "relevance_filter", "citations", "synthesis"])
def test_queries_of_retrieval_keep_pairs_in_their_tasks(spark, tmp_path, monkeypatch, name):
    """Rows are those of the SQL; pools get cut candidates, a number that doesn't follow the pairs, and whole ones aren't shuffled."""
    queries, chunks, _ = _matched(spark)
    queries.select((F.col("query_id") * 100).alias("doc_id"), F.col("query").alias("title")).write.parquet(f"{tmp_path}/documents.parquet")
    of = F.create_map(F.lit("title"), "title", F.lit("section_title"), F.concat(F.lit("part "), F.col("item_key")))
    then = F.timestamp_seconds(F.lit(1_700_000_000) + F.abs(F.hash("id")) % 9000)
    vectors = chunks.withColumns({"metadata": of, "updated_at": then, "created_at": then, "embed_provider": F.lit("x"), "tokens": F.lit(1), "content_hash": F.md5("text")}).drop("title")
    vectors.write.parquet(f"{tmp_path}/vectors.parquet")
    given, whole = [], retrieval.hybrid_candidates
    monkeypatch.setattr(retrieval, "hybrid_candidates", lambda *a, **kw: given.append(whole(*a, **kw)) or given[-1])
    result = compare(spark, connect(str(tmp_path)), name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert " equal," in result, result
    (found,) = given
    if name == "hybrid_score":
        assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    else:
        assert found.count() <= 12 * (40 + retrieval.pool_size() * found.rdd.getNumPartitions()) < 12 * 1500 / 4


def test_scores_of_citations_are_rounded_as_in_sql(spark):
    """0.5095 is a little less than half-way as a double times 1,000, though not in decimal form."""
    hits = spark.createDataFrame([(i, "s", None, i / 10000) for i in range(15_000)], "query_id long, source_name string, section string, rerank_score double")
    got = rows(said.citations(hits), "query_id", "score")
    want = duckdb.sql("SELECT i, round(i::DOUBLE / 10000::DOUBLE, 3) FROM range(15000) r(i)").fetchall()
    assert dict(got) == dict(want) and dict(got)[5095] == 0.509


def test_rerank_score(spark):
    q = spark.createDataFrame([(1, "alpha beta gammas")], "query_id long, query string")
    text = "Alpha beta gammas are told of here, " + "at some length " * 5
    pooled = spark.createDataFrame([(1, "a", 0.6, 0.55, 1), (1, "b", 0.1, 0.1, 2)], "query_id long, id string, dense double, score double, pos int")
    chunks = spark.createDataFrame([("a", text, "alpha house", None, None, None), ("b", "x", "y", None, None, None)], "id string, text string, source_name string, section string, ts timestamp, time timestamp")
    got = dict(rows(retrieval.rerank(pooled, q, chunks), "id", "rerank_score"))
    assert got["a"] == pytest.approx(0.8225, abs=1e-4)
    assert got["b"] == pytest.approx((0.07 + 0.015) * 0.7, abs=1e-4)


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("admission", "admissions", "hostel", "placement", "library")], "word string")
    stems = spark.createDataFrame([("admissoin",), ("hostal",), ("hostel",), ("abc",), ("zzzzzz",)], "stem string")
    got = rows(retrieval.corrected_terms(stems, words), "stem", "place", "word")
    assert ("admissoin", 1, "admission") in got and ("hostal", 1, "hostel") in got
    assert {s for s, _, _ in got} == {"admissoin", "hostal"}


def test_event_streams_of_a_folder(spark, small, tmp_path):
    """A large table is a folder of files."""
    from quern.queries_retrieval import stream_sessions

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    assert rows(stream_sessions(spark, f"file://{tmp_path}")) == rows(stream_sessions(spark, small))


def test_event_streams_outlive_idle_users(spark, tmp_path):
    """The state of users who were idle for days is dropped by timer, and no row with it."""
    from quern.queries_retrieval import stream_sessions

    at = lambda h: datetime.fromtimestamp((h + 24) * 3600)
    ev = [(10, at(0), 1), (11, at(1), 1), (12, at(8), 1), (13, at(500), 2), (14, at(501), 2)]
    spark.createDataFrame(ev, "event_id long, ts timestamp, user_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    assert rows(stream_sessions(spark, f"file://{tmp_path}"), "event_id", "user_id", "session_no", "held") == [(10, 1, 0, 1), (11, 1, 0, 2), (12, 1, 1, 1), (13, 2, 0, 1), (14, 2, 0, 2)]


def test_event_streams_keep_old_and_unknown(spark, tmp_path):
    """Times before 1970, no time and no user: nothing is late in the first batch."""
    from quern.queries_retrieval import stream_sessions

    at = lambda h: datetime.fromtimestamp(h * 3600)
    ev = [(10, at(-30), 1), (11, at(0), 1), (12, None, 1), (13, at(1), None), (14, at(2), None), (15, None, 3)]
    spark.createDataFrame(ev, "event_id long, ts timestamp, user_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    assert rows(stream_sessions(spark, f"file://{tmp_path}"), "event_id", "user_id", "session_no", "held") == [(10, 1, 0, 1), (11, 1, 1, 1), (12, 1, 1, 2), (13, None, 0, 1), (14, None, 0, 2), (15, 3, 0, 1)]


def test_sessions_go_on_with_the_next_batch(spark, tmp_path):
    """Number and messages of a session come from the state; a batch that is done again changes nothing, written rows or state lost or not."""
    from quern.streaming.ingest import SessionWindow

    at = lambda h: datetime.fromtimestamp(h * 3600)
    batches = [
        [(1, at(0), 7), (2, at(5), 7), (3, None, 7), (4, at(1), None), (5, None, None), *((100 + i, at(i / 8), 9) for i in range(25))],
        [(6, at(11), 7), (7, at(18), 7), (8, at(4), None), (200, at(4), 9)],
        [(9, at(500), 8), (201, at(1), 9)],
        [(10, at(501), 7)],
    ]
    window = SessionWindow(spark, f"file://{tmp_path}/w")
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "event_id long, ts timestamp, user_id long")
        if n == 1:  # as if the run had failed between rows and state
            window.rows.append(window._numbered(df, window._kept()).withColumn("batch", F.lit(n).cast("long")), n)
        for _ in range(2):
            window.step(df, n)
    got = {r[0]: tuple(r)[1:] for r in window.read().select("event_id", "user_id", "session_no", "held").collect()}
    assert [got[100 + i] for i in range(25)] == [(9, 0, min(20, i + 1)) for i in range(25)] and len(got) == window.read().count() == 37
    assert {k: v for k, v in got.items() if k < 100} == {1: (7, 0, 1), 2: (7, 0, 2), 3: (7, 0, 3), 4: (None, 0, 1), 5: (None, 0, 2), 6: (7, 0, 4), 7: (7, 1, 1), 8: (None, 0, 3), 9: (8, 0, 1), 10: (7, 0, 1)}
    assert got[200] == got[201] == (9, 0, 20)  # what is late goes to the session under way
    # Users idle for four days are gone.
    assert rows(window.state.read(), "user_id", "event_id") == [(7, 10), (8, 9)]


def test_sessions(spark):
    at = lambda s: datetime.fromtimestamp(s)
    ev = spark.createDataFrame([(1, at(0)), (1, at(21600)), (1, at(43201)), (2, at(5)), (None, at(1))], "user_id long, ts timestamp")
    assert rows(sessions.sessions(ev, "user_id", "ts"), "user_id", "session_no", "n_events") == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


def test_rewrite(spark):
    m = spark.createDataFrame(
        [("s", 1, "user", "When does the library open?"), ("s", 2, "assistant", "At nine."), ("s", 3, "user", "and on Sunday?"), ("s", 4, "user", "And on Sunday?"), ("s", 5, "user", "what are the rules about borrowing books")],
        "session_id string, turn int, role string, message string",
    )
    got = dict(rows(sessions.rewritten(m), "turn", "question"))
    first = "When does the library open?"
    assert got == {1: first, 3: f"and on Sunday? ({first})", 4: f"And on Sunday? ({first})", 5: "what are the rules about borrowing books"}


def test_embed_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    out = embedding.embed_documents(df, embedding.LocalHashEmbedder(16))
    got = {r["id"]: list(r["embedding"]) for r in out.collect()}
    assert got[1] == got[2] and set(got) == {1, 2, 3} and not any(got[3])
    with pytest.raises(embedding.EmbeddingUnavailable):
        embedding.RemoteEmbedder("far:1").embed(["x"])


def test_answers(spark):
    hits = spark.createDataFrame(
        [(q, 1, "Dr. Ann Lee heads the library. Fees: 20 per year for members", "Library", "", "2") for q in (1, 2, 3)]
        + [(q, 2, "- Library hours: 9 to 17\nnothing\n(Library hours: 9 to 17", "Hours", None, "1") for q in (1, 2, 3)] + [(4, 1, None, None, None, None)],
        "query_id long, rank int, text string, source_name string, section string, time string",
    )
    asked = spark.createDataFrame([(1, "who heads the library"), (2, "list all about the library"), (3, "one line on the library"), (4, None), (5, "x")], "query_id long, query string")
    got = {r["query_id"]: r["answer"] for r in said.answers(hits, asked).collect()}
    assert got[1] == "**Library:**\n* **Dr. Ann** Lee heads the library. Fees: 20 per year for members"
    assert got[2] == got[1] + "\n\n**Hours:**\n* **Library hours**: 9 to 17"
    assert got[3] == "**Library**: Dr. Ann** Lee heads the library. Fees: 20 per year for members"
    assert got[4] == "" and 5 not in got
    assert said.answers(hits.limit(0), asked).count() == 0


def test_answer_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for term, title, want in (("cse", "Computer Science Engineering", True), ("abc", "Computer Science", False), ("coe", "College of Engineering", True), ("ce", "College of Engineering", True), ("eng", "College of Engineering", True), ("", "x", False)):
        assert one(said.title_matches(F.lit(term), F.lit(title))) is want
    wants = said.question_columns(spark.createDataFrame([(1, "give 3 points on fees"), (2, "briefly"), (3, "all the fees"), (4, "the 12"), (5, None)], "query_id int, query string"))
    assert [tuple(r)[2:4] for r in wants.orderBy("query_id").collect()] == [(3, 1), (4, 1), (50, 4), (8, 1), (8, 1)]
    assert wants.where("query_id = 4").first()["stems"] == ["the"]
    assert len(one(said.lines_of(F.lit("Prof. Smith teaches optics to the second year students here. " * 5)))) == 5
    assert one(said.lines_of(F.lit(None).cast("string"))) == []
    assert one(said.emphasised(F.lit("Fees: 20"))) == "* **Fees**: 20" and one(said.emphasised(F.lit("- "))) == ""
    assert one(said.without_greeting(F.lit("Hello! I would be happy to help. the library opens."))) == "The library opens."
    assert one(said.without_greeting(F.lit("Hello!"))) == "Hello!"


def test_slices_of_many_items_equal_the_plain_fold(spark):
    g = random.Random(12)
    items = [(f"i{i:05d}", g.choice([0, 1, 1, 2, 3, 7, 40, 149, 150, 151, 400])) for i in range(12_000)]
    for target, cap in ((150, 0), (150, 9_000), (7, 0)):
        at, held, used, want = 0, 0, 0, {}
        for key, n in sorted(items, key=lambda x: (-x[1], x[0])):
            if n == 0:
                want[key] = (None, "empty")
            elif cap and used and used + n > cap:
                want[key] = (None, "deferred")
            else:
                want[key], used, held = (at, "planned"), used + n, held + n
                if held >= target:
                    at, held = at + 1, 0
        got = {r["item_key"]: (r["slice"], r["state"]) for r in commit_slices(spark.createDataFrame(items, "item_key string, n_chunks int"), target, cap).collect()}
        assert got == want


def test_batches_of_lanes_equal_the_plain_fold(spark):
    g = random.Random(13)
    data = [(g.choice([None, "hot", "hot", "hot", "a", "b"]), i, g.choice([None, 0, 5, 90, 400])) for i in range(4000)]
    want = {}
    for lane in (None, "hot", "a", "b"):
        batch = texts = held = 0
        for _, i, n in (x for x in data if x[0] == lane):
            n = min(n or 0, 300)
            if texts and (texts >= 20 or held + n > 1000):
                batch, texts, held = batch + 1, 0, 0
            texts, held = texts + 1, held + n
            want[i] = batch
    df = spark.createDataFrame(data, "lane string, pos long, n_tokens int")
    assert {r["pos"]: r["batch"] for r in request_batches(df, 20, 1000, 300, "lane").collect()} == want
    assert request_batches(df.limit(0), lane="lane").count() == 0 and request_batches(df.limit(0)).count() == 0
