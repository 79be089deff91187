"""Queries over texts and URLs, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions.guard import ABUSIVE, INJECTION, OFF_TOPIC, verdict
from quern.functions.vectors import fitted, hash_embedding, norm
from quern.operators import chunking, cleaning
from quern.operators.sessions import _REFERS, formatted_history, last_messages, messages_of, needs_history, rewritten
from quern.session import read_table

#: The site of the test data.
APEX = "velmora-institute.example"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def _site(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "vectors").where("source_type = 'website'").select("id", "text").distinct()


def token_counts(s, d):
    return _docs(s, d).select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


def text_hashes(s, d):
    c = F.col("text")
    return _docs(s, d).select("doc_id", T.content_hash(c).alias("content_hash"), T.fingerprint(c).alias("fp"), T.dedupe_key(c).alias("dedupe_key"), F.md5(F.substring(T.input_cut(c, 100), 1, 400)).alias("input_md5"))


def input_hashes(s, d):
    """Of what an embedding request takes; ``text_hashes`` states its ``input_md5`` for a cut of 100 tokens."""
    return _docs(s, d).select("doc_id", F.md5(T.input_cut(F.col("text"))).alias("input_md5"))


def clean_texts(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"), F.md5(T.clean_lines(F.col("text"))).alias("lines_md5"))


def title_stems(s, d):
    j = lambda c: F.array_join(c, " ")
    return _docs(s, d).select("doc_id", j(T.query_stems(F.col("title"))).alias("stems"), j(T.rerank_terms(F.col("title"))).alias("terms"), j(T.filter_stems(F.col("title"))).alias("filter_stems"))


def thin_pages(s, d):
    return cleaning.thin_pages(_docs(s, d), "text", 120).select("doc_id")


def boilerplate_lines(s, d):
    return cleaning.boilerplate_lines(_site(s, d), "id", "text", 0.02)


def boilerplate_stripped(s, d):
    return cleaning.without_boilerplate(_site(s, d), "id", "text", 0.02).select("id", F.md5("clean").alias("clean_md5"), "kept_original")


def consecutive_duplicates(s, d):
    return cleaning.consecutive_duplicates(read_table(s, d, "vectors").select("id", "text").distinct(), "id", "text")


def consecutive_events(s, d):
    """The same operator over texts that hold such lines: the events of each user, one to a line."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    logs = read_table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), "\n").alias("text"))
    return cleaning.consecutive_duplicates(logs, "user_id", "text")


def sentence_atoms(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(chunking.sentence_atoms(F.col("text"))).alias("pos", "atom"))


def chunks_recursive(s, d):
    return chunking.chunked(_docs(s, d).select("doc_id", "text"), "text", "recursive")


def chunks_packed(s, d):
    return chunking.chunked(_docs(s, d).select("doc_id", "text"), "text", "packed")


def chunk_store_rows(s, d):
    items = _docs(s, d).select(
        F.col("source").alias("source_id"), F.coalesce("title", F.lit("")).alias("source_name"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("item_key"), "text"
    )
    return chunking.chunk_rows(items).select("id", "source_id", "item_key", "ordinal", "tokens")


def url_checks(s, d):
    u = F.col("url")
    return (
        read_table(s, d, "crawl_state")
        .select("url")
        .distinct()
        .select("url", U.host(u).alias("host"), U.is_internal(u, APEX).alias("internal"), U.is_allowed(u, APEX).alias("allowed"), U.frontier_url(u).alias("frontier"), U.has_skipped_extension(u).alias("skipped"))
    )


def file_types(s, d):
    return read_table(s, d, "vectors").where("source_type = 'document'").select("source_name").distinct().select("source_name", T.file_type(F.col("source_name")).alias("file_type"))


def chunk_id_parts(s, d):
    c = lambda n: F.col(n)
    return read_table(s, d, "vectors").select("id", T.chunk_id(c("source_id"), c("item_key"), F.lit(1), c("text")).alias("made")).distinct()


def hash_embed_sparse(s, d):
    return hash_embedding(_docs(s, d), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def vector_norms(s, d):
    v = fitted(F.col("embedding"), 64)
    return read_table(s, d, "vectors").where("embedding is not null").select("id", F.size(v).alias("n"), F.round(norm(v), 5).alias("length")).distinct()


def _chats(s, d):
    return messages_of(_docs(s, d).where("doc_kind = 'chat'"), "doc_id", "text")


def chat_messages(s, d):
    return _chats(s, d)


def history_window(s, d):
    return last_messages(_chats(s, d), 4).select("session_id", "turn", "role", "message")


def heuristic_rewrite(s, d):
    return rewritten(_chats(s, d))


def history_text(s, d):
    return formatted_history(_chats(s, d))


def follow_ups(s, d):
    return _chats(s, d).where("role = 'user'").select("session_id", "turn", needs_history(F.col("message")).alias("needs_history"))


def guard_verdicts(s, d):
    return _docs(s, d).select("doc_id", verdict(F.col("text")).alias("verdict"))


WS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
NOT_WS = r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    b = bare(f"coalesce({x}, '')")
    return f"CASE WHEN length({b}) > 0 THEN (floor(greatest(length({b}) / 4.0::DOUBLE, len(regexp_extract_all({b}, '{NOT_WS}+')) * 1.3::DOUBLE)) + 1)::INT ELSE 0 END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words_sql(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def singular_sql(w: str) -> str:
    return f"CASE WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"


def stems_sql(x: str) -> str:
    kept = rf"list_filter({words_sql(x)}, lambda w: NOT list_contains({_list(T.STOP_WORDS)}, w) AND (length(w) > 2 OR regexp_full_match(w, '\p{{Nd}}+')))"
    return f"list_transform({kept}, lambda w: {singular_sql('w')})"


def terms_sql(x: str) -> str:
    return rf"list_filter({words_sql(x)}, lambda w: length(w) >= 3 OR regexp_full_match(w, '\p{{Nd}}+'))"


def filter_stems_sql(x: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-zA-Z0-9_-]+')"
    return f"list_transform(list_filter({found}, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_list(T.FILTER_STOP_WORDS)}, w)), lambda w: {singular_sql('w')})"


_LINES = r"string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10))"
_CLEAN = bare(r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")

_BOILER = rf"""
WITH p AS (SELECT DISTINCT id, text FROM vectors WHERE source_type = 'website'),
l AS (SELECT DISTINCT id, unnest(list_transform({_LINES}, lambda x: lower({bare('x')}))) AS line FROM p),
b AS (SELECT line, count(*) AS n_pages FROM l WHERE line <> '' AND length(line) <= 90 GROUP BY 1
      HAVING count(*) >= greatest(6, floor((SELECT count(*) FROM p) * 0.02::DOUBLE)))
"""

_STEP = (1 << 32) % 768
_HASHED = rf"""
WITH t AS (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)),
p AS (SELECT doc_id,
        list_reduce([0::BIGINT] || list_transform(range(4), lambda i: ('0x' || substr(md5(token), (i * 8 + 1)::INT, 8))::BIGINT), lambda a, b: (a * {_STEP} + b) % 768)::INT AS bucket,
        (CASE WHEN ('0x' || substr(md5(token), 31, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE / sqrt(pos) AS w FROM t),
q AS (SELECT doc_id, bucket, sum(w) AS w FROM p GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM q GROUP BY 1)
"""

CHATS_SQL = rf"""
l AS (SELECT doc_id AS session_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
      FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE doc_kind = 'chat')),
r AS (SELECT *, nullif(regexp_extract(line, '^\s*(user|assistant|system):', 1), '') AS role FROM l),
t AS (SELECT *, count(role) OVER (PARTITION BY session_id ORDER BY pos) AS turn FROM r),
m AS (SELECT session_id, turn, max(role) AS role,
        {bare(r"string_agg(regexp_replace(line, '^\s*(user|assistant|system):\s*', ''), chr(10) ORDER BY pos)")} AS message
      FROM t WHERE turn > 0 GROUP BY 1, 2)
"""

def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


#: Signs back to letters; runs of a character cut to two; separators between single letters dropped – by the characters, as
#: not every engine looks behind.
_GUARD = rf"""
WITH a AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS low FROM documents), b AS (SELECT *, translate(low, '@$01!3*', 'asoiie') AS plain FROM a), c AS (SELECT *, string_split(plain, '') AS cs FROM b),
e AS (SELECT *, array_to_string(list_filter(cs, lambda x, i: NOT (i > 2 AND x = cs[(i - 1)::INT] AND x = cs[(i - 2)::INT] AND x <> chr(10))), '') AS flat,
  array_to_string(list_filter(cs, lambda x, i: NOT (i > 1 AND contains(' ._-', x) AND {{w0}} AND {{w1}} AND NOT {{w2}} AND NOT {{w3}})), '') AS joined FROM c)
""".format(**{n: f"regexp_full_match(coalesce(cs[(i {d})::INT], ' '), '[A-Za-z0-9_]')" for n, d in (("w0", "- 1"), ("w1", "+ 1"), ("w3", "+ 2"))}, w2="(i > 2 AND regexp_full_match(cs[greatest(1, i - 2)::INT], '[A-Za-z0-9_]'))")

QUERIES = {
    "token_counts": token_counts, "text_hashes": text_hashes, "input_hashes": input_hashes, "clean_texts": clean_texts, "title_stems": title_stems, "thin_pages": thin_pages,
    "boilerplate_lines": boilerplate_lines, "boilerplate_stripped": boilerplate_stripped, "consecutive_duplicates": consecutive_duplicates, "consecutive_events": consecutive_events,
    "sentence_atoms": sentence_atoms, "chunks_recursive": chunks_recursive, "chunks_packed": chunks_packed, "chunk_store_rows": chunk_store_rows,
    "url_checks": url_checks, "file_types": file_types, "chunk_id_parts": chunk_id_parts, "hash_embed_sparse": hash_embed_sparse, "vector_norms": vector_norms,
    "chat_messages": chat_messages, "history_window": history_window, "heuristic_rewrite": heuristic_rewrite, "history_text": history_text, "follow_ups": follow_ups,
    "guard_verdicts": guard_verdicts,
}

_HOST = r"regexp_replace(nullif(lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), '^www\.', '')"
_PATH = r"lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_SKIP = "(" + "|".join(e.replace(".", r"\.") for e in U.SKIP_EXTENSIONS) + ")$"

ORACLE = {
    "token_counts": f"SELECT doc_id, {tokens_sql('text')} AS n_tokens FROM documents",
    "text_hashes": f"""SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, sha1(text) AS fp,
        md5(lower({bare(f"regexp_replace(text, '{WS}+', ' ', 'g')")})) AS dedupe_key, md5(left(text, 400)) AS input_md5 FROM documents""",
    "input_hashes": "SELECT doc_id, md5(left(text, 8192)) AS input_md5 FROM documents",
    "clean_texts": f"""SELECT doc_id, md5({_CLEAN}) AS clean_md5,
        md5(array_to_string(list_filter(list_transform({_LINES}, lambda x: {bare('x')}), lambda x: length(x) > 1), chr(10))) AS lines_md5 FROM documents""",
    "title_stems": f"""SELECT doc_id, array_to_string({stems_sql('title')}, ' ') AS stems, array_to_string({terms_sql('title')}, ' ') AS terms,
        array_to_string({filter_stems_sql('title')}, ' ') AS filter_stems FROM documents""",
    "thin_pages": f"SELECT doc_id FROM documents WHERE {tokens_sql('text')} < 120",
    "boilerplate_lines": _BOILER + "SELECT line, n_pages FROM b",
    "boilerplate_stripped": _BOILER
    + rf""", x AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT id, {_LINES} AS ls FROM p)),
      k AS (SELECT *, lower({bare('line')}) AS norm FROM x WHERE lower({bare('line')}) NOT IN (SELECT line FROM b)),
      g AS (SELECT *, lag(norm) OVER (PARTITION BY id ORDER BY pos) AS before FROM k),
      c AS (SELECT id, {bare("string_agg(line, chr(10) ORDER BY pos)")} AS clean FROM g WHERE norm = '' OR before IS NULL OR before <> norm GROUP BY 1),
      f AS (SELECT p.id, p.text, coalesce(c.clean, '') AS clean, length(coalesce(c.clean, '')) < greatest(200, floor(length(p.text) * 0.15::DOUBLE)) AS kept_original FROM p LEFT JOIN c USING (id))
      SELECT id, md5(CASE WHEN kept_original THEN text ELSE clean END) AS clean_md5, kept_original FROM f""",
    "guard_verdicts": _GUARD + f"""SELECT doc_id, CASE WHEN {_any('low', INJECTION)} THEN 'injection' WHEN {' OR '.join(_any(x, ABUSIVE) for x in ('low', 'plain', 'flat', 'joined'))} THEN 'abusive'
      WHEN {_any('low', OFF_TOPIC)} THEN 'off-topic' ELSE 'allowed' END AS verdict FROM e""",
    "consecutive_events": """WITH g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      SELECT user_id, pos::INT AS pos, event_type AS line FROM g WHERE event_type = before""",
    "consecutive_duplicates": rf"""
      WITH x AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls)))::INT AS pos FROM (SELECT DISTINCT id, {_LINES} AS ls FROM vectors)),
      g AS (SELECT *, lower({bare('line')}) AS norm, lag(lower({bare('line')})) OVER (PARTITION BY id ORDER BY pos) AS before FROM x)
      SELECT id, pos, line FROM g WHERE norm <> '' AND norm = before""",
    "sentence_atoms": rf"""
      WITH a AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(
          list_filter(list_transform(string_split(text, chr(10)), lambda x: {bare('x')}), lambda x: x <> ''),
          lambda x: string_split(regexp_replace(x, '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: {bare('x')}), lambda x: x <> '') AS atoms FROM documents)
      SELECT doc_id, unnest(range(len(atoms)))::INT AS pos, unnest(atoms) AS atom FROM a""",
    "url_checks": rf"""
      WITH u AS (SELECT DISTINCT url, {_HOST} AS host, {_PATH} AS path FROM crawl_state)
      SELECT url, host, host IS NULL OR host = '{APEX}' OR host LIKE '%.{APEX}' AS internal,
        coalesce(regexp_matches(url, '^\s*[hH][tT][tT][pP][sS]?://') AND host IS NOT NULL
          AND NOT regexp_matches(path, '\.(com|org|net|edu|gov|io)/') AND NOT regexp_matches(path, '{_SKIP}') AND (host = '{APEX}' OR host LIKE '%.{APEX}'), false) AS allowed,
        regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS frontier, regexp_matches(path, '{_SKIP}') AS skipped FROM u""",
    "file_types": """SELECT DISTINCT source_name, CASE WHEN contains(source_name, '.') THEN lower(string_split(source_name, '.')[-1]) ELSE CASE WHEN source_name IS NULL THEN '' ELSE '' END END AS file_type
        FROM vectors WHERE source_type = 'document'""",
    "chunk_id_parts": """SELECT DISTINCT id, source_id || '::' || left(md5(coalesce(item_key, '')), 10) || '::1::' || left(md5(text), 8) AS made FROM vectors""",
    "hash_embed_sparse": _HASHED + "SELECT doc_id, bucket, round(w / l, 6) AS weight FROM q JOIN n USING (doc_id) WHERE l > 0 AND w <> 0",
    "vector_norms": """SELECT DISTINCT id, 64 AS n, round(sqrt(list_sum(list_transform(list_resize(embedding, 64, 0::FLOAT)::DOUBLE[], lambda x: x * x))), 5) AS length
        FROM vectors WHERE embedding IS NOT NULL""",
    "chat_messages": f"WITH {CHATS_SQL} SELECT session_id, turn, role, message FROM m",
    "history_window": f"""WITH {CHATS_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM m)
        SELECT session_id, turn, role, message FROM w WHERE n <= 4""",
    "heuristic_rewrite": rf"""WITH {CHATS_SQL},
        n AS (SELECT *, count(*) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
        q AS (SELECT a.session_id, a.turn, a.message, a.before,
                (SELECT b.message FROM m b WHERE b.session_id = a.session_id AND b.role = 'user' AND b.turn < a.turn AND lower(b.message) <> lower(a.message) ORDER BY b.turn DESC LIMIT 1) AS prior
              FROM n a WHERE a.role = 'user')
        SELECT session_id, turn, message,
          CASE WHEN len(string_split_regex(message, '\s+')) < 6 AND before >= 2 AND message <> '' AND prior IS NOT NULL AND prior <> '' THEN message || ' (' || prior || ')' ELSE message END AS question FROM q""",
    "follow_ups": rf"""WITH {CHATS_SQL} SELECT session_id, turn, regexp_matches(message, '{_REFERS}') OR len({words_sql('message')}) <= 7 AS needs_history FROM m WHERE role = 'user'""",
    "history_text": rf"""WITH {CHATS_SQL}
        SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' || message ELSE 'Assistant: ' || regexp_replace(message, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g') END, chr(10) ORDER BY turn) AS history
        FROM m WHERE role IN ('user', 'assistant') GROUP BY 1""",
}
