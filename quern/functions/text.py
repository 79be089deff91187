"""Text rules as Column expressions: one definition each, used by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it, and a word, in a syntax that Java and RE2 share.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
WORD = r"[\p{L}\p{N}_]+"

# Words that carry no topic, for the query's stems and for the relevance filter.
STOP_WORDS = (
    "what", "is", "the", "are", "of", "in", "for", "to", "at", "and", "a", "an", "on",
    "tell", "me", "about", "can", "you", "does", "when", "where", "how", "do", "did",
    "college", "institute", "there", "any", "please", "give", "list",
    "my", "your", "our", "i", "we", "he", "she", "it", "they", "them", "his", "her",
    "their", "know", "knows", "knew", "remember", "name", "names",
)
FILTER_STOP_WORDS = (
    "the", "and", "for", "with", "all", "need", "about", "tell", "list", "names", "what", "give", "please", "can", "you", "i", "how", "are", "is", "its",
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def count_tokens(text: Column) -> Column:
    """Conservative estimate: the larger of a quarter of the characters and 1.3 times the words, rounded down, plus 1.

    0 for a null or blank text. Doubles throughout, as a bare 1.3 would be a decimal.
    """
    bare = stripped(F.coalesce(text, F.lit("")))
    words = F.size(F.regexp_extract_all(bare, F.lit(rf"[^\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+"), F.lit(0)))
    estimate = F.floor(F.greatest(F.length(bare) / F.lit(4.0).cast("double"), words * F.lit(1.3).cast("double"))) + 1
    return F.when(F.length(bare) > 0, estimate.cast("int")).otherwise(F.lit(0))


def content_hash(text: Column) -> Column:
    """The registry's hash: ``sha256:`` and the digest; a null text hashes as an empty one."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def fingerprint(text: Column) -> Column:
    """Key of the vector cache."""
    return F.sha1(F.coalesce(text, F.lit("")))


def dedupe_key(text: Column) -> Column:
    """Digest under which chunks count as duplicates: lower case, white space collapsed."""
    return F.md5(F.lower(stripped(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " "))))


def clean_text(text: Column) -> Column:
    """Line feeds alone end lines, blanks and tabs are collapsed, at most one empty line in a row, ends stripped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return stripped(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_lines(text: Column) -> Column:
    """Lines stripped, and those of at most one character dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), stripped)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 1), "\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def singular(word: Column) -> Column:
    """One plural ``s`` less, but not of a short word or of ``ss``."""
    plural = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3)
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _number(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def query_stems(text: Column, extra_stop_words: tuple[str, ...] = ()) -> Column:
    """Stems by which a question is matched: no stop words, at least three letters or a number."""
    stop = F.array(*[F.lit(w) for w in (*STOP_WORDS, *extra_stop_words)])
    kept = F.filter(words(text), lambda w: ~F.array_contains(stop, w) & ((F.length(w) > 2) | _number(w)))
    return F.transform(kept, singular)


def rerank_terms(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) >= 3) | _number(w))


def filter_stems(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in FILTER_STOP_WORDS])
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z0-9_-]+"), F.lit(0))
    return F.transform(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~F.array_contains(stop, w)), singular)


def escaped(word: Column) -> Column:
    """A word as a pattern of itself."""
    return F.regexp_replace(word, r"([^\p{L}\p{N}_ ])", r"\\$1")


def prefix_hits(stems: Column, text: Column) -> Column:
    """Number of stems with which some word of ``text`` begins. The cheap test stands before the pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(stems, lambda s: F.contains(low, s) & F.rlike(low, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), escaped(s)))))


def part_hits(stems: Column, text: Column) -> Column:
    """Number of stems that occur anywhere in ``text``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(stems, lambda s: F.contains(low, s)))


def chunk_id(source: Column, key: Column, ordinal: Column, text: Column) -> Column:
    return F.concat_ws("::", source, F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 10), ordinal.cast("string"), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8))


def file_type(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def parsed_time(text: Column) -> Column:
    """A time written in one of three forms, else ISO; null if it is none."""
    head = F.substring(text, 1, 19)
    return F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text)
    )


def input_cut(text: Column, max_tokens: int = 2048) -> Column:
    """The text as an embedding request takes it: at most four characters for each token allowed."""
    return F.substring(text, 1, max_tokens * 4)
