"""The main body of pages, by minimum-cut labelling.

Every non-blank line of a page is a node. A classifier gives its log-odds of being boilerplate – menus, paths,
consent notices, side boxes, teasers, prompts to share, footers – which become the capacities to the two
terminals. Lines that stand together are tied by edges: adjacent lines, more so if they look alike or continue
each other's sentence and less across a blank line; and siblings, lines of one block with the same shape that
have one other line between them. The minimum cut is the labelling with the least total cost; so a teaser
without any mark of its own goes with the side box it stands in, and a short heading with its paragraph.

The classifier has two parts: structure (weights below, in log-odds), among it the number of pages that hold
the same line, counted over the whole collection; and words, a naive Bayes fitted on the lines of a bounded sample of
pages of which structure alone is sure. Words are counted where the pages are; only sums come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: Pages on whose lines the word classifier is fitted, about (a sample by hash where there are more).
SAMPLE_PAGES = 3200
#: A line is hot from this part of all lines on; so there are at most so many hot lines.
HOT_PARTS = 10_000
#: Lines that a task labels, about.
TASK_LINES = 20_000

# Phrases that stand alone on a line of a page's surroundings, in the languages of the collection.
_LABELS = {
    "menu", "search", "login", "log in", "login / register", "sign in", "register", "a- a a+", "toggle navigation", "skip to main content", "skip to content", "navigation",
    "view all", "more", "read more", "show more", "you may also like", "related pages", "latest news", "notice board", "upcoming", "quick links", "share this page", "share", "print",
    "back to top", "top", "subscribe to our newsletter", "like this page? tell a friend!", "accept all", "accept", "reject", "reject all", "manage preferences", "ok, got it", "ok", "save my choices",
    "home", "about us", "contact", "contact us", "sitemap", "imprint", "privacy policy", "terms of use", "downloads", "gallery", "careers", "alumni", "student login", "exam cell", "campus life", "placements", "hostel", "departments", "library", "research", "admissions",
    "startseite", "über uns", "kontakt", "suche", "anmelden", "nach oben", "seite teilen", "verwandte seiten", "aktuelles", "alle akzeptieren", "nur notwendige", "folgen sie uns", "fachbereiche", "bibliothek", "forschung", "zulassung", "wohnheim", "alle anzeigen", "mehr", "das könnte sie auch interessieren",
    "accueil", "à propos", "connexion", "recherche", "haut de page", "partager cette page", "à lire aussi", "actualités", "liens utiles", "tout accepter", "tout refuser", "suivez-nous", "départements", "bibliothèque", "résidence", "tout voir", "voir tout",
    "inicio", "quiénes somos", "contacto", "acceso", "buscar", "volver arriba", "compartir esta página", "últimas noticias", "enlaces rápidos", "noticias", "síganos", "aceptar todo", "aceptar", "rechazar", "departamentos", "biblioteca", "investigación", "admisiones", "residencia", "ver todo", "también le puede interesar", "páginas relacionadas",
    "मुख्य पृष्ठ", "परिचय", "संपर्क", "खोज", "लॉगिन", "ऊपर जाएँ", "यह पृष्ठ साझा करें", "नवीनतम समाचार", "त्वरित लिंक", "हमसे जुड़ें", "स्वीकार करें", "विभाग", "पुस्तकालय", "अनुसंधान", "प्रवेश", "छात्रावास", "सभी देखें", "यह भी पढ़ें",
}
_FOOTER = re.compile(
    r"(?i)^(© ?\d{4}\b|copyright\b.{0,6}\d{4}|follow us\s*:|share\s*:|visitors\s*:\s*\d|last updated\s*:|zuletzt geändert\s*:|dernière mise à jour\s*:|última actualización\s*:|अंतिम अद्यतन\s*:|"
    r"best viewed\b|designed and maintained\b|powered by\b|like this page\b|subscribe to\b)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|सर्वाधिकार सुरक्षित|,\s*tel\.\s*[\d+-]"
)
_CONSENT = re.compile(
    r"(?i)\b(we use cookies|uses? cookies|cookie policy|optional cookies|process usage data|withdraw consent|small files on your device|privacy (?:policy|statement|matters)|"
    r"verwenden cookies|datenschutzerklärung|utilise des cookies|utilisons des cookies|utilizamos cookies|nutzen cookies|politique de confidentialité|usamos cookies|utiliza cookies|política de privacidad|terms of use)\b|कुकीज़ का उपयोग|गोपनीयता नीति"
)
_CUT_SHORT = re.compile(r"(?i)(…|\.\.\.|\[…\]|\[\.\.\.\]|read more|more »|\(new\)|weiterlesen( »)?|mehr »|lire la suite( »)?|leer más( »)?|ver más( »)?|और पढ़ें( »)?|\(neu\)|\(nouveau\)|\(nuevo\)|\(नया\))$")
_TAGS = re.compile(r"(?i)^(tags?|filed under|categor(?:y|ies)|posted (?:in|by|on)|labels?|keywords|topics|schlagwörter|abgelegt unter|kategorien?|étiquettes|mots-clés|classé dans|catégories?|etiquetas|archivado en|categorías?|टैग|श्रेणी)\b\s*:?\s*\S|^# \S")
_DATED = re.compile(r"(?i)^\d{1,2}\.? (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mär|mai|okt|dez|janv|févr|mars|avr|juin|juil|août|sept|déc|ene|abr|ago|dic|जन|फ़?र|मार्च|अप्रैल|मई|जून|जुल|अग|सित|अक्|नव|दिस)[^\W\d_]*\.? \S")
_LABELLED = re.compile(r"^[^\W\d_]\w*(?: \w+)?: \S+(?: \S+){0,4}$")
_SENTENCE_END = re.compile(r"[.!?।][\"”’»)]*$")
_ITEM = re.compile(r"^(?:[*•-] \S|\d{1,3}\. \S|[QA]: )")
_LINK_MARK = re.compile(r"^[»›>→] ?\S")
_PATH = re.compile(r" (?:>|»|›|/|→|::) ")
_BAR = re.compile(r"\s*[|·•]\s+|\s{2,}[|·]\s*| \| ")
_COLUMNS = re.compile(r"\s{2,}|\s*[|·•]\s*")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")

#: Log-odds of the structural features.
WEIGHTS = {
    "bias": 0.0, "label": 3.5, "footer": 4.0, "consent": 2.5, "cut_short": 4.5, "tags": 3.0, "dated": 1.5, "pager": 3.0, "path": 3.0, "path_to_title": 4.0, "bar": 2.5, "link_mark": 2.5,
    "repeated": 1.1, "sentence": -2.2, "long": -1.5, "item": -2.5, "title": -5.0, "lower": -1.5, "amount": -1.2, "phrase": -0.8, "long_phrase": -0.6, "labelled": -1.5,
}


def normal_line(line: str) -> str:
    """The form in which lines are counted: lower case, white space collapsed, each number as one digit."""
    return _DIGITS.sub("0", _SPACE.sub(" ", line).strip().lower())


def line_features(line: str, pages: int, title: str, after: str = "") -> dict[str, float]:
    """Structural features of a stripped line that stands on ``pages`` pages; ``after`` is the line below it."""
    flat = _SPACE.sub(" ", line)
    low = flat.lower()
    words = flat.split(" ")
    n, chars = len(words), len(flat)
    f: dict[str, float] = {"bias": 1.0}
    ends = bool(_SENTENCE_END.search(flat))
    footer = _FOOTER.search(flat)
    wrapped = after[:1].islower() and not ends and n >= 3  # the sentence goes on below
    open_phrase = n >= 6 and not ends and words[-1][:1].islower()  # a heading, or a sentence cut off
    consent = _CONSENT.search(flat) or (wrapped and _CONSENT.search(flat + " " + after))
    bare = low.strip("»›>→ ")
    columns = [p.lower() for p in _COLUMNS.split(line) if p]
    if bare in _LABELS or len(columns) > 1 and sum(p in _LABELS for p in columns) >= 0.6 * len(columns):
        f["label"] = 1.0
    if footer:
        f["footer"] = 1.0
    if consent:
        f["consent"] = 1.0
    if _CUT_SHORT.search(flat):
        f["cut_short"] = 1.0
    if _TAGS.match(flat) and not ends:
        f["tags"] = 1.0
    if _DATED.match(flat) and not ends and n <= 8:
        f["dated"] = 1.0
    if (flat[0] in "«‹←" and "»" not in flat) or (flat[-1] in "»›→" and "«" not in flat and not _CUT_SHORT.search(flat)):
        f["pager"] = 1.0
    parts = _PATH.split(flat)
    if len(parts) >= 2 and not f.get("label"):
        last = parts[-1].strip().lower()
        if title and last and (title.startswith(last) or last.startswith(title)):
            f["path_to_title"] = 1.0
        elif len(parts) >= 3 and all(len(p) <= 24 for p in parts[:-1]) and not any(c.isdigit() for c in flat):
            f["path"] = 1.0
    bar = [p for p in _BAR.split(flat) if p.strip()]
    digits = any(c.isdigit() for c in flat)
    if len(bar) >= 3 and not digits and all(len(p.split()) <= 3 for p in bar) and not _ITEM.match(flat):
        f["bar"] = 1.0 if len(bar) > 3 or pages > 2 else 0.4
    elif len(bar) == 2 and pages > 2 and not digits:
        f["bar"] = 0.6
    if _LINK_MARK.match(flat) and n <= 5:
        f["link_mark"] = 1.0
    if _ITEM.match(flat):
        f["item"] = 1.0
    if pages > 1:
        f["repeated"] = min(5.0, math.log2(pages)) * (0.3 if (wrapped or open_phrase or flat[0].islower()) and not consent and not footer else 0.5 if ends and n <= 6 else 1.0)
    if title and low == title:
        f["title"] = 1.0
    if not footer and not consent and not f.keys() & {"cut_short", "tags", "dated"}:
        if ends and n >= 4:
            f["sentence"] = 1.0
        elif ends:
            f["sentence"] = 0.5
        if chars > 120:
            f["long"] = 1.0
        if flat[0].islower():
            f["lower"] = 1.0
        if _LABELLED.match(flat) and "repeated" not in f:
            f["labelled"] = 1.0
        if re.search(r"[₹$€%]|\b\d+ seats\b|\broom \d|\bextension \d", flat):
            f["amount"] = 1.0
        if n >= 4 and "bar" not in f:
            f["phrase"] = 1.0
            if n >= 6:
                f["long_phrase"] = 1.0
    return f


class LineClassifier:
    """Log-odds of a line being boilerplate. ``words``: log-odds of words, fitted; may be empty."""

    def __init__(self, words: dict[str, float] | None = None, weights: dict[str, float] | None = None):
        self.words, self.weights = words or {}, weights or WEIGHTS

    def structure(self, line: str, pages: int, title: str, after: str = "") -> float:
        return sum(self.weights[k] * v for k, v in line_features(line, pages, title, after).items())

    def log_odds(self, line: str, pages: int, title: str, after: str = "") -> float:
        known = [self.words[w] for w in _WORD.findall(line.lower()) if w in self.words] if self.words else ()
        lexical = max(-0.4, min(0.4, 0.5 * sum(known) / math.sqrt(len(known)))) if known else 0.0
        return self.structure(line, pages, title, after) + lexical


def _count_words(batches):
    """Of the lines whose structure alone leaves no doubt, how many hold each word: as content and as boilerplate. The row
    without a word has the sums."""
    plain = LineClassifier()
    for b in batches:
        counts: dict[str, list[int]] = {"": [0, 0]}
        for text, title, held in zip(*(b.column(c).to_pylist() for c in ("text", "title", "held"))):
            pages, name = {x["line_no"]: x["n"] for x in held or ()}, _SPACE.sub(" ", title or "").strip().lower()
            for number, line in enumerate(text.split("\n"), 1):
                bare = line.strip()
                if not bare:
                    continue
                s = plain.structure(bare, pages.get(number, 1), name)
                if abs(s) < 3 or _SPACE.sub(" ", bare).lower() == name:
                    continue  # a page's title is a teaser elsewhere
                found = set(_WORD.findall(bare.lower()))
                for w in found:
                    counts.setdefault(w, [0, 0])[s > 0] += 1
                counts[""][s > 0] += len(found)
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[w][0] for w in names], pa.int64()), pa.array([counts[w][1] for w in names], pa.int64())], names=["word", "content", "other"]
        )


def fit_words(pages: DataFrame) -> dict[str, float]:
    """Log-odds of words that at least five lines hold, from ``text, title, held`` of some pages."""
    sums = pages.select("text", "title", "held").mapInArrow(_count_words, "word string, content long, other long").groupBy("word").agg(F.sum("content").alias("a"), F.sum("other").alias("b"))
    rows = {r["word"]: (r["a"], r["b"]) for r in sums.where("word = '' or a + b >= 5").collect()}
    content, other = rows.pop("", (0, 0))
    if not content or not other:
        return {}
    return {w: math.log((b + 1) / (other + 100)) - math.log((a + 1) / (content + 100)) for w, (a, b) in sorted(rows.items())}


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: a node labelled true costs ``max(0, -unary)``, one labelled false
    ``max(0, unary)``, and an edge its capacity if its ends differ.

    Nodes whose own cost outweighs all their edges are settled first, which shifts the edges' costs to their
    neighbours and settles more; what is left is solved by maximum flow. Both steps are exact. A node with no
    preference at all is false.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(u[i]) < sum(near[i].values()) or (u[i] == 0 and near[i]):
            continue
        label[i] = u[i] > 0
        for j, c in near[i].items():
            u[j] += c if label[i] else -c
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow({i: u[i] for i in rest}, {i: near[i] for i in rest})):
            label[i] = side
    return [bool(x) for x in label]


def _flow(unary: dict[int, float], near: dict[int, dict[int, float]]) -> list[bool]:
    """Maximum flow by augmenting paths, one source node after the other; true is the source's side of the minimum cut.

    A path is looked for from the node outwards, so it ends at the nearest place with room. Where none is left,
    all that was reached stays on the source's side for good: no later path leads through it, as none leads out. So
    the time grows with a page's length, its edges being short.
    """
    residual = {i: dict(near[i]) for i in unary}
    room = {i: max(0.0, -x) for i, x in unary.items()}
    closed: set[int] = set()
    for s, left in unary.items():
        while left > 1e-12 and s not in closed:
            back: dict[int, int] = {s: s}
            queue, end = deque([s]), None
            while queue:
                i = queue.popleft()
                if room[i] > 1e-12:
                    end = i
                    break
                for j, c in residual[i].items():
                    if c > 1e-12 and j not in back and j not in closed:
                        back[j] = i
                        queue.append(j)
            if end is None:
                closed.update(back)
                break
            path, i = [], end
            while i != s:
                path.append((back[i], i))
                i = back[i]
            c = min([left, room[end], *(residual[a][b] for a, b in path)])
            left, room[end] = left - c, room[end] - c
            for a, b in path:
                residual[a][b] -= c
                residual[b][a] = residual[b].get(a, 0.0) + c
    return [i in closed for i in unary]


def _shape(line: str) -> int:
    """Coarse look of a line: 0 sentence or paragraph, 1 item, 2 heading or teaser, 3 label."""
    n = line.count(" ") + 1
    if _ITEM.match(line):
        return 1
    if _CUT_SHORT.search(line):
        return 2
    if len(line) > 120 or (_SENTENCE_END.search(line) and n >= 4):
        return 0
    return 2 if n >= 4 else 3


def page_edges(lines: list[str], at: list[int]) -> list[tuple[int, int, float]]:
    """Edges between the non-blank lines ``lines`` with line numbers ``at``."""
    shapes = [_shape(x) for x in lines]
    teaser = [bool(_CUT_SHORT.search(x)) for x in lines]
    edges = []
    for i in range(len(lines) - 1):
        a, b = lines[i], lines[i + 1]
        apart = at[i + 1] - at[i] > 1
        open_end = not _SENTENCE_END.search(a) and a[-1] not in ":?"
        tail = b.count(" ") < 3 and a.count(" ") >= 3 and _SENTENCE_END.search(b)
        if not apart and open_end and (b[:1].islower() or tail) and len(a) > 20:
            c = 3.0  # a wrapped sentence
        elif shapes[i] == shapes[i + 1] == 2 and (teaser[i] or teaser[i + 1]):
            c, apart = 1.4, False  # headings and the first words of what they lead to
        elif shapes[i] == shapes[i + 1]:
            c = 1.3
        elif {shapes[i], shapes[i + 1]} == {2, 3}:
            c = 1.2
        elif shapes[i] == 2 and shapes[i + 1] in (0, 1):
            c = 0.9  # a heading and what it heads
        else:
            c = 0.4
        edges.append((i, i + 1, c * (0.5 if apart else 1.0)))
        if i + 2 < len(lines) and shapes[i] == shapes[i + 2] and shapes[i] in (2, 3) and at[i + 2] - at[i] == 2:
            edges.append((i, i + 2, 0.5))
    return edges


def boilerplate_lines(text: str, held: dict[int, int], title: str | None, classifier: LineClassifier) -> list[int]:
    """Numbers, from 1, of the lines of a page that aren't its own content. ``held``: pages that hold each line."""
    numbered = [(i, x.strip()) for i, x in enumerate(text.split("\n"), 1)]
    numbered = [(i, x) for i, x in numbered if x]
    if not numbered:
        return []
    at, lines = [i for i, _ in numbered], [x for _, x in numbered]
    name = _SPACE.sub(" ", title or "").strip().lower()
    if not name:  # the path to the page names it too
        low = {_SPACE.sub(" ", x).lower() for x in lines}
        name = next((last for x in lines if len(parts := _PATH.split(_SPACE.sub(" ", x).lower())) > 1 and len(last := parts[-1].strip()) > 12 and last in low), "")
    below = [*lines[1:], ""]
    unary = [classifier.log_odds(x, held.get(i, 1), name, b) for (i, x), b in zip(numbered, below)]
    return [i for i, cut in zip(at, min_cut(unary, page_edges(lines, at))) if cut]


def _line_keys(batches):
    for b in batches:
        page, number, key = [], [], []
        for p, text in zip(b.column("page").to_pylist(), b.column("text").to_pylist()):
            for i, line in enumerate(text.split("\n"), 1):
                if low := normal_line(line):
                    page.append(p)
                    number.append(i)
                    key.append(low)
        yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(number, pa.int32()), pa.array(key, pa.string())], names=["page", "line_no", "line"])


def _label(classifier: LineClassifier):
    def run(batches):
        for b in batches:
            ids, numbers = [], []
            for key, text, title, held in zip(*(b.column(c).to_pylist() for c in ("id", "text", "title", "held"))):
                for n in boilerplate_lines(text, {x["line_no"]: x["n"] for x in held or ()}, title, classifier):
                    ids.append(key)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32())], names=["id", "line_no"])

    return run


def _pages(rows: DataFrame) -> DataFrame:
    """``page, id, text, title, held``: a row for each id, with the counts of its lines over all pages."""
    known = rows.where("id is not null and text is not null").withColumn("page", F.xxhash64("id"))
    keyed = known.select("page", "text").mapInArrow(_line_keys, "page long, line_no int, line string").select("page", "line_no", F.xxhash64("line").alias("key"))
    lines = materialise(keyed, "page-lines")  # counted, looked up and sampled: cut into lines once
    n_lines, parts = lines.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = lines.groupBy("key", "page").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    counts = materialise(counts, "line-counts")
    least_hot = max(1, n_lines // HOT_PARTS)
    hot, seldom = F.broadcast(counts.where(F.col("n") > least_hot)), counts.where(F.col("n") <= least_hot)
    met = lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(seldom, "key"))
    # Shuffled by page once, into as many parts as there are tasks' worth of lines: labelling costs time, not bytes.
    n = max(parts, min(n_lines // TASK_LINES, 100 * parts))
    own = known.repartition(n, "page").groupBy("page", "id").agg(F.max(F.struct("text", "title")).alias("v")).select("page", "id", "v.text", "v.title")
    held = met.repartition(n, "page").groupBy("page").agg(F.collect_set(F.struct("line_no", "n")).alias("held"))  # bounded by the lines of one page
    return own.join(held, "page", "left")


def page_boilerplate(rows: DataFrame) -> DataFrame:
    """``id, line_no`` of every non-blank line that isn't part of its page's own content, distinct.

    ``rows``: ``id, text, title``; other columns are ignored. Lines count from 1 after splitting at line feeds. A
    null id or text gives nothing, a null title is an unknown one, blank lines are never reported, and rows that
    repeat an id count once (of different texts under one id the greatest is taken). Texts are taken whole.
    """
    pages = _pages(rows.select("id", "text", "title"))
    n = max(1, rows.count())
    words = fit_words(pages.where(F.pmod("page", F.lit(1 << 20)) < F.lit(min(1 << 20, int((1 << 20) * SAMPLE_PAGES / n)))))
    return pages.select("id", "text", "title", "held").mapInArrow(_label(LineClassifier(words)), "id string, line_no int")


def main_content(rows: DataFrame) -> DataFrame:
    """``rows`` with ``main_text``: the text without its boilerplate lines; all rows and columns are kept.

    A column named ``main_text`` is replaced. A page of nothing but boilerplate comes out empty.
    """
    cut = page_boilerplate(rows).groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_cut"))
    base = rows.drop("main_text")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (l, i) -> _cut is null or not array_contains(_cut, i + 1)), '\\n')")
    return base.join(cut, base["id"] == cut["_id"], "left").withColumn("main_text", kept).drop("_id", "_cut")
