"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

A token is a tag, or a word, together with the path of containers around it. Its occurrence vector says how often it
stands on each of the host's pages. Tokens with equal vectors form an equivalence class. A class is valid if at least
half of the host's pages (and MIN_PAGES different ones) have it, it has two tokens or more, and its tokens come in the
same order wherever they occur; tokens out of order leave it. Valid classes nest by their paths into the host's
template; what lies between their tokens are its slots. The main slot is the best of the template's containers (an
article before a main part, a content block, the body). Its text, without boilerplate containers inside it, is the
page's main text. Blocks all of whose words are the template's go too where they stand outside of articles and main
parts, or anywhere in an element that may be boilerplate by one word of its name; such a name alone decides nothing
on a host with a template.

Vectors are compared by an exclusive-or of hashes over different pages. Most tokens stand on few pages; to keep them
from moving, a first pass counts, for each host, on how many pages some token falls into each of BUCKETS hash
buckets, and only tokens of buckets that reach half of the pages go on. Both passes add up what a task has of a host
before it moves, so a host with a third of all pages is a few rows of each task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, ship, table, text_slices

#: Elements that hold no main text, elements without content, and those that break a block.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea", "svg", "head", "title", "dialog", "menu", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "ul", "ol", "dl", "figure", "blockquote", "details"} | BOILERPLATE
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "hr", "figcaption", "address", "caption", "summary"}
#: Parts of class names, ids and roles that mark boilerplate and main content.
BOILERPLATE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "comment", "comments", "disqus", "share", "social", "related", "promo", "popup", "modal", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "login", "widget", "pagination", "toolbar", "complementary", "contentinfo", "search"}
CONTENT_NAMES = {"content", "article", "post", "entry", "story", "main", "text", "body"}
#: Words that make a name tell of a layout ("no-sidebar"), elements whose name never makes them
#: boilerplate, and those that an opening tag ends (a paragraph: that of any block).
LAYOUT_WORDS = {"no", "with", "without", "has", "have", "is", "hide", "show", "on", "off", "enabled", "disabled"}
SAFE = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: Different pages that a host needs for a template, and hash buckets of the first pass.
MIN_PAGES = 3
BUCKETS = 1024
#: Hosts whose page counts a task holds before it hands them on.
HELD_HOSTS = 2_000
#: Boilerplate elements that are ignored if nothing closes them.
UNCLOSED = {"noscript", "svg"}
#: Longest attributes whose label a worker keeps.
KEPT_CHARS = 200
LIMIT_HOSTS = 20_000
SALTS = 16

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


def _label(name: str, attributes: str) -> tuple[str, int]:
    """_read_label(); attributes that hold no class, id or role are not read, and short ones once for each worker."""
    low = attributes.lower()
    if low.isascii() and "class" not in low and "id" not in low and "role" not in low:
        attributes = ""
    return (_read_label if len(attributes) <= KEPT_CHARS else _read_label.__wrapped__)(name, attributes)


@lru_cache(maxsize=20_000)
def _read_label(name: str, attributes: str) -> tuple[str, int]:
    """(name with its class, id and role; grade: -1 boilerplate, -2 perhaps, 4 article, 3 main, 2 content, 1 body, else 0).

    A name all of whose words mark boilerplate does so for its element. One word of a longer name ("site-footer")
    leaves it open, and decides nothing for a layout ("no-sidebar"), a header of content ("article-header"), or an
    element that another name calls content.
    """
    found = sorted({(k.lower(), (a or b or c).strip()) for k, a, b, c in _NAMES.findall(attributes)}) if attributes else []
    parts = {w.lower() for _, v in found for w in _WORDS.findall(v)}
    label = name + "".join(f"[{k}={v}]" for k, v in found)
    if name in BOILERPLATE:
        return label, -1
    if parts & BOILERPLATE_NAMES and name not in SAFE:
        names = [{w.lower() for w in _WORDS.findall(one)} for _, v in found for one in v.split()]
        if any(n and n <= BOILERPLATE_NAMES for n in names):
            return label, -2 if name == "table" else -1
        clear = any(len(n) == 1 and n <= CONTENT_NAMES for n in names)
        if not clear and any(n & BOILERPLATE_NAMES and not n & LAYOUT_WORDS and not (n & CONTENT_NAMES and n & BOILERPLATE_NAMES == {"header"}) for n in names):
            return label, -2
    grade = {"article": 4, "main": 3, "body": 1}.get(name, 0)
    return label, grade or (2 if name in ("div", "section", "td") and parts & CONTENT_NAMES else 0)


#: What stands at a text: boilerplate, an article or main part (kept even if constant), an element that is perhaps
#: boilerplate by its name, or neither.
DROPPED, PLAIN, DOUBTFUL, KEPT = -1, 0, 2, 4


def walk(page: str, by_name: bool = True) -> Iterator[tuple[str, str, str, int, str]]:
    """(what, path, name, grade, text): 'open' and 'close' of containers, 'tag' of other elements, and 'text', whose
    grade is DROPPED, PLAIN, DOUBTFUL or KEPT.

    A closing tag without its opening one is ignored; one that skips open containers closes them too, and an open
    paragraph, item or cell ends where the next one begins. What is perhaps boilerplate by its name is so if that is to
    be told by_name, outside of articles and main parts; else its text is DOUBTFUL. A main part is no boilerplate by
    the names around it. Contents of scripts and the like are not walked.
    """
    stack: list[tuple[str, str, int, int]] = []
    last: dict[str, int] = {}
    path, grade, kind, at = "", 0, PLAIN, 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield "text", path, "", DROPPED if grade < 0 else kind, page[at : m.start()]
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if held is None:
                yield "tag", path, f"/{name}", grade, ""
                continue
            while len(stack) > held:
                stack.pop()
                yield "close", path, name, grade, ""
                path, grade, kind = stack[-1][1:] if stack else ("", 0, PLAIN)
            continue
        label, own = _label(name, m[4])
        while stack and name in ENDED_BY.get(stack[-1][0], ()):
            ended = stack.pop()[0]
            yield "close", path, ended, grade, ""
            path, grade, kind = stack[-1][1:] if stack else ("", 0, PLAIN)
        doubtful = own == -2
        if doubtful:
            own = -1 if by_name and kind != KEPT else 0
        if name in UNCLOSED and m.start() > last.setdefault(name, page.lower().rfind(f"</{name}") if name not in last else 0):
            continue
        if name in VOID or m[4].rstrip().endswith("/") or (name not in CONTAINERS and own >= 0 and not doubtful):
            yield "tag", path, name, grade, ""
            continue
        path, grade = f"{path}/{label}", own if grade >= 0 or (name == "main" and not any(s[0] in BOILERPLATE for s in stack)) else -1
        kind = KEPT if own >= 3 else DOUBTFUL if doubtful and not by_name else kind
        stack.append((name, path, grade, kind))
        yield "open", path, name, grade, ""
    if at < len(page):
        yield "text", path, "", DROPPED if grade < 0 else kind, page[at:]


_hash = xxhash.xxh64_intdigest


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=20_000)
def _seed(path: str) -> int:
    return _hash(path)


def word_token(seed: int, word: str) -> int:
    """The token of a word below the path with this seed."""
    return _signed(_hash(word, seed=seed))


def _tag(what: str, path: str, name: str) -> str:
    return f"{path}>" if what == "open" else f"{path}</" if what == "close" else f"{path}/{name}"


def buckets(page: str) -> set[int]:
    """The buckets of the page's tokens."""
    found = set()
    for what, path, name, _, text in walk(page):
        if what != "text":
            found.add(_seed(_tag(what, path, name)))
        elif path:
            found.update(map(_hash, text.split(), repeat(_seed(path))))
    return {t & (BUCKETS - 1) for t in found}


def tokens(page: str, allowed: list[bool] | None = None) -> dict[int, list]:
    """token -> [occurrences, first position, grade (of containers), characters of text right inside, name (of tags)];
    allowed: for each bucket whether its tokens are wanted (all, if None)."""
    found: dict[int, list] = {}
    at = 0
    for what, path, name, grade, text in walk(page):
        if what == "text":
            words = text.split() if path else []
            if words:
                seed = _seed(path)
                if (inside := found.get(_seed(f"{path}>"))) is not None:
                    inside[3] += sum(map(len, words))
                for k, t in enumerate(map(_hash, words, repeat(seed)), at + 1):
                    if allowed is None or allowed[t & (BUCKETS - 1)]:
                        if t in found:
                            found[t][0] += 1
                        else:
                            found[t] = [1, k, 0, 0, None]
                at += len(words)
            continue
        at += 1
        token = _tag(what, path, name)
        t = _seed(token)
        if allowed is None or allowed[t & (BUCKETS - 1)]:
            found.setdefault(t, [0, at, grade if what == "open" else 0, 0, token])[0] += 1
    return {_signed(t): e for t, e in found.items()}


def main_text(page: str, main: str | None, paths: list[str] | None = None, words: frozenset[int] = frozenset()) -> str:
    """The blocks inside the container with path `main` (else the page's best container), joined by blank lines.

    paths: of the host's template's containers (None: it has no template, and names alone tell what is perhaps
    boilerplate). words: the template's; a block that has no other goes unless it is part of an article or main part,
    and not of a doubtful element there. If no block has any other word, the page is all template, and all stay.
    """
    events = list(walk(page, paths is None))
    opened = [(g, p) for what, p, _, g, _ in events if what == "open"]
    if main is None or not any(p == main for _, p in opened):
        main = max(opened, key=lambda o: o[0])[1] if opened and max(opened)[0] > 0 else ""
    blocks, piece, fresh, kept, inside, depth = [], [], False, False, main == "", 0
    for what, path, name, grade, text in events:
        if what == "open" and path == main:
            inside, depth = True, depth + 1
        if what == "text":
            if inside and grade != DROPPED:
                piece.append(text)
                kept = kept or (grade == KEPT and not text.isspace())
                fresh = fresh or not words or any(word_token(seed, w) not in words for seed in (_seed(path),) for w in text.split())
            continue
        if name.lstrip("/") in BLOCKS and name not in UNCLOSED and not (what == "tag" and grade < 0):
            blocks.append(("".join(piece), fresh, kept))
            piece, fresh, kept = [], False, False
        elif name == "br" and inside and grade >= 0:
            piece.append(" ")
        if what == "close" and path == main and main:
            depth -= 1
            inside = depth > 0
    blocks.append(("".join(piece), fresh, kept))
    texts = [(" ".join(html.unescape(b).split()), fresh, kept) for b, fresh, kept in blocks]
    texts = [t for t in texts if t[0]]
    some = any(fresh for _, fresh, _ in texts)
    return "\n\n".join(b for b, fresh, kept in texts if fresh or kept or not some)


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _beside(rows: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """rows with what is known of their host (_host); a large host's pages go to several tasks if rows have to move."""
    if hosts.count() <= LIMIT_HOSTS:
        return rows.join(F.broadcast(hosts), "_host", how)
    salted = hosts.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], how).drop("_salt")


def _frequent_buckets(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """_host, pages and frequent (a bit for each bucket that half of the host's different pages reach)."""

    def packed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n.tobytes() for n in held.values()], pa.binary())], names=["_host", "counts"])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for first, stop, _, _ in text_slices(b.column(1)):
                part = b.slice(first, stop - first)
                for host, page in zip(part.column(0).to_pylist(), part.column(1).fill_null("").to_pylist(), strict=True):
                    mine = held.setdefault(host, np.zeros(BUCKETS, np.uint32))
                    mine[list(buckets(page))] += 1
                if len(held) > HELD_HOSTS:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def add(batches):
        host, total = None, None
        for b in batches:
            for h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != host:
                    if host is not None:
                        yield packed({host: total})
                    host, total = h, np.zeros(BUCKETS, np.uint32)
                total += np.frombuffer(raw, np.uint32)
        if host is not None:
            yield packed({host: total})

    sums = rows.select("_host", "_html").mapInArrow(count, "_host string, counts binary").repartition("_host").sortWithinPartitions("_host").mapInArrow(add, "_host string, counts binary")
    sums = saved(sums, "buckets").join(hosts, "_host")

    def bits(batches):
        for b in batches:
            made = [np.packbits(2 * np.frombuffer(raw, np.uint32).astype(np.int64) >= n, bitorder="little").tobytes() for raw, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.binary())], names=["_host", "pages", "frequent"])

    return saved(sums.select("_host", "counts", "pages").mapInArrow(bits, "_host string, pages long, frequent binary"), "frequent")


def occurrences(rows: DataFrame, known: DataFrame) -> DataFrame:
    """_host, page (its hash), token, n, position, grade, chars and name, once for each different page, of the tokens
    whose bucket is frequent on their host."""

    def run(batches):
        for b in batches:
            for first, stop, _, _ in text_slices(b.column(2)):
                part = b.slice(first, stop - first)
                at, out = [], []
                for k, (page, frequent) in enumerate(zip(part.column(2).fill_null("").to_pylist(), part.column(3).to_pylist(), strict=True)):
                    allowed = np.unpackbits(np.frombuffer(frequent, np.uint8), bitorder="little").astype(bool).tolist()
                    mine = [(t, *e) for t, e in tokens(page, allowed).items()]
                    at += [k] * len(mine)
                    out += mine
                at = pa.array(at, pa.int64())
                values = [pa.array([o[j] for o in out], pa.int64()) for j in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *values, pa.array([o[5] for o in out], pa.string())], names=["_host", "page", "token", "n", "position", "grade", "chars", "name"])

    found = _beside(rows, known.select("_host", "frequent"), "inner").select("_host", F.xxhash64("_html").alias("page"), "_html", "frequent")
    found = found.mapInArrow(run, "_host string, page long, token long, n long, position long, grade long, chars long, name string")
    return saved(found.dropDuplicates(["_host", "page", "token"]), "occurrences")


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, main (path of its main container, null if it has none), paths (its template's containers, in page
    order) and words (its template's), for the hosts with MIN_PAGES different pages."""
    ship(pages.sparkSession)
    rows = pages.select(_host(url).alias("_host"), F.coalesce(F.col(source), F.lit("")).alias("_html"))
    hosts = saved(rows.select("_host", F.xxhash64("_html").alias("page")).distinct().groupBy("_host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES), "hosts")
    known = _frequent_buckets(_beside(rows, hosts.select("_host"), "left_semi") if hosts.count() <= LIMIT_HOSTS else rows, hosts)
    found = occurrences(rows, known)
    stats = found.groupBy("_host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("on"), F.max("grade").alias("grade"), F.sum("chars").alias("chars"), F.min("name").alias("name"))
    frequent = saved(stats, "vectors").join(known.select("_host", "pages"), "_host").where((F.col("on") * 2 >= F.col("pages")) & (F.col("on") >= MIN_PAGES))
    sizes = frequent.groupBy("_host", "vector").agg(F.count("*").alias("size")).where("size > 1")
    classes = saved(frequent.join(sizes, ["_host", "vector"]), "classes")
    in_class = found.join(classes.select("_host", "token", "vector"), ["_host", "token"])
    rank = F.row_number().over(Window.partitionBy("_host", "page", "vector").orderBy("position", "token"))  # the tokens of one page
    ordered = in_class.withColumn("rank", rank).groupBy("_host", "token").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.avg("position").alias("position")).where("first = last")
    valid = saved(classes.join(ordered.select("_host", "token", "position"), ["_host", "token"]), "valid")
    path = F.expr("substring(name, 1, length(name) - 1)")
    container = F.col("name").endswith(">")
    best = F.max_by(F.when(container & (F.col("grade") > 0), path), F.struct(F.when(container, F.col("grade")), "chars", "name"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(container, F.struct("position", path.alias("path"))))), lambda p: p["path"])
    return valid.groupBy("_host").agg(best.alias("main"), listed.alias("paths"), F.sort_array(F.collect_list(F.when(F.col("name").isNull(), F.col("token")))).alias("words")).withColumnRenamed("_host", "host")


def extract(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """keep columns and text, the main text of every page.

    A null or empty page has an empty text. A page of a host without a template (of fewer than MIN_PAGES different
    pages), or without its main container, is read by its own best container, and a page without any as a whole, in
    both cases without boilerplate. Repeated pages are read each, and count once for the template. Columns of pages
    called ``text``, ``main``, ``paths`` or ``words`` are not kept.
    """
    ship(pages.sparkSession)
    keep = [c for c in keep if c not in ("text", "main", "paths", "words")]
    known = saved(templates(pages, url, source).withColumnRenamed("host", "_host"), "templates")
    rows = pages.select(*keep, _host(url).alias("_host"), F.col(source).alias("_html"))
    joined = _beside(rows, known, "left").select(*keep, "_html", "main", "paths", "words")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema[: len(keep)])

    def run(batches):
        for b in batches:
            for first, stop, _, _ in text_slices(b.column(len(keep))):
                part = b.slice(first, stop - first)
                told = (part.column(len(keep) + j).to_pylist() for j in (1, 2, 3))
                texts = [main_text(page, main, paths, frozenset(words or ())) for page, main, paths, words in zip(part.column(len(keep)).fill_null("").to_pylist(), *told, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return joined.mapInArrow(run, f"{kept}text string")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
