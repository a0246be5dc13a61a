"""Main text of web pages: markup rules and nearest-URL page differencing.

A page becomes lines, one per block of text, each with what encloses it.  Pages
of one host, in order of URL path, are each aligned with the page before and
the page after by the longest common subsequence of their lines: what two
neighbours share is the site's template, and is deleted.

Two things bound what differencing may decide.  Lines that markup declares to
be no content (menus, headers, footers, sidebars, notices, adverts, forms,
comments) go even where they differ between neighbours, as rotating adverts and
menus do.  And where a page has an ``<article>`` or ``<main>``, only what is in
it is content; a line there is template only where the alignments carry it
through three pages in order, neither pair of them are copies (share most of
the content of either), and most pages of the host have it in their content, as
copies of an article and passages that some documents quote would otherwise
vanish.  Elsewhere a shared line goes at once, unless
what is shared is most of the page's text, as in copies; then it goes if it is
carried through three pages, each of which has text of its own besides.

What is sorted and compared is each page's line hashes, not its text.  The sort
is a range partitioning by (host, path, page), which splits a hot host; the
pages at the edges of partitions are paired in a second step, so the pairs do
not depend on the partitioning.  The lines to delete are then joined to the
pages, broadcast where they are few (counted), else by shuffle.

A null page or one without text gives an empty text; a null URL is a host and
path of its own.  Equal rows are compared once and each get the result.  An empty
table gives an empty one; other columns are not read.  Text that a page hides is
text of the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Masks up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 20_000
#: Matching line pairs beyond which pages are halved before they are aligned.
MATCHES = 2_000_000

BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it ends at their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg".split())
DROP = frozenset("nav footer aside form button select textarea script style title head iframe noembed noframes template svg menu input".split())
CONTENT = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role that declare an element to be no content, if
#: nothing else is in that name but these and NEUTRAL ones: a "share-price" is
#: none, nor is "post-comments-open".
DROP_PARTS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion related reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Those that count on an ``<article>`` or ``<main>`` itself, whose classes tell
#: more of the page around it.
CONTENT_PARTS = frozenset("ad ads advert advertisement comment comments promo promoted related reply sponsored".split())

NEUTRAL = frozenset(
    "area article articles bar bars block blocks bottom box boxes button buttons col column container entry global group icon icons inner item items left link links list lists media outer page post posts primary right row secondary section sections signup site slot stories story top unit wrap wrapper zone".split()
)
_KNOWN = DROP_PARTS | NEUTRAL | {"header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"""(?<![^\s"'/])(?:(class|id|role)|[^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES_P = BLOCK - {"br", "option", "legend"}


def _named(attributes: str, ids: bool = True) -> set[str]:
    """The parts of those names in an element's class, id and role, in lower
    case, of which all parts are known.  Attribute values are skipped as they
    are read, so that only attributes count."""
    out: set[str] = set()
    for m in _NAMED.finditer(attributes):
        if not m[1] or m[1].lower() == "id" and not ids:
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = {x.lower() for x in _PARTS.findall(name)}
            if parts <= _KNOWN:
                out |= parts
    return out


def _attributes(html: str, at: int) -> tuple[str, int]:
    """The attributes of a tag from ``at`` on, and where the tag ends.

    A > in quotes is no end, unless the quote is never closed.
    """
    i = at
    while m := _STOP.search(html, i):
        if m[0] == ">":
            return html[at : m.start()], m.end()
        close = html.find(m[0], m.end())
        if close < 0:
            end = html.find(">", at)
            return (html[at:end], end + 1) if end >= 0 else (html[at:], len(html))
        i = close + 1
    return html[at:], len(html)


def _declared(tag: str, attributes: str) -> bool:
    """Whether an element's tag or attributes say it is no content."""
    if tag in DROP:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    # the id of a heading or section is the anchor of a topic
    return tag not in HEADING and bool(_named(attributes, tag != "section") & (CONTENT_PARTS if tag in CONTENT else DROP_PARTS))


def _is_header(tag: str, attributes: str) -> bool:
    """Whether an element is a header, of which headings in content stay."""
    return tag == "header" or bool(attributes) and tag not in CONTENT and tag not in HEADING and tag not in ("html", "body") and "header" in _named(attributes)


def lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in content element, declared to be no content) of each block.

    The open elements are counted by name, so an end tag that ends nothing is
    passed over at once, and one that ends something takes what it closes off
    the stack: a page is read in time linear in its length.  A form that turns
    out to hold an ``<article>`` or ``<main>`` is a page in a form, and no form.
    """
    html, out = html or "", []
    # tag, drops, holds content, whether a header whose headings stay
    stack: list[list] = []
    there: Counter[str] = Counter()
    forms: list[list] = []
    drops = holds = headers = headings = 0
    piece: list[str] = []
    state = (False, False)

    def flush() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append((text, *state))
            piece.clear()

    def now() -> tuple[bool, bool]:
        return holds > 0, drops > 0 or (headers > 0 and not (holds and headings))

    def pop(k: int) -> None:
        nonlocal drops, holds, headers, headings
        while len(stack) > k:
            entry = stack.pop()
            there[entry[0]] -= 1
            if forms and forms[-1] is entry:
                forms.pop()
            drops, holds, headers, headings = drops - entry[1], holds - entry[2], headers - entry[3], headings - (entry[0] in HEADING)

    def last(tag: str) -> int:
        """The place of the innermost open element of a name that is open."""
        k = len(stack) - 1
        while stack[k][0] != tag:
            k -= 1
        return k

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if (text := html[at : m.start() if m else len(html)]) != "":
            if (here := now()) != state:
                flush()
                state = here
            piece.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attributes, at = _attributes(html, at)
        if tag in BLOCK:
            flush()
        if m[1]:
            if there[tag]:
                pop(last(tag))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
            continue
        if (tag in _CLOSES_P or tag == "li") and there["p"]:
            k = last("p")
            if not any(x[0] in BLOCK for x in stack[k + 1 :]):
                pop(k)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        header = _is_header(tag, attributes)
        entry = [tag, not header and _declared(tag, attributes), tag in CONTENT or bool(re.search(r"""role\s*=\s*["']?main\b""", attributes)), header]
        if entry[2]:
            for form in forms:
                drops, form[1] = drops - form[1], False
            forms.clear()
        stack.append(entry)
        there[tag] += 1
        if tag == "form":
            forms.append(entry)
        drops, holds, headers, headings = drops + entry[1], holds + entry[2], headers + entry[3], headings + (tag in HEADING)
    flush()
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each head of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _longest(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Positions in a and b of a longest common subsequence.

    Matching pairs are threaded in order (Hunt-Szymanski).  Over MATCHES of
    them, a is halved and b cut where the halves have most (Hirschberg).
    """
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    if len(a) > 1 and sum(len(where.get(x, ())) for x in a) > MATCHES:
        half, x, y = len(a) // 2, np.array(a, np.int64), np.array(b, np.int64)
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _longest(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _longest(a[half:], b[cut:])]
    ends: list[int] = []  # the least end in b of a chain of each length
    links: list[tuple[int, int, object]] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    chain, link = [], links[-1] if links else None
    while link:
        chain.append(link[:2])
        link = link[2]
    return chain[::-1]


def common_lines(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence, after head and
    tail are stripped."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    chain = _longest(a[n : len(a) - m], b[n : len(b) - m])
    left = [*range(n), *(n + i for i, _ in chain), *range(len(a) - m, len(a))]
    right = [*range(n), *(n + j for _, j in chain), *range(len(b) - m, len(b))]
    return left, right


#: A page as it is compared: hashes and lengths of its lines, which of them are
#: open (not dropped by markup), and whether those are in content elements.
_SIGNATURE = "uid long, host string, path string, hashes array<long>, lengths array<int>, open array<int>, inner boolean"


def _signatures(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 3):
            hashes, lengths, opened, inside = [], [], [], []
            for html in part.column(3).to_pylist():
                found = lines(html)
                inner = any(x[1] for x in found)
                hashes.append([xxhash.xxh64_intdigest(x[0]) - (1 << 63) for x in found])
                lengths.append([len(x[0]) for x in found])
                opened.append([k for k, x in enumerate(found) if not x[2] and (x[1] or not inner)])
                inside.append(inner)
            yield C.record({"uid": part.column(0), "host": part.column(1), "path": part.column(2), "hashes": pa.array(hashes, pa.list_(pa.int64())), "lengths": pa.array(lengths, pa.list_(pa.int32())), "open": pa.array(opened, pa.list_(pa.int32())), "inner": pa.array(inside, pa.bool_())})

    return pages.select("uid", "host", "path", "html").mapInArrow(run, _SIGNATURE)


def _most(page: dict, gone: Iterable[int]) -> bool:
    """Whether these lines are more than half of a page's open text."""
    lengths = page["lengths"]
    return 2 * sum(lengths[k] for k in gone) > sum(lengths[k] for k in page["open"])


def _shared(pages: Iterable[dict]) -> Iterator[tuple[int, list[int]]]:
    """(page, lines of it that are template) from pages in order of host and path."""
    x = y = before = None
    for z in pages:
        pair = None
        if y and y["host"] == z["host"] and (y["open"] or z["open"]):
            left, right = common_lines(y["hashes"], z["hashes"])
            mine = [[k for k in page["open"] if k in at] for page, at in ((y, set(left)), (z, set(right)))]
            copies = any(_most(page, gone) for page, gone in zip((y, z), mine, strict=True))
            pair = (dict(zip(left, right, strict=True)), copies)
            for page, gone in zip((y, z), mine, strict=True):
                if gone and not page["inner"] and not _most(page, gone):
                    yield page["uid"], gone
        if before and pair:
            # what goes through three pages
            back = {j: i for i, j in before[0].items()}
            through = [(back[k], k, pair[0][k]) for k in back if k in pair[0]]
            gone = [[k for k in page["open"] if k in at] for page, at in zip((x, y, z), map(set, zip(*through, strict=True)), strict=True)] if through else [[]] * 3
            own = all(len(at) < len(page["open"]) for page, at in zip((x, y, z), gone, strict=True))
            for page, found in zip((x, y, z), gone, strict=True):
                if found and (not (before[1] or pair[1]) if page["inner"] else own):
                    yield page["uid"], found
        x, y, before = y, z, pair


def _of_most_pages(found: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of template lines in content elements, those that most pages of the host
    have in theirs; others stay.

    Only lines that alignments found are counted, by host and hash.
    """
    inner = signatures.filter("inner").select("uid", "host", "hashes", "open")
    marked = found.join(signatures.select("uid", "host", "inner", "hashes"), "uid")
    rest = marked.filter("not inner").select("uid", "gone")
    asked = C.durable(marked.filter("inner").select("uid", "host", F.explode("gone").alias("line"), F.col("hashes")).select("uid", "host", "line", F.get("hashes", F.col("line")).alias("hash")))
    wanted = asked.select("host", "hash").distinct()
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    each = inner.select("host", F.explode(F.array_distinct(F.transform("open", lambda k: F.get("hashes", k)))).alias("hash"))
    times = each.join(few, ["host", "hash"], "left_semi").groupBy("host", "hash").agg(F.count("*").alias("n"))
    pages = inner.groupBy("host").agg(F.count("*").alias("all"))
    common = times.join(pages, "host").filter(2 * F.col("n") > F.col("all")).select("host", "hash")
    kept = asked.join(common, ["host", "hash"], "left_semi").groupBy("uid").agg(F.collect_set("line").alias("gone"))
    return rest.unionByName(kept)


_PAIRED = "part int, side int, gap boolean, uid long, host string, hashes array<long>, lengths array<int>, open array<int>, inner boolean, gone array<int>"
_FOUND = pa.schema([("uid", pa.int64()), ("gone", pa.list_(pa.int32()))])
_EDGE_FIELDS = ["uid", "host", "hashes", "lengths", "open", "inner"]


def template_lines(pages: DataFrame) -> DataFrame:
    """``uid`` and ``gone``: the lines of each page that are template.

    ``pages`` has uid, host, path and html, one row for each uid.
    """
    spark = pages.sparkSession
    order = ["host", "path", "uid"]
    parts = C.partitions(spark)
    ordered = C.durable(_signatures(pages).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    kinds = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("gap", pa.bool_()), ("uid", pa.int64()), ("host", pa.string()), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("open", pa.list_(pa.int32())), ("inner", pa.bool_()), ("gone", pa.list_(pa.int32()))])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, edges = TaskContext.get().partitionId(), 0, []

        def each() -> Iterator[dict]:
            nonlocal n
            for batch in batches:
                for page in batch.to_pylist():
                    # the first two and the last two pages
                    edges.append(page)
                    if len(edges) > 4:
                        del edges[2]
                    n += 1
                    yield page

        found = _shared(each())
        while rows := [{"part": part, "side": -1, "uid": u, "gone": g} for u, g in islice(found, 1000)]:
            yield pa.RecordBatch.from_pylist(rows, kinds)
        if edges:
            yield pa.RecordBatch.from_pylist([{"part": part, "side": k, "gap": k == 2 and n > 4} | {f: page[f] for f in _EDGE_FIELDS} for k, page in enumerate(edges)], kinds)

    found = C.durable(ordered.mapInArrow(within, _PAIRED))
    # at most four pages of each partition; those between are a gap
    edges = found.filter("side >= 0").select("part", "side", "gap", *_EDGE_FIELDS).repartition(1).sortWithinPartitions("part", "side")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []
        for batch in batches:
            for page in batch.to_pylist():
                if page["gap"]:
                    yield pa.RecordBatch.from_pylist([{"uid": u, "gone": g} for u, g in _shared(run)], _FOUND)
                    run = []
                run.append(page)
        yield pa.RecordBatch.from_pylist([{"uid": u, "gone": g} for u, g in _shared(run)], _FOUND)

    rows = found.filter("side = -1").select("uid", "gone").unionByName(edges.mapInArrow(across, "uid long, gone array<int>"))
    rows = rows.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return _of_most_pages(rows, ordered)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_chars`` of every page."""
    place = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(
        F.xxhash64(F.col(id), F.col(url), F.col(html)).alias("uid"),
        F.lower(F.regexp_extract(place, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(place, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(id).alias("id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    gone = C.durable(template_lines(rows.select("uid", "host", "path", "html").dropDuplicates(["uid"]) if _repeats(rows) else rows))
    few = gone.count() <= BROADCAST_ROWS
    joined = rows.select("uid", "id", "url", "html").join(F.broadcast(gone) if few else gone, "uid", "left").select("id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 2):
            texts = []
            for page, drop in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found, drop = lines(page), set(drop or ())
                inner = any(x[1] for x in found)
                texts.append(" ".join(x[0] for k, x in enumerate(found) if not x[2] and (x[1] or not inner) and k not in drop))
            yield C.record({"id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    kinds = dict(rows.dtypes)
    return joined.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id).withColumnRenamed("url", url)


def _repeats(rows: DataFrame) -> bool:
    """Whether any uid occurs twice (only hashes are counted)."""
    return not rows.select("uid").groupBy("uid").count().filter("count > 1").isEmpty()


def op1_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
