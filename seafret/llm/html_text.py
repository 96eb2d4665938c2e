"""Main text of web pages by markup and by differencing against the pages nearest by URL.

A page becomes text lines, one for each block. Pages of a host are ordered by URL path; each is aligned with its neighbours in that
order (the nearest ones with other lines) by longest common subsequence, and lines it shares with them are deleted: at the
head and tail of the page if one neighbour has them, inside it if both have. This decides on every page; markup is a check after it.
Shared lines of a marked article stay, since articles quote each other. An article all of whose lines all neighbours have is a card
or a copy: it goes if it is named a card and the page has text of its own, or if that text holds sentences; else it stays. Lines marked as
something else go. Unmarked lines that are not shared stay. A block that is only named like something else (search, related) goes if
the neighbours have all its lines. No rule compares lengths.

Null html and null urls count as empty; a page without a host has no neighbours. On a page without neighbours nothing is known
to be shared: all lines stay that are not marked or named as something else, but beside an article text outside of any element goes. Ties in the order go by the page's hash. Repeated pages
are each other's copies and are not compared with each other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import attach, text_of, written

#: Lines by markup: marked as other than the article, unmarked, marked as the article, in a block named like something else outside
#: an article or in one, outside of any element, in an article named a card. A line's kind is one of these plus BLOCK times the
#: number of the element that marks it.
OTHER, PLAIN, CORE, NAMED, INNER, BARE, CARD = 0, 1, 2, 3, 4, 5, 6
BLOCK = 8
#: Instead of places: no page to compare with.
NOBODY = [-1]

# Elements of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Dropped with what they hold: to the end of the page if never closed, or only from opening to closing part.
RAW = {"script", "style"}
CLOSED = set("template svg iframe textarea select title".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead "
    "tr ul video audio".split()
)
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OTHER_ELEMENTS = set("head nav aside footer form menu".split())
# Controls: text where they stand in a sentence, parts of the frame elsewhere.
CONTROLS = {"button", "label"}
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote figcaption caption pre".split())
CODE = {"pre", "code"}
# Elements that say something without attributes.
NOTED = {"article", "main", "header", "dialog"}
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CORE_ELEMENTS = {"article", "main"}
# Words of class and id attributes: comments and adverts go wherever they are, parts of the page's frame outside articles; all
# others need the neighbours' word.
CLEAR_WORDS = set("ad ads advert adverts advertisement advertisements advertising adsense adslot comment comments commentlist disqus".split())
CLEAR_LABELS = {"share", "sharing"}
FRAME_WORDS = set(
    "sidebar sidebars menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs pager pagination footer masthead topbar "
    "toolbar cookie cookies gdpr newsletter".split()
)
DOUBT_WORDS = FRAME_WORDS | set(
    "sponsor sponsored sponsors promo promotion promoted banner consent notice notices subscribe subscription signup login signin "
    "search share sharing social related recommended recommendations discussion respond reply replies popup modal overlay widget "
    "widgets copyright skip paywall alert".split()
)
# Whole labels of comments and adverts, which are believed inside articles too.
WHOLE_LABEL = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|comments?|commentlist|disqus)"
    r"(?:[-_](?:list|area|section|form|box|thread|wrapper|wrap|container|block|slot|unit|banner|label|respond))*",
    re.I,
)
CARD_WORDS = set("card cards teaser teasers preview snippet tile excerpt featured".split())
HEADER_WORDS = {"header"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NEUTRAL_WORDS = {"no", "has", "with", "without", "not", "hoc"}
CORE_NAMES = set(
    "article article-body article-content article-text articlebody post-body post-content post-text entry-content entry-body "
    "story-body main-content maincontent content-body page-content".split()
)

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW | CLOSED}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)")


def kind_of(name: str, attributes: str, inside: int, stack: list[tuple[str, int]] = ()) -> int:
    """What an element makes of its content, given what it is inside of (kind, and the open elements)."""
    if inside == OTHER or name in OTHER_ELEMENTS:
        return OTHER
    if name in CONTROLS and not any(n in TEXT_BLOCKS for n, _ in stack):
        return OTHER
    if not attributes and name not in NOTED:
        return inside
    own = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    if name in OTHER_ELEMENTS or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return OTHER
    article = inside in (CORE, INNER, CARD)
    code = name in CODE or any(n in CODE for n, _ in stack)
    card = False
    if name == "header" and not article:
        return OTHER
    if own.get("role", "").lower() in OTHER_ROLES:
        return OTHER
    # the id of a heading is the place a link leads to
    names = f"{own.get('class', '')} {'' if name in HEADINGS else own.get('id', '')}".split()
    doubt = name == "dialog"
    if name not in ("html", "body", "main") and not code:
        for label in names:
            words = {w.lower() for w in WORD.findall(label)}
            if words & NEUTRAL_WORDS:
                continue
            if name == "article":
                if words & {"comment", "comments", "reply", "replies"}:
                    return OTHER
                card = card or bool(words & CARD_WORDS)
            elif label.lower() in CLEAR_LABELS or (not article and name not in INLINE and words & FRAME_WORDS):
                return OTHER
            elif WHOLE_LABEL.fullmatch(label) if article or name in INLINE else words & CLEAR_WORDS:
                if not (article and name in INLINE):
                    return OTHER
            elif words & DOUBT_WORDS or (not article and words & HEADER_WORDS):
                doubt = True
    if inside == INNER or doubt:
        return INNER if article else NAMED
    if name in CORE_ELEMENTS or own.get("role") == "main" or own.get("itemprop") == "articleBody" or CORE_NAMES.intersection(x.lower() for x in names):
        return CARD if card else CORE
    return inside


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Lines of a page in order and their kinds; white space in a line is one space."""
    lines: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    kind, at, blocks = PLAIN, 0, 0

    def flush() -> None:
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                lines.append(line)
                bare = kind == PLAIN and all(n in ("html", "body") for n, _ in stack)
                kinds.append(BARE if bare else kind)
            parts.clear()

    def close(depth: int) -> None:
        nonlocal kind
        if any(n in BLOCKS for n, _ in stack[depth:]) or stack[depth][1] != kind:
            flush()
        kind = stack[depth][1]
        del stack[depth:]

    open_ended: set[str] = set()
    while token := TOKENS.search(html, at):
        if token.start() > at:
            parts.append(entities.unescape(html[at : token.start()]))
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        name = name.lower()
        slash, attributes = (token[1], token[3]) if token[2] else (token[4], token[6])
        if not slash and (name in RAW or name in CLOSED and not attributes.endswith("/")) and name not in open_ended:
            end = END[name].search(html, at)
            if end or name in RAW:
                at = end.end() if end else len(html)
                continue
            open_ended.add(name)
        if slash:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name in BLOCKS:
                flush()
            continue
        ends = {"p"} if name in BLOCKS else {name} if name in CLOSES_ITSELF else set()
        limit = CLOSES_ITSELF.get(name, BLOCKS - {"p"})
        if name in CLOSES_ITSELF:
            ends = ends | ({name} if name not in ("dt", "dd") else {"dt", "dd"})
        for depth in range(len(stack) - 1, -1, -1) if ends else ():
            if stack[depth][0] in ends:
                close(depth)
                break
            if stack[depth][0] in limit:
                break
        new = kind_of(name, attributes, kind % BLOCK, stack)
        if new == kind % BLOCK:
            new = kind
        elif new != OTHER:
            blocks += 1
            new += BLOCK * blocks
        if name in BLOCKS or new != kind:
            flush()
        elif name in ("td", "th"):
            parts.append(" ")
        if not attributes.rstrip().endswith("/") or name in BLOCKS:
            stack.append((name, kind))
            kind = new
    if at < len(html):
        parts.append(entities.unescape(html[at:]))
    flush()
    return lines, kinds


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest common subsequence in both, exact for any length in linear memory."""
    head = 0
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
    rest = n - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1]) if rest else []
    tail = int(differ[0]) if len(differ) else rest
    ia, ib = np.arange(head, len(a) - tail), np.arange(head, len(b) - tail)
    ia, ib = ia[np.isin(a[ia], b[ib])], ib[np.isin(b[ib], a[ia])]
    ma, mb = _lcs(a[ia], b[ib])
    ends = np.arange(tail)
    return (
        np.concatenate([np.arange(head), ia[ma], len(a) - tail + ends]).astype(np.int64),
        np.concatenate([np.arange(head), ib[mb], len(b) - tail + ends]).astype(np.int64),
    )


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def _lcs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    if len(a) == 1:
        hit = np.flatnonzero(b == a[0])[:1]
        return (np.zeros(1, np.int64), hit) if len(hit) else (none, none)
    # split a in half and b where both halves together match most
    half = len(a) // 2
    total = _row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(total))
    if total[cut] == 0:
        return none, none
    la, lb = _lcs(a[:half], b[:cut])
    ra, rb = _lcs(a[half:], b[cut:])
    return np.concatenate([la, ra + half]), np.concatenate([lb, rb + cut])


def place(url: str | None) -> tuple[str, str]:
    """Host and path."""
    m = HOST.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for url, html in zip(batch.column(1), batch.column(2)):
            at.append(place(url.as_py()))
            lines, _ = page_lines(html.as_py() or "")
            rows.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([h for h, _ in at], pa.string()),
                pa.array([p for _, p in at], pa.string()),
                pa.array(rows, pa.list_(pa.int64())),
            ],
            ["mark", "host", "path", "hashes"],
        )


#: A row for each page (mark, run) and one for each run of pages with equal lines (run, size, ...).
DIFF = "mark long, run long, size long, host string, path string, before array<int>, after array<int>, hashes array<long>"
ARROW = pa.schema(
    [
        ("mark", pa.int64()),
        ("run", pa.int64()),
        ("size", pa.int64()),
        ("host", pa.string()),
        ("path", pa.string()),
        ("before", pa.list_(pa.int32())),
        ("after", pa.list_(pa.int32())),
        ("hashes", pa.list_(pa.int64())),
    ]
)


class Run:
    """Pages side by side in the order with one host and the same lines; before and after are None until known."""

    def __init__(self, run: int, host: str, path: str, hashes: np.ndarray, before=None, after=None):
        self.run, self.host, self.path, self.hashes, self.before, self.after = run, host, path, hashes, before, after
        self.size = 0

    def same(self, other: Run) -> bool:
        return self.host == other.host and np.array_equal(self.hashes, other.hashes)


def _share(one: Run, other: Run) -> None:
    both = lcs(one.hashes, other.hashes) if one.host and one.host == other.host else (NOBODY, NOBODY)
    one.after, other.before = both


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come in order; each run gets its lines shared with the run before and after, but for the ends of a partition."""

    def told(run: Run) -> dict:
        edge = run.before is None or run.after is None
        names = ("run", "size", "host", "path", "before", "after")
        return {n: getattr(run, n) for n in names} | {"hashes": run.hashes if edge else None}

    base = TaskContext.get().partitionId() << 33
    run: Run | None = None
    n = 0
    for batch in batches:
        rows = []
        for mark, host, path, hashes in zip(*(batch.column(k) for k in range(4))):
            new = Run(base + n, host.as_py(), path.as_py(), np.asarray(hashes.values.to_numpy(zero_copy_only=False)))
            if run is None or not run.same(new):
                if run is not None:
                    _share(run, new)
                    rows.append(told(run))
                run = new
                n += 1
            run.size += 1
            rows.append({"mark": mark.as_py(), "run": run.run})
        yield _rows(rows)
    if run is not None:
        yield _rows([told(run)])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last runs of all partitions, in order: a run cut by borders is one, and its sides come from the runs next to it."""
    groups: list[list[Run]] = []
    sizes: dict[int, int] = {}
    for batch in batches:
        for r in batch.to_pylist():
            one = Run(r["run"], r["host"], r["path"], np.array(r["hashes"] or [], np.int64), r["before"], r["after"])
            sizes[one.run] = r["size"]
            last = groups[-1][-1] if groups else None
            if last is not None and last.after is None and one.before is None and last.same(one):
                groups[-1].append(one)
            else:
                groups.append([one])
    for left, right in zip(groups, groups[1:]):
        if left[-1].after is None and right[0].before is None:
            _share(left[-1], right[0])
    rows = []
    for group in groups:
        before, after = group[0].before, group[-1].after
        before, after = NOBODY if before is None else before, NOBODY if after is None else after
        rows += [{"run": r.run, "size": sizes[r.run], "before": before, "after": after} for r in group]
    yield _rows(rows)


def shared_lines(pages: DataFrame) -> DataFrame:
    """mark, before, after of pages and their number: places of the lines shared with the neighbours on their host.

    Pages are dealt out by range of host, path and mark, so a host with a third of all pages is cut like any other; the runs at
    the borders, two for each partition, are compared in one small task. No result depends on where the borders are.
    """
    hashed = read(pages).mapInArrow(_hashed, "mark long, host string, path string, hashes array<long>")
    hashed = written(hashed, "page-lines")
    order = ("host", "path", "mark")
    diffs = written(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_diff, DIFF), "page-diffs")
    runs = diffs.filter(F.col("size").isNotNull())
    edges = runs.filter(F.col("before").isNull() | F.col("after").isNull()).repartition(1).sortWithinPartitions("host", "path", "run")
    inner = runs.filter(F.col("before").isNotNull() & F.col("after").isNotNull())
    names = ("run", "size", "before", "after")
    runs = written(inner.select(*names).unionByName(edges.mapInArrow(_borders, DIFF).select(*names)), "page-runs")
    marked = diffs.filter(F.col("size").isNull()).groupBy("mark", "run").agg(F.count(F.lit(1)).alias("copies"))
    # copies of a row are side by side, but a border may give them two runs
    marked = marked.groupBy("mark").agg(F.min("run").alias("run"), F.sum("copies").alias("copies"))
    return attach(marked, runs, "run", "size").select("mark", "copies", "before", "after")


def read(pages: DataFrame) -> DataFrame:
    """mark (hash of id, url and html, so repeated rows are one page), url, html, page_id."""
    page, html = F.col("page_id").cast("long"), text_of("html")
    return pages.select(F.xxhash64(page, "url", html).alias("mark"), "url", html.alias("html"), page.alias("page_id"))


def deleted(n: int, before: list[int] | None, after: list[int] | None) -> np.ndarray:
    """Lines that go: shared with both neighbours, or with one in an unbroken stretch from the head or to the tail."""
    one, two = np.zeros(n, bool), np.zeros(n, bool)
    for places, flags in ((before, one), (after, two)):
        at = np.array(places if places is not None else [], np.int64)
        flags[at[at < n]] = True
    either = one | two
    rim = np.zeros(n, bool)
    for flags in (one, two):
        if not flags.all():  # a page that is wholly inside another one has no rim
            rim |= np.logical_and.accumulate(flags) | np.logical_and.accumulate(flags[::-1])[::-1]
    return (one & two & ~either.all()) | rim


ENDS = tuple(".!?\u2026\u3002\uff01\uff1f")
CLOSING = "\"'\u201d\u2019\u00bb)"


def is_sentence(line: str) -> bool:
    """Five words or more, and an end."""
    return line.rstrip(CLOSING).endswith(ENDS) and len(line.split(None, 5)) >= 5


def main_text(lines: list[str], kinds: list[int], before: list[int] | None = None, after: list[int] | None = None) -> str:
    """Lines that the alignment with the neighbours (None: there is none) leaves, checked by markup."""
    k = np.array(kinds, np.int64)
    role, block = k % BLOCK, k // BLOCK
    core, named, inner, bare = (role == CORE) | (role == CARD), role == NAMED, role == INNER, role == BARE
    plain = (role == PLAIN) | named | bare
    if before is None and after is None:
        keep = core | inner | (plain & ~named & ~bare) if (core | inner).any() else plain
    else:
        gone = deleted(len(lines), before, after)
        known = [set(x) for x in (before, after) if x is not None]
        shared = np.array([all(i in x for x in known) for i in range(len(lines))], bool)
        keep = (core | plain) & ~gone
        for b in np.unique(block[named | inner]):
            its = (named | inner) & (block == b)
            if shared[its].all():
                keep &= ~its
            else:
                keep |= its & inner
        own = keep & ~shared & ~bare
        for b in np.unique(block[core & gone]):
            article = core & (block == b)
            if not shared[article].all():
                keep |= article
            elif (role[article] == CARD).all() and own.any() or any(is_sentence(lines[i]) for i in np.flatnonzero(own)):
                keep &= ~article
            else:
                keep |= article
    return "\n".join([x for x, y in zip(lines, keep) if y])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed html: all pages are shuffled once to meet their shared lines."""
    for batch in batches:
        packed = [zlib.compress(html.as_py(), 1) for html in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["mark", "page_id", "url", "packed"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, before, after in zip(batch.column(2), batch.column(3), batch.column(4)):
            lines, kinds = page_lines(zlib.decompress(html.as_py()).decode("utf-8", "replace"))
            sides = [None if x == NOBODY else x for x in (before.as_py(), after.as_py())]
            texts.append(main_text(lines, kinds, *sides))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = written(shared_lines(pages), "page-shared")
    packed = read(pages).select("mark", "page_id", "url", F.col("html").cast("binary")).mapInArrow(_packed, "mark long, page_id long, url string, packed binary")
    joined = attach(packed, shared, "mark", "copies")
    found = joined.select("page_id", "url", "packed", "before", "after").mapInArrow(_texts, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
