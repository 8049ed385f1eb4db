"""Main text of web pages by nearest-URL page differencing.

A page is read into lines (blocks). Every page is compared with the page whose URL is nearest within
the host and that is no copy of it: their lines are aligned by longest common subsequence, and shared
lines are deleted. Markup is evidence on single lines: what stands in a menu, footer, form or the
like can't be the article, and a line inside an article element is only deleted if most pages of the
host have it too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, released, stored

#: Pages of a stretch of URLs, and stretches at most; so many keys are looked at for each stretch to place its ends.
STRETCH_PAGES, STRETCHES, LOOKS = 5_000, 20_000, 20
#: A neighbour that shares more than this of what a page has besides the host's recurring lines is a copy and says nothing.
COPY = 0.5
#: A line recurs on a host if this share of its different pages has it, and so many at least.
RECURRING, RECURRING_PAGES = 0.5, 3
#: Pages that are looked at ahead for one that is no copy, where there is none before.
AHEAD = 16

# Elements that end a block, that hold no text of the page, that aren't the article.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split())
_ASIDE = frozenset("nav header footer aside form menu dialog button select option datalist fieldset head search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar alert".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottom sidebar aside ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager pagenav search searchbox form copyright legal skip teaser outbrain taboola".split()
)
_MAIN_NAMES = frozenset("articlebody article-body article-content article__body post-content entry-content post-body story-body".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in _RAW}

OPEN, MAIN = 0, 1


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element begins what can't be the article, or the article."""
    aside, main = name in _ASIDE, name in ("article", "main")
    for m in _ATTR.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            main = main or not _MAIN_NAMES.isdisjoint(value.split())
            aside = aside or not _NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value))
        elif key == "role":
            main, aside = main or value in ("main", "article"), aside or value in _ROLES
        elif key == "itemprop":
            main, aside = main or value == "articlebody", aside or value == "comment"
        else:
            aside = aside or key == "hidden" or value == "true"
    return aside, main


def page_lines(html: str) -> list[tuple[int, str]]:
    """The lines of a page in order, each MAIN (inside the article) or OPEN; the rest is left out."""
    lines: list[tuple[int, str]] = []
    piece: list[str] = []
    main: list[list] = []  # open elements that began the article: name and how often it is nested in itself
    skip: list = []  # the same of the element that is being left out
    at, size = 0, len(html)

    def flush():
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                lines.append((MAIN if main else OPEN, text))

    while at < size:
        tag = _TAG.search(html, at)
        if not tag:
            if not skip:
                piece.append(html[at:])
            break
        if tag.start() > at and not skip:
            piece.append(html[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if skip:
            if name == skip[0]:
                skip[1] += -1 if closing else 1
                if not skip[1]:
                    skip = []
            elif closing and (name == "body" or main and name == main[0][0] and main[0][1] == 1 and name != skip[0]):
                skip = []  # an element that was never closed ends with what it is in
            if skip:
                if name in _RAW and not closing and (end := _ENDS[name].search(html, at)):
                    at = end.end()
                    if name == skip[0]:
                        skip[1] -= 1
                        skip = skip if skip[1] else []
                continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            piece.append(" ")
        if closing:
            for i in range(len(main) - 1, -1, -1):
                if main[i][0] == name:
                    main[i][1] -= 1
                    if not main[i][1]:
                        del main[i:]
                    break
            continue
        if name in _RAW:
            end = _ENDS[name].search(html, at)
            at = end.end() if end else size
            continue
        if name in _VOID or tag[3].endswith("/"):
            continue
        aside, begins = _marks(name, tag[3])
        if aside and not (name in ("html", "body") or begins and name in ("article", "main")) and not (name == "header" and main):
            flush()
            skip = [name, 1]
        elif begins:
            main.append([name, 1])
        elif main:
            for m in reversed(main):
                if m[0] == name:
                    m[1] += 1
                    break
    flush()
    return lines


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


class Page:
    """The lines of a page, and what it has of its own besides the host's recurring lines."""

    def __init__(self, key: str, kinds: list[int], lines: list[str], recurring: frozenset[int]):
        self.key, self.kinds, self.lines = key, kinds, lines
        self.recurs = [line_hash(t) in recurring for t in lines]
        self.all = Counter(lines)
        self.own = Counter(t for t, r in zip(lines, self.recurs, strict=True) if not r)
        self.size = sum(len(t) * c for t, c in self.own.items())

    def copies(self, other: Page) -> bool:
        both = self.own & other.all
        return sum(len(t) * c for t, c in both.items()) > COPY * self.size

    def text(self, other: Page | None) -> str:
        """What is left of the page without the lines it shares with the other; without another, those that recur on the host go."""
        shared = set(common(self.lines, other.lines)) if other else {i for i, r in enumerate(self.recurs) if r}
        marked = MAIN in self.kinds
        keep = (i not in shared or (kind == MAIN and not r) for i, (kind, r) in enumerate(zip(self.kinds, self.recurs, strict=True)))
        return "\n".join(t for t, kind, k in zip(self.lines, self.kinds, keep, strict=True) if k and (kind == MAIN or not marked))


def line_hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >= 1 << 63 else x


def differences(pages):
    """(page, other) for pages of one host in the order of their URLs: the nearest page that is no copy, before or else ahead.

    Copies that stand together count as one page, so that each meets what stands before them.
    """
    before: list[Page] = []
    ahead: deque[Page] = deque()

    def next_one():
        page = ahead.popleft()
        other = next((x for x in (*reversed(before), *ahead) if not page.copies(x)), None)
        if before and page.copies(before[-1]):
            before[-1] = page
        else:
            before[:] = [*before, page][-2:]
        return page, other

    for page in pages:
        ahead.append(page)
        if len(ahead) > AHEAD:
            yield next_one()
    while ahead:
        yield next_one()


def url_key(url: str | None) -> tuple[str, str]:
    """Host, and path with numbers written so that they sort as numbers."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", (url or "").strip())
    rest = rest.lstrip("/")
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.lower(), re.sub(r"\d+", lambda m: m[0].lstrip("0").rjust(12, "0"), path.rstrip("/"))


def page_key(url: str | None, id_: object, html: str) -> str:
    """Orders pages by host and path; equal URLs by a hash of the page, so that they can be parted too."""
    host, path = url_key(url)
    return f"{host}\x01{path}\x02{xxhash.xxh64_hexdigest(f'{id_}{html}'.encode('utf-8', 'surrogatepass'))}"


def _host(key: str) -> str:
    return key.split("\x01", 1)[0]


def _sketches(df: DataFrame) -> DataFrame:
    """(key, host, page, lines): each page's key, and the hashes of all of its lines together and of each."""

    def run(batches):
        for batch in batches:
            keys, whole, lines = [], [], []
            for id_, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys.append(page_key(url, id_, html or ""))
                lines.append(sorted({line_hash(t) for _, t in page_lines(html or "")}))
                whole.append(line_hash(str(lines[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([_host(k) for k in keys], pa.string()), pa.array(whole, pa.int64()), pa.array(lines, pa.list_(pa.int64()))], names=["key", "host", "page", "lines"])

    return df.mapInArrow(released(run), "key string, host string, page long, lines array<long>")


def recurring_lines(sketches: DataFrame) -> DataFrame:
    """(host, lines): hashes of each host's recurring lines, at most 1 / RECURRING times as many as a page has on average."""
    once = sketches.groupBy("host", "page").agg(F.first("lines").alias("lines"))  # equal pages count once
    size = once.groupBy("host").agg(F.count("*").alias("pages"))
    often = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING_PAGES)
    return often.join(size, "host").where(F.col("n") >= RECURRING * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def _bounds(sketches: DataFrame) -> list[str]:
    """Keys that part the pages in stretches of similar counts: quantiles of keys chosen by their hash."""
    pages = sketches.count()
    want = min(STRETCHES, pages // STRETCH_PAGES) + 1
    if want == 1:
        return []
    every = max(1, pages // (want * LOOKS))
    keys = sorted(r.key for r in sketches.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect())
    return sorted({keys[i * len(keys) // want] for i in range(1, want)}) if keys else []


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: id, url, text, n_chars.

    Null or empty html gives an empty text; a null url counts as a host of its own kind (empty).
    Pages of equal URLs are neighbours in the order of a hash; repeated rows stay. A page with copies
    only in reach loses the host's recurring lines; one alone on its host is judged by its markup. Null ids stay null; other columns are
    dropped; an empty table gives an empty result. Nothing is capped.
    """
    prepare(df.sparkSession)
    given = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    sketches = stored(_sketches(given), "page-sketches")
    bounds = _bounds(sketches)
    # each stretch also gets the last page before it and the first after it, if the host goes on
    ghosts = _ghosts(sketches, bounds)

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[list] = [[] for _ in range(7)]
                for id_, url, html in zip(*(batch.column(k).slice(at, 200).to_pylist() for k in range(3)), strict=True):
                    key, lines = page_key(url, id_, html or ""), page_lines(html or "")
                    for part, ghost in [(bisect_right(bounds, key), False), *((p, True) for p in ghosts.get(key, ()))]:
                        for column, value in zip(out, (id_, url, key, part, [kind for kind, _ in lines], [text for _, text in lines], ghost), strict=True):
                            column.append(value)
                types = (batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.list_(pa.int8()), pa.list_(pa.string()), pa.bool_())
                cols = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out[0]), pa.list_(pa.int64()))], names=["id", "url", "key", "part", "kinds", "lines", "ghost", "recurring"])

    def head(batches):
        for batch in batches:
            hosts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(f"{h}\x01", p, r) for h, r in zip(hosts, lines, strict=True) for p in range(bisect_right(bounds, f"{h}\x01"), bisect_right(bounds, f"{h}\x02") + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "part", "recurring"])

    kind = dict(given.dtypes)["id"]
    pages = given.mapInArrow(released(read), f"id {kind}, url string, key string, part int, kinds array<byte>, lines array<string>, ghost boolean, recurring array<long>")
    # a host's recurring lines stand before its pages in each of its stretches
    heads = recurring_lines(sketches).mapInArrow(head, "key string, part int, recurring array<long>")
    pages = pages.unionByName(heads.withColumn("ghost", F.lit(True)), allowMissingColumns=True)

    def differ(batches):
        host, recurring, rows, types = None, frozenset(), [], None

        def hosts():
            """Pages one after the other, in runs of one host and stretch."""
            nonlocal types, recurring
            for batch in batches:
                types = batch.schema
                for row in batch.to_pylist():
                    yield (row["part"], _host(row["key"])), row

        def run(first, rest):
            """Pages of the run that begins with the row ``first``; what comes after is left in ``rest``."""
            nonlocal recurring
            recurring = frozenset()
            name, row = first
            while row is not None:
                if row["recurring"] is not None:
                    recurring = frozenset(row["recurring"])
                else:
                    page = Page(row["key"], row["kinds"], row["lines"], recurring)
                    page.row = row
                    yield page
                following = next(rest, (None, None))
                if following[0] != name:
                    left.append(following)
                    return
                row = following[1]

        stream, left = hosts(), []
        first = next(stream, (None, None))
        while first[1] is not None:
            for page, other in differences(run(first, stream)):
                if not page.row["ghost"]:
                    rows.append((page.row["id"], page.row["url"], page.text(other)))
                if len(rows) >= 200:
                    yield _texts(rows, types)
                    rows = []
            first = left.pop() if left else (None, None)
        if rows:
            yield _texts(rows, types)

    found = pages.repartition("part").sortWithinPartitions("part", "key").mapInArrow(released(differ), f"id {kind}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _texts(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field("id").type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())], names=["id", "url", "text", "n_chars"])


def _ghosts(sketches: DataFrame, bounds: list[str]) -> dict[str, list[int]]:
    """Stretches that get a page besides its own, by the page's key."""
    if not bounds:
        return {}

    @F.pandas_udf("int")
    def part(keys):
        return keys.map(lambda k: bisect_right(bounds, k))

    ends = sketches.withColumn("part", part("key")).groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
    found: dict[str, list[int]] = {}
    for a, b in zip(ends, ends[1:], strict=False):
        if _host(a.hi) == _host(b.lo):
            found.setdefault(a.hi, []).append(b.part)
            found.setdefault(b.lo, []).append(a.part)
    return found
