"""Main text of web pages: page structure, and suffix arrays of each host's pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import cut, spread_join

# Element and class names of HTML pages.
RAW = {"script", "style", "noscript", "template", "textarea", "select", "iframe", "svg", "math", "title", "object", "canvas", "video", "audio"}
CHROME = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
MAIN = {"article", "main"}
BLOCK = {"p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary", "body", "header", "head", "html", "center", "hgroup", "search"} | CHROME | MAIN
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "reply", "respond", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "note"}

_OPEN = re.compile(r"<(?:!--|/?[A-Za-z]|[!?/])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element is furniture: by its name, else by class, id, role, hidden."""
    if tag in CHROME or tag == "header" and not in_main:
        return True
    if not attrs.strip() or tag in ("html", "body") or tag in MAIN and in_main is None:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id") and NAMES.intersection(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


class Tags:
    """The tags of a page from left to right, each character looked at a bounded number
    of times: the places of the next closing quotes and comment ends are kept until the
    reading passes them, so an end that never comes is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.next = {q: -2 for q in ('"', "'", "-->", ">")}  # -2: not looked for yet

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` next stands, or the page's length."""
        if self.next[what] < at:
            p = self.page.find(what, at)
            self.next[what] = len(self.page) if p < 0 else p
        return self.next[what]

    def _end(self, at: int) -> int:
        """The > that ends a tag, quoted parts passed over; without one, the next >."""
        first = at
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            if close == len(self.page):
                return self._find(">", first)
            at = close + 1
        return self._find(">", first)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag: where it begins and ends, whether it closes, its name (none for
        comments and declarations) and attributes. A < that begins no tag is text."""
        page, n = self.page, len(self.page)
        m = _OPEN.search(page, at)
        if not m:
            return None
        if m[0] == "<!--":
            return m.start(), min(self._find("-->", m.end()) + 3, n), False, "", ""
        closes = m[0][1] == "/"
        name = _NAME.match(page, m.start() + 1 + closes)
        if not name:
            return m.start(), min(self._find(">", m.end()) + 1, n), False, "", ""
        end = self._end(name.end())
        if end == n:  # a page that ends within a tag
            return m.start(), n, False, "", ""
        return m.start(), end + 1, closes, name[0].lower(), page[name.end() : end]


def blocks(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """(block text, whether it is furniture or outside the main part) in page order,
    and whether the page marks a main part: an article or main element outside of
    furniture, not such a name in a script, comment or longer name. Tags are read
    leniently: an end tag closes the nearest open element of its name, others are
    ignored."""
    out: list[tuple[str, bool, bool]] = []  # text, furniture, main
    open_: list[tuple[str, bool, bool]] = []  # name, furniture from here on, main from here on
    depth: dict[str, int] = {}  # how many of a name are open
    part: list[str] = []
    marked = False

    def flush() -> None:
        if part:
            words = html.unescape("".join(part)).split()
            part.clear()
            if words:
                drop, main = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
                out.append((" ".join(words), drop, main))

    at, n, tags = 0, len(page), Tags(page)
    while at < n:
        m = tags.after(at)
        if not m:
            part.append(page[at:])
            break
        begin, end_, closes, tag, attrs = m
        if begin > at:
            part.append(page[at:begin])
        at = end_
        if not tag:
            continue
        if tag in RAW and not closes:
            if not attrs.rstrip().endswith("/"):
                end = _CLOSE[tag].search(page, at)
                gt = page.find(">", end.end()) if end else -1
                at = n if gt < 0 else gt + 1
            part.append(" " if tag not in ("title", "script", "style") else "")
            continue
        if tag == "br":
            part.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID or tag not in BLOCK and tag not in ("span", "a", "i", "b", "em", "strong", "small", "label", "ins"):
            continue
        if not closes:
            drop, main = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            inside = True if main else (None if tag in MAIN else False)
            furniture = _is_chrome(tag, attrs, inside)
            if tag in BLOCK and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody") or furniture:
                if furniture and not drop:
                    flush()
                open_.append((tag, drop or furniture, main or tag in MAIN))
                marked = marked or tag in MAIN and not (drop or furniture)
                depth[tag] = depth.get(tag, 0) + 1
        elif depth.get(tag):
            if open_[-1][1]:
                flush()
            while True:
                name = open_.pop()[0]
                depth[name] -= 1
                if name == tag:
                    break
    flush()
    return [(t, drop or marked and not main) for t, drop, main in out], marked


def ranks(seq: np.ndarray, most: int = 1 << 12) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ."""
    _, r = np.unique(seq, return_inverse=True)
    out, h = [r.astype(np.int64)], 1
    while h < most and h < len(seq) and out[-1].max() + 1 < len(seq):
        nxt = np.full(len(seq), -1, np.int64)
        nxt[:-h] = out[-1][h:]
        key = out[-1] * (len(seq) + 1) + nxt + 1
        _, r = np.unique(key, return_inverse=True)
        out.append(r)
        h *= 2
    return out


def repeated_tokens(streams: list[list[str | None]], least: int = 8) -> list[np.ndarray]:
    """For each page's tokens, which lie in a string of ``least`` tokens or more that
    distinct pages have; a None stands between blocks, and no string goes over it. Streams are joined in one sequence, each ended by a symbol of
    its own; its suffix array (prefix doubling) gives common prefixes of neighbours
    by comparing ranks from long to short; runs of ``least`` or more with over one
    page mark their tokens. Pages with equal streams count as one page."""
    first: dict[tuple, int] = {}
    names = [first.setdefault(tuple(s), len(first)) for s in streams]
    distinct = list(first)
    number: dict[str, int] = {}
    seq, page = [], []
    for k, s in enumerate(distinct):
        seq += [number.setdefault(t, len(number)) if t is not None else -len(distinct) - 1 - len(seq) - j for j, t in enumerate(s)]
        seq.append(-k - 1)
        page += [k] * (len(s) + 1)
    if not number:
        return [np.zeros(len(s), bool) for s in streams]
    a, p = np.array(seq), np.array(page)
    levels = ranks(a)
    order = np.argsort(levels[-1], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = i + lcp, j + lcp
        ok = (x < len(a)) & (y < len(a))
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        lcp[ok] += 1 << k
    covered = np.zeros(len(a) + 1, np.int64)
    group = np.concatenate(([0], np.cumsum(lcp < least)))
    low, high = np.full(group[-1] + 1, len(distinct)), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, p[order]), np.maximum.at(high, group, p[order])
    starts = order[(low < high)[group]]
    np.add.at(covered, starts, 1), np.add.at(covered, np.minimum(starts + least, len(a)), -1)
    flags = np.cumsum(covered)[:-1] > 0
    ends = np.flatnonzero((a < 0) & (a >= -len(distinct)))
    begins = np.concatenate(([0], ends[:-1] + 1))
    return [flags[begins[k] : ends[k]] for k in names]


def host_texts(pages: list[str], least: int = 8) -> list[str]:
    """Main texts of pages of one host. Furniture goes by structure. What stands
    outside a marked main part, and everything on pages that mark none, is searched
    for token strings that distinct pages of the host repeat; on pages that mark no
    main part those are removed and the unique runs stay. A marked main part stays
    whole: its author says where the article is."""
    parsed = [blocks(p) for p in pages]
    streams, where = [], []
    for found, marked in parsed:
        use = [k for k, (_, drop) in enumerate(found) if drop or not marked]
        where.append(use)
        streams.append([t for k in use for t in (*found[k][0].split(" "), None)])
    of: dict[str, set[int]] = {}  # a block of under ``least`` tokens is compared whole
    copy: dict[tuple, int] = {}
    for n, ((found, _), use) in enumerate(zip(parsed, where)):
        same = copy.setdefault(tuple(streams[n]), n)
        for k in use:
            if found[k][0].count(" ") < least - 1:
                of.setdefault(found[k][0], set()).add(same)
    out = []
    for (found, marked), use, flags in zip(parsed, where, repeated_tokens(streams, least)):
        if marked:
            out.append("\n".join(t for t, drop in found if not drop))
            continue
        at, kept = 0, []
        for k in use:
            words = found[k][0].split(" ")
            own = [w for w, f in zip(words, flags[at : at + len(words)]) if not f]
            at += len(words) + 1
            if own and not found[k][1] and len(of.get(found[k][0], ())) < 2:
                kept.append(" ".join(own))
        out.append("\n".join(kept))
    return out


RESULT = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = "host string, page_id long, url string, stream binary, marked boolean, texts array<string>, drops array<boolean>, uid long"


def _digest(*parts: str) -> bytes:
    return xxhash.xxh3_128_digest("\0".join(parts).encode())


def _units(texts: list[str], least: int) -> set[bytes]:
    """Digests of a stream's distinct strings of ``least`` tokens, and of its shorter
    blocks, which are compared whole."""
    out = set()
    for t in texts:
        words = t.split(" ")
        if len(words) < least:
            out.add(_digest("b", t))
        else:
            out.update(_digest("s", *words[i : i + least]) for i in range(len(words) - least + 1))
    return out


def _without(texts: list[str], drops: list[bool], repeated: set[bytes], least: int) -> str:
    """What ``host_texts`` keeps of a page that marks no main part."""
    kept = []
    for t, drop in zip(texts, drops):
        words = t.split(" ")
        if drop or len(words) < least and _digest("b", t) in repeated:
            continue
        covered = np.zeros(len(words), bool)
        for i in range(len(words) - least + 1):
            if _digest("s", *words[i : i + least]) in repeated:
                covered[i : i + least] = True
        own = [w for w, c in zip(words, covered) if not c]
        if own:
            kept.append(" ".join(own))
    return "\n".join(kept)


def _result(ids, urls, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def large_hosts(rows: DataFrame, least: int = 8) -> DataFrame:
    """``RESULT`` for pages (page_id, url, html, host) of hosts too large for one task,
    the same as by ``host_texts`` over each whole host.

    A string of ``least`` tokens repeats if distinct streams of its host have it: the
    least and the greatest stream digest of each string's, combined before the shuffle,
    differ. Pages without a marked main part get their repeated strings back by a join
    that deals common strings over many tasks, then by the row's number, so neither a
    host nor a string is one task's burden. Digests have 128 bits."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for page in b.column(2).to_pylist():
                found, marked = blocks(page)
                used = [t for t, drop in found if drop or not marked]
                for x, v in zip(out, (_digest(str(len(used)), *used), marked, [t for t, _ in found], [bool(d) for _, d in found])):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_()))))], names=[c.split()[0] for c in PARSED.split(", ")][:7])

    parsed = rows.select("page_id", "url", "html", "host").mapInArrow(parse, PARSED.rpartition(",")[0])
    parsed = cut(parsed.withColumn("uid", F.monotonically_increasing_id()), "html-parsed")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, stream, uid, gram = [], [], [], []
            for h, s, u, marked, texts, drops in zip(*(b.column(i).to_pylist() for i in range(6))):
                found = _units([t for t, d in zip(texts, drops) if d or not marked], least)
                host += [h] * len(found)
                stream += [s] * len(found)
                uid += [u] * len(found)
                gram += found
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(stream, pa.binary()), pa.array(uid, pa.int64()), pa.array(gram, pa.binary())], names=["host", "stream", "uid", "gram"])

    units = lambda df: df.select("host", "stream", "uid", "marked", "texts", "drops").mapInArrow(strings, "host string, stream binary, uid long, gram binary")
    repeated = units(parsed).groupBy("host", "gram").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi"), F.count("*").alias("n"))
    repeated = cut(repeated.where("lo <> hi").select("host", "gram", "n"), "html-repeats")
    free = parsed.where("not marked")
    asked = cut(units(free).select("host", "uid", "gram"), "html-strings")
    total = asked.count()
    found = spread_join(asked, repeated.select("host", "gram"), ["host", "gram"], repeated, total) if total else asked
    own = found.groupBy("uid").agg(F.collect_list("gram").alias("grams"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for marked, found, drops, grams in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                texts.append("\n".join(t for t, d in zip(found, drops) if not d) if marked else _without(found, drops, set(grams or ()), least))
            yield _result(b.column(0), b.column(1), texts)

    whole = parsed.where("marked").withColumn("grams", F.lit(None).cast("array<binary>"))
    cols = ["page_id", "url", "marked", "texts", "drops", "grams"]
    return whole.select(cols).union(free.join(own, "uid", "left").select(cols)).mapInArrow(finish, RESULT)


def extract(pages: DataFrame, slice_pages: int = 512, slice_mb: int = 32, least: int = 8, broadcast_hosts: int = 50_000) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Pages move once, to their host's task; pages of hosts of over ``slice_pages`` pages
    or ``slice_mb`` megabytes go by ``large_hosts``, with the same result, so no task
    holds a large host; of a very long page, a task holds that page. The
    large hosts' list is broadcast up to ``broadcast_hosts`` rows,
    beyond that joined by a shuffle. Null html: empty text. Null url: a host of its
    own. Null page_id: kept as null. Repeated rows: one result each, and one page in
    the search for repeats. Empty table: no rows. Other columns are not read."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    sizes = pages.select(host.alias("large"), F.octet_length("html").alias("size")).groupBy("large").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    large = sizes.where((F.col("n") > slice_pages) | (F.col("size") > slice_mb << 20))
    n = large.limit(broadcast_hosts + 1).count()
    many = None
    if n:
        large = F.broadcast(large.select("large")) if n <= broadcast_hosts else large.select("large")
        many = rows.join(large, F.col("host") == F.col("large"), "left_semi")
        rows = rows.join(large, F.col("host") == F.col("large"), "left_anti")
    dealt = rows.repartition("host").sortWithinPartitions("host", "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        urls: list = []
        bodies: list = []
        at = None

        def solve() -> Iterator[pa.RecordBatch]:
            texts = host_texts(bodies, least)
            for i in range(0, len(ids), 1000):
                yield _result(ids[i : i + 1000], urls[i : i + 1000], texts[i : i + 1000])

        for b in batches:
            for page_id, url, body, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if key != at and ids:
                    yield from solve()
                    ids, urls, bodies = [], [], []
                at = key
                ids.append(page_id), urls.append(url), bodies.append(body)
        if ids:
            yield from solve()

    few = dealt.mapInArrow(run, RESULT)
    return few.union(large_hosts(many, least)) if many is not None else few
