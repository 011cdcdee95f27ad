"""HTML extraction: equivalence-class template deduction over the pages of a host.

A page is read as a sequence of tokens: its tags with class, id and role, and its blocks of text
(by a hash of the whole block). Tokens of a host whose occurrence vectors (how often each page has
them) are equal form a class; the vector is kept as a sum of hashes over pages, so that it is a
grouped aggregate and a host with any share of the pages never meets in one task. A class is valid
if enough of the host's pages have it. Blocks of valid classes are the template's own text; what
is left of an element after those nested in it is its varying text. The template's slot for the
main text is an element of a class that holds once on a page: an article or main element with at
least half of the host's varying text, or else the innermost container with most of it, those of
classes of several tokens first. Each page is then cut at the template and what varies in that
slot comes out: blocks constant over the host's pages go, and so do elements that a fixed list of
names marks as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments, whose text may vary from page to page like the main text. Where a host has no slot,
blocks that recur on most of its pages go.

Cases. Null or empty html: empty text. Pages that end early, unclosed or stray tags, quotes and
comments are read as far as they go. A null or unusual url belongs to the host ''. Pages of a
host with too few pages for a template go by their own elements. A page whose slot has constant
blocks only (copies of one page) keeps them. Repeated rows come out alike.
Null page_ids are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import lean, raw
from .common import chosen, small, written

#: Share of a host's pages that a valid class is on, and the least number of such pages.
SUPPORT = 0.5
LEAST = 3
#: Share of a host's pages on which a block of text makes it template text.
RECURS = 0.6
#: Inside the slot a block may recur and still be main text: there it is constant on at least this
#: share of the host's pages, and on this number of pages. Headings stay, however often they recur.
CONSTANT, CONSTANT_LEAST = 0.8, 6
#: Hosts up to which templates are broadcast; beyond, pages of a host are dealt to so many places.
HOSTS, SALTS = 20_000, 16
#: Share of a host's varying text in the slot: of an article or main element, of any container.
NAMED_HOLDS, HOLDS = 0.5, 0.8

# Element names and the words in class, id and role that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title|svg|canvas|object|select"
DROP = set("script style noscript template textarea iframe title svg canvas object select head nav footer aside form button dialog menu".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus dialog footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related reply replies respond share sharing shares sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo search alert".split())
#: Words that say nothing of what an element holds, beside one of MARKS.
PLAIN = set("area article articles bar block body bottom box btn button buttons card center col column container content desktop feed fixed form global group here icon icons inner item items label left link links list main mobile outer overlay page pages panel placeholder post posts primary reader readers right row secondary section side site slot small sticky stories text thread title top unit us user users view wrap wrapper zone".split())
_MARK_PAIRS = re.compile(r"(?:^|[-_\s])(?:side-?bar|nav-?bar|pop-?up|sign-?up|log-?in)(?=$|[-_\s])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*\Z", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

_marked: dict[str, tuple[str, bool]] = {}


def host_of(url: str):
    """The host of an address, or nothing."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def boilerplate(value: str) -> bool:
    """Whether a whole class name, id or role is one of boilerplate: a word of MARKS, with none beside
    it that tells of other things (`related-posts` is, `related-work` and `search-engine` aren't)."""
    parts = [p for p in _SPLIT.split(_MARK_PAIRS.sub("-sidebar-", value)) if p and not p.isdigit()]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in PLAIN for p in parts)


def token(name: str, attrs: str) -> tuple[str, bool]:
    """A tag's token, and whether it begins boilerplate."""
    if "=" not in attrs:
        return name, name in DROP
    got = _marked.get(key := name + attrs) if len(attrs) < 200 else None
    if got is None:
        found = [(a.lower(), (b or c or d or "").lower()) for a, b, c, d in _ATTR.findall(attrs)]
        mark = name in DROP
        for _, value in found:
            mark = mark or any(map(boilerplate, value.split()))
        if name in ("html", "body", "article", "main"):
            mark = False
        # digits vary from page to page: an id or a class is a token without them
        got = name + "".join(f"[{a}={re.sub('[0-9]+', '#', v)}]" for a, v in sorted(found) if v), mark
        if len(attrs) < 200:
            if len(_marked) > 20_000:
                _marked.clear()
            _marked[key] = got
    return got


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(0, text, ''), (1, name, attributes) at a start tag, (2, name, '') at an end tag."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield 0, page[at : m.start()], ""
        at = m.end()
        if name := m[3] or m[6]:
            if m[2] or m[5]:
                yield 2, name.lower(), ""
            else:
                yield 1, name.lower(), m[4] or m[7] or ""
    if at < len(page):
        yield 0, page[at:], ""


def clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def block(text: str) -> str:
    """What a block of text is known by."""
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def walk(page: str, slot: str | None):
    """(blocks in the slot, blocks outside boilerplate, tokens, places): tokens are (token, depth,
    text kept inside, boilerplate, place of the token around) in page order, places the innermost
    tokens around the blocks outside boilerplate (-1: none)."""
    stack: list[list] = []  # name, token, in boilerplate, in slot, place in seen
    opened: dict[str, list[int]] = {}  # where each name is open in the stack
    blocks: list[int] = []  # and where blocks are
    seen: list[list] = []
    inside: list[str] = []
    outside: list[str] = []
    places: list[int] = []
    parts: list[str] = []
    drop = hit = False

    def flush() -> None:
        if parts:
            if not drop and (text := clean(parts)):
                outside.append(text)
                places.append(stack[-1][4] if stack else -1)
                if hit:
                    inside.append(text)
                if stack:
                    seen[stack[-1][4]][2] += len(text)
            parts.clear()

    def push(entry: list) -> None:
        opened.setdefault(entry[0], []).append(len(stack))
        if entry[0] in BLOCKS or entry[0] in DROP:
            blocks.append(len(stack))
        stack.append(entry)

    def off() -> list:
        top = stack.pop()
        opened[top[0]].pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        return top

    def pop() -> None:
        nonlocal drop, hit
        flush()
        top = off()
        if stack:
            seen[stack[-1][4]][2] += seen[top[4]][2]
        drop, hit = (stack[-1][2], stack[-1][3]) if stack else (False, False)

    for kind, a, b in events(page):
        if kind == 0:
            parts.append(a)
        elif kind == 1:
            if a in VOID:
                parts.append(" ") if a in ("br", "wbr", "img") else flush() if a == "hr" else None
                continue
            if a in BLOCKS:
                flush()
                if a in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") or a in DROP or a in ("article", "main"):
                    # an open paragraph, with what is open inside it, ends here
                    k = blocks[-1] if blocks else -1
                    if k >= 0 and (stack[k][0] == "p" or stack[k][0] == a and a in ("li", "dt", "dd", "tr", "td", "th")):
                        while len(stack) > k:
                            pop()
            name, mark = token(a, b)
            if mark or a in DROP or a == "header":
                flush()
            mark = mark or a == "header" and not hit
            seen.append([name, len(stack), 0, drop or mark, stack[-1][4] if stack else -1])
            drop, hit = drop or mark, hit or name == slot
            push([a, name, drop, hit, len(seen) - 1])
        else:
            if a in VOID:
                continue
            k = opened[a][-1] if opened.get(a) else -1
            if k < 0 or a not in BLOCKS and blocks and blocks[-1] > k:
                if a in BLOCKS:
                    flush()
                continue
            if a in BLOCKS or stack[k][2] != drop:
                flush()
            if any(s[0] in BLOCKS or s[2] != (stack[k - 1][2] if k else False) for s in stack[k:]):
                while len(stack) > k:
                    pop()
            else:  # inline: its text stays part of the open block
                while len(stack) > k:
                    off()
                drop, hit = (stack[-1][2], stack[-1][3]) if stack else (False, False)
    while stack:
        pop()
    flush()
    return inside, outside, seen, places


def around(seen: list[list], at: int, paths: dict[int, frozenset]) -> frozenset:
    """The tokens around a place; elements that add none share a set, however deep they are."""
    way = []
    while at not in paths:
        way.append(at)
        at = seen[at][4]
    found = paths[at]
    for k in reversed(way):
        name = seen[k][0]
        found = paths[k] = found if name in found else found | {name}
    return found


def vector(page_id: int, times: int) -> int:
    """What a page adds to the occurrence vector's hash of a token that it has so often."""
    x = (page_id * 0x9E3779B97F4A7C15 + times * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 29) & 0x7FFFFFFF


def tokens(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """host, token, path, and sums over pages: pages with it, occurrences, vector, once, depth,
    text kept inside; a block's token is = and its hash, its path the elements around it; token
    '' counts the host's pages and text. Tokens on fewer than `least` pages can't be valid."""
    names = ["host", "token", "path", "pages", "times", "vector", "once", "depth", "chars", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def rows() -> pa.RecordBatch:
            cols = list(zip(*([*k, *v] for k, v in held.items()), strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names)
            held.clear()
            return out

        for b in batches:
            hosts, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            data, off = raw(b.column(2))
            for k, host in enumerate(hosts):
                _, outside, seen, places = walk(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"), None)
                own: dict[str, list] = {}
                paths: dict[int, frozenset] = {-1: frozenset()}
                for name, depth, chars, mark, _ in seen:
                    x = own.setdefault(name, ["", 0, depth, 0, 0])
                    x[1] += 1
                    x[3] += chars
                    x[4] += mark
                for text, at in zip(outside, places, strict=True):
                    if (x := own.get(name := "=" + block(text))) is None:
                        x = own[name] = ["\0".join(sorted(around(seen, at, paths))), 0, 0, 0, 0]
                    x[1] += 1
                    x[3] += len(text)
                total = held.setdefault((host, ""), [""] + [0] * 7)
                total[1] += 1
                total[6] += sum(map(len, outside))
                for name, (path, times, depth, chars, mark) in own.items():
                    x = held.setdefault((host, name), [path] + [0] * 7)
                    x[0] = min(x[0], path)
                    for i, v in enumerate((1, times, vector(keys[k] or 0, times), times == 1, depth, chars, mark > 0), 1):
                        x[i] += v
                if len(held) > 50_000:
                    yield rows()
        if held:
            yield rows()

    found = pages.select("host", "page_id", "html").mapInArrow(lean(run), "host string, token string, path string, " + ", ".join(f"{n} long" for n in names[3:]))
    return found.groupBy("host", "token").agg(F.min("path").alias("path"), *(F.sum(n).alias(n) for n in names[3:])).where((F.col("token") == "") | (F.col("pages") >= least))


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """host, pages, slot (a token or null), recurring (blocks that are template text) and
    constant (those that are so inside the slot too).

    Valid tokens are on a fixed share of the host's pages, so a host has no more of them than
    its average page has tokens, over that share.
    """
    found = written(tokens(pages, least), "page-tokens")
    count = found.where("token = ''").select("host", F.col("pages").alias("host_pages"), F.col("chars").alias("all"))
    valid = found.where("token <> ''").join(small(count, count.count(), 100_000), "host").where((F.col("pages") >= least) & (F.col("pages") >= support * F.col("host_pages")))
    text = F.startswith(F.col("token"), F.lit("="))
    again = valid.where(text & (F.col("pages") >= RECURS * F.col("host_pages")))
    heading = F.col("path").rlike(r"(^|\x00)h[1-6](\[|\x00|$)")
    stays = ~heading & (F.col("pages") >= CONSTANT_LEAST) & (F.col("pages") >= CONSTANT * F.col("host_pages"))
    key = F.substring("token", 2, 32)
    blocks = again.groupBy("host").agg(F.sum("chars").alias("same_all"), F.collect_list(key).alias("recurring"), F.collect_list(F.when(stays, key)).alias("constant"))
    # the template's own text by the elements that it is nested in
    nested = again.select("host", "chars", F.explode(F.split("path", "\0")).alias("token")).groupBy("host", "token").agg(F.sum("chars").alias("same"))
    classes = valid.groupBy("host", "pages", "times", "vector").agg(F.count("*").alias("members"))
    once = valid.where(~text & (F.col("once") >= 0.9 * F.col("pages")) & (F.col("mark") < 0.5 * F.col("pages"))).join(classes, ["host", "pages", "times", "vector"])
    once = once.join(nested, ["host", "token"], "left").join(blocks.select("host", "same_all"), "host", "left")
    varies, all_varies = F.col("chars") - F.coalesce("same", F.lit(0)), F.col("all") - F.coalesce("same_all", F.lit(0))
    share = F.when(all_varies > 0, varies / all_varies).when(F.col("all") > 0, F.col("chars") / F.col("all")).otherwise(0.0)
    name = F.split("token", r"\[")[0]
    # an article on a part of the pages is measured against that part
    named = F.when(share * F.col("host_pages") / F.col("pages") < NAMED_HOLDS, 0).when(name == "article", 3).when((name == "main") | F.contains("token", F.lit("[role=main]")), 2).otherwise(0)
    box = name.isin("div", "section", "td", "table", "article", "main") & (share >= HOLDS)
    best = once.select("host", "token", "chars", named.alias("named"), (F.col("members") > 1).alias("several"), (F.col("depth") / F.col("pages")).alias("depth"), box.alias("box")).where("named > 0 or box")
    slot = best.groupBy("host").agg(F.max(F.struct("named", "several", "depth", "chars", "token")).alias("x")).select("host", F.col("x.token").alias("slot"))
    return count.join(slot, "host", "left").join(blocks, "host", "left").select("host", F.col("host_pages").alias("pages"), "slot", "recurring", "constant")


def cut(page: str, slot: str | None, recurring: set[str], constant: set[str]) -> str:
    """The main text of a page, by its host's template."""
    inside, outside, seen, _ = walk(page, slot)
    if not inside:
        for name, _, _, mark, _ in seen:  # a page that lacks the template's slot
            if not mark and name != slot and (name.split("[")[0] in ("article", "main") or "[role=main]" in name):
                inside = walk(page, name)[0]
                break
        else:
            if not any(name == slot for name, *_ in seen):
                return "\n".join(t for t in outside if not recurring or block(t) not in recurring)
    varies = [t for t in inside if block(t) not in constant] if constant else inside
    return "\n".join(varies or inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page of pages (page_id, url, html)."""
    rows = chosen(pages, page_id="long", url="string", html="string").withColumn("host", host_of("url"))
    found = written(templates(rows), "templates")
    n = found.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(2))
            slots, recurring, constant = b.column(3), b.column(4), b.column(5)
            text = [cut(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"), slots[k].as_py(), set(recurring[k].as_py() or ()), set(constant[k].as_py() or ())) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], ["page_id", "url", "text", "n_chars"])

    found = found.select("host", "slot", "recurring", "constant")
    if n <= HOSTS:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:  # a host may have any share of the pages
        salted = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_s", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_s"], "left")
    return joined.select("page_id", "url", "html", "slot", "recurring", "constant").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
