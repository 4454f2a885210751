"""Main text of web pages: templates deduced from tokens that share their occurrence vectors over the pages of a host."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, durable, small_batches, texts

#: A class of tokens counts if so many tokens share its vector, on so many pages and so large a share of the host's pages.
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 3, 3, 0.5
#: A slot is not the article if links or text that the host repeats make up more than this share of it. The slot with the most
#: text is the article unless another one has this share of that, which is a tie.
REPEATED, TIED = 0.5, 0.5
#: Roles that one task holds before it sends what it has counted; bytes of templates up to which they are broadcast.
HELD, BROADCAST_BYTES = 100_000, 8 << 20

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_INSIDE = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that stand inside a line without parting it.
_UNSEEN = frozenset("script style iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td template tfoot th thead title tr ul".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption tr tbody thead tfoot".split())
#: Elements that are never part of an article.
_DROPPED = frozenset("head title script style noscript template textarea iframe xmp noembed noframes nav footer aside form button select option optgroup fieldset legend dialog menu search svg canvas object audio video math".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or an id that name something beside the article.
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login comment comments "
    "disqus respond replies share sharing social related recommended widget toolbar pagination pager copyright masthead".split()
)
#: End tags a start tag implies, and where the search for them stops.
_IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Open(NamedTuple):
    """An open element: its tag, its role (path of tags with their classes), the path of its container, and where it is.

    dropped is the path of the innermost element around it that is never part of an article, as far as tags and names tell.
    """

    tag: str
    path: str
    container: str
    dropped: str
    main: bool
    children: dict[str, int]


class Block(NamedTuple):
    text: str
    container: str
    dropped: str
    main: bool
    linked: int


@lru_cache(maxsize=20_000)
def _read_attrs(tag: str, raw: str) -> tuple[str, bool]:
    """(what the class and the id add to a role, whether the attributes name something beside the article)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    own = " ".join(filter(None, (found.get("class"), found.get("id"))))
    words = {w.lower() for w in _WORDS.findall(own)}
    beside = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES or not words.isdisjoint(_NAMES) or (tag != "article" and "header" in words)
    mark = _DIGITS.sub("0", own)
    if found.get("role", "").lower() in ("main", "article"):
        mark += "[main]"
    return ("." + mark if mark else ""), beside


def parse(html: str) -> tuple[dict[str, int], list[Block], list[str]]:
    """(occurrences of each token, blocks of text in page order, tokens by first occurrence) of one page.

    A token is a start or end tag in its role, which holds the path to it; containers of one kind in one parent are told apart
    by their order. References are decoded, white space in a block becomes one space; empty blocks are left out.
    """
    counts: dict[str, int] = {}
    blocks: list[Block] = []
    stack = [Open("", "", "", "", False, {})]
    buffer: list[str] = []
    linked, link = 0, 0  # characters inside links since the last block, and the depth of the element that holds an open link

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.container, top.dropped, top.main, min(linked, len(text))))
        linked = 0

    def close(to: int) -> None:
        nonlocal link
        flush()
        del stack[to:]
        if len(stack) < link:
            link = 0

    at = 0
    while (m := _TAG.search(html, at)) is not None:
        if m.start() > at:
            buffer.append(html[at : m.start()])
            linked += m.start() - at if link else 0
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                buffer.append(m["cdata"].replace("&", "&amp;"))
            continue
        tag = name.lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in _BLOCK and tag not in _DROPPED:
            if tag == "a":
                link = 0 if m["end"] else len(stack)
            if m["end"] == "":
                token = f"{stack[-1].path}<{tag}"
                counts[token] = counts.get(token, 0) + 1
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    token = f"{stack[i].path}>"
                    counts[token] = counts.get(token, 0) + 1
                    close(i)
                    break
            else:
                flush()
            continue
        if tag not in _UNSEEN:
            flush()
        if tag in _IMPLIED:
            ends, stop = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends.split():
                    close(i)
                    break
        if stack[-1].tag == "p" and tag not in _UNSEEN:
            close(len(stack) - 1)
        if tag in ("article", "main", "body"):
            # a menu, a page header or the head that was never closed ends here
            for i in range(1, len(stack)):
                if stack[i].tag in ("nav", "header", "head"):
                    close(i)
                    break
        up = stack[-1]
        mark, beside = _read_attrs(tag, m["attrs"]) if m["attrs"].strip(" /") else ("", False)
        main = up.main or tag in ("article", "main") or mark.endswith("[main]")
        path = f"{up.path}/{tag}{mark}"
        if tag not in _LEAF:
            nth = up.children[path] = up.children.get(path, 0) + 1
            path += f"[{nth}]" if nth > 1 else ""
        beside = tag in _DROPPED or (tag == "header" and not up.main) or (beside and tag not in ("html", "body", "main"))
        dropped = path if beside else up.dropped
        counts[path] = counts.get(path, 0) + 1
        if tag in _INSIDE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        if tag not in _VOID:
            stack.append(Open(tag, path, up.container if tag in _LEAF else path, dropped, main, {}))
    buffer.append(html[at:])
    flush()
    return counts, blocks, list(counts)


def _text_token(block: Block) -> str:
    return f"{block.container}#{xxh64_intdigest(block.text.encode(), 3):x}"


_STATS = ("chars", "linked", "beside", "marked")
_COUNTED = "host string, token string, pages long, total long, one long, two long, place double, " + ", ".join(f"{x} long" for x in _STATS)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, occurrences, two sums that tell occurrence vectors apart, places, and characters of text.

    Text counts for its container and for itself: all, in links, in elements beside the article, and in marked articles.
    """
    held: dict[tuple[str, str], list] = {}

    def send() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 4, pa.float64(), *[pa.int64()] * len(_STATS))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _COUNTED.split(", ")])

    for batch in batches:
        for name, host, html in zip(column(batch, "page_id").to_pylist(), column(batch, "host").to_pylist(), texts(batch, "html"), strict=True):
            if not host:
                continue
            counts, blocks, order = parse(html)
            stats: dict[str, tuple[int, ...]] = {}
            for b in blocks:
                n = len(b.text)
                own = (n, b.linked, n if b.dropped else 0, n if b.main else 0)
                token = _text_token(b)
                for key in (b.container, token):
                    stats[key] = tuple(map(sum, zip(stats[key], own, strict=True))) if key in stats else own
                counts[token] = counts.get(token, 0) + 1
                if counts[token] == 1:
                    order.append(token)
            page = xxh64_intdigest(html.encode("utf-8", "surrogatepass"), (name or 0) & (1 << 63) - 1)
            counts[""] = 1
            place = {t: i / len(order) for i, t in enumerate(order)}
            for token, n in counts.items():
                h = xxh64_intdigest(n.to_bytes(8, "little"), page)
                row = held.get((host, token))
                if row is None:
                    row = held[(host, token)] = [0, 0, 0, 0, 0.0, *[0] * len(_STATS)]
                row[0] += 1
                row[1] += n
                row[2] += h & 0xFFFFFFFF
                row[3] += h >> 32
                row[4] += place.get(token, 0.0)
                for i, x in enumerate(stats.get(token, ())):
                    row[5 + i] += x
            if len(held) > HELD:
                yield send()
    if held:
        yield send()


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, main): the template of each host.

    Tokens whose occurrence vectors over the host's pages are equal (equal page counts, sums and hashes of the vectors) form a
    class. Classes of enough tokens, on enough pages, are valid; nested by the paths of their tokens they are the template.
    tokens lists (token, class, chars, linked, beside, marked, repeated) of valid classes in page order; it is bounded by the
    tokens of two pages of the host, as each stands on half of its pages. repeated are the characters in a container's texts
    that themselves belong to the template. main is the slot that article_slots puts first.
    """
    counted = pages.mapInArrow(_occurrences, _COUNTED)
    sums = counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "one", "two", "place", *_STATS)))
    # the many texts of one page only end here: what a host's pages share is little
    shared = durable(sums.where((F.col("pages") >= CLASS_PAGES) | (F.col("token") == "")))
    size = shared.where("token = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = shared.where("token <> ''").join(size, "host").where(F.col("pages") >= CLASS_SHARE * F.col("host_pages"))
    vector = ["host", "pages", "total", "one", "two"]
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", *_STATS)
    classes = frequent.groupBy(*vector).agg(F.count("*").alias("n"), F.collect_list(member).alias("members")).where(F.col("n") >= CLASS_TOKENS)
    of = F.struct("m.place", "m.token", F.xxhash64(*vector[1:]).alias("class"), *(f"m.{x}" for x in _STATS))
    listed = classes.withColumn("m", F.explode("members")).groupBy("host").agg(F.array_sort(F.collect_list(of)).alias("tokens"))
    repeated = frequent.where("instr(token, '#') > 0").groupBy("host", F.substring_index("token", "#", 1).alias("slot")).agg(F.sum("chars").alias("n"))
    texts_ = repeated.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("repeated"))
    return size.select("host").join(listed, "host", "left").join(texts_, "host", "left").mapInArrow(_with_main, _TEMPLATE)


_TOKEN = ("token", "class", *_STATS, "repeated")
_TEMPLATE = f"host string, tokens array<struct<token:string,{','.join(f'{x}:bigint' for x in _TOKEN[1:])}>>, main string"


def _with_main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("token", pa.string()), *((x, pa.int64()) for x in _TOKEN[1:])]))
    for batch in batches:
        tokens = []
        for own, repeated in zip(column(batch, "tokens").to_pylist(), column(batch, "repeated").to_pylist(), strict=True):
            more = dict(repeated or [])
            tokens.append([{k: t[k] for k in _TOKEN[:-1]} | {"repeated": more.get(t["token"], 0)} for t in own or []])
        first = [next(iter(article_slots(own)), None) for own in tokens]
        yield pa.RecordBatch.from_arrays([column(batch, "host"), pa.array(tokens, kind), pa.array(first, pa.string())], ["host", "tokens", "main"])


def _fits(token: dict) -> bool:
    return token["chars"] > 0 and "#" not in token["token"] and token["linked"] <= REPEATED * token["chars"] and token["repeated"] <= REPEATED * token["chars"]


def article_slots(template: list[dict]) -> list[str]:
    """The template's slots that may hold the article, the likeliest first: text of their own, not links or repeated text.

    More text over the host's pages goes first. Tags and names only settle a tie for the first place.
    """
    fit = sorted((t for t in template if _fits(t)), key=lambda t: (t["linked"] - t["chars"], t["token"]))
    tied = [t for t in fit if t["chars"] - t["linked"] >= TIED * (fit[0]["chars"] - fit[0]["linked"])]
    if len(tied) > 1:
        best = min(tied, key=lambda t: (2 * t["beside"] > t["chars"], 2 * t["marked"] <= t["chars"], fit.index(t)))
        fit.remove(best)
        fit.insert(0, best)
    return [t["token"] for t in fit]


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def region(main: str, template: list[dict]) -> str:
    """The element around the main slot whose other slots may all hold text of the article; body and marked articles end it."""
    top = main
    while (up := _parent(top)).count("/") > 2 and not re.match(r"(?:article|main)\b", top.rpartition("/")[2]):
        if not all(_fits(t) for t in template if t["chars"] and "#" not in t["token"] and _under(t["token"], up)):
            break
        top = up
    return top


def slots(blocks: list[Block], template: dict[str, int]) -> dict[str, list[int]]:
    """Blocks by slot: the deepest token of the template on the path of a block's container."""
    out: dict[str, list[int]] = {}
    for i, b in enumerate(blocks):
        path = b.container
        while path and path not in template:
            path = _parent(path)
        out.setdefault(path, []).append(i)
    return out


def _ordered(template: list[tuple[str, int]], order: list[str]) -> dict[str, int]:
    """The template's tokens, without classes whose tokens stand in another order on this page."""
    here = {t: i for i, t in enumerate(order)}
    last: dict[int, int] = {}
    bad = set()
    for token, kind in template:
        if "#" in token or token not in here:
            continue
        if here[token] < last.get(kind, -1):
            bad.add(kind)
        last[kind] = here[token]
    return {t: k for t, k in template if k not in bad or "#" in t}


def chosen(html: str, template: list[dict] = ()) -> tuple[list[str], bool]:
    """(blocks of the page's article, whether the template chose them).

    Blocks are grouped by the template's slots. The first of article_slots that this page has is the article, with its region; inside of it only what tags and names tell to be beside an article is left out, and nothing else. A host
    without a template, or a page without its slots, is decided by marked articles, or else by the page's own container with
    the most text, outside elements beside the article.
    """
    _, blocks, order = parse(html)
    here = set(order)
    known = _ordered([(t["token"], t["class"]) for t in template], order) if template else {}
    main = next((x for x in article_slots(template) if x in here and x in known), None)
    if main is not None:
        top = region(main, template)
        fit = {t["token"] for t in template if _fits(t)}
        found = slots(blocks, known)
        inside = {i for slot, own in found.items() if _under(slot, top) for i in own}
        # a title or a lead that stands in an element around the region, but not in the body
        inside |= {i for slot, own in found.items() if slot in fit and slot.count("/") > 2 and _under(top, slot) for i in own if blocks[i].container == slot}
        kept = [b for i, b in enumerate(blocks) if i in inside and not (b.dropped.startswith(top + "/") or (b.dropped and not _under(b.container, top)))]
        return [b.text for b in kept], True
    live = [b for b in blocks if not b.dropped]
    kept = [b for b in live if b.main]
    if not kept and live:
        chars: dict[str, int] = {}
        for b in live:
            chars[b.container] = chars.get(b.container, 0) + len(b.text)
        top = max(chars, key=chars.get)
        kept = [b for b in live if _under(b.container, top)]
    return [b.text for b in kept], False


def main_text(html: str, template: list[dict] = ()) -> str:
    """Blocks of the page's article, joined by two line feeds."""
    return "\n\n".join(chosen(html, template)[0])


_TEXT = "page_id long, url string, text string, n_chars long, by_template boolean"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[dict]] = {}
    for batch in batches:
        out, by = [], []
        for host, html, tokens in zip(column(batch, "host").to_pylist(), texts(batch, "html"), column(batch, "tokens"), strict=True):
            if host not in known:
                if len(known) > 256:
                    known.clear()
                known[host] = tokens.as_py() or []
            blocks, template = chosen(html, known[host])
            out.append("\n\n".join(blocks))
            by.append(template)
        yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(by, pa.bool_())], [x.split()[0] for x in _TEXT.split(", ")])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_template (whether the host's template chose the text) of every row of pages (page_id, url, html).

    Templates come from all pages of a host; counts are summed in each task first, so a host with a third of all pages is no
    more work for one task. Templates join pages by host, broadcast if they are small. Null html is empty, an empty page has an
    empty text; pages without a host have no template; repeated rows are rows like others; other columns are ignored; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").alias("html"))
    found = durable(templates(rows.select("page_id", "host", "html")))
    size = found.agg(F.sum(F.aggregate("tokens", F.lit(0), lambda a, x: a + F.length(x["token"]) + 64))).first()[0] or 0
    by_host = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")
    return rows.join(by_host, "host", "left").mapInArrow(_extracted, _TEXT)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 4: main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
