"""Main text of web pages: the article's blocks, and a host suffix array for what is repeated.

A page is cut into blocks by its markup. Blocks of menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles are marked by their elements. The token streams of all
blocks of all pages make one suffix array per host, in which a run of at least `run` tokens that
suffixes of distinct pages share is boilerplate. Such suffixes have equal first tokens, so they are
found as groups by host and first `run` tokens, without a sort: the tokens that all these groups
cover are those of the runs of any length. The main text of every page is, in page order, the text
of its article elements and what no run covers of its other unmarked text. The text of an article
element is its page's own even where another page repeats it; it is not cut, but counts as a
repeat of text elsewhere. Suffixes that can meet no token that may be cut decide nothing; hosts
without such a token are left out, and where there are few, suffixes unlike theirs.

Defined cases: null and empty html give an empty text; null page ids, urls and repeated rows are
handled row by row (rows with equal page id and url count as one page); pages without a host share
the empty host; an empty table gives no rows; other columns are left out; long pages are read whole
and once, from front to back. Ties do not occur: a run is repeated or not.
"""

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B
from plyforge.scale import BROADCAST_ROWS, keep_keys, lookup_join
from plyforge.session import written

RUN = 6  # tokens

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED_ELEMENTS = frozenset(
    "head nav header footer aside form button select textarea noscript template iframe svg menu"
    " dialog object canvas audio video".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
#: Words of class and id names (and roles) of the kinds of elements that are no part of the main text.
MARKED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb"
    " breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies"
    " disclaimer disqus footer header masthead menu menus nav navbar navigation newsletter notice"
    " notices notification notifications pagination promo promos promotion replies reply respond"
    " sidebar sidebars sponsor sponsored sponsors toolbar topbar".split()
)
#: Words that may stand beside them in a name such as `comment-list`; any other makes it another thing.
PLACE_NAMES = frozenset(
    "area bar block body bottom box container content count footer form global group inner item"
    " items label left links list main outer page panel primary right secondary section site slot"
    " text thread top unit wrap wrapper".split()
)
RAW_ELEMENTS = frozenset("script style noscript template textarea title xmp".split())
RAW_ENDS = {name: re.compile(rf"</{name}(?:\s[^>]*)?/?>", re.I) for name in RAW_ELEMENTS}
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_PART = re.compile(r"""[>]|=\s*(["'])""")
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"(?<![\w-])(?:hidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
NAME_PART = re.compile(r"[A-Za-z]+")

MARKED, ARTICLE, LOOSE = 0, 1, 2


def _is_marked(name: str, attributes: str, in_article: bool) -> bool:
    if name in MARKED_ELEMENTS:
        return not (name == "header" and in_article)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for match in NAMES.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        if any(_names_a_mark(name) for name in value.split()):
            return True
    return False


def _names_a_mark(name: str) -> bool:
    """Whether a class is a marked word, alone or with words for a place or a part of one."""
    parts = {part.lower() for part in NAME_PART.findall(name)}
    return not MARKED_NAMES.isdisjoint(parts) and parts <= MARKED_NAMES | PLACE_NAMES


def tags(page: str):
    """(start, end, closing, name, attributes) of the page's tags in order, in one pass.

    Comments and the contents of scripts, styles and the like belong to their tag, which then has no
    name. A quote only opens a value right after an equals sign; if one is never closed, tags end at
    the next `>` from there on. What looks like a tag and has no end runs to the end of the page.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        closing = page.startswith("/", start + 1)
        named = TAG_NAME.match(page, start + 1 + closing)
        if not named:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = start + 9
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start) + 1 or len(page)
            else:
                continue  # a bare `<`
            yield start, end, False, "", ""
            at = end
            continue
        name, end, place = named[0].lower(), -1, named.end()
        while quotes and end < 0:
            part = TAG_PART.search(page, place)
            if not part:
                break
            if not part[1]:
                end = part.end()
            else:
                place = page.find(part[1], part.end()) + 1
                if not place:
                    break
        if end < 0:
            quotes = False
            end = page.find(">", named.end()) + 1
            if not end:
                yield start, len(page), False, "", ""
                return
        attributes = page[named.end() : end - 1]
        if name in RAW_ELEMENTS and not closing:
            found = RAW_ENDS[name].search(page, end)
            end, name = (found.end() if found else len(page)), ""
        yield start, end, closing, name, attributes
        at = end


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks as (kind, text), without markup and with single spaces."""
    if "<![CDATA[" in page:
        page = page.replace("]]>", "")
    out, parts, stack, opened = [], [], [], Counter()
    marked = article = 0
    at = 0

    def end_block():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((MARKED if marked else ARTICLE if article else LOOSE, text))

    for start, end, closing, name, attributes in tags(page):
        parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name not in INLINE:
            end_block()
        if closing:
            if not opened[name]:
                continue
            if name in INLINE:
                # An open block inside stays open: only this inline element ends.
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if stack[place][1] or stack[place][2]:
                    end_block()
                    marked -= stack[place][1]
                    article -= stack[place][2]
                del stack[place]
                opened[name] -= 1
                continue
            while stack:
                own, was_marked, was_article = stack.pop()
                opened[own] -= 1
                marked -= was_marked
                article -= was_article
                if own == name:
                    break
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        is_marked = _is_marked(name, attributes, bool(article))
        is_article = name in ("article", "main")
        if is_marked and name in INLINE:
            end_block()
        if is_marked or is_article or name not in ("p", "li", "br"):
            stack.append((name, is_marked, is_article))
            opened[name] += 1
            marked += is_marked
            article += is_article
    parts.append(page[at:])
    end_block()
    return out


BLOCKS = "page_id long, url string, blocks array<struct<kind: int, text: string>>"
_BLOCKS = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))


def _cut(batches):
    for batch in B.slices(batches, "html"):
        found = [[{"kind": k, "text": text} for k, text in blocks(page)] for page in B.texts(batch.column("html"))]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(found, _BLOCKS)]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "blocks"])


def page_blocks(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """Per page: its host and all its blocks."""
    narrow = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"),
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    return narrow.mapInArrow(_cut, BLOCKS).withColumn("host", host)


def token_streams(cut: DataFrame) -> DataFrame:
    """host, page, row and the tokens of the page's blocks in page order, and which of them are loose."""
    words = lambda block: F.split(block["text"], " ")
    loose = lambda block: F.transform(words(block), lambda _: block["kind"] == LOOSE)
    return cut.select(
        "host",
        F.xxhash64("page_id", "url").alias("page"),
        _row_key().alias("row"),
        F.flatten(F.transform("blocks", words)).alias("tokens"),
        F.flatten(F.transform("blocks", loose)).alias("loose"),
    )


def _row_key():
    return F.xxhash64("page_id", "url", F.to_json("blocks"))


def _token_count():
    return F.aggregate("blocks", F.lit(0), lambda n, block: n + F.size(F.split(block["text"], " "))).cast("long")


def suffixes(streams: DataFrame, run=RUN, loose=False) -> DataFrame:
    """Each suffix of at least `run` tokens: host, page, row, its place and its first tokens.

    With `loose` only those with a loose token among the first ones.
    """
    places = F.sequence(F.lit(1), F.size("tokens") - run + 1)
    if loose:
        places = F.filter(places, lambda at: F.exists(F.slice("loose", at, run), lambda x: x))
    prefix = lambda at: F.struct(at.alias("at"), F.array_join(F.slice("tokens", at, run), " ").alias("prefix"))
    found = streams.where(F.size("tokens") >= run).select(
        "host", "page", "row", F.explode(F.transform(places, prefix)).alias("found")
    )
    return found.select("host", "page", "row", "found.at", "found.prefix")


def repeated_prefixes(found: DataFrame) -> DataFrame:
    """The first tokens of suffixes that at least two pages of a host have.

    Suffixes with a common prefix of `run` tokens are neighbours in the host's suffix array. Each
    such bucket is reduced to its smallest and largest page in every task first, so a run that all
    pages of a large host have stays cheap.
    """
    groups = found.groupBy("host", "prefix").agg(
        F.min("page").alias("first"), F.max("page").alias("last")
    )
    return groups.where(F.col("first") != F.col("last")).select("host", "prefix")


def _unique_runs(blocks, starts, run) -> str:
    covered = set()
    for start in starts or ():
        covered.update(range(start - 1, start - 1 + run))
    out, at = [], 0
    for block in blocks or ():
        tokens = block["text"].split(" ")
        if block["kind"] == ARTICLE:
            out += tokens
        elif block["kind"] == LOOSE:
            out += [token for i, token in enumerate(tokens, at) if i not in covered]
        at += len(tokens)
    return " ".join(out)


def _joined(batches, run):
    for batch in batches:
        cut, starts = batch.column("blocks").to_pylist(), batch.column("starts").to_pylist()
        text = [_unique_runs(*pair, run) for pair in zip(cut, starts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())],
            ["page_id", "url", "text"],
        )


def main_text(pages: DataFrame, *, page_id="page_id", url="url", html="html", run=RUN) -> DataFrame:
    """page_id, url and the main text of every row of `pages`.

    Only rows with loose text wait for what is repeated. Pages of hosts without such rows deal out no
    suffixes, and if the rows are few, the other pages deal out only suffixes that these have.
    """
    cut = written(page_blocks(pages, page_id=page_id, url=url, html=html), "blocks")
    is_open = F.exists("blocks", lambda block: block["kind"] == LOOSE)
    open_rows = cut.where(is_open).withColumn("row", _row_key())
    wanted = suffixes(token_streams(open_rows), run, loose=True)
    found = suffixes(keep_keys(token_streams(cut), open_rows, "host"), run)
    if (open_rows.agg(F.sum(_token_count())).first()[0] or 0) <= BROADCAST_ROWS:
        keys = wanted.select("host", "prefix").distinct()
        found = found.join(F.broadcast(keys), ["host", "prefix"], "left_semi")
    covered = (
        lookup_join(wanted, repeated_prefixes(found), ["host", "prefix"], "left_semi")
        .groupBy("row")
        .agg(F.collect_set("at").alias("starts"))  # at most one page's tokens
    )
    rest = open_rows.join(covered, "row", "left").select("page_id", "url", "blocks", "starts")
    rest = rest.mapInArrow(
        lambda batches: _joined(batches, run), "page_id long, url string, text string"
    )
    article = F.transform(F.filter("blocks", lambda block: block["kind"] == ARTICLE), lambda block: block["text"])
    own = cut.where(~is_open).select("page_id", "url", F.array_join(article, " ").alias("text"))
    return own.unionByName(rest)
