"""Main text of web pages by consensus paths per host.

First pass: each page is read into containers. A container's generalised path lists the tags above it with the first
class of each, digits removed. The page votes for the smallest container that holds all its content blocks (an h1, or
25 characters that are not mostly links), never for a list, table or quote; an article or main element with most of the
page's text is preferred. Paths form a prefix tree per page and travel as 64-bit hashes. Spark adds up the votes per host, and where pages of the winner keep other text. Second pass:
every page is extracted anew with the winning path of its host. A page with content blocks outside that path, at
places where the winner's pages usually have no text, uses the common container of both; text at the usual places stays out.

Text blocks are cut at block elements, never at ``<br>``. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments and hidden elements are left out by element name, attribute, or by a class, id or role that
names such a thing, whatever their size; of a header inside an article the h1 stays. Where a page has no content block
outside such classes, the one of these elements with the most text counts as unmarked (never one for comments). Broken
markup is read leniently: missing end tags, stray end tags, unclosed quotes, a page cut off in the middle; the time for a
page grows with its length, not with its depth.

Defined cases: null or empty html gives an empty text. Pages without a host in their URL (or with a null URL) vote
together. Ties between paths go to the smaller hash. Rows that repeat an id are extracted each. An empty
table gives an empty result. Other columns play no part. Votes are summed before they are shuffled, and each host has
one winner, so a host with a third of all pages needs no special care; winners are broadcast when a count of their
hashes shows that they are small, else joined by shuffle.
"""

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import table
from plantpulse.session import checkpointed

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe template title svg math object".split())
SKIPPED = frozenset(
    "head nav header footer aside form button select menu dialog audio video canvas fieldset label".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td blockquote ul ol dl figure".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promotion recommended related replies reply reviews search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget adsbygoogle".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply reviews".split())
# Parts that only name the frame or place of what the part before them says; parts after which a word says what the page
# has or does; first parts of what holds the text itself.
FRAMES = frozenset(
    "area bar block bottom box button buttons container desktop dialog fixed form holder icons inner item items leaderboard left "
    "links list main media mobile outer panel posts primary right secondary section slot sticky thread threads top unit widget "
    "widgets wrap wrapper".split())
NEGATIONS = frozenset("has no with without enabled disabled active open closed".split())
TEXT_WORDS = frozenset("article body content entry layout main page post story text".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"} | {"li", "dd", "dt"}
# Elements that end where a sibling of the same family begins, and the elements that such an end does not reach beyond.
FAMILIES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Containers that can be the main one: a list, table or quote is part of the text around it.
CHOSEN = frozenset("html body div section article main center".split())
SHARE, CONTENT = 0.75, 25
# Bound of the winners that a join may broadcast, in hashes of 8 bytes.
MAX_BROADCAST_HASHES = 4_000_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)|<[a-zA-Z/][^<]*\Z", re.S)
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:\s*=\s*["']?(?:hidden|true)?["']?)?(?=[\s/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[^a-z]+")


class Paths:
    """Prefix tree of the container paths of a page. Node 0 is the page; a node's number is larger than its parent's."""

    def __init__(self):
        self.parent, self.hash, self.name, self.clean, self.depth, self._known = [0], [0], [""], [True], [0], {}

    def below(self, node: int, name: str, label: str) -> int:
        key = (node, name, label)
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(node)
            step = f"{self.hash[node]}/{name}.{label}".encode()
            self.hash.append(xxhash.xxh3_64_intdigest(step) - (1 << 63))
            self.name.append(name)
            self.clean.append(self.clean[node] and name in CHOSEN)
            self.depth.append(self.depth[node] + 1)
        return self._known[key]

    def sums(self, values) -> list[float]:
        """For each node what the (node, value) pairs at it and below it add up to."""
        total = [0.0] * len(self.parent)
        for node, value in values:
            total[node] += value
        for node in range(len(total) - 1, 0, -1):
            total[self.parent[node]] += total[node]
        return total

    def inside(self, tops) -> list[bool]:
        """Which nodes are one of ``tops`` or below one."""
        out = [0 in tops]
        for node in range(1, len(self.parent)):
            out.append(node in tops or out[self.parent[node]])
        return out

    def common(self, nodes) -> int:
        """Deepest container above all nodes that is, with all above it, no list, table or quote."""
        nodes = list(nodes)
        held = self.sums((node, 1) for node in nodes)
        return max((node for node in range(len(held)) if held[node] == len(nodes) and self.clean[node]), default=0)


def _names_other(token: str) -> str:
    """The word by which a class, id or role says that an element is not main text, or nothing."""
    parts = [part for part in _WORDS.split(token) if len(part) > 1]
    if not NEGATIONS.isdisjoint(parts):
        return ""
    while len(parts) > 1 and parts[-1] in FRAMES:
        parts.pop()
    if parts and parts[-1] in SKIP_WORDS:
        return parts[-1]
    return next((part for part in parts if part in SKIP_WORDS), "") if parts and parts[0] not in TEXT_WORDS else ""


def _marks(rest: str):
    """First class without digits, and the word by which class, id or role name something that is not main text."""
    first, word = "", ""
    if "=" in rest:
        for name, value in _CLASS.findall(rest):
            for token in value.strip("\"'").lower().split():
                word = word or _names_other(token)
            if name.lower() == "class" and value.strip("\"'").split():
                first = re.sub(r"[^a-z_-]", "", value.strip("\"'").lower().split()[0])
    return first, word


def _left_out(pieces, above, words):
    """Numbers of the marked elements that are left out, with those inside them: all, or on a page without a content block
    outside them all but the one with the most text, if that has such a block."""
    total, content = [0] * len(above), [False] * len(above)
    for block in pieces:
        size: dict[int, int] = {}
        for text, _, mark, link, head in block:
            if not link and (length := len(text.strip())):
                size[mark] = size.get(mark, 0) + length
                content[mark] = content[mark] or head
        for mark, length in size.items():
            total[mark] += length
            content[mark] = content[mark] or length >= CONTENT
    comment = [False] * len(above)
    for mark in range(1, len(above)):
        comment[mark] = words[mark] in COMMENT_WORDS or comment[above[mark]]
    gone = set(range(1, len(above)))
    if not content[0]:
        able = [mark for mark in gone if content[mark] and not comment[mark]]
        if able:
            top = max(able, key=lambda mark: (total[mark], -mark))
            while top:
                gone.discard(top)
                top = above[top]
    return gone


def blocks(page: str):
    """(paths, blocks): a block is (node, text, link characters, whether it is an h1), in page order, left-out parts excluded."""
    paths = Paths()
    stack = []  # (name, node, left out, link, number of the marked element around it, inside an article)
    open_names: dict[str, int] = {}
    above_mark, words = [0], [""]  # of each marked element the one around it, and its word; 0 is the page
    parts, pieces = [], []  # of the block that is being read, and of each block

    def flush():
        if parts:
            pieces.append(parts[:])
            parts.clear()

    def add(raw):
        if raw and not (stack and stack[-1][2]):
            node, link, mark = (stack[-1][1], stack[-1][3], stack[-1][4]) if stack else (0, False, 0)
            parts.append((html.unescape(raw), node, mark, link, any(entry[0] == "h1" for entry in stack[-3:])))

    def pop(depth):
        if any(entry[0] in BLOCKS for entry in stack[depth:]):
            flush()
        for entry in stack[depth:]:
            open_names[entry[0]] -= 1
        del stack[depth:]

    def close(name):
        if open_names.get(name):
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))

    at, end = 0, len(page)
    while at < end:
        match = _TAG.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at:match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["end"]:
            close(name)
            continue
        if name in BLOCKS:
            flush()
        if name == "br":
            add(" ")
        if name in CLOSES_P:
            close("p")
        if name in FAMILIES:
            family, walls = FAMILIES[name]
            if any(open_names.get(other) for other in family):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in walls:
                        break
                    if stack[i][0] in family:
                        pop(i)
                        break
        if name in VOID:
            continue
        rest = match["rest"] or ""
        if name in RAW and not rest.endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if rest.endswith("/") and name not in BLOCKS:
            continue
        _, node, out, link, mark, article = stack[-1] if stack else ("", 0, 0, False, 0, False)
        first, word = _marks(rest)
        # 1: left out; 2: the header of an article, of which the h1 stays.
        if (name in SKIPPED and not (name == "header" and article)) or _HIDDEN.search(rest):
            out_here = 1
        elif name == "header":
            out_here = out or 2
        else:
            out_here = 0 if out == 2 and name == "h1" else out
        if name in CONTAINERS:
            node = paths.below(node, name, first)
        # A page may mark its body or article with any class: those are never left out for it.
        marked = bool(word) and not out_here and name not in ("html", "body", "article", "main")
        if marked:
            above_mark.append(mark), words.append(word)
            mark = len(above_mark) - 1
        if name in BLOCKS or name == "a" or out_here != out or marked:  # other inline elements change nothing
            stack.append((name, node, out_here, link or name == "a", mark, article or name in ("article", "main")))
            open_names[name] = open_names.get(name, 0) + 1
    flush()
    gone = _left_out(pieces, above_mark, words) if len(above_mark) > 1 else set()
    found = []
    for block in pieces:
        kept = [piece for piece in block if piece[2] not in gone] if gone else block
        text = " ".join("".join(piece[0] for piece in kept).split())
        if text:
            head = next(piece for piece in kept if piece[0].strip())
            found.append((head[1], text, sum(len(piece[0].strip()) for piece in kept if piece[3]), head[4]))
    return paths, found


def _value(block) -> float:
    return float(max(0, len(block[1]) - 2 * block[2]))


def _content(found):
    """Blocks that the main container must hold: those of some length and every h1; on a page without any, all that are not links."""
    rated = [block for block in found if _value(block)]
    return [block for block in rated if block[3] or len(block[1]) >= CONTENT] or rated


def best_path(paths: Paths, found) -> tuple[int, float]:
    """Smallest container of all content blocks; an article or main element with most of the text is preferred. With the page's score."""
    held = paths.sums((block[0], _value(block)) for block in found)
    if not held[0]:
        return 0, 0.0
    named = [node for node in range(1, len(held)) if paths.name[node] in ("article", "main") and held[node] >= SHARE * held[0]]
    if named:
        return max(named, key=lambda node: (paths.depth[node], -node)), held[0]
    return paths.common(block[0] for block in _content(found)), held[0]


def votes(page: str | None) -> tuple[int, float, list[int]]:
    """Path a page votes for, the weight of its vote (0: none), and the places of text outside the path. Long pages weigh
    more, by the logarithm of their text."""
    paths, found = blocks(page or "")
    top, total = best_path(paths, found)
    if not top:
        return 0, 0.0, []
    within = paths.inside({top})
    return paths.hash[top], float(len(bin(int(total))) - 2), sorted({paths.hash[block[0]] for block in found if not within[block[0]]})


def extract(page: str | None, path: int | None, usual=()) -> str:
    """Text of a page, given the winning path of its host and the places outside it where the winner's pages have text."""
    paths, found = blocks(page or "")
    usual = frozenset(usual or ())
    unusual = [paths.hash[node] not in usual for node in range(len(paths.hash))]
    tops = {node for node in range(1, len(paths.hash)) if paths.hash[node] == path} if path else set()
    inside = paths.inside(tops)
    within = [block for block in found if inside[block[0]]]
    if within:
        score, total = sum(map(_value, within)), sum(map(_value, found))
        other = [block[0] for block in _content(found) if not inside[block[0]] and unusual[block[0]]]
        named = all(paths.name[top] in ("article", "main") for top in tops)
        if other and not (named and score >= SHARE * total):
            around = paths.inside({paths.common([*tops, *other])})
            within = [block for block in found if inside[block[0]] or (around[block[0]] and unusual[block[0]])]
    else:
        left = [block for block in found if unusual[block[0]]]
        left = left if sum(map(_value, left)) else found
        own = paths.inside({best_path(paths, left)[0]})
        within = [block for block in left if own[block[0]]]
    return "\n".join(block[1] for block in within)


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Winning path of every host, and the places outside it that hold text on at least half of the pages that chose it."""
    def run(batches):
        for batch in batches:
            rows = [votes(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["host", "path", "weight", "places"])

    cast = df.select(_host(url_col).alias("host"), F.col(html_col).alias("page")).mapInArrow(
        run, "host string, path long, weight double, places array<long>")
    # The place 0, the page itself, stands for the vote.
    place = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.array_remove("places", 0))).alias("place")
    summed = checkpointed(cast.filter("weight > 0").select("host", "path", "weight", place).groupBy("host", "path", "place").agg(F.sum("weight").alias("weight")))
    best = summed.filter("place = 0").groupBy("host").agg(F.min(F.struct((-F.col("weight")).alias("w"), "path")).alias("best")).select(
        "host", "best.path", (-F.col("best.w")).alias("won"))
    # At most twice as many places as a page has: each holds text on half of the pages.
    usual = summed.filter("place != 0").join(best, ["host", "path"]).filter(F.col("weight") * 2 >= F.col("won")).groupBy("host").agg(
        F.collect_list("place").alias("usual"))
    return best.join(usual, "host", "left").select("host", "path", "usual")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of every row of ``df``."""
    winners = checkpointed(host_paths(df, url_col, html_col))
    few = (winners.agg(F.sum(F.greatest(F.size("usual"), F.lit(0)) + 4)).first()[0] or 0) <= MAX_BROADCAST_HASHES
    pages = df.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__page"), _host(url_col).alias("host"))
    joined = pages.join(F.broadcast(winners) if few else winners, "host", "left").select("__id", "__url", "__page", "path", "usual")
    kinds = joined.schema

    def run(batches):
        for batch in batches:
            texts = [extract(page.as_py(), path.as_py(), usual.as_py())
                     for page, path, usual in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["__id", "__url", "text"])

    out = f"__id {kinds['__id'].dataType.simpleString()}, __url {kinds['__url'].dataType.simpleString()}, text string"
    return joined.mapInArrow(run, out).select(
        F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
