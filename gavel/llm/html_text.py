"""Main text of web pages by consensus paths of a host.

1. Every page is scored on its own: the containers of its text blocks get the length of their unlinked text.
2. The paths of the best containers (tags with classes, digits generalised) are votes; Spark adds them up
   per host, with partial sums before the shuffle, so a host with a third of all pages is no hot group.
3. Every page is read again with its host's winning path, and the text around it that belongs to the same article. A page
   on which that path does not hold a good part of what its own best container holds keeps its own as well.

The parser is a tokenizer with a stack of open elements: it does not build a document tree, and unclosed or
crossed tags and cut-off pages are read as far as they go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Styles of elements that are not shown.
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: Elements whose content is not markup, and elements that never have content.
RAW = frozenset("script style textarea title iframe xmp noembed noframes template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that separate blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be the container of a page's main text.
CONTAINER = frozenset("article body div main section td".split())
#: Parts of a page that are never main text.
ASIDE = frozenset("aside button dialog fieldset footer head iframe input label menu nav noscript object option script select style svg template textarea".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comment\w*|consent|cookies?|disqus|footer|hidden|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[^a-z])"
)
#: Names that tell how a page is laid out, not what an element holds: has-sidebar, no-sidebar, overflow-hidden, md:hidden, share-enabled.
LAYOUT_NAME = re.compile(r"(?:has|no|not|non|with|without|overflow|backface)[-_].*|.*[-_](?:enabled|disabled)|.*:.*")
#: Readers' talk may be longer than what it is about.
TALK_WORDS = re.compile(r"(?:^|[^a-z])(?:comment\w*|disqus|replies|respond)(?:$|[^a-z])")
#: An end tag may be missing: the element ends where one of these begins.
CLOSED_BY = {"p": BLOCK - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names do not make them an aside: the page itself and its headings.
UNNAMED = HEADINGS | {"html", "body"}
#: Parts into which the pages of one host are split.
SALTS = 64
#: Part of the page's own best container that a winning path beside it must hold in order to replace it.
GOOD_PART = 0.5

Block = tuple[str, int, tuple[str, ...]]  # text, characters of it in links, paths of the containers around it


def _path(tag: str, classes: str) -> str:
    names = sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()})
    return ".".join([tag, *names])


def _aside_name(attributes: dict[str, str], by: tuple[str, ...] = ("class", "id", "role")) -> str:
    """The words of an element's class, id and role by which it would be no main text; empty if there are none."""
    named = " ".join(attributes.get(a, "") for a in by).lower().split()
    return " ".join(n for n in named if not LAYOUT_NAME.fullmatch(n) and ASIDE_WORDS.search(n))


def _without_asides(found: list[tuple[Block, tuple[int, ...]]], talk: list[bool], holders: set[int], beside: set[int], anchors: set[int]) -> list[Block]:
    """The blocks that stand in none of the elements that are asides by their name.

    A name alone does not discard the page: an element that holds its only article or main, or most of its
    unlinked text, is no aside. Elements beside an article or main with text (``beside``) are asides in any case,
    and so is talk, unless nothing else is left. Inside an article an id is mostly the target of a link: what only its id
    names (``anchors``) is an aside if it is mostly linked itself.
    """
    worth = [len(text) - linked for (text, linked, _), _ in found]
    quiet = [w for w, (_, names) in zip(worth, found) if not any(talk[n] for n in names)]
    inside = [0] * len(talk)
    for w, (_, names) in zip(worth, found):
        for n in names:
            inside[n] += w
    total = sum(quiet)
    if any(w and not names and re.search(r">(?:article|main)\b", block[2][-1] if block[2] else "") for w, (block, names) in zip(worth, found)):
        holders = set()
    else:
        beside = set()
    gone = {n for n, w in enumerate(inside) if n not in anchors and (talk[n] or (n not in holders and (n in beside or 2 * w <= total)))}
    for n in anchors:
        mine = [block for block, names in found if n in names]
        if 2 * sum(linked for _, linked, _ in mine) > sum(len(text) for text, _, _ in mine):
            gone.add(n)
    for again in (gone, {n for n in gone if talk[n]}, set()):
        left = [block for block, names in found if not again.intersection(names)]
        if any(len(text) > linked for text, linked, _ in left):
            return left
    return [block for block, names in found if not gone.intersection(names)]


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without those in parts that are never main text."""
    found: list[tuple[Block, tuple[int, ...]]] = []  # with the named asides around it
    # open elements: (tag, aside?, path of the container or None, number of the named aside or None)
    stack: list[tuple[str, bool, str | None, int | None]] = []
    talk: list[bool] = []
    holders: set[int] = set()
    beside: set[int] = set()  # named asides outside of article and main
    anchors: set[int] = set()  # elements inside of them that only their id names
    asides = links = linked = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                block = (said, min(linked, len(said)), tuple(p for _, _, p, _ in stack if p))
                found.append((block, tuple(n for *_, n in stack if n is not None)))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal asides, links
        while len(stack) > depth:
            tag, aside, *_ = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            asides -= aside
            links -= tag == "a"

    at = 0
    while at < len(page):
        token = TOKEN.search(page, at)
        upto = token.start() if token else len(page)
        if upto > at and not asides:
            text.append(page[at:upto])
            if links:
                linked += upto - at
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                if tag in BLOCK and not asides:
                    flush()
            continue
        if tag in VOID:
            if not asides:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not end:
                break
            at = end.start()
            continue
        for depth in range(len(stack) - 1, -1, -1):
            above = stack[depth][0]
            if tag in CLOSED_BY.get(above, ()):
                close(depth)
                break
            if above in CONTAINER or above in ("table", "ul", "ol", "dl"):
                break
        if tag in BLOCK and not asides:
            flush()
        attributes = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(token[3])} if token[3].strip("/ ") else {}
        within = any(t in ("article", "main") for t, *_ in stack)
        named = _aside_name(attributes) if tag not in UNNAMED else ""
        aside = tag in ASIDE or (tag == "header" and not within) or "hidden" in attributes or bool(NOT_SHOWN.search(attributes.get("style", "")))
        number = None
        if tag in ("article", "main"):
            if not named and not asides:
                holders.update(n for *_, n in stack if n is not None)
        elif (named or tag == "form") and not aside:
            # a form may wrap the whole page, so it counts like a name
            number = len(talk)
            only_id = within and tag != "form" and not _aside_name(attributes, ("class", "role"))
            talk.append(bool(TALK_WORDS.search(named)) and not only_id)
            if only_id:
                anchors.add(number)
            elif not within:
                beside.add(number)
        path = None
        if tag in CONTAINER:
            outer = next((p for _, _, p, _ in reversed(stack) if p), "")
            path = f"{outer}>{_path(tag, attributes.get('class', ''))}"
        if token[3].endswith("/>") and tag not in BLOCK and tag != "a":
            continue
        stack.append((tag, aside, path, number))
        asides += aside
        links += tag == "a"
    flush()
    return _without_asides(found, talk, holders, beside, anchors)


def container_scores(blocks: list[Block]) -> dict[str, float]:
    """Unlinked characters per container path: a block counts for the container it stands in, and by
    half for the next one around it."""
    scores: dict[str, float] = {}
    for text, linked, paths in blocks:
        worth = len(text) - linked
        for path, part in zip(reversed(paths), (1.0, 0.5)):
            scores[path] = scores.get(path, 0.0) + worth * part * (1.25 if re.search(r">(article|main)[^>]*$", path) else 1.0)
    return scores


def best_container(blocks: list[Block]) -> tuple[str, float]:
    scores = container_scores(blocks)
    return max(scores.items(), key=lambda x: (x[1], x[0])) if scores else ("", 0.0)


def _mostly_unlinked(blocks: list[Block]) -> bool:
    return 2 * sum(linked for _, linked, _ in blocks) < sum(len(text) for text, _, _ in blocks)


def whole_region(blocks: list[Block], path: str) -> list[int]:
    """Numbers of the blocks that belong to a container's text.

    The nearest article or main around it is taken whole; without one, the highest container below the body whose
    further text is mostly unlinked. Text that stands directly in the containers around that one, such as a
    headline above it, goes along if it is mostly unlinked; other containers beside it do not.
    """
    inside = [paths[: paths.index(path) + 1] for _, _, paths in blocks if path in paths]
    if not inside:
        return []
    around = inside[0]
    top = next((p for p in reversed(around) if re.search(r">(?:article|main)(?:\.[^>]*)?$", p)), None)
    if top is None:
        further = ((p, [b for b in blocks if p in b[2] and path not in b[2]]) for p in around[:-1] if not re.search(r">body(?:\.[^>]*)?$", p))
        top = next((p for p, more in further if _mostly_unlinked(more)), path)
    above = {"", *around[: around.index(top)]}
    direct = [b for b in blocks if (b[2][-1] if b[2] else "") in above]
    if not _mostly_unlinked(direct):
        above = set()
    return [i for i, (_, _, paths) in enumerate(blocks) if top in paths or (paths[-1] if paths else "") in above]


def main_text(page: str, winner: str | None) -> str:
    """Main text of one page by its host's winning path, or by its own best container.

    A winning path with a good part of what the page's own container holds replaces it where neither holds the other; in all
    other cases nothing of either is left out.
    """
    blocks = page_blocks(page)
    own, _ = best_container(blocks)
    if not own:
        return "\n\n".join(text for text, _, _ in blocks)
    chosen = set(whole_region(blocks, own))
    if winner and winner != own:
        voted = set(whole_region(blocks, winner))
        mine, theirs = (sum(len(blocks[i][0]) for i in part) for part in (chosen - voted, voted - chosen))
        # the vote is about what the two do not share
        chosen = voted if mine and theirs and theirs >= GOOD_PART * mine else chosen | voted
    return "\n\n".join(blocks[i][0] for i in sorted(chosen))


def host_of(url: Column) -> Column:
    """Lower-case host of a url, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, winner): the path most pages of a host vote for; ties go to the longer text, then the
    greater path. Pages without text do not vote."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [best_container(page_blocks(p)) for p in frame["html"]]
            yield pd.DataFrame({"host": frame["host"], "path": [p for p, _ in best], "score": [s for _, s in best]})

    given = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    votes = given.mapInPandas(vote, schema).filter("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), F.col("score").desc(), F.col("path").desc())
    return votes.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").select("host", F.col("path").alias("winner"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` but the html, and ``text_col``: the page's main text, blocks joined by two line feeds.

    Character references are decoded, white space inside a block is one blank. Null and empty
    html gives an empty text; pages without a host are one host; repeated rows are read like any other.
    Rows are neither dropped nor merged. A column that is called as ``text_col`` is replaced; others pass through.
    """
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    # pages of a crowded host are spread over salts; the one row of every host is repeated for each
    winners = host_paths(pages, url_col, html_col).select(F.col("host").alias("__host"), "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.pmod(F.xxhash64(F.col(url_col), F.col(html_col)), F.lit(SALTS)).cast("int")
    salted = pages.select(*rest, F.coalesce(F.col(html_col), F.lit("")).alias("__html"), host_of(F.col(url_col)).alias("__host"), salt.alias("__salt"))
    joined = salted.join(winners, ["__host", "__salt"], "left")
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = [main_text(p, w) for p, w in zip(batch.column(at["__html"]).to_pylist(), batch.column(at["winner"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in rest), pa.array(texts, pa.string())], schema.names)

    return joined.select(*rest, "__html", "winner").mapInArrow(read, schema)
