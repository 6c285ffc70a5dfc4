"""Main text of web pages by consensus of each host's pages.

Pass 1 scores the containers of every page by the text of their blocks; the page
votes for the generalised tag-class path of its best one. Pass 2 reads each page
again and takes what lies under one of its host's paths, chosen by votes and by the
share of the page's own text that lies there; a path needs SUPPORT of its host's
votes and FAIR of the page's text, and without such a path the page's own best
container counts. The best container is the one with most unlinked text in its
blocks; the container around it takes over if it is an article, or if what it holds
besides is a title or a large part (an intro, a second section).

Site furniture is left out: by element and role; and by class or id, if a whole name
says so (``cookie-notice``, not ``has-sidebar``) and the element is a block and no
article or main part; where no article or main part lies outside, an element that
holds most of the page's text is kept all the same.

Edge cases: a NULL or empty page gives an empty text, and so does one without
text outside furniture; unclosed and misnested tags close as browsers close them,
roughly; pages without a host vote together; repeated rows each get a row; other
columns are carried along. Nothing is cut off.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import stored, wider
from relweave.llm.url_filter import host_of

#: Share of its host's votes that a path needs; at most 1 / SUPPORT paths reach it.
SUPPORT = 0.04
#: Share of a page's text that a host's path must hold to be taken.
FAIR = 0.2
#: Share of a class-marked element in its page's text from which the mark is not believed.
MOST = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside menu dialog head".split())
#: Left out without ending the block they stand in.
INLINE_FURNITURE = frozenset(
    "script style noscript template iframe svg canvas button select textarea object audio video map datalist title".split()
)
#: Left out like elements with a telling class.
SOFT = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Parts of class and id names that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail menu nav navbar"
    " navigation breadcrumb breadcrumbs header footer masthead comment comments disqus replies respond related recommended"
    " share sharing social widget widgets pagination pager toolbar search hidden".split()
)
#: Parts that may stand beside a mark in a telling name.
BESIDE = frozenset(
    "a and area articles bar block body bottom box bottom buttons button column container content div form group header id inner"
    " item items left links link list main media mobile mini more module outer page panel pages post posts primary right row secondary"
    " section side site slot stories story sub thread top unit wrap wrapper zone".split()
)
NEVER = frozenset("html body article main".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | FURNITURE | SOFT | frozenset(
    "html address blockquote dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary table"
    " caption tbody thead tfoot tr th ul".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
#: An opening tag of the first kind ends an open element of the second, up to the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def telling(names: str) -> bool:
    """Whether one of the names is made of furniture words and plain ones alone."""
    for name in names.split():
        parts = {p.lower() for p in _NAME_PART.findall(name)}
        if not parts.isdisjoint(MARKS) and parts <= MARKS | BESIDE:
            return True
    return False


def parse(page: str | None) -> tuple[list[int], list[int], list[str], list[tuple[int, str, int]]]:
    """Elements and text blocks of a page, furniture left out.

    (parent of each element, hash of its path, its name, blocks), a block being
    (element, text, characters inside links). Element 0 is the page.
    """
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parents, paths, kinds, marked = [-1], [0], [""], [False]
    blocks: list[tuple[int, str, int]] = []
    stack = [("", 0, False)]  # name, element, furniture
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = links = 0
    page = page or ""

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((stack[-1][1], text, linked))
            pieces.clear()
        linked = 0

    def pop_to(depth):
        nonlocal links
        while len(stack) > depth:
            name = stack.pop()[0]
            opened[name] -= 1
            if name == "a":
                links -= 1

    def find(names, until):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in until:
                return 0
        return 0

    def say(text):
        nonlocal linked
        if text and not stack[-1][2]:
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCKS:
                flush()
            if opened.get(name):
                # an inline end tag does not reach out of its block
                depth = find((name,), () if name in BLOCKS else BLOCKS)
                if depth:
                    pop_to(depth)
            continue
        if name == "br":
            say(" ")
        if name in BLOCKS:
            flush()
            if opened.get("p") and (depth := find(CLOSED_BY_BLOCK, CONTAINERS)):
                pop_to(depth)
            if name in SIBLINGS and (depth := find(*SIBLINGS[name])):
                pop_to(depth)
        if name in VOID:
            continue
        attributes = m[3] or m[6] or ""
        above = stack[-1]
        furniture = above[2] or name in INLINE_FURNITURE or (
            name in FURNITURE and not (name == "header" and (opened.get("article") or opened.get("main")))
        )
        kind, soft = name, name in SOFT
        if attributes and not furniture and "=" in attributes and name in BLOCKS:
            values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            label = values.get("class", "")
            kind = f"{name}.{_DIGITS.sub('0', ' '.join(sorted(label.split())))}" if label else name
            if name not in NEVER:
                soft = soft or telling(f"{label} {values.get('id', '')}")
                furniture = values.get("role", "").lower() in ROLES
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
        if name in BLOCKS and not furniture:
            parents.append(above[1])
            paths.append(hashed(f"{paths[above[1]]}>{kind}") >> 1)
            kinds.append(name)
            marked.append(soft)
            element = len(parents) - 1
        else:
            element = above[1]
        if name == "a":
            links += 1
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, element, furniture))
    flush()
    if any(marked):
        inside = unlinked(parents, blocks)
        stories = [i for i, kind in enumerate(kinds) if kind in ("article", "main") and inside[i]]
        for i in range(1, len(parents)):  # parents come first
            doubted = marked[i] and inside[i] > MOST * inside[0] and all(below(parents, s, i) for s in stories)
            marked[i] = marked[parents[i]] or (marked[i] and not doubted)
        blocks = [b for b in blocks if not marked[b[0]]]
    return parents, paths, kinds, blocks


def unlinked(parents, blocks) -> list[int]:
    """Characters outside links in each element and all below it."""
    inside = [0] * len(parents)
    for element, text, linked in blocks:
        inside[element] += max(0, len(text) - linked)
    for i in range(len(parents) - 1, 0, -1):
        inside[parents[i]] += inside[i]
    return inside


def best_path(parents, paths, kinds, blocks) -> int | None:
    """Path of the page's best container, None if it has none with text."""
    found: dict[int, int] = {}
    first: dict[int, int] = {}
    for element, text, linked in blocks:
        worth, credited = 2 * max(0, len(text) - 2 * linked), 0
        while element >= 0 and worth > 0 and credited < 2:
            if kinds[element] in CONTAINERS:
                found[paths[element]] = found.get(paths[element], 0) + (worth if not credited else worth // 2)
                first.setdefault(paths[element], element)
                credited += 1
            element = parents[element]
    if not found:
        return None
    path = min(found, key=lambda p: (-found[p], first[p]))
    inside, at = unlinked(parents, blocks), first[path]
    while True:
        around = parents[at]
        while around > 0 and kinds[around] not in CONTAINERS:
            around = parents[around]
        if around <= 0:
            return path
        held = sum(inside[i] for i, p in enumerate(paths) if p == path and below(parents, i, around))
        rest = inside[around] - held
        titled = any(kinds[e] == "h1" and below(parents, e, around) and not below(parents, e, at) for e, _, _ in blocks)
        if kinds[around] in ("article", "main"):
            climbs = rest > 0 and (kinds[around] == "article" or titled or rest <= 0.6 * inside[around])
        elif kinds[around] == "body":
            climbs = titled and rest <= 0.1 * inside[around]
        else:
            climbs = 0 < rest <= 0.15 * inside[around] or rest > 0.3 * inside[around]
        if not climbs:
            return path
        at, path = around, paths[around]


def below(parents, element: int, top: int) -> bool:
    while element > top:
        element = parents[element]
    return element == top


def text_under(parsed, votes: dict[int, float]) -> str:
    """Text of the host's path with the best votes times share of the page's text, else of
    the page's best container, else of the page. ``votes`` has shares of the host's votes."""
    parents, paths, kinds, blocks = parsed
    if not blocks:
        return ""
    total = sum(len(t) - min(len(t), link) for _, t, link in blocks)
    inside = unlinked(parents, blocks)

    def under(path):
        flags = [False] * len(parents)
        held = 0
        for i, p in enumerate(paths):
            above = i > 0 and flags[parents[i]]
            flags[i] = p == path or above
            held += inside[i] if p == path and not above else 0
        return held, flags

    present = set(paths)
    choices = [(share * held, path, flags) for path, share in votes.items() if path in present for held, flags in [under(path)] if held >= FAIR * total and held > 0]
    if choices:
        flags = max(choices, key=lambda c: (c[0], -c[1]))[2]
    else:
        path = best_path(*parsed)
        flags = under(path)[1] if path is not None else [True] * len(parents)
    return "\n".join(t for e, t, _ in blocks if flags[e]) or "\n".join(t for _, t, _ in blocks)


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): each page votes for the path of its best container."""
    read, best = parse, best_path

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            votes: dict[tuple, int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = best(*read(page.as_py()))
                if path is not None:
                    votes[host, path] = votes.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.int64()), pa.array(votes.values(), pa.int64())],
                names=["host", "path", "votes"],
            )

    rows = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with t_text, the main text of each page."""
    pages = pages.drop("t_text")
    votes = stored(host_votes(pages), "votes")
    share = F.col("votes") / F.col("all")
    kept = votes.join(votes.groupBy("host").agg(F.sum("votes").alias("all")), "host").where(share >= SUPPORT)
    # a table of known size: Spark sends it to the pages if it is small enough for that
    winners = stored(kept.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.struct("path", share.alias("share"))).alias("__paths")), "paths")
    read, take = parse, text_under

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [
                take(read(p.as_py()), {x["path"]: x["share"] for x in w.as_py() or []}) for p, w in zip(batch.column("__html"), batch.column("__paths"))
            ]
            names = [n for n in batch.schema.names if n not in ("__html", "__paths")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "t_text"])

    own = F.coalesce(host_of(F.col("url")), F.lit(""))
    joined = pages.withColumn("__html", F.col("html").cast("string")).withColumn("__own", own).join(
        winners, F.col("__own") == F.col("__host"), "left"
    )
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], "__html", "__paths").mapInArrow(
        run, wider(pages, t_text="string")
    )
