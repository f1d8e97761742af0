"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a few templates. A token is an element in its role (its
path of elements from the root) or a text in its place. Per host, tokens that occur
equally often on each page -- that share their occurrence vector -- form an
equivalence class. A class is kept if enough pages have it and it is valid: its
elements follow each other in one order, and each lies in a slot of an element that
is nested already, so that the classes nest into the host's template.
The slots are the places of the template's elements that hold changing text. Slots
under furniture elements (menus, headers, footers, sidebars, notices, adverts, forms,
comments) are left out. Of the others the article's are those under the article or main
elements, whichever hold more text, or else under the lowest element that all changing
text outside of links shares; there, beside the block that holds most of it, blocks of
nothing but links or of texts that no page changes are left out. The article's slots are extracted from every page, block by
block, whole.

Vectors are compared by their sums of hashed entries, an aggregate that needs no
page of a host to meet another; what reaches one task per host are the tokens with
high support, whose number is bounded by the size of a page. A text counts as part of
the template only if each of at least ``MIN_PAGES`` pages of the host has it exactly
once outside article and main elements; a block of nothing else is left out.

Defined cases: a null or empty html gives an empty text, a null url or one without a
host is a host of its own; a host without a deducible template falls back to the
page's own article, main or body element; repeated rows count as pages and keep their
rows; markup that never closes ends with the page; other columns are not read.
"""
from __future__ import annotations

import html
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored
from .linkgraph import split_url

MIN_PAGES = 5
#: Elements nested deeper have the path of the one at this depth.
MAX_DEPTH = 256
SUPPORT = 0.5
#: Fixed element names of HTML by their use here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody "
                  "td tfoot th thead tr ul caption".split())
SKIPPED = frozenset("head nav footer aside form button select textarea menu iframe object svg canvas audio video "
                    "dialog fieldset label input template noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that name furniture.
FURNITURE = re.compile(r"(?:^|[^a-z])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu\w*|nav\w*|"
                       r"breadcrumbs?|footer|comments?|replies|respond|disqus|cookies?|consent|notices?|alert|popup|modal|"
                       r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|"
                       r"pagination|pager|masthead|site-header|page-header|contentinfo|complementary)(?![a-z])")
_HEADER = re.compile(r"(?:^|[^a-z])header(?![a-z])")
_RAW = "script|style|title|textarea|noscript|template|xmp"
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|"
                     r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_WORDY = re.compile(r"\w")
_SPACE = re.compile(r"\s+")


def _element(name: str, attributes: str) -> str:
    """An element's role: its name with class, id and role, numbers taken out."""
    if not attributes or "=" not in attributes:
        return name
    named = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attributes))
    return f"{name}[{_SPACE.sub(' ', _DIGITS.sub('#', named.lower())).strip().replace('/', '|')}]" if named.strip() else name


def walk(page: str):
    """Yield (path, text, new block?) for each text and (path, None, _) for each element
    that opens; a path is the tuple of open elements."""
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    path: tuple[str, ...] = ()

    def close(k: int) -> tuple[str, ...]:
        while len(stack) > k:
            places[stack.pop()].pop()
        return path[:k]
    at, fresh = 0, True
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield path, page[at:m.start()], fresh
            fresh = False
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if places[name]:
                path = close(places[name][-1])
            fresh = fresh or name in BLOCK
            continue
        if name == "br":
            yield path, " ", fresh
            continue
        if name in BLOCK:
            fresh = True
            if places["p"]:  # a block ends an open paragraph and what is open in it
                path = close(places["p"][-1])
        if name in CLOSES:
            k = max((places[n][-1] for n in CLOSES[name] if places[n]), default=-1)
            if k > max((places[n][-1] for n in ("ul", "ol", "dl", "table", "select") if places[n]), default=-1):
                path = close(k)
        element = _element(name, m[4])
        yield (*path, element), None, fresh
        if name not in VOID and not m[4].endswith("/"):
            places[name].append(len(stack))
            stack.append(name)
            if len(path) < MAX_DEPTH:  # deeper ones are open, their texts lie at this depth
                path = (*path, element)
    if at < len(page):
        yield path, page[at:], fresh


def _name(element: str) -> str:
    return element.partition("[")[0]


def furniture(path: tuple[str, ...]) -> bool:
    """Whether any element of the path is page furniture. A header counts outside of an
    article only."""
    inside = False
    for element in path:
        name, _, named = element.partition("[")
        inside = inside or name in ("article", "main")
        if name in SKIPPED or named and FURNITURE.search(named) and name not in ("body", "html"):
            return True
        if not inside and (name == "header" or named and _HEADER.search(named)):
            return True
    return False


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def _text_hash(path: tuple[str, ...], text: str) -> str:
    return xxhash.xxh64_hexdigest("/".join(path) + "\0" + text)


def tokens(page: str) -> dict[tuple[str, str | None], list]:
    """(path, hash of a text or None) -> [count, first place, characters, characters in links]."""
    found: dict = {}
    for place, (path, text, _) in enumerate(walk(page)):
        joined = "/".join(path)
        if text is None:
            own = found.setdefault((joined, None), [0, place, 0, 0])
            own[0] += 1
        elif text.strip():
            size = len(text) if _WORDY.search(text) else 0  # separators weigh nothing
            if path:
                holder = found.setdefault((joined, None), [0, place, 0, 0])
                holder[2] += size
                if any(_name(e) == "a" for e in path):
                    holder[3] += size
            if not any(_name(e) in ("article", "main") for e in path):
                own = found.setdefault((joined, _text_hash(path, _clean(text))), [0, place, 0, 0])
                own[0] += 1
                own[2] += size
                if any(_name(e) == "a" for e in path):
                    own[3] += size
    return found


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, path, text, n, place, chars, link_chars) of ``pages`` (host, page, html)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], {k: [] for k in ("path", "text", "n", "place", "chars", "link_chars")}
        for k, page in enumerate(batch.column("html").to_pylist()):
            for (path, text), values in tokens(page or "").items():
                rows.append(k)
                for name, v in zip(out, (path, text, *values)):
                    out[name].append(v)
        take = pa.array(rows, pa.int64())
        kinds = {"path": pa.string(), "text": pa.string()}
        return pa.record_batch({"host": batch.column("host").take(take), "page": batch.column("page").take(take)}
                               | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})
    return map_batches(pages, run, "host string, page long, path string, text string, n long, place long, chars long, link_chars long")


def deduce(rows: pd.DataFrame) -> tuple[list[str], list[str], int]:
    """(roots of the article, and after a "!" what is left out under them, hashes of template texts, number of nested classes) from one
    host's tokens: path, text, pages, host_pages, once, vector, place, chars, link_chars."""
    if rows.empty:
        return [], [], 0
    total = int(rows["host_pages"].iloc[0])
    elements = rows[rows["text"].isna()].sort_values(["place", "path"])
    place = dict(zip(elements["path"], elements["place"]))
    ordered = set()
    for _, own in elements.groupby("vector", sort=False):
        # Ordered: an element's mean place is before that of what it holds.
        paths = list(own["path"])
        if all(place[p] <= place[q] for p in paths for q in paths if q.startswith(p + "/")):
            ordered.update(paths)
    # Nested: the element above is the page's root or itself nested. A class that reaches into
    # several slots of others nests there part by part.
    nested: set[str] = set()
    for path in elements["path"]:
        above = path.rpartition("/")[0]
        if path in ordered and (not above or above in nested):
            nested.add(path)
    n_classes = elements.loc[elements["path"].isin(nested), "vector"].nunique()
    texts = rows[rows["text"].notna() & (rows["once"] == rows["host_pages"]) & (rows["host_pages"] >= MIN_PAGES)]
    template_texts = sorted(texts["text"])

    slots = elements[elements["path"].isin(nested) & ~elements["path"].map(lambda p: furniture(tuple(p.split("/"))))]
    # Text outside of links that changes: what two or more pages all have once does not.
    fixed = rows[rows["text"].notna() & (rows["once"] == rows["host_pages"]) & (rows["host_pages"] >= 2)]
    still = (fixed["chars"] - fixed["link_chars"]).astype(float).groupby(fixed["path"]).sum().to_dict()
    changing, held = {}, {}
    for path, chars, link in zip(slots["path"], slots["chars"], slots["link_chars"]):
        own = max(float(chars) - float(link) - still.get(path, 0.0), 0.0)
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            up = "/".join(parts[:k])
            changing[up] = changing.get(up, 0.0) + own
            held[up] = held.get(up, 0.0) + float(chars)

    by_name = {}
    for name in ("main", "article"):
        found = [p for p in slots["path"] if _name(p.rpartition("/")[2]) == name]
        by_name[name] = [p for p in found if not any(p.startswith(q + "/") for q in found)]
    if any(by_name.values()):
        heavy = {name: sum(changing[p] for p in found) for name, found in by_name.items() if found}
        return sorted(by_name[max(heavy, key=lambda n: (heavy[n], n == "article"))]), template_texts, n_classes
    weight: dict[str, float] = {}
    for path, chars, link in zip(slots["path"], slots["chars"], slots["link_chars"]):
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            up = "/".join(parts[:k])
            weight[up] = weight.get(up, 0) + float(chars) - float(link)
    holders = [p for p in weight if p in nested and _name(p.rpartition("/")[2]) in BLOCK
               and _name(p.rpartition("/")[2]) not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr")]
    most = max(weight.values(), default=0)
    if not holders or most <= 0 or total < 1:
        return [], template_texts, n_classes
    enough = [p for p in holders if weight[p] >= 0.7 * most]
    if not enough:
        return [], template_texts, n_classes
    most_of_it = max(enough, key=lambda p: (p.count("/"), weight[p], p))
    # Up to where all changing text is inside: some may lie beside that block.
    whole = max(changing.values())
    root = most_of_it
    while changing[root] < whole and "/" in root:
        root = root.rpartition("/")[0]
    if changing[root] < whole:  # not even one outermost element
        roots = sorted(p for p in changing if "/" not in p and (changing[p] > 0 or p == root))
    else:
        roots = [root]
    out: list[str] = []
    for path in sorted(changing, key=lambda p: p.count("/")):
        if any(path.startswith(r + "/") for r in roots) and _name(path.rpartition("/")[2]) in BLOCK \
                and not (path + "/").startswith(most_of_it + "/") and not most_of_it.startswith(path + "/") \
                and changing[path] <= 0 < held[path] and not any(path.startswith(o + "/") for o in out):
            out.append(path)
    return [*roots, *("!" + p for p in out)], template_texts, n_classes


def templates(pages: DataFrame) -> DataFrame:
    """(host, roots, texts, n_classes): one row per host of ``pages`` (host, page, html)."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    met = (page_tokens(pages).groupBy("host", "path", "text")
           .agg(F.count("*").alias("pages"), F.count_if(F.col("n") == 1).alias("once"),
                F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string").alias("vector"),
                F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars")))
    # A page has a bounded number of tokens, so few can be on so many pages.
    rows = stored(met.join(sizes, "host").where(
        (F.col("pages") >= SUPPORT * F.col("host_pages")) & (F.col("text").isNull() | (F.col("once") == F.col("host_pages")))), "tokens")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        roots, texts, n = deduce(own)
        return pd.DataFrame({"host": [own["host"].iloc[0]], "roots": [roots], "texts": [texts], "n_classes": [n]})
    return rows.groupBy("host").applyInPandas(run, "host string, roots array<string>, texts array<string>, n_classes int")


def main_text(page: str | None, roots: list[str], texts: set[str]) -> str:
    """The article's blocks, joined by line breaks."""
    blocks: list[list[str]] = []
    own: list[bool] = []
    wanted = [tuple(r.split("/")) for r in roots if r[:1] != "!"]
    unwanted = [tuple(r[1:].split("/")) for r in roots if r[:1] == "!"]
    every = list(walk(page or ""))
    opened = {path for path, text, _ in every if text is None}
    wanted = [r for r in wanted if r in opened]
    if not wanted:  # not a page of the template: its own article, main or body, or all of it
        for name in ("article", "main", "body"):
            wanted = [p for p in opened if _name(p[-1]) == name and not furniture(p)]
            if wanted:
                break
        wanted, unwanted = wanted or [()], []
    verdicts: dict[tuple[str, ...], bool] = {}
    broken = True
    for path, text, fresh in every:
        broken = broken or fresh
        if text is None:
            continue
        if path not in verdicts:
            verdicts[path] = (any(path[:len(r)] == r for r in wanted) and not furniture(path)
                              and not any(path[:len(r)] == r for r in unwanted))
        if not verdicts[path]:
            broken = True
            continue
        if broken or not blocks:
            blocks.append([])
            own.append(False)
            broken = False
        blocks[-1].append(text)
        own[-1] = own[-1] or text.strip() != "" and not (texts and _text_hash(path, _clean(text)) in texts)
    # A block that is nothing but template text goes.
    return "\n".join(x for x in (_clean("".join(b)) for b, changing in zip(blocks, own) if changing) if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    host, _ = split_url(F.col("url"))
    given = pages.select("page_id", "url", "html", host.alias("host"))
    found = stored(templates(given.select("host", F.xxhash64("page_id", "html").alias("page"), "html")), "templates")
    met = given.join(found.select("host", "roots", "texts"), "host", "left").select("page_id", "url", "html", "roots", "texts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, roots, own in zip(*(batch.column(c).to_pylist() for c in ("html", "roots", "texts"))):
            texts.append(main_text(page, roots or [], set(own or ())))
        return pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"),
                                "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    schema = T.StructType([met.schema["page_id"], met.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return map_batches(met, run, schema)
