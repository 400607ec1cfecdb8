"""Main text of web pages, with templates deduced from pages of the same host.

A page is a sequence of tokens: opening and closing tags with their path, and text runs with theirs.
Over the pages of a host, a token's occurrence vector says how often it stands on each page. Tokens
with equal vectors form an equivalence class. A class on at least half of the pages is valid, its
tokens ordered by their mean place; valid classes nest by the stretch of page they span, and
together are the host's template.
What varies lies in the slots between its tokens. The region of the article is the element that the
template marks as such and that holds most varying text, or else the innermost element that holds
all of it.

Vectors are kept as sums of page hashes, which add up before any shuffle, so a host with a third of
all pages is no hot spot. A template holds at most twice as many tokens as an average page has.
Pages whose host has no region of its own (a single page, no template) are read by markup alone.
"""

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import sliced, stage_columns

#: Share of a host's pages that a template token is on.
SUPPORT = 0.5
#: Different pages that a text has to be on before it counts as the template's and not the article's.
LEAST_PAGES = 3
#: Share of a host's varying text that a region named by its tag holds.
NAMED_SHARE = 0.5
TASK_TOKENS = 200_000
#: Levels of a page that have paths of their own.
DEEPEST = 128

# Element and class names of HTML pages.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul caption".split()
)
GAPS = frozenset("br td th".split())
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select datalist "
    "dialog menu audio video map".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent "
    "cookie cookies disclaimer disqus footer header-bar masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo promoted related replies share sharing sidebar site-footer site-header site-nav social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Names that articles use too: where a host has a template, only what belongs to it is dropped by them.
DOUBTFUL_NAMES = frozenset("banner disclaimer menu notice notices social toolbar widget".split())
#: Endings that turn a compound name into a state of the page.
STATES = frozenset("closed free hidden none off on open".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
REGIONS = ("article", "main")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_PARTS = re.compile(r"[^\w-]+")
_COMPOUND = re.compile(r"[-_]+")


@dataclass(slots=True)
class Event:
    kind: str  # "open", "close" or "text"
    name: str
    marks: str  # class, id and role of an opening tag
    text: str


def events(page: str) -> Iterator[Event]:
    """Tags and text runs of a page in order; comments, declarations and raw content are passed over."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            yield Event("text", "", "", page[at:])
            return
        if found.start() > at:
            yield Event("text", "", "", page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        if not found.group(2):
            continue
        name = found.group(2).lower()
        if found.group(1):
            yield Event("close", name, "", "")
            continue
        attributes = found.group(3)
        marks = ""
        if "=" in attributes:
            own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            marks = "|".join(own.get(k, "").lower().replace("/", "_") for k in ("class", "id", "role"))
        yield Event("open", name, marks, "")
        if name in _RAW_END and not attributes.endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = max(end.end(), at)
            yield Event("close", name, "", "")


def is_dropped(event: Event, inside: bool, doubtful: bool = True) -> bool:
    """Whether an opening tag starts something that is no main text; ``inside``: within the region;
    ``doubtful``: also by names that articles use."""
    if event.name in DROPPED or event.name == "header" and not inside:
        return True
    if not event.marks or event.name in REGIONS or event.name in ("html", "body"):
        return False
    classes, own_id, role = event.marks.split("|")
    if role in DROPPED_ROLES:
        return True
    names = DROPPED_NAMES if doubtful else DROPPED_NAMES - DOUBTFUL_NAMES
    return any(_names(p, names) for p in _PARTS.split(f"{classes} {own_id}"))


def _names(mark: str, names: frozenset[str]) -> bool:
    """``ad``, or a compound that starts so: ``ad-slot``, ``ad__box``, but not ``ad-free``."""
    if mark in names:
        return True
    first, *rest = _COMPOUND.split(mark)
    return bool(rest) and first in names and rest[-1] not in STATES


def _ends(own: list[Event]) -> dict[int, int]:
    """Place of the closing tag of each opening tag that has one."""
    found: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for at, event in enumerate(own):
        if event.kind == "open":
            waiting.setdefault(event.name, []).append(at)
        elif event.kind == "close" and waiting.get(event.name):
            found[waiting[event.name].pop()] = at
    return found


class _Open:
    """The open elements at a place of a page, with their paths. Elements beyond ``DEEPEST`` levels count as
    children of the last level, so paths stay short; browsers flatten such pages too."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[str] = [""]
        self.count: dict[str, int] = {}
        #: path -> the path around it, in the order in which they appeared
        self.around: dict[str, str] = {}

    def path_of(self, label: str) -> str:
        around = self.paths[min(len(self.names), DEEPEST - 1)]
        return f"{around}/{label}" if around else label

    def push(self, name: str, label: str) -> str:
        path = self.path_of(label)
        self.around.setdefault(path, self.paths[min(len(self.names), DEEPEST - 1)])
        self.names.append(name)
        self.paths.append(path)
        self.count[name] = self.count.get(name, 0) + 1
        return path

    def pop(self) -> tuple[str, str]:
        name = self.names.pop()
        self.count[name] -= 1
        return name, self.paths.pop()


def _paths(own: list[Event], ends: dict[int, int], stack: _Open | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(place, kind, path, text) of the tokens that count for a template; dropped parts are one token
    each, and one that is never closed is read as any element. Takes time in proportion to the page."""
    stack = stack or _Open()
    stop = -1
    for at, event in enumerate(own):
        if at <= stop:
            continue
        if event.kind == "open":
            label = f"{event.name}.{event.marks}" if event.marks.strip("|") else event.name
            void = event.name in VOID
            if (void or at in ends) and is_dropped(event, any(stack.count.get(n) for n in REGIONS)):
                yield at, "drop", stack.path_of(label), ""
                if not void:
                    stop = ends[at]
                continue
            if void:
                continue
            if event.name in ("p", "li") and stack.names and stack.names[-1] == event.name:
                stack.pop()
            yield at, "open", stack.push(event.name, label), ""
        elif event.kind == "close":
            while stack.count.get(event.name):
                name, path = stack.pop()
                if name == event.name:
                    yield at, "close", path, ""
                    break
        elif text := event.text.strip():
            yield at, "text", stack.paths[-1], text


def _token(kind: str, path: str, text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(f"{kind} {path} {text}") - (1 << 63)


def host_of(url: Column) -> Column:
    """Host name of a URL in lower case; empty for null or none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_TOKENS = "host string, token long, path string, pages long, total long, v1 long, v2 long, v3 long, place long, mass long, kind string, squares long, seen1 long, seen2 long"


def _page_tokens(page: str) -> dict[int, list]:
    """token -> [kind, path, count, first place, characters of text (inside, for an opening tag)]; the
    token 0 stands for the page itself"""
    own = list(events(page))
    found: dict[int, list] = {0: ["page", None, 1, 0, 0]}
    masses: dict[str, int] = {}
    stack = _Open()
    for place, (_, kind, path, text) in enumerate(_paths(own, _ends(own), stack)):
        entry = found.setdefault(_token(kind, path, text), [kind, path, 0, place, 0])
        entry[2] += 1
        if kind == "text":
            entry[4] += len(text)
            masses[path] = masses.get(path, 0) + len(text)
    found[0][4] = sum(masses.values())
    # a path appears after the one around it
    for path, around in reversed(stack.around.items()):
        if around:
            masses[around] = masses.get(around, 0) + masses.get(path, 0)
    for entry in found.values():
        if entry[0] == "open":
            entry[4] = masses.get(entry[1], 0)
    return found


def _vectors(pages: DataFrame) -> DataFrame:
    """Summed occurrence vectors of the tokens of each host; the token 0 stands for the page itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        sums: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            columns = [[], [], *([] for _ in range(12))]
            for (host, token), values in sums.items():
                for column, value in zip(columns, (host, token, *values), strict=True):
                    column.append(value)
            sums.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string(), *[pa.int64()] * 3]
            names = [c.split(" ")[0] for c in _TOKENS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in sliced(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                digest = xxh3_128_intdigest(page)
                limbs = [(digest >> s) & 0x3FFFFFFF for s in (0, 30, 60)]
                seen = [1 << digest % 63, 1 << digest % 61]
                for token, (kind, path, n, place, mass) in _page_tokens(page).items():
                    own = sums.get((host, token))
                    if own is None:
                        sums[host, token] = [path, 1, n, *(n * x for x in limbs), place, mass, kind, n * n, *seen]
                    else:
                        own[1] += 1
                        own[2] += n
                        for k in range(3):
                            own[3 + k] += n * limbs[k]
                        own[6] += place
                        own[7] += mass
                        own[9] += n * n
                        own[10] |= seen[0]
                        own[11] |= seen[1]
            if len(sums) > TASK_TOKENS:
                yield flush()
        yield flush()

    per_task = pages.mapInArrow(count, _TOKENS)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2", "v3", "place", "mass", "squares")]
    return per_task.groupBy("host", "token").agg(
        F.max("path").alias("path"), F.max("kind").alias("kind"), *sums, *(F.bit_or(c).alias(c) for c in ("seen1", "seen2"))
    )


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``host, n_pages, classes, region, template`` from ``pages`` (``host``, ``html``): the valid
    classes as arrays of tokens, outermost first; the path of the article's element or null; the
    texts and dropped parts of the template, null for a host of fewer than ``LEAST_PAGES`` different
    pages. Copies of one page are no template: a text has to be on so many different pages as well.
    """
    tokens = stage_columns(_vectors(pages), "page-tokens")
    # never more than there are: two different pages can share a bit
    different = F.greatest(F.bit_count("seen1"), F.bit_count("seen2")).alias("different")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("n_pages"), F.col("mass").alias("n_chars"), different.alias("n_different"))
    frequent = tokens.where("token <> 0").join(hosts, "host").where((F.col("pages") > 1) & (F.col("pages") >= support * F.col("n_pages")))
    once = F.col("total") == F.col("pages")
    # as often on each page of the host
    even = (F.col("pages") == F.col("n_pages")) & (F.col("squares") * F.col("pages") == F.col("total") * F.col("total"))
    place = (F.col("place") / F.col("pages")).alias("place")
    member = F.struct(place, "token", "path", "mass", "kind", once.alias("once"), even.alias("even"), different)
    vector = ["pages", "total", "v1", "v2", "v3"]
    classes = frequent.groupBy("host", "n_pages", "n_chars", "n_different", *vector).agg(F.sort_array(F.collect_list(member)).alias("tokens"))
    # a class of tokens on equally many places of each page is ordered by their mean places; it nests
    # in the classes that start before it and end after it
    whole = F.struct(
        F.element_at("tokens", 1)["place"].alias("first"),
        (-F.element_at("tokens", -1)["place"]).alias("last"),
        "pages",
        "tokens",
    )
    nested = classes.groupBy("host", "n_pages", "n_chars", "n_different").agg(F.sort_array(F.collect_list(whole)).alias("classes"))

    def fixed(c: Column) -> Column:
        """Texts and dropped parts of a class: those that come and go with a tag, or are on all pages alike."""
        tagged = F.exists(c["tokens"], lambda t: t["kind"].isin("open", "close", "drop"))
        return F.filter(c["tokens"], lambda t: t["kind"].isin("text", "drop") & (t["different"] >= LEAST_PAGES) & (tagged | t["even"]))

    every = F.flatten(F.transform("classes", lambda c: c["tokens"]))
    nested = nested.withColumn("fixed", F.flatten(F.transform("classes", fixed)))
    # a region is one element of a page
    nested = nested.withColumn("elements", F.filter(every, lambda t: (t["kind"] == "open") & t["once"]))

    def mass(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda total, t: total + t["mass"])

    def varying(element: Column) -> Column:
        below = F.concat(element["path"], F.lit("/"))
        return element["mass"] - mass(F.filter("fixed", lambda t: F.startswith(F.concat(t["path"], F.lit("/")), below)))

    slots = F.transform("elements", lambda t: F.struct(t["path"].alias("path"), varying(t).alias("varying")))
    nested = nested.withColumn("slots", slots).withColumn("slots_chars", F.col("n_chars") - mass(F.col("fixed")))
    held = F.filter("slots", lambda t: t["varying"] > 0)
    named = F.filter(
        held,
        lambda t: F.regexp_extract(t["path"], r"([^/]*)$", 1).rlike(rf"^({'|'.join(REGIONS)})(\.|$)") & (t["varying"] >= NAMED_SHARE * F.col("slots_chars")),
    )
    holding = F.filter(held, lambda t: t["varying"] == F.col("slots_chars"))
    deepest = F.array_sort(holding, lambda a, b: F.when(F.length(a["path"]) > F.length(b["path"]), -1).otherwise(1))
    region = F.coalesce(F.get(named, F.lit(0))["path"], F.get(deepest, F.lit(0))["path"])
    template = F.when(F.col("n_different") >= LEAST_PAGES, F.array_sort(F.transform("fixed", lambda t: t["token"])))
    return nested.select("host", "n_pages", "classes", region.alias("region"), template.alias("template"))


def extract(page: str, region: str | None = None, template: Iterable[int] | None = None) -> list[str]:
    """Blocks of main text in page order. ``region``: path of the element that holds the article on
    pages of the host; a page without it is read by its ``article`` or ``main``, else whole.
    ``template``: tokens of the host's template, which are left out; a page that has nothing besides
    them is read by markup alone, as without a template."""
    own = list(events(page))
    ends = _ends(own)
    tokens = list(_paths(own, ends)) if region or template else []
    start = next((at for at, kind, path, _ in tokens if kind == "open" and path == region), None)
    for name in REGIONS:
        if start is None:
            start = next((at for at, event in enumerate(own) if event.kind == "open" and event.name == name), None)
    span = (0, len(own)) if start is None else (start, ends.get(start, len(own) - 1) + 1)
    inside = start is not None and own[start].name in REGIONS
    if template is None:
        return _blocks(own, ends, span, inside, None)
    known = frozenset(template)
    fixed = {at for at, kind, path, text in tokens if kind in ("text", "drop") and _token(kind, path, text) in known}
    return _blocks(own, ends, span, inside, fixed) or _blocks(own, ends, span, inside, None)


def _blocks(own: list[Event], ends: dict[int, int], span: tuple[int, int], inside: bool, fixed: set[int] | None) -> list[str]:
    """Blocks of text of the events in ``span``, without the ``fixed`` ones (null: no template)."""
    at, stop = span
    blocks: list[str] = []
    line: list[str] = []

    def close():
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    while at < stop:
        event = own[at]
        at += 1
        if event.kind == "text":
            line.append(" " if fixed and at - 1 in fixed else event.text)
            continue
        if event.name in BLOCKS:
            close()
        elif event.name in GAPS:
            line.append(" ")
        if event.kind == "open" and event.name not in VOID and is_dropped(event, inside):
            if fixed is not None and at - 1 not in fixed and not is_dropped(event, inside, doubtful=False):
                continue
            end = ends.get(at - 1)
            if end is not None and end < stop:
                at = end + 1
                if event.name in BLOCKS:
                    close()
    close()
    return blocks


def main_text(pages: DataFrame, more: Column | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null html counts as empty and has an empty text; a null url has no host, and such pages share
    one template. Repeated rows give repeated results; other columns are ignored. Templates join
    from the right: Spark broadcasts them only where it measures them below its threshold. ``more``: a
    struct of the row that is handed on as column ``more``. Pages of any size and depth are read whole;
    elements beyond ``DEEPEST`` levels count as children of that level. Of several ``article`` elements on
    a page whose host has no region of its own the first one is read.
    """
    extra = {} if more is None else {"more": more}
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        *(c.alias(n) for n, c in extra.items()),
    )
    regions = stage_columns(templates(own.select("host", "html")).select("host", "region", "template"), "page-regions")

    names = list(extra)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "region", "template")), strict=True)
            texts = ["\n".join(extract(*row)) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    *(batch.column(n) for n in names),
                ],
                names=["page_id", "url", "text", "n_chars", *names],
            )

    rows = own.join(regions, "host", "left").select("page_id", "url", "html", "region", "template", *names)
    kinds = "".join(f", {n} {own.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(read, f"page_id long, url string, text string, n_chars long{kinds}")
