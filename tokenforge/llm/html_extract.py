"""Main text of web pages by wrapper induction.

For each host some pages of distinct main text are parsed and their trees aligned by
simple tree matching.  Aligned nodes with the same text on all of them are the template;
slots whose text varies hold the content.  The wrapper of a host is the path of
the smallest element that holds all unmarked varying text, and the paths and texts of
the template elements inside it.  These pages only propose it; all pages of the host
decide.  A template text that any page lacks at its path, while it has the path, is
none.  Where a page has other text beside an element of the path than the proposed
wrapper, the content is the element around both.  The wrapper is then applied to every
page of the host, where only elements with a template's text leave.
Elements that HTML or their names mark as menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment are never content.  A host with
fewer than two distinct pages has no wrapper: the page's own main element or
articles are taken, else its body.

The proposing pages are ``SAMPLE_PAGES`` a host, found on a thin table, so a host may
hold any share of all rows: more pages only make more text vary, which moves the path
up and drops template texts, as the confirming pass over all pages does.  Wrappers are
joined by host (broadcast only if their measured size is small).

Defined results: a null or empty page has the empty text; a page whose url has no
host, or that lacks the wrapper's element, is handled like one without a wrapper;
repeated rows are extracted each; other columns are neither read nor needed.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, maybe_broadcast
from .html_dom import Node, blocks, parse

SAMPLE_PAGES = 8               # pages of a host that its wrapper is proposed from

BOILER_TAGS = frozenset("nav footer aside form button select dialog menu head label".split())
BOILER_NAMES = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|ads?|advert\w*|sponsor\w*|"
    r"promo|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|share|sharing|"
    r"social|related|recommended|comments?|commentlist|respond|disqus|pagination|pager|login|signup|search|skip-link|"
    r"contentinfo|complementary)(?:[-_ ]|$)")


def boilerplate(n: Node, inside: bool = False) -> bool:
    """Marked as no content by its tag or its names; ``inside`` an article its own
    header is content."""
    if n.tag in BOILER_TAGS or (n.tag == "header" and not inside):
        return True
    return bool(n.names) and n.tag not in ("html", "body", "article", "main", "#root") and \
        BOILER_NAMES.search(n.names) is not None


def own_main(root: Node) -> list[Node]:
    """The page's main element, else its outermost articles, else its body."""
    found: dict[str, list[Node]] = {"main": [], "article": [], "body": []}
    todo = [root]
    while todo:
        n = todo.pop()
        if n is not root and boilerplate(n):
            continue
        kind = "main" if n.tag == "main" or "main" in n.names.split() else n.tag
        if kind in found:
            found[kind].append(n)
            if kind == "article":
                continue
        todo.extend(reversed(n.children()))
    return found["main"][:1] or found["article"] or found["body"][:1] or [root]


def page_text(nodes: list[Node], drop: frozenset = frozenset()) -> str:
    inside = any(n.tag in ("article", "main") for n in nodes)
    return "\n\n".join(blocks(nodes, lambda n: boilerplate(n, inside) or id(n) in drop))


class Skeleton:
    """A tree for alignment: neighbouring elements with the same label are one
    node, marked elements are left out."""
    __slots__ = ("label", "tag", "path", "nodes", "kids", "text", "size")

    def __init__(self, label: str, tag: str, path: str, nodes: list[Node]):
        self.label, self.tag, self.path, self.nodes = label, tag, path, nodes
        self.kids: list[Skeleton] = []
        self.text = ""                             # of the node itself and all below
        self.size = 1


def skeleton(nodes: list[Node], path: str = "", depth: int = 0) -> Skeleton:
    first = nodes[0]
    out = Skeleton(first.label, first.tag, f"{path}>{first.label}" if path else first.label, nodes)
    out.text = "\n\n".join(blocks(nodes, boilerplate))
    if depth < 40:
        groups: list[list[Node]] = []
        for n in (c for x in nodes for c in x.children()):
            if boilerplate(n):
                continue
            if groups and groups[-1][0].label == n.label:
                groups[-1].append(n)
            else:
                groups.append([n])
        out.kids = [skeleton(g, out.path, depth + 1) for g in groups]
        out.size += sum(k.size for k in out.kids)
    return out


def tree_match(a: Skeleton, b: Skeleton, memo: dict) -> int:
    """Simple tree matching: most nodes of two ordered trees that can be paired
    with their parents paired and their order kept."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        rows = [[0] * (len(b.kids) + 1)]
        for x in a.kids:
            row = [0]
            for j, y in enumerate(b.kids, 1):
                row.append(max(row[-1], rows[-1][j], rows[-1][j - 1] + tree_match(x, y, memo)))
            rows.append(row)
        memo[key] = (rows[-1][-1] + 1, rows)
    return memo[key][0]


def aligned(a: Skeleton, b: Skeleton, memo: dict) -> list[tuple[Skeleton, Skeleton]]:
    """The pairs of a best matching, found back through its tables."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if not tree_match(x, y, memo):
            continue
        out.append((x, y))
        rows = memo[(id(x), id(y))][1]
        i, j = len(x.kids), len(y.kids)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.kids[i], y.kids[j]))
    return out


def beside(x: Skeleton, kid: Skeleton) -> list[str]:
    """Text of a node outside one of its children."""
    inner = {id(n) for n in kid.nodes}
    return blocks(x.nodes, lambda n: boilerplate(n) or id(n) in inner)


def digest(parts: list[str]) -> str:
    return hashlib.blake2b("\n\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def entry(n: Node, path: str) -> str:
    """An element's path and a hash of its text."""
    return f"{path}\t{digest(blocks([n], boilerplate))}"


def step_entry(outer: list[Node], inner: list[Node], path: str, below: str) -> str:
    """Two paths, one below the other, and a hash of the text between them."""
    kept = {id(n) for n in inner}
    return f"{path}\t{below}\t{digest(blocks(outer, lambda n: boilerplate(n) or id(n) in kept))}"


def induce(pages: list[str]) -> tuple[str | None, list[str]]:
    """(path of the content element, entries of template elements below it) from
    pages of one host; pages with the same main text count once."""
    path, _, template = proposed(pages)
    return path, [t for t in template if t.startswith(f"{path}>")]


def proposed(pages: list[str]) -> tuple[str | None, list[str], list[str]]:
    """As :func:`induce`, with the entries of the steps from the root to the content
    element, and the template entries of the whole page."""
    roots = {}
    for p in pages:
        r = parse(p)
        roots.setdefault(page_text(own_main(r)), r)
    if len(roots) < 2:
        return None, [], []
    first, *rest = (skeleton([r]) for r in roots.values())
    same: dict[int, int] = {}
    nodes: dict[int, Skeleton] = {}
    pairs: dict[int, list[Skeleton]] = {}          # a node's partners on the other pages
    for other in rest:
        for x, y in aligned(first, other, {}):
            nodes[id(x)] = x
            pairs.setdefault(id(x), []).append(y)
            if x.text == y.text:
                same[id(x)] = same.get(id(x), 0) + 1
    if same.get(id(first), 0) == len(rest):
        return None, [], []
    best, chain = first, [first.path]
    while True:
        at = pairs[id(best)]
        step = [k for k in best.kids if len(pairs.get(id(k), ())) == len(rest) and same.get(id(k), 0) < len(rest)
                and all(beside(best, k) == beside(x, y) for x, y in zip(at, pairs[id(k)]))]
        if not step or best.tag in ("article", "main"):
            break
        if step[0].tag in ("p", "b", "span", "i", "em", "strong", "a", "h1", "ul", "ol", "li", "table", "tr", "td"):
            break
        best = step[0]
        chain.append(best.path)
    at = found_at(next(iter(roots.values())), set(chain))
    steps = [step_entry(at[a], at[b], a, b) for a, b in zip(chain, chain[1:])]
    template = [entry(x, n.path) for k, n in nodes.items() if same.get(k, 0) == len(rest) >= 2 and "." in n.label
                and n.text for x in n.nodes]
    return best.path, steps, sorted(set(template))


def at_paths(root: Node, paths: set[str]) -> list[tuple[Node, str]]:
    """The elements at any of the paths, in page order."""
    out, todo = [], [(root, root.label)]
    while todo:
        n, at = todo.pop()
        if at in paths:
            out.append((n, at))
        if any(w.startswith(at) for w in paths):
            todo.extend((c, f"{at}>{c.label}") for c in reversed(n.children()))
    return out


def found_at(root: Node, paths: set[str]) -> dict[str, list[Node]]:
    out: dict[str, list[Node]] = {p: [] for p in paths}
    for n, at in at_paths(root, paths):
        out[at].append(n)
    return out


def refuted(page: str, template: list[str], steps: list[str] = ()) -> list[str]:
    """The entries whose path the page has, but nowhere with their text, and the steps
    whose paths it has, but with other text between them."""
    if not page or not (template or steps):
        return []
    parts = [t.split("\t") for t in steps]
    paths = {t.split("\t")[0] for t in template}
    found = found_at(parse(page), paths | {p for s in parts for p in s[:2]})
    have = {entry(n, at) for at in paths for n in found[at]}
    return [t for t in template if found[t.split("\t")[0]] and t not in have] + \
        [s for s, (a, b, _) in zip(steps, parts) if found[a] and found[b] and step_entry(found[a], found[b], a, b) != s]


def apply_wrapper(page: str, path: str | None, template: list[str]) -> str:
    """The text of a page below the wrapper's path, or of its own main part."""
    if not page:
        return ""
    root = parse(page)
    drop: set[int] = set()
    if path:
        wanted = set(template)
        paths = {t.split("\t")[0] for t in template}
        at_any = at_paths(root, paths | {path})
        found = [n for n, at in at_any if at == path]
        drop = {id(n) for n, at in at_any if at in paths and entry(n, at) in wanted}
        if found and found[0].tag not in ("body", "html", "#root"):
            return page_text(found, frozenset(drop))
    return page_text(own_main(root), frozenset(drop))


WRAPPER_SQL = "host string, path string, steps array<string>, template array<string>"
OUT = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])


def host_of(url: str):
    """Host of a url in lower case; empty without one."""
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """One proposed wrapper a host, from its first pages of distinct main text in the
    order of a hash."""
    rows = pages.where((F.length(F.col(html)) > 0) & (host_of(url) != "")).select(
        host_of(url).alias("host"), F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    w = Window.partitionBy("host").orderBy("h")
    chosen = rows.select("host", "h", main_hash_udf()("html").alias("m")).groupBy("host", "m").agg(F.min("h").alias("h")) \
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample).select("host", "h")
    chosen, small = bounded(chosen)
    some = rows.join(maybe_broadcast(chosen, small), ["host", "h"]).dropDuplicates(["host", "h"])

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        path, steps, template = proposed(group.sort_values("h")["html"].tolist())
        return pd.DataFrame({"host": [key[0]], "path": [path], "steps": [steps], "template": [template]})
    return some.groupBy("host").applyInPandas(make, WRAPPER_SQL)


def main_hash_udf():
    """Hash of a page's own main text."""
    def run(html: pa.Array) -> pa.Array:
        return pa.array([digest([page_text(own_main(parse(h or "")))]) for i in range(0, len(html), 256)
                         for h in html.slice(i, 256).to_pylist()], pa.string())
    return F.arrow_udf(run, "string")


def refuted_udf():
    def run(html: pa.Array, template: pa.Array, steps: pa.Array) -> pa.Array:
        return pa.array([refuted(h or "", t or [], s or []) for i in range(0, len(html), 256) for h, t, s in
                         zip(*(x.slice(i, 256).to_pylist() for x in (html, template, steps)))], pa.list_(pa.string()))
    return F.arrow_udf(run, "array<string>")


def confirmed(known: DataFrame, small: bool, pages: DataFrame, url: str, html: str) -> DataFrame:
    """The wrappers without the template entries that a page of their host refutes, and
    with the path up to the first step that one refutes; only these entries are
    shuffled."""
    some = known.where(F.size("template") + F.size("steps") > 0).select(F.col("host").alias("_host"), "template", "steps")
    wrong = pages.where(F.length(F.col(html)) > 0).select(F.col(html).alias("_html"), host_of(url).alias("_at")) \
        .join(maybe_broadcast(some, small), F.col("_at") == F.col("_host")) \
        .select("_host", F.explode(refuted_udf()("_html", "template", "steps")).alias("_t")).distinct() \
        .groupBy("_host").agg(F.collect_list("_t").alias("_wrong"))
    bad = F.coalesce("_wrong", F.array().cast("array<string>"))
    first = F.get(F.filter("steps", lambda s: F.array_contains(bad, s)), F.lit(0))
    out = known.join(wrong, F.col("host") == F.col("_host"), "left").select(
        "host", F.coalesce(F.substring_index(first, "\t", 1), "path").alias("path"), F.array_except("template", bad).alias("template"))
    return out.withColumn("template", F.filter("template", lambda t: F.startswith(t, F.concat("path", F.lit(">")))))


def extract_udf():
    def chunk(batch: pa.Array) -> pa.Array:
        texts = [apply_wrapper(p or "", w, t or []) for p, w, t in zip(*(batch.field(k).to_pylist() for k in range(3)))]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          fields=list(OUT))

    def run(html: pa.Array, path: pa.Array, template: pa.Array) -> pa.Array:
        parts = [chunk(pa.StructArray.from_arrays([x.slice(i, 256) for x in (html, path, template)], ["h", "p", "t"]))
                 for i in range(0, len(html), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], OUT)
    return F.arrow_udf(run, "text string, n_chars long")


def html_extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html",
                 sample: int = SAMPLE_PAGES) -> DataFrame:
    """``keep`` columns, the main text of every page and its code points."""
    known, small = bounded(wrappers(pages, url, html, sample))
    known, small = bounded(confirmed(known, small, pages, url, html))
    known = known.select(F.col("host").alias("_w_host"), F.col("path").alias("_w_path"),
                         F.col("template").alias("_w_template"))
    cols = [F.col(f"`{c}`") for c in keep]
    rows = pages.select(*cols, F.col(html).alias("_w_html"), host_of(url).alias("_w_at"))
    rows = rows.join(maybe_broadcast(known, small), F.col("_w_at") == F.col("_w_host"), "left")
    return rows.select(*cols, extract_udf()("_w_html", "_w_path", "_w_template").alias("_x")).select(*cols, "_x.*")
