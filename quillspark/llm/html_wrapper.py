"""Main text by union-free wrappers, inferred from pages of one host.

1. Each page becomes a stream of tokens (tags and text slots) and that a
   union-free expression: under every element, equal children are folded into
   one that repeats, and what alternates between equal children into a repeated
   group.  So an expression has as many nodes as a page has distinct paths.
2. Expressions of one host are aligned one after another, element by element, into
   its wrapper.  What one stream lacks becomes optional, what comes in another
   order becomes a repeated group, and a slot whose texts differ varies.
   Wrappers align with wrappers just as well: tasks make one a host from their
   own pages, and these are combined in groups of bounded size.
3. A page's slots are content or not by its host's wrapper.  From the root, the
   part that holds nearly all varying text is gone into as long as there is one;
   in it all slots count that are not template text.  Element and class names
   that tell a role enter as prior weights only.
4. Pages of one host with the same paths share a decision, which is looked up.
   Content slots are joined in page order.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import defaultdict
from collections.abc import Iterable

import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.url_filter import host_of
from quillspark.operators.skew import column_of, hot_cold_join, numbered
from quillspark.scratch import materialize

#: Elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold whole parts of a page.
REGIONS = frozenset("html body article main div section table tbody tr td center header footer nav aside form fieldset".split())
#: Prior weights: elements and classes that tell a role.
CONTENT = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form button select dialog menu head noscript template svg math object".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter notice popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
LEADS = frozenset("ad ads advert comment comments cookie newsletter related reply sidebar sponsor sponsored".split())
ENDS = frozenset("area bar block body box container form holder item items link links list panel post posts section slot text unit wrap wrapper".split())
PRIOR = 64.0
#: Elements that an opening tag closes if they are open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header main nav ol section table td ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements deeper than this, and levels of wrappers with more nodes than that, count with the element above.
DEPTH, MAX_NODES = 24, 500
#: A slot with one text on so many pages is template text (twice as many where a name says content).
SUPPORT = 4
#: Share of a part's varying text that the next part must hold to be gone into.
DOMINANT = 0.8
#: Wrappers aligned by one task, and nodes that a task holds before it gives them away.
TOGETHER, HELD = 256, 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s\xa0]+")


def role_word(attributes: str) -> str:
    """The first class, id or role that names a part beside the article: a known word alone or last, or a known pair."""
    for a in _ATTRIBUTE.finditer(attributes):
        for name in (a[2] or a[3] or a[4] or "").lower().split():
            parts = re.split(r"[-_]+", name)
            if parts[-1] in WORDS or len(parts) > 1 and parts[0] in LEADS and parts[-1] in ENDS:
                return parts[-1] if parts[-1] in WORDS else parts[0]
    return ""


class _Element:
    __slots__ = ("name", "hint", "parent", "alive", "nested", "path", "chars", "links")

    def __init__(self, name: str, hint: str, parent: "_Element | None"):
        self.name, self.hint, self.parent, self.alive, self.nested, self.path = name, hint, parent, False, False, ""
        self.chars = self.links = 0

    def mark(self) -> str:
        """Name, role word, and whether a part has text of its own only (=) or mostly links (@)."""
        kind = "" if self.name not in REGIONS else "@" if 2 * self.links > self.chars else "" if self.nested else "="
        return self.name + ("~" + self.hint if self.hint else "") + kind


def page_slots(html: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """([(path, text, characters in links)] of each block of text, [(path, parent's path)] of each element) in page order.

    A path is the marks of the open elements that are not inline.  Text of one
    block is joined over inline elements; white space becomes one space.
    Elements without text are left out.
    """
    root = _Element("", "", None)
    elements: list[_Element] = []
    slots: list[tuple[_Element, str, int]] = []
    stack: list[tuple[str, _Element]] = []
    owner, linked = root, 0
    held: list[str] = []
    in_links = 0

    def flush() -> None:
        nonlocal in_links
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            slots.append((owner, text, min(in_links, len(text))))
        in_links = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                text = _html.unescape(m[0])
            elif m[0].startswith("<![CDATA["):
                text = m[0][9:].removesuffix("]]>")
            else:
                continue
            held.append(text)
            if linked:
                in_links += len(text)
            continue
        name = name.lower()
        if m[1]:
            if any(x == name for x, _ in stack):
                while True:
                    gone, above = stack.pop()
                    if above is not owner:
                        flush()
                        owner = above
                    linked -= gone == "a"
                    if gone == name:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if end or name != "iframe":
                end_at = html.find(">", end.start()) if end else -1
                at = end_at + 1 if end_at >= 0 else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if m[3].endswith("/") and name in ("svg", "math"):
            continue
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                flush()
                owner = stack[i][1]
                linked -= sum(x == "a" for x, _ in stack[i:])
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break
        hint = "" if name in HEADINGS else role_word(m[3])
        stack.append((name, owner))
        linked += name == "a"
        if name not in INLINE or hint:
            flush()
            owner = _Element(name, hint, owner)
            elements.append(owner)
    flush()
    for element, text, links in slots:
        element.alive = True
        element.chars += len(text)
        element.links += links
    for e in reversed(elements):  # children before parents
        if e.alive:
            above = e.parent
            above.alive = above.nested = True
            above.chars += e.chars
            above.links += e.links
    found = [e for e in elements if e.alive]
    for e in found:  # parents come before children
        above = e.parent.path
        e.path = f"{above}/{e.mark()}" if above.count("/") < DEPTH else above
    return [(e.path, text, links) for e, text, links in slots], [(e.path, e.parent.path) for e in found if e.path != e.parent.path]


def fold(marks: list[str]) -> list[list[str]]:
    """Children in order, each once: what lies between two equal ones is a repeated group with them."""
    first, last = {}, {}
    for i, mark in enumerate(marks):
        first.setdefault(mark, i)
        last[mark] = i
    out: list[list[str]] = []
    end = -1
    for mark, i in first.items():
        # Neighbours that are equal are one child that repeats; a group needs something between them.
        if i < end:
            out[-1].append(mark)
        else:
            out.append([mark])
        end = max(end, last[mark])
    return out


def align_children(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    """``a`` widened to take ``b`` too.

    Both are in order; an item of several marks is a repeated group.  Marks that
    only one has stay where it has them, as optional; what the two have in
    another order, or one has as a group, becomes a group with all between.
    """
    place = {mark: i for i, item in enumerate(a) for mark in item}
    spans, inside, after, reached = [], defaultdict(list), defaultdict(list), -1
    for item in b:
        known = [place[mark] for mark in item if mark in place]
        if not known:
            after[reached].append(item)
            continue
        low, high = min(known), max(known)
        if low < reached:
            spans.append((low, reached))
        spans.append((low, high))
        inside[low] += [mark for mark in item if mark not in place]
        reached = max(reached, high)
    out: list[list[str]] = [*after[-1]]
    spans.sort()
    i = at = 0
    while i < len(a):
        end = i
        while at < len(spans) and spans[at][0] <= end:
            end = max(end, spans[at][1])
            at += 1
        group = []
        for k in range(i, end + 1):
            group += a[k] + inside[k] + ([mark for item in after[k] for mark in item] if k < end else [])
        out += [group, *after[end]]
        i = end + 1
    return out


#: A wrapper node: pages with it, most at once in one element, pages with text, characters, of them in links, least and greatest hash of the text, children.
Wrapper = dict[str, list]


def expression(slots: list[tuple[str, str, int]], elements: list[tuple[str, str]]) -> Wrapper:
    """Union-free expression of one page, as the wrapper of that page alone."""
    out: Wrapper = {"": [1, 1, 0, 0, 0, None, None, []]}
    kids: dict[str, list[str]] = defaultdict(list)
    for path, above in elements:
        out.setdefault(path, [1, 1, 0, 0, 0, None, None, []])
        kids[above].append(path[len(above) + 1 :])
    texts: dict[str, list] = defaultdict(lambda: [0, 0, xxhash.xxh64()])
    for path, text, links in slots:
        held = texts[path]
        held[0] += len(text)
        held[1] += links
        held[2].update(text + "\n")
    for path, (chars, links, digest) in texts.items():
        h = digest.intdigest() - 2**63
        out[path][2:7] = [1, chars, links, h, h]
    for path, marks in kids.items():
        out[path][7] = fold(marks)
        for mark in set(marks):
            out[f"{path}/{mark}"][1] = max(out[f"{path}/{mark}"][1], marks.count(mark))
    return out


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _greatest(a, b):
    return b if a is None else a if b is None else max(a, b)


def align(wrapper: Wrapper, other: Wrapper) -> Wrapper:
    """``wrapper`` widened, in place, to take another wrapper or expression of its host."""
    for path, node in other.items():
        own = wrapper.get(path)
        if own is None:
            wrapper[path] = [*node[:7], [list(item) for item in node[7]]]
            continue
        own[0] += node[0]
        own[1] = max(own[1], node[1])
        own[2], own[3], own[4] = own[2] + node[2], own[3] + node[3], own[4] + node[4]
        own[5], own[6] = _least(own[5], node[5]), _greatest(own[6], node[6])
        if own[7] != node[7]:
            own[7] = align_children(own[7], node[7])
    return wrapper


def coarsen(wrapper: Wrapper, max_nodes: int = MAX_NODES) -> Wrapper:
    """The wrapper without its deepest levels, whose slots count with the element above, so that it has ``max_nodes`` at most.

    The level follows from how many paths there are, so combining in any order ends at the same.
    """
    while len(wrapper) > max_nodes and (deepest := max(path.count("/") for path in wrapper)) > 1:
        for path in [p for p in wrapper if p.count("/") == deepest]:
            node, above = wrapper.pop(path), wrapper[path.rsplit("/", 1)[0]]
            above[2], above[3], above[4] = above[2] + node[2], above[3] + node[3], above[4] + node[4]
            above[5], above[6], above[7] = _least(above[5], node[5]), _greatest(above[6], node[6]), []
    return wrapper


def infer_wrapper(pages: Iterable[Wrapper]) -> Wrapper:
    """Align expressions (or wrappers) one after another."""
    out: Wrapper = {}
    for page in pages:
        align(out, page)
        if len(out) > MAX_NODES:
            coarsen(out)
    return out


def _role(mark: str) -> tuple[str, str]:
    name, _, hint = mark.rstrip("=@").partition("~")
    return name, hint


def _beside(mark: str) -> bool:
    """Do names say that this part lies beside the article?  A header may be the article's own."""
    name, hint = _role(mark)
    return name in ASIDE or bool(hint) and hint != "header"


def _is_header(mark: str) -> bool:
    return "header" in _role(mark)


def prior(path: str) -> float:
    """Weight of text at ``path`` by the names on it."""
    marks = path.split("/")[1:]
    if any(_beside(m) for m in marks):
        return 1 / PRIOR
    if any(_role(m)[0] in CONTENT for m in marks):
        return PRIOR
    return 1 / PRIOR if any(_is_header(m) for m in marks) else 1.0


def content_paths(paths: list[str], wrapper: Wrapper) -> set[str]:
    """The paths of a page's slots that hold main text, by the wrapper of its host."""
    def node_of(path: str) -> list:
        while path not in wrapper:
            path = path.rsplit("/", 1)[0]
        return wrapper[path]

    nodes = {path: node_of(path) for path in paths}
    varied = any(node[5] != node[6] for node in wrapper.values())

    def is_template(path: str) -> bool:
        need = SUPPORT * (2 if any(_role(m)[0] in CONTENT for m in path.split("/")) else 1)
        return varied and nodes[path][5] == nodes[path][6] and nodes[path][2] >= need

    def decide(template: set[str]) -> set[str]:
        mass: dict[str, float] = defaultdict(float)
        kids: dict[str, set[str]] = defaultdict(set)
        for path in paths:
            _, _, pages, chars, links, _, _, _ = nodes[path]
            # What a page with this slot has in it: characters outside links, and a little for those in links.
            weight = 0.0 if path in template else prior(path) * (chars - 0.9 * links) / max(1, pages)
            at = path
            while True:
                mass[at] += weight
                if not at:
                    break
                kids[at.rsplit("/", 1)[0]].add(at)
                at = at.rsplit("/", 1)[0]
        at, dropped = "", set()
        while True:
            parts = sorted(k for k in kids[at] if _role(k.rsplit("/", 1)[1])[0] in REGIONS)
            best = max(parts, key=lambda k: (mass[k], k), default="")
            if not best or mass[best] <= 0 or mass[best] < DOMINANT * mass[at]:
                break
            mark = best.rsplit("/", 1)[1]
            group = next((item for item in node_of(at)[7] if mark in item), []) if node_of(best)[1] > 1 else []
            # Parts that alternate with the chosen one, which repeats, belong to it.
            dropped |= {k for k in parts if k != best and k.rsplit("/", 1)[1] not in group}
            at = best
        out = set()
        for path in paths:
            inside = not at or path == at or path.startswith(at + "/")
            # Where names on the way in tell a role, the text there has told otherwise.
            above = at if inside else next(path[:k] for k in range(len(path), -1, -1) if (k == len(path) or path[k] == "/") and (not path[:k] or (at + "/").startswith(path[:k] + "/")))
            rest = path[len(above) :].split("/")[1:]
            whole = not any(_role(m)[0] not in ("", "html", "body") for m in above.split("/"))
            if path in template or any(path == d or path.startswith(d + "/") for d in dropped) or any(map(_beside, rest)):
                continue
            if any(_is_header(m) and not any(_role(x)[0] in CONTENT for x in rest[:k]) for k, m in enumerate(rest)) and (whole or not inside):
                continue
            # Lists of links above the article are menus.
            if (whole or not inside) and 2 * nodes[path][4] > nodes[path][3] and not any(_role(m)[0] in CONTENT for m in rest):
                continue
            out.add(path)
        return out

    # Where nothing is left (copies of one page, template text alone) no text counts as template text.
    return decide({path for path in paths if is_template(path)}) or decide(set())


def _shape(slots: list[tuple[str, str, int]]) -> list[str]:
    return sorted({path for path, _, _ in slots})


def _shape_key(shape: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(shape)) - 2**63


def _infer(batches: Iterable):
    """A task's wrapper of each host and the shapes (sets of slots' paths) of its pages, from rows (host, html)."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64())
    wrappers: dict[str, Wrapper] = {}
    shapes: dict[str, dict[int, list]] = {}

    def leave():
        rows = [(host, part, json.dumps(w, ensure_ascii=False), None, None, w[""][0]) for host, w in wrappers.items()]
        rows += [(host, part, None, key, shape, n) for host, found in shapes.items() for key, (shape, n) in found.items()]
        wrappers.clear()
        shapes.clear()
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), types)], ["host", "part", "wrapper", "e", "shape", "pages"])

    held = 0
    for batch in batches:
        for host, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            slots, elements = page_slots(data.as_py() or "")
            wrapper = wrappers.setdefault(host, {})
            before = len(wrapper)
            if len(align(wrapper, expression(slots, elements))) > MAX_NODES:
                coarsen(wrapper)
            held += max(0, len(wrapper) - before)
            shape = _shape(slots)
            known = shapes.setdefault(host, {}).setdefault(_shape_key(shape), [shape, 0])
            known[1] += 1
            held += len(shape) if known[1] == 1 else 0
            if held > HELD:
                yield from leave()
                held = 0
    yield from leave()


def _combine(pdf):
    """Partial wrappers of one host and group of tasks, aligned into one."""
    import pandas as pd

    pdf = pdf.sort_values(["part", "wrapper"])
    wrapper = infer_wrapper(map(json.loads, pdf["wrapper"]))
    return pd.DataFrame([(pdf["host"].iloc[0], int(pdf["part"].iloc[0]), json.dumps(wrapper, ensure_ascii=False), int(pdf["pages"].sum()))], columns=["host", "part", "wrapper", "pages"])


def _partials(pages: DataFrame) -> DataFrame:
    return materialize(pages.select("host", "html").mapInArrow(_infer, "host string, part long, wrapper string, e long, shape array<string>, pages long"), "partial-wrappers")


def _combined(partials: DataFrame) -> DataFrame:
    rows = partials.where("wrapper is not null").select("host", "part", "wrapper", "pages")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # No task aligns more than the wrappers of ``TOGETHER`` tasks.
        rows = rows.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("long"))
        parts = -(-parts // TOGETHER)
        rows = materialize(rows.groupBy("host", "part").applyInPandas(_combine, "host string, part long, wrapper string, pages long"), "wrappers")
        if parts <= 1:
            return rows.drop("part")


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (see ``Wrapper``, as JSON) and pages: one row per host of ``pages`` (host, html)."""
    return _combined(_partials(pages))


def _decide(batches: Iterable):
    import pyarrow as pa

    for batch in batches:
        out = []
        for host, e, shape, wrapper, n in zip(*(c.to_pylist() for c in batch.columns)):
            content = content_paths(shape, json.loads(wrapper))
            out.append((host, e, [i for i, path in enumerate(shape) if path in content], n))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64()))], ["host", "e", "content", "shown"])


def _parse(batches: Iterable):
    """Each page's blocks of text in order, neighbours of one path joined, and their paths' numbers in its shape."""
    import pyarrow as pa

    for batch in batches:
        keys, texts, places = [], [], []
        for data in batch.column(3):
            slots, _ = page_slots(data.as_py() or "")
            shape = _shape(slots)
            number = {path: i for i, path in enumerate(shape)}
            own: list[str] = []
            where: list[int] = []
            for path, text, _ in slots:
                if where and where[-1] == number[path]:
                    own[-1] += " " + text
                else:
                    own.append(text)
                    where.append(number[path])
            keys.append(_shape_key(shape))
            texts.append(own)
            places.append(where)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keys, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], ["page_id", "url", "host", "e", "texts", "places"])


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, url and text of every row of ``pages``; text is empty where there is none.

    Null html is an empty page.  Null urls and urls without a host share one
    wrapper.  Repeated rows are extracted each.  Pages cut off in the middle
    end there.  Empty tables give empty results; other columns are ignored,
    whatever their names.
    """
    pages, names = numbered(pages)
    rows = pages.select(column_of(names, id_col).cast("long").alias("page_id"), column_of(names, url_col).alias("url"), column_of(names, html_col).alias("html"))
    rows = rows.select("page_id", "url", host_of(F.coalesce("url", F.lit(""))).alias("host"), "html")
    partials = _partials(rows)
    wrappers = _combined(partials)
    shapes = partials.where("shape is not null").groupBy("host", "e").agg(F.first("shape").alias("shape"), F.sum("pages").alias("shown"))
    # A host's weight here is how many shapes it has, which its pages bound.
    asked = hot_cold_join(shapes, wrappers, ["host"], "pages", F.col("e")).select("host", "e", "shape", "wrapper", "shown")
    decided = materialize(asked.mapInArrow(_decide, "host string, e long, content array<int>, shown long"), "decisions")
    parsed = rows.mapInArrow(_parse, "page_id long, url string, host string, e long, texts array<string>, places array<int>")
    joined = hot_cold_join(parsed, decided, ["host", "e"], "shown", F.struct("page_id", "url"))
    kept = F.filter(F.arrays_zip("texts", "places"), lambda x: F.array_contains("content", x["places"]))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["texts"]), " ").alias("text"))
