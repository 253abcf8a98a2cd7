"""Content and boilerplate of a page by a minimum cut.

Each block of text is a node between two terminals. The nearest telling container and a logistic regression over cues of
the block (length, links, punctuation, kind of element, legal lines) give a cost for either label, which become the
capacities from and to the terminals. Smoothness edges join blocks that follow one another, more strongly within one
container, and join blocks and containers to the container around them. The minimum cut is the labelling of least total
cost: blocks in telling containers keep their label, and a block that nothing tells about is outvoted by its neighbours.

The regression is fitted on about SAMPLE pages, chosen by hash: blocks in articles count as content, blocks in navigation,
footers and the like as boilerplate. It starts at fixed scores of the cues and stays there as far as labels are few, so a
table without labelled blocks, or with one label only, is judged by those. All pages are extracted, sampled or not.

A node whose terminal capacity is larger than all its edges together has its label in every minimum cut, so such nodes
are settled first, again and again, their edges becoming terminal capacity of their neighbours; max-flow decides the rest.

A form or a box with a word like "sidebar" among its names may be a mere wrapper of the page. It is one if it holds most
of the prose, and most of that within articles if there are such; then it tells nothing. Otherwise an article within a form
counts as if outside of it, and one within or with such a word is weighed by its blocks. Within navigation, footers, asides,
hidden boxes and comments nothing else is telling; comments are a wrapper only of a page that has no other prose.

Defined results: null and blank pages have an empty text; a page that is all boilerplate has an empty text; repeated
rows are extracted one by one; a very long page is worked on whole; an empty table gives an empty result; other columns pass
through, but a column with the name of a result is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.htmlblocks import HEADINGS, Block, Container, Page, parse
from contextloom.llm.shared import free_name, table

RESULTS = ["text", "n_chars"]

GOOD_TAGS = {"article": 5.0, "main": 4.0}
BAD_TAGS = {"nav": 9.0, "footer": 9.0, "aside": 9.0, "form": 9.0, "menu": 9.0, "dialog": 9.0, "header": 6.0, "search": 9.0, "address": 2.0}
GOOD_MARKS = set("article articlebody post entry story content main body text prose".split())
BAD_MARKS = set(
    "nav navbar navigation menu menubar header masthead footer sidebar side rail ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification alert popup modal overlay comment comments reply replies respond disqus discussion form login signup "
    "subscribe subscription newsletter search share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget "
    "copyright legal disclaimer toolbar contentinfo complementary tags skip".split()
)
COMMENT_MARKS = set("comment comments reply replies respond disqus discussion".split())
LINK_MARK, OUTSIDE, BODY = 9.0, 2.5, 1.0
#: Scores of cues before the fit.
LINKS, SHORT, COPYRIGHT = 3.0, 0.5, 4.0
LENGTHS = ((400, 3.0), (160, 2.0), (60, 1.0))
#: Cues of a block: length by these bounds, part in links, end of a sentence, kind of element, legal line.
BOUNDS = (20, 40, 60, 100, 160, 250, 400, 800)
SHAPE = (len(BOUNDS) + 1, 3, 2, 4, 2)
KINDS = dict.fromkeys(HEADINGS, 0) | {"p": 1, "pre": 1} | dict.fromkeys(("li", "dt", "dd", "td", "th"), 2)
#: Pages for the fit, blocks' worth of faith in the scores before it, and the most that cues may weigh.
SAMPLE, FAITH, MOST = 2000, 20.0, 3.5
#: Taken from an article that has or is within a box with a bad mark; long text outweighs the rest.
DOUBT = 6.0
#: Characters of a block of prose, and of the prose of a page that a box with a bad mark may wrap.
PROSE, WRAPPED = 60, 160
NEXT_SAME, NEXT_OTHER, TREE = 1.0, 0.3, 0.5


def _bad_mark(box: Container) -> bool:
    return box.name not in ("html", "body") and bool(box.marks & BAD_MARKS) and not box.marks & GOOD_MARKS


def wrappers(page: Page) -> set[int]:
    """Forms and boxes with bad marks that hold most of the page's prose."""
    boxes = page.boxes
    unsure = [k for k, box in enumerate(boxes) if box.name == "form" or _bad_mark(box)]
    if not unsure:
        return set()
    shut, comment, article, good = ([False] * len(boxes) for _ in range(4))
    for k, box in enumerate(boxes):
        up = box.parent
        shut[k] = up >= 0 and shut[up] or box.hidden or box.name in BAD_TAGS and box.name not in ("form", "header", "address")
        comment[k] = up >= 0 and comment[up] or _bad_mark(box) and bool(box.marks & COMMENT_MARKS)
        article[k] = up >= 0 and article[up] or box.name in GOOD_TAGS
        good[k] = up >= 0 and good[up] or box.name not in ("html", "body") and bool(box.marks & GOOD_MARKS) and not box.marks & BAD_MARKS
    prose = [(b.box, len(b.text)) for b in page.blocks if len(b.text) >= PROSE and b.linked <= 0.5 * len(b.text) and not shut[b.box]]
    prose = [x for x in prose if not comment[x[0]]] or prose
    telling = [x for x in prose if article[x[0]]] or [x for x in prose if good[x[0]]] or prose
    held = []
    for part in (prose, telling):
        sums = [0] * len(boxes)
        for k, n in part:
            sums[k] += n
        for k in range(len(boxes) - 1, 0, -1):  # a box comes after the one around it
            sums[boxes[k].parent] += sums[k]
        held.append(sums)
    most = lambda k: all(2 * sums[k] > sums[0] for sums in held)
    return {k for k in unsure if most(k) and (held[0][0] >= WRAPPED or not _bad_mark(boxes[k]))}


def container_scores(page: Page) -> list[float]:
    """For each container the score of the nearest telling container at or around it."""
    wraps = wrappers(page)
    scores: list[float] = []
    inside: list[bool] = []
    closed: list[int] = []  # what bad boxes are around: 0 none, 1 forms, 2 bad marks, 3 such that nothing within is telling
    for k, box in enumerate(page.boxes):
        around = scores[box.parent] if box.parent >= 0 else 0.0
        held = inside[box.parent] if box.parent >= 0 else False
        shut = closed[box.parent] if box.parent >= 0 else 0
        good, bad = bool(box.marks & GOOD_MARKS), bool(box.marks & BAD_MARKS)
        if box.hidden:
            score, shut = -LINK_MARK, 3
        elif box.name in BAD_TAGS and box.name != "form" and not (box.name == "header" and held):
            score, shut = -BAD_TAGS[box.name], shut if box.name in ("header", "address") else 3
        elif shut == 3:
            score = around
        elif _bad_mark(box) and k not in wraps:
            if box.marks & COMMENT_MARKS:
                score, shut = -LINK_MARK, 3
            else:
                score, shut = GOOD_TAGS[box.name] - DOUBT if box.name in GOOD_TAGS else -LINK_MARK, 2
        elif box.name == "form" and k not in wraps:
            score, shut = -BAD_TAGS["form"], max(shut, 1)
        elif box.name in GOOD_TAGS:
            score, shut = (GOOD_TAGS[box.name] - DOUBT, 2) if shut == 2 else (GOOD_TAGS[box.name], 0)
        elif around < -6:  # within boilerplate only an article's own element is telling
            score = around
        elif good and not bad and box.name not in ("html", "body"):
            score = max(around, 3.0)
        else:
            score = around
        scores.append(score)
        inside.append(held or box.name == "article")
        closed.append(shut)
    return scores


def cues(b: Block) -> int:
    """The cell of SHAPE that the block is in."""
    n = len(b.text)
    links = 0 if not b.linked else 2 if b.linked > 0.5 * n else 1
    legal = n < 200 and ("©" in b.text or "all rights reserved" in b.text.lower())
    cell = bisect_right(BOUNDS, n) * 3 + links
    cell = cell * 2 + (b.text.rstrip("\"'”»)")[-1:] in (".", "!", "?", "…", "。", "！", "？"))
    return (cell * 4 + KINDS.get(b.tag, 3)) * 2 + legal


def _fixed_costs() -> list[float]:
    out = []
    for length, links, _, kind, legal in np.ndindex(*SHAPE):
        least = BOUNDS[length - 1] if length else 0
        score = next((w for n, w in LENGTHS if least >= n), SHORT if kind == 0 else -SHORT)
        out.append(score - LINKS * (links == 2) - COPYRIGHT * legal)
    return out


FIXED_COSTS = _fixed_costs()


def fit_costs(counts: dict[tuple[int, bool], int]) -> list[float]:
    """Cost of each cell from how many blocks of a cell have a label: penalised logistic regression, labels weighing alike."""
    total = [sum(n for (_, y), n in counts.items() if y == label) for label in (False, True)]
    if not all(total):
        return FIXED_COSTS
    ends = np.cumsum((0, *SHAPE))
    x = np.zeros((len(FIXED_COSTS), ends[-1] + 1))
    for cell, where in enumerate(np.ndindex(*SHAPE)):
        x[cell, [ends[k] + at for k, at in enumerate(where)] + [-1]] = 1.0
    rows = sorted(counts)
    cell, label = np.array([c for c, _ in rows]), np.array([y for _, y in rows], dtype=float)
    weight = np.array([counts[r] * sum(total) / (2 * total[r[1]]) for r in rows])
    start, own = np.array(FIXED_COSTS), x[cell]

    def loss(w: np.ndarray) -> float:
        z = start[cell] + own @ w
        return float(weight @ (np.logaddexp(0, z) - label * z) + FAITH / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(start[cell] + own @ w)))
        slope = own.T @ (weight * (p - label)) + FAITH * w
        step = np.linalg.solve((own * (weight * p * (1 - p))[:, None]).T @ own + FAITH * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return [float(z) for z in np.clip(start + x @ w, -MOST, MOST)]


def labelled_cells(page: Page) -> list[tuple[int, bool]]:
    """Cells of the blocks that a telling container labels."""
    boxes = container_scores(page)
    return [(cues(b), boxes[b.box] > 0) for b in page.blocks if boxes[b.box] >= 4.0 or boxes[b.box] <= -6.0]


def block_scores(page: Page, costs: list[float] = FIXED_COSTS) -> list[float]:
    """Positive where content is likelier."""
    boxes = container_scores(page)
    marked = any(boxes[b.box] >= 4.0 for b in page.blocks)
    out = []
    for b in page.blocks:
        score = boxes[b.box]
        if score == 0.0:
            score = -OUTSIDE if marked else BODY
        out.append(score + costs[cues(b)] if score > -6 else score)
    return out


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Between blocks 0..n-1 and containers n.."""
    n, found = len(page.blocks), []
    for i, b in enumerate(page.blocks):
        if i:
            found.append((i - 1, i, NEXT_SAME if page.blocks[i - 1].box == b.box else NEXT_OTHER))
        found.append((i, n + b.box, TREE))
    used, todo = set(), {b.box for b in page.blocks}
    while todo:
        box = todo.pop()
        if box not in used:
            used.add(box)
            around = page.boxes[box].parent
            if around >= 0:
                found.append((n + box, n + around, TREE))
                todo.add(around)
    return found


def minimum_cut(bias: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: |bias| is paid where the label is not bias > 0, a link's weight where its ends differ."""
    bias = list(bias)
    near: list[dict[int, float]] = [{} for _ in bias]
    for a, b, w in links:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(bias)
    todo = deque(range(len(bias)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(bias[i]) >= sum(near[i].values()):
            label[i] = bias[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                bias[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(len(bias)) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        arcs = [(place[i], place[j], w, w) for i in left for j, w in near[i].items() if i < j]
        content = _source_side([bias[i] for i in left], arcs)
        for i, x in zip(left, content, strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _source_side(bias: list[float], arcs: list[tuple[int, int, float, float]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow, found by blocking flows in layers."""
    n = len(bias)
    source, sink = n, n + 1
    arcs = [*arcs, *((source, i, b, 0.0) if b > 0 else (i, sink, -b, 0.0) for i, b in enumerate(bias))]
    to, room, out = [], [], [[] for _ in range(n + 2)]
    for a, b, there, back in arcs:  # arc e and its reverse e ^ 1
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        room += [there, back]
    while True:
        layer = [-1] * (n + 2)
        layer[source] = 0
        queue = deque([source])
        while queue and layer[sink] < 0:
            i = queue.popleft()
            for e in out[i]:
                if room[e] > 1e-9 and layer[to[e]] < 0:
                    layer[to[e]] = layer[i] + 1
                    queue.append(to[e])
        if layer[sink] < 0:
            return [x >= 0 for x in layer[:n]]
        tried, path, i = [0] * (n + 2), [], source
        while True:
            if i == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                i = to[path[first] ^ 1]
                del path[first:]
            elif tried[i] < len(out[i]):
                e = out[i][tried[i]]
                if room[e] > 1e-9 and layer[to[e]] == layer[i] + 1:
                    path.append(e)
                    i = to[e]
                else:
                    tried[i] += 1
            elif i == source:
                break
            else:
                i = to[path.pop() ^ 1]
                tried[i] += 1


def main_text(source: str | None, costs: list[float] = FIXED_COSTS) -> str:
    page = parse(source or "")
    if not page.blocks:
        return ""
    bias = block_scores(page, costs) + [0.0] * len(page.boxes)
    labels = minimum_cut(bias, edges(page))
    return "\n".join(b.text for b, x in zip(page.blocks, labels, strict=False) if x)


def _cells_of(source: pa.Array) -> pa.Array:
    """For each page twice the cell, plus one for content, of every labelled block."""
    return pa.array([[2 * c + y for c, y in labelled_cells(parse(x.as_py() or ""))] for x in source], type=pa.list_(pa.int64()))


def learn_costs(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> list[float]:
    """Costs of cells fitted on about `sample` pages; only counts of cells leave the executors."""
    slim = pages.select(F.col(html).alias("html")).where("html is not null")
    share = min(1.0, sample / max(1, slim.count()))
    some = slim.where(F.pmod(F.xxhash64("html"), F.lit(1 << 31)) < int(share * (1 << 31)))
    cells = some.select(F.explode(F.arrow_udf(_cells_of, "array<long>")("html")).alias("cell"))
    return fit_costs({(r.cell >> 1, bool(r.cell & 1)): r["count"] for r in cells.groupBy("cell").count().collect()})


def extract(pages: DataFrame, html: str = "html", costs: list[float] = FIXED_COSTS) -> DataFrame:
    """pages without html, with text (blocks of the main text joined by newlines) and n_chars."""

    def main_texts(source: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), costs) for x in source], type=pa.string())

    rest = [c for c in pages.columns if c.lower() not in RESULTS and c != html]
    inner = free_name([*pages.columns, *RESULTS], "_row")
    df = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias(inner), F.col(html).alias("_html")).withColumn("text", F.arrow_udf(main_texts, "string")("_html"))
    return df.select(*(F.col(f"{inner}.`{c}`") for c in rest), "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, costs=learn_costs(pages)).select("page_id", "url", "text", "n_chars")
