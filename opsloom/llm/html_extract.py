"""Main-text extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path and the element that contains it. For each path of
the page, and for each path within one container, text length and punctuation a block are summed into ratios, which rise
no further once they are those of a full sentence or two. Both ratios are fused; each block's value is smoothed with those
of the blocks around it whose paths are near in the tag tree; and the outcome is weighted by the share of the path's text
outside links and by what element names and class words say of the path. Paths over a share of the page's best score are
content. Short blocks (headings, list items, captions) have no ratios worth the name: they join the content of their
container where most of it is content.

A null or empty page, or one without text outside links, gives the empty text. Pages are read one by one, so ties, repeated
rows and extra columns change nothing, and an empty table gives an empty table. A page of any length is read whole, in time
and memory that grow with its length: elements nested deeper than DEEPEST are read as their neighbours, as browsers do.
Unclosed and stray tags are closed as browsers do for the common cases.
"""

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import values

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = RAW | set("head template svg math canvas object audio video select button form dialog".split())
#: Elements that aren't steps of a path: their blocks are siblings of what stands around them.
TRANSPARENT = set("ul ol dl menu tbody thead tfoot tr figure picture details".split())
CONTAINERS = set("html body div section article main aside nav header footer table td".split())
SHORT = set("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre p summary address hr br".split())
BLOCK = set(
    "html body article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption main address hr br nav footer header aside form fieldset legend details summary".split()
)
CLOSES_P = BLOCK - set("html body td th tr thead tbody tfoot caption br li dt dd legend summary figcaption".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = set("ul ol dl table html body article section div main td th blockquote".split())
FORMATTING = set("a b i u s em strong small big code font span tt strike sub sup mark q cite abbr".split())
# Class, id and role words of containers that are seldom the article, and of those that sometimes aren't.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|popup|modal|overlay|newsletter|sidebar|side-bar|comments?|disqus|replies|respond|"
    r"social|sharing|share|breadcrumbs?|pagination|pager|menu|nav|navbar|navigation|footer|masthead|toolbar|login|signup|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:promo\w*|banner|notice|rail|related|recommend\w*|widget|skip|search|subscribe)(?:$|[\s_-])", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，]")
SPACE = re.compile(r"\s+")
#: What an element's name or class says of the text beneath it.
FURNITURE_WEIGHT, DOUBTFUL_WEIGHT, HEADER_WEIGHT = 0.002, 0.6, 0.004
BOILERPLATE = {"nav": 0.001, "footer": 0.002, "aside": 0.003}
#: The length and the marks of a block from which its ratios rise no further.
FULL_LENGTH, FULL_MARKS = 200, 3
#: Blocks to both sides that smooth a block, and their weights by the distance of the paths.
AROUND, NEAR = 3, (1.0, 0.6, 0.4)
#: The share of the best score that makes a path content; the share of a container's text that lets its short blocks join.
THRESHOLD, MOSTLY, SHARE = 0.4, 0.5, 0.5
LEAST_WEIGHT = 0.4
DEEPEST = 512


class Path:
    """A root-to-leaf tag path of a page. Each is one object: a tree of steps, however deep, costs a step a path."""

    __slots__ = ("name", "parent", "weight", "hidden", "article", "steps")

    def __init__(self, name: str, parent: "Path | None", weight: float, hidden: bool):
        self.name, self.parent, self.weight, self.hidden, self.steps = name, parent, weight, hidden, {}
        self.article = name in ("article", "main") or (parent is not None and parent.article)

    def step(self, name: str, attributes: str) -> "Path":
        hidden, weight, mark = self.hidden or name in HIDDEN, 1.0, ""
        if attributes and not hidden:
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and UNSEEN.search(value)):
                    hidden = True
                elif key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
                    weight = min(weight, FURNITURE_WEIGHT if FURNITURE.search(value) else DOUBTFUL_WEIGHT if DOUBTFUL.search(value) else 1.0)
                    if key == "class" and name in CONTAINERS:
                        mark = value[:40]
        weight = min(weight, BOILERPLATE.get(name, 1.0))
        if name == "header":
            weight = min(weight, 1.0 if self.article else HEADER_WEIGHT)
        if (name in TRANSPARENT or name in FORMATTING or name == "a" or (name == "header" and self.article)) and not hidden and weight == 1.0:
            return self
        key = (name, mark, weight, hidden)
        if key not in self.steps:
            self.steps[key] = Path(name, self, min(weight, self.weight), hidden)
        return self.steps[key]


def distance(p: Path, q: Path) -> int:
    """Steps between two paths in the tag tree, 3 for all that are farther."""
    if p is q:
        return 0
    if p.parent is q or q.parent is p:
        return 1
    if p.parent is q.parent or (p.parent and p.parent.parent is q) or (q.parent and q.parent.parent is p):
        return 2
    return 3


class Block:
    """Text between two block boundaries, and its group: its path and the container that holds it."""

    __slots__ = ("texts", "path", "group", "chars", "linked", "marks")

    def __init__(self, path: Path, holder: "Around | None"):
        self.texts, self.path, self.group, self.chars, self.linked, self.marks = [], path, (path, holder), 0, 0, 0


class Around:
    """An open container: a linked list towards the root, so that depth costs nothing a block."""

    __slots__ = ("name", "above")

    def __init__(self, name: str, above: "Around | None"):
        self.name, self.above = name, above


def blocks_of(page: str) -> list[Block]:
    """The page's visible blocks of text in order."""
    root = Path("", None, 1.0, False)
    stack: list[tuple[str, Path, Around | None]] = []  # name, path, the container that holds what is in the element
    opened: Counter = Counter()
    found: list[Block] = []
    fresh, at = True, 0

    def text(a: int, b: int) -> None:
        nonlocal fresh
        path = stack[-1][1] if stack else root
        if a >= b or path.hidden:
            return
        piece = page[a:b]
        if fresh or not found:
            holder = stack[-1][2] if stack else None
            if holder is not None and stack[-1][0] in CONTAINERS:
                holder = holder.above  # text that lies in a container itself is a block of what holds the container
            found.append(Block(path, holder))
            fresh = False
        own = found[-1]
        own.texts.append(piece)
        n = len(piece.strip())
        own.chars += n
        own.linked += n if opened["a"] else 0
        own.marks += len(PUNCTUATION.findall(piece))

    def close_to(i: int) -> None:
        nonlocal fresh
        fresh |= any(s[0] in BLOCK for s in stack[i:])
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]

    def push(name: str, attributes: str) -> None:
        if len(stack) < DEEPEST:
            path, holder = (stack[-1][1], stack[-1][2]) if stack else (root, None)
            opened[name] += 1
            stack.append((name, path.step(name, attributes), Around(name, holder) if name in CONTAINERS else holder))

    pos = 0
    while m := TOKEN.search(page, pos):
        text(at, m.start())
        at = pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3)
            continue
        fresh |= name in BLOCK
        if m[1]:
            if opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close_to(i)
                        break
                    if name not in SCOPES and stack[i][0] in SCOPES:
                        break
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    again = [s[0] for s in stack[i + 1 :] if s[0] in FORMATTING]
                    close_to(i)
                    for n in again:
                        push(n, "")
                    break
                if stack[i][0] in SCOPES:
                    break
        if (ends := ENDS.get(name)) and any(opened[e] for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close_to(i)
                elif stack[i][0] in SCOPES:
                    break
        push(name, m[3] or "")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
            pos = at = end.start() if end else len(page)
    text(at, len(page))
    return [b for b in found if b.chars]


def ratio(blocks: list[Block]) -> float:
    """Text length and punctuation a block, each up to its full value."""
    n = len(blocks)
    return min(1.0, sum(b.chars for b in blocks) / n / FULL_LENGTH) * (0.2 + min(1.0, sum(b.marks for b in blocks) / n / FULL_MARKS)) / 1.2


def path_scores(blocks: list[Block]) -> dict[tuple, float]:
    """The score of each tag path in each container."""
    paths, groups = defaultdict(list), defaultdict(list)
    for b in blocks:
        paths[b.path].append(b)
        groups[b.group].append(b)
    of_path = {p: ratio(own) for p, own in paths.items()}
    most = max((sum(b.chars - b.linked for b in own) for own in groups.values()), default=0) or 1
    of_group = {g: (of_path[g[0]] * ratio(own)) ** 0.5 for g, own in groups.items()}
    fused = [of_group[b.group] for b in blocks]
    smoothed = defaultdict(float)
    for i, b in enumerate(blocks):
        total = weights = 0.0
        for j in range(max(0, i - AROUND), min(len(blocks), i + AROUND + 1)):
            d = distance(b.path, blocks[j].path)
            if d < len(NEAR):
                total += NEAR[d] * fused[j]
                weights += NEAR[d]
        smoothed[b.group] += total / weights
    scores = {}
    for g, own in groups.items():
        outside = 1 - sum(b.linked for b in own) / sum(b.chars for b in own)
        # A path with much of the page's text counts for more than one with a line of it.
        part = sum(b.chars - b.linked for b in own) / most
        scores[g] = smoothed[g] / len(own) * outside**2 * g[0].weight * part**SHARE
    return scores


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of the paths over the threshold, and the short blocks that join them."""
    scores = path_scores(blocks)
    best = max(scores.values(), default=0.0)
    if not best:
        return []
    chosen = {g for g, v in scores.items() if v >= THRESHOLD * best}
    # Of each container, its own text: all that could be content, and what is.
    able = [b.path.weight >= LEAST_WEIGHT and 2 * b.linked <= b.chars for b in blocks]
    whole, taken = Counter(), Counter()
    for b, fit in zip(blocks, able, strict=True):
        if fit and (holder := b.group[1]):
            whole[holder] += b.chars
            taken[holder] += b.chars * (b.group in chosen)
    homes = {h for h in taken if taken[h] >= MOSTLY * whole[h] and taken[h]}

    def joins(b: Block) -> bool:
        holder, inner = b.group[1], True
        for _ in range(3):  # a list or a quotation may lie in an element or two of its own
            if holder is None:
                return False
            if holder in homes and (inner or holder.name not in ("html", "body")):
                return b.path.name in SHORT or holder.name not in ("html", "body")
            holder, inner = holder.above, False
        return False

    kept = [b.group in chosen or (fit and joins(b)) for b, fit in zip(blocks, able, strict=True)]
    first = kept.index(True)
    if not any(k and b.path.name == "h1" for k, b in zip(kept, blocks, strict=True)):
        # A title that stands alone before the content.
        for i in range(first - 1, -1, -1):
            if blocks[i].path.name == "h1" and able[i]:
                kept[i] = True
                break
    return [b for b, k in zip(blocks, kept, strict=True) if k]


def clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def extract(page: str) -> str:
    return " ".join(t for b in content(blocks_of(page)) if (t := clean("".join(b.texts))))


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """`df` with `out_col`: the main text of the page in `html_col`."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(p) if p else "" for p in values(pages)], pa.string())

    return df.withColumn(out_col, run(F.col(html_col)))
