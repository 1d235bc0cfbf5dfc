"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 3).

A page is read into leaf blocks: runs of text between block-level tags, with the tags and class words above them. Each
block is main text or not; its features are the tags and words of its ancestors and the form of its text, and neighbours
are coupled. The field is trained on labelled pages (module `labelled_pages`) by maximum likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches, table
from factorspark.llm.labelled_pages import MARK, labelled_pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^>]*+)?)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
# Names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
SECTION = frozenset("article aside footer form header main nav section table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("button script style textarea title noscript template iframe svg select object xmp noembed noframes".split())
#: What of these holds no markup that counts.
NO_MARKUP = frozenset("script style textarea title template iframe xmp noembed noframes".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}


@dataclass
class Block:
    """A leaf block: its text, how many characters of it are links, and the elements above it."""

    text: str
    linked: int
    tags: tuple[str, ...]
    words: frozenset[str]
    label: int = 0


@dataclass
class _Open:
    tag: str
    words: frozenset[str] = field(default_factory=frozenset)
    main: bool = False


def start_tags(page: str, wanted: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(name, attributes) of the start tags with these names, in order, but not of those in comments, scripts, templates and the like,
    nor in the attributes of others."""
    at, unended = 0, set()
    last = page.rfind(">")
    while at <= last and (m := _TOKEN.search(page, at)):
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[1]:
            continue
        if tag in wanted:
            yield tag, m[3] or ""
        if tag in NO_MARKUP and not m[3].endswith("/") and tag not in unended:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif tag == "script":
                return
            else:
                unended.add(tag)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; character references decoded, white space joined. Unclosed and stray tags are mended
    the usual way: a paragraph ends where a block begins, an end tag closes what is open inside its element, the head ends at what
    cannot stand in it, and what is not shown is left out up to its end tag (without one, only a script runs to the end)."""
    stack: list[_Open] = []
    out: list[Block] = []
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)
    unended: set[str] = set()  # no end tag of these is ahead
    last = max(page.rfind(">"), page.rfind("<!--"))  # no markup begins after these

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = frozenset().union(*(o.words for o in stack)) if stack else frozenset()
                out.append(Block(text, linked, tuple(o.tag for o in stack if o.tag != MARK), words, int(any(o.main for o in stack))))
            parts.clear()
        linked = 0

    def close(tags, bounds=()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in bounds:
                return

    def text(raw: str):
        nonlocal linked
        if raw:
            if raw.strip(" \t\n\f\r"):
                close(("head",))
            decoded = html.unescape(raw)
            parts.append(decoded)
            if any(o.tag == "a" for o in stack):
                linked += len(decoded.strip())

    while at < end:
        m = _TOKEN.search(page, at) if at <= last else None
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag == MARK:
                flush()
            close((tag,), () if tag not in ("p", "li") else ("article", "main", "body"))
            continue
        if tag not in IN_HEAD:
            close(("head",))
        if tag in RAW:
            if not m[3].endswith("/") and tag not in unended:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag == "script":
                    at = end
                else:
                    unended.add(tag)
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            close(("p",), ("article", "main", "body", "div", "section", "td", "li", "blockquote"))
            if tag in _CLOSES:
                close(*_CLOSES[tag])
        if tag in VOID:
            parts.append(" ")
            continue
        if m[3].endswith("/"):
            continue
        words, main = set(), False
        for name, *values in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            if name.lower() == MARK:
                main = True
            else:
                words.update(_WORDS.findall("".join(values).lower()))
        stack.append(_Open(tag, frozenset(words), main))
    flush()
    return out


def features(block: Block) -> list[str]:
    n, words = len(block.text), block.text.count(" ") + 1
    density = 4 * block.linked // n if block.linked else -1
    out = [f"in:{t}" for t in set(block.tags)] + [f"word:{w}" for w in block.words]
    last = next((t for t in reversed(block.tags) if t in BLOCK), "")
    section = next((t for t in reversed(block.tags) if t in SECTION), "")
    out += [f"tag:{last}", f"place:{section}/{last}", f"length:{min(8, n.bit_length())}", f"words:{min(6, words.bit_length())}", f"links:{density}"]
    out += [f"ends:{'stop' if block.text[-1] in '.!?…:;' else 'open'}", f"commas:{min(2, block.text.count(','))}"]
    if "©" in block.text or "(c)" in block.text:
        out.append("copyright")
    if len(block.tags) < 3:
        out.append("shallow")
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the features, label 1 against 0, and log-potentials of neighbouring labels and of the first."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]


def train(pages: list[str], epochs: int = 150, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by forward-backward over all pages at once and Adam. Deterministic."""
    rows = [b for p in pages if (b := leaf_blocks(p))]
    names = sorted({f for blocks in rows for b in blocks for f in features(b)})
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(rows), max(map(len, rows))
    x, y, mask = np.zeros((n, longest, len(names)), "float32"), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, blocks in enumerate(rows):
        for j, b in enumerate(blocks):
            x[i, j, [index[f] for f in features(b)]] = 1
            y[i, j], mask[i, j] = b.label, True
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows_at = np.arange(n)
    for epoch in range(1, epochs + 1):
        w, steps, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        unary = np.zeros((n, longest, 2))
        unary[:, :, 1] = x @ w
        unary[:, 0] += first
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(alpha[:, t - 1, :, None] + steps, axis=1) + unary[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = np.logaddexp.reduce(steps + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
        norm = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - norm[:, None, None]) * mask[:, :, None]
        edge = np.zeros((2, 2))
        for t in range(1, longest):
            both = alpha[:, t - 1, :, None] + steps + (unary[:, t] + beta[:, t])[:, None, :] - norm[:, None, None]
            edge += (np.exp(both) * mask[:, t, None, None]).sum(axis=0)
            np.subtract.at(edge, (y[mask[:, t], t - 1], y[mask[:, t], t]), 1)
        start = node[:, 0].sum(axis=0) - np.bincount(y[rows_at, 0], minlength=2)
        grad = np.concatenate((np.einsum("ij,ijk->k", node[:, :, 1] - y * mask, x), edge.ravel(), start)) / n + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    steps = tuple(map(tuple, theta[-6:-2].reshape(2, 2).tolist()))
    return Field(dict(zip(names, theta[:-6].tolist())), steps, tuple(theta[-2:].tolist()))


def viterbi(model: Field, blocks: list[Block]) -> list[int]:
    """The likeliest labels."""
    if not blocks:
        return []
    get, ((s00, s01), (s10, s11)) = model.weights.get, model.steps
    back: list[tuple[int, int]] = []
    zero, one = model.first
    for i, b in enumerate(blocks):
        own = sum(get(f, 0.0) for f in features(b))
        if i:
            to0, to1 = (zero + s00, one + s10), (zero + s01, one + s11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            zero, one = max(to0), max(to1)
        one += own
    label = int(one > zero)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def main_text(model: Field, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(model, blocks)) if y)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of the whole page, blocks joined by an empty line.

    Null and empty html, and pages without main text, give the empty text. White space, as Unicode has it, is joined within a
    block. Rows are independent: repeated ones give repeated results; other columns are not read.
    """
    small_batches(pages.sparkSession)
    model = model or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, p) for p in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The main text of all `pages`."""
    return extract(table(spark, sf_dir, "pages"))
