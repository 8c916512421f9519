"""Leaf text blocks of an HTML page, with the elements around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Element names that matter to how a page is cut into blocks (fixed values of the HTML standard).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br img input wbr".split())
UNSEEN = frozenset("head iframe math noembed noframes noscript object script select style svg template textarea title".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: An element that starts ends an open one of these, unless one of the others is open inside it.
ENDS = {
    "li": (("li",), ("ol", "ul", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
NAMED = frozenset(["class", "id", "role", "data-label"])


@dataclass(frozen=True)
class Block:
    """A run of text between the borders of block elements. ``path`` has the elements around it, outermost first."""

    text: str
    path: tuple[tuple[str, str], ...]  # element name; its class, id and role
    linked: int  # characters inside links
    bold: int  # characters inside b, strong, em, i or code
    label: str | None = None  # data-label of the nearest element that has one


def tag_end(page: str, at: int) -> int:
    """Where the tag that starts at ``at`` ends: at a ``>`` outside quotes; at the first one if a quote is not closed. -1: nowhere."""
    first = end = page.find(">", at)
    while end >= 0:
        double, single = page.find('"', at, end), page.find("'", at, end)
        if double < 0 and single < 0:
            return end
        quote = min(q for q in (double, single) if q >= 0)
        close = page.find(page[quote], quote + 1)
        if close < 0:
            return first
        at = close + 1
        if at > end:
            end = page.find(">", at)
    return first


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order; comments, markup and unseen elements have no text.

    Character references are decoded, white space becomes one space, blocks without
    other text are left out. Elements that are not closed end with the one around them.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, str | None]] = []
    texts: list[str] = []
    count: dict[str, int] = {}
    linked = bold = 0

    def flush() -> None:
        nonlocal linked, bold
        if texts:
            joined = "".join(texts)
            text = " ".join(html.unescape(joined).split()) if "&" in joined else " ".join(joined.split())
            if text:
                label = next((x[2] for x in reversed(stack) if x[2]), None)
                out.append(Block(text, tuple((n, a) for n, a, _ in stack), linked, bold, label))
            texts.clear()
        linked = bold = 0

    def close(depth: int) -> None:
        if any(n in BLOCK for n, _, _ in stack[depth:]):
            flush()
        for n, _, _ in stack[depth:]:
            count[n] -= 1
        del stack[depth:]

    def add(text: str) -> None:
        nonlocal linked, bold
        if any(count.get(n) for n in UNSEEN):
            return
        texts.append(text)
        if count.get("a"):
            linked += len(text)
        elif any(count.get(n) for n in ("b", "strong", "em", "i", "code")):
            bold += len(text)

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if after in ("!", "?"):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        closing = after == "/"
        name = NAME.match(page, start + 1 + closing)
        if name is None:  # no tag: a sign in the text
            add("<")
            at = start + 1
            continue
        end = tag_end(page, name.end())
        if end < 0:  # a page that breaks off inside a tag
            break
        tag, at = name.group().lower(), end + 1
        if closing:
            if count.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                # an inline element does not end the block elements inside it
                if tag in BLOCK or tag in UNSEEN or not any(n in BLOCK for n, _, _ in stack[depth + 1 :]):
                    close(depth)
            continue
        if tag in SPACE:
            add(" ")
        if tag in BLOCK:
            if count.get("p"):  # a paragraph holds no block
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
                if depth >= 0 and stack[depth][0] == "p":
                    close(depth)
            flush()
        if tag in ENDS:
            ended, kept = ENDS[tag]
            if any(count.get(n) for n in ended):
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ended or stack[k][0] in kept), -1)
                if depth >= 0 and stack[depth][0] in ended:
                    close(depth)
        if tag in VOID:
            continue
        names, label = "", None
        if end > name.end():
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(page, name.end(), end) if k.lower() in NAMED}
            label = found.pop("data-label", None)
            names = " ".join(found.values()).lower()
        if tag in RAW:
            over = RAW_END[tag].search(page, at)
            at = over.start() if over else size
        if tag in ("html", "body") and count.get(tag):
            continue
        stack.append((tag, names, label))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out
