"""A small tolerant HTML tree: block elements and the text runs between their boundaries."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML element classes (WHATWG HTML living standard).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr "
              # MathML: formulas are part of the sentence around them
              "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms "
              "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics").split())
HIDDEN = frozenset("head iframe noscript object script style svg template textarea title".split())
# A formula's source in another notation; inside math only.
ANNOTATION = frozenset(("annotation", "annotation-xml"))
# What may stand in a head; any other element, or text, ends one that was not closed.
IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())
# An opening tag closes an open element of these kinds (optional end tags).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th"),
          "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"                                                      # comment
    r"|<(?P<raw>script|style|textarea|title|iframe|noscript)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ANY_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAY_HIDE = re.compile(r"hidden|none", re.I)
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?")
ATTRIBUTE_TOKEN = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TITLE_TAGS = re.compile(r"^<[^>]*>|</title\s*>$", re.I)
WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """A block element, or (with ``tag`` '#text') a run of inline text."""
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: str = ""
    link_chars: int = 0
    children: list[int] = field(default_factory=list)


def attribute_tokens(attrs: str) -> tuple[str, ...]:
    found = []
    for m in ATTRIBUTE.finditer(attrs):
        value = CAMEL.sub(" ", m[2] or m[3] or m[4] or "")
        found += ATTRIBUTE_TOKEN.findall(value.lower())
    return tuple(found)


def hides_itself(attrs: str) -> bool:
    """Whether an element's attributes hide it: ``hidden``, ``aria-hidden`` or its style's ``display``."""
    if not MAY_HIDE.search(attrs):
        return False
    values: dict[str, str] = {}
    for m in ANY_ATTRIBUTE.finditer(attrs):  # of a repeated attribute the first counts
        values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip().lower())
    if values.get("hidden", "until-found") != "until-found" or values.get("aria-hidden") == "true":
        return True
    shown = DISPLAY.findall(STYLE_COMMENT.sub("", values.get("style", "")))
    return bool(shown) and ([d for d, important in shown if important] or [d for d, _ in shown])[-1] == "none"


def parse(source: str) -> list[Node]:
    """Nodes in page order; node 0 is the page, its text the title.  Hidden elements and comments leave nothing."""
    nodes = [Node("#page", -1, 0)]
    # open elements: name, number of the block node (-1: inline), whether hidden
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
    block, links, hidden = 0, 0, 0
    pending: list[str] = []
    pending_links = 0

    def flush() -> None:
        nonlocal pending, pending_links
        if pending:
            text = WHITE.sub(" ", html.unescape("".join(pending))).strip()
            if text:
                nodes[block].children.append(len(nodes))
                nodes.append(Node("#text", block, nodes[block].depth + 1, (), text, min(pending_links, len(text))))
            pending, pending_links = [], 0

    def pop_to(position: int) -> None:
        nonlocal block, links, hidden
        if any(n >= 0 for _, n, _ in stack[position:]):
            flush()
        for name, _, hides in stack[position:]:
            links -= name == "a"
            hidden -= hides
        del stack[position:]
        block = next(n for _, n, _ in reversed(stack) if n >= 0)

    def innermost(names, stop=()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                break
        return 0

    def add(piece: str) -> None:
        nonlocal pending_links
        if hidden and stack[-1][0] == "head" and not piece.isspace():
            pop_to(len(stack) - 1)
        if not hidden:
            pending.append(piece)
            if links:
                pending_links += len(piece)

    at = 0
    for m in MARKUP.finditer(source):
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() == "title" and not nodes[0].text:
                nodes[0].text = WHITE.sub(" ", html.unescape(TITLE_TAGS.sub("", m[0]))).strip()
            continue
        if m["end"]:
            i = innermost((tag,))
            if i:
                pop_to(i)
            elif tag == "p" or tag == "br":
                flush() if tag == "p" else pending.append(" ")
            continue
        attrs = m["attrs"]
        if hidden and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in ANNOTATION and innermost(("math",)):
            if not attrs.endswith("/"):
                hidden += 1
                stack.append((tag, -1, True))
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                pending.append(" " if tag == "br" else "")
            else:
                if tag == "a" and (i := innermost(("a",))):
                    pop_to(i)
                links += tag == "a"
                stack.append((tag, -1, False))
            continue
        if i := innermost(("p",), ("button", "td", "th", "li", "div", "article", "section")):
            pop_to(i)
        if tag in CLOSES and (i := innermost(CLOSES[tag], SCOPES.get(tag, ("table",)))):
            pop_to(i)
        flush()
        if tag in VOID or attrs.endswith("/") and tag in ("hr", "p", "div"):
            continue
        if tag == "body" and hidden:  # what was left open in the head ends here
            pop_to(1)
        # pages that hide their root show it by script
        hides = tag in HIDDEN or bool(attrs) and tag not in ("html", "body") and hides_itself(attrs)
        hidden += hides
        nodes[block].children.append(len(nodes))
        nodes.append(Node(tag, block, nodes[block].depth + 1, attribute_tokens(attrs) if attrs else ()))
        block = len(nodes) - 1
        stack.append((tag, block, hides))
    if at < len(source):
        add(source[at:])
    flush()
    return nodes
