"""Pages as trees of blocks: elements that start a block, and runs of text between two block edges.

Follows how browsers read markup where it matters for text: end tags that may be left out, raw text of
scripts, comments, character references, unclosed and stray tags. Never fails; what a broken tag swallows at
the end of a page is lost as in a browser. Every step is linear in the page, and nothing recurses.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# --- fixed values: element names of HTML and how they nest ---------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math object".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd map mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements that a start tag of the key ends when one is open, and those beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: These start a node but do not end a paragraph.
PHRASES = set("button select option optgroup label audio video canvas output meter progress picture".split())
HEAD = set("head meta link base title style script noscript template".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag of another block does not reach beyond these.
WALLS = {"td", "th", "caption", "table", "button"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
# --------------------------------------------------------------------------------------------------

#: A comment, a declaration or a tag. Every alternative takes all it can or reaches the end of the page.
MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Nodes in page order; a node's parent comes before it. A run of text has the tag ``#text``."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    main: list[str | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, names=(), text="", linked=0, main=None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.main.append(main)
        return len(self.tag) - 1


def attributes(raw: str) -> tuple[tuple[str, ...], str | None]:
    """The words of an element's class, id and role, and the mark of labelled pages."""
    words: list[str] = []
    main = None
    for name, *values in NAMED.findall(raw):
        name, value = name.lower(), "".join(values)
        if name == "data-main":
            main = value
        elif name == "style":
            words += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name in ("hidden", "aria-hidden"):
            words += ["hidden"] if value.lower() != "false" else []
        else:
            words += [w.lower() for w in PIECES.findall(html.unescape(value))]
    return tuple(dict.fromkeys(words)), main


def parsed(page: str | None) -> Tree:
    page = page or ""
    tree = Tree()
    tree.add(-1, "#page")
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones have the node of their block
    opened: dict[str, int] = {}  # how many elements of a name are open
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            tree.add(stack[-1][1], "#text", text=text, linked=min(linked, len(text)))
        run.clear()
        linked = 0

    def cut(depth: int) -> None:
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    def end(names: set[str], walls: set[str]) -> None:
        """Close the innermost open element of ``names`` with all inside it, unless a wall is nearer."""
        if not any(opened.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth][0]
            if name in names:
                cut(depth)
                return
            if name in walls:
                return

    def write(text: str) -> None:
        nonlocal linked
        if text:
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if opened.get("a"):
                linked += len(" ".join(text.split()))

    at = 0
    while True:
        mark = page.find("<", at)
        found = MARK.match(page, mark) if mark >= 0 else None
        if mark < 0:
            write(page[at:])
            break
        if found is None:  # a plain "<"
            write(page[at : mark + 1])
            at = mark + 1
            continue
        write(page[at:mark])
        at = found.end()
        slash, name, raw = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            if name in INLINE or ":" in name:
                if opened.get(name):
                    # Blocks that were opened inside stay open.
                    depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name)
                    opened[name] -= 1
                    del stack[depth]
                run.extend(" " if name == "br" else "")
            else:
                flush()
                end(HEADINGS if name in HEADINGS else {name}, set() if name in TABLE else WALLS)
            continue
        if name in RAW:
            if name in ("svg", "math", "object", "template"):
                close = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+>?", re.I)
                depth, last = (0 if raw.endswith("/") else 1), at
                while depth and (found := close.search(page, last)):
                    depth += -1 if found.group(1) else 0 if found.group().endswith("/>") else 1
                    last = found.end()
                at = last if not depth else len(page)
            else:
                found = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                at = found.end() if found else len(page)
            run.append(" ")
            continue
        if name in INLINE or ":" in name:
            if name == "br":
                run.append(" ")
            elif name not in VOID:
                if name == "a" and opened.get("a"):  # links do not nest
                    depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "a")
                    opened["a"] -= 1
                    del stack[depth]
                stack.append((name, stack[-1][1]))
                opened[name] = opened.get(name, 0) + 1
            continue
        flush()
        if name in VOID or name in ("html", "frameset"):
            continue
        if name == "body" and opened.get("body"):
            continue
        if name not in PHRASES:
            end({"p"}, WALLS)
        if name not in HEAD:
            end({"head"}, set())
        if name in ENDS:
            end(*ENDS[name])
        names, main = attributes(raw) if raw else ((), None)
        stack.append((name, tree.add(stack[-1][1], name, names, main=main)))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return tree
