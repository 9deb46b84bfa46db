"""From HTML to text: a scanner over tags, and rules for blocks and links. Linear in the page, whatever it holds."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose boundaries end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't markup, and those of them whose content isn't shown.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW - {"textarea", "xmp"}

_QUOTE_OR_END = re.compile("[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """The place after a tag whose name ends at `at`: a quoted > doesn't end it; the page's end does."""
    while True:
        found = _QUOTE_OR_END.search(page, at)
        if not found:
            return len(page)
        if found[0] == ">":
            return found.end()
        close = page.find(found[0], found.end())
        if close < 0:
            return len(page)
        at = close + 1


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", as written), ("open", name), ("close", name) and ("raw", content of the raw element opened before)."""
    at, start = 0, 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        closing = after == "/"
        if closing:
            after = page[at + 2 : at + 3]
        if after.isascii() and after.isalpha():
            kind = "close" if closing else "open"
        elif after and (closing or after in "!?"):
            kind = "none"  # a comment, a declaration or something taken for a comment
        else:
            at += 1
            continue
        if start < at:
            yield "text", page[start:at]
        if kind == "none":
            long = page.startswith("<!--", at)
            close = page.find("-->" if long else ">", at + (4 if long else 2))
            start = at = len(page) if close < 0 else close + (3 if long else 1)
            continue
        first = at + 1 + closing
        name_end = _NAME_END.search(page, first)
        name = page[first : name_end.start() if name_end else len(page)].lower()
        start = at = _tag_end(page, name_end.start()) if name_end else len(page)
        yield kind, name
        if kind == "open" and name in RAW:
            close = _CLOSE[name].search(page, at)
            end = close.start() if close else len(page)
            yield "raw", page[at:end]
            start = at = end
    if start < len(page):
        yield "text", page[start:]


def read_page(page: str | None, link_share: float = 0.5) -> dict:
    """Title, text of the kept blocks (one a line), and counts of a page.

    A block is the text between two boundaries of block elements, entities decoded and white space
    made one blank. It is kept if at most `link_share` of its characters belong to links.
    """
    blocks: list[tuple[str, int]] = []
    parts: list[tuple[str, bool]] = []
    title, raw, links, n_links = None, "", 0, 0

    def end_block() -> None:
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            in_links = sum(len("".join(p.split())) for p, linked in parts if linked)
            blocks.append((text, in_links))
        parts.clear()

    for kind, value in tokens(page or ""):
        if kind == "text":
            parts.append((html.unescape(value), links > 0))
        elif kind == "raw":
            shown = html.unescape(value) if raw in ("title", "textarea") else value
            if raw == "title" and title is None:
                title = " ".join(shown.split())
            if raw not in HIDDEN:
                parts.append((shown, links > 0))
        else:
            if value in BLOCKS:
                end_block()
            elif value == "br":
                parts.append((" ", False))
            if value == "a":
                links = 1 if kind == "open" else 0
                n_links += kind == "open"
            raw = value if kind == "open" else ""
    end_block()
    letters = [len(text.replace(" ", "")) for text, _ in blocks]
    kept = [text for (text, linked), size in zip(blocks, letters, strict=True) if linked <= link_share * size]
    return {
        "title": title,
        "text": "\n".join(kept),
        "n_blocks": len(blocks),
        "n_kept": len(kept),
        "n_links": n_links,
        "chars": sum(letters),
        "link_chars": sum(linked for _, linked in blocks),
    }
