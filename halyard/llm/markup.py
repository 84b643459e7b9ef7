"""Tags of an HTML page in one pass, after the rules of HTML: a quote opens a value only behind ``=``.

Time is linear in the page's length whatever it holds. Defined cases: a comment without end reaches to the page's end, and so do
a script and a style; any other raw element without end is its start tag only; a page that ends inside a tag loses what
stands from that tag's ``<`` on; ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text; of an attribute that is given twice, the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_VALUE = r"(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))"
_ATTRIBUTE = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+{value})?+"
_PLAIN = _ATTRIBUTE.replace("{value}", re.sub(r"\((?!\?)", "(?:", _VALUE))
_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|" + _PLAIN + r")*+)>")
_ATTR = re.compile("(" + _ATTRIBUTE.replace("*+(?:[", "*+)(?:[", 1).replace("{value}", _VALUE))
RAW = frozenset("script style noscript template iframe svg textarea select title".split())
_CLOSE = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*+>?", re.I) for name in RAW}


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) in order; the name is '' for what has no meaning here: comments, declarations and raw
    elements with their content. What stands between two of these is text.
    """
    at, size = 0, len(html)
    unclosed: set[str] = set()
    while (start := html.find("<", at)) >= 0:
        if m := _TAG.match(html, start):
            name, closing, at = m[2].lower(), bool(m[1]), m.end()
            if name in RAW and not closing and name not in unclosed:
                if found := _CLOSE[name].search(html, at):
                    name, at = "", found.end()
                elif name in ("script", "style"):
                    name, at = "", size
                else:
                    unclosed.add(name)
            yield start, at, "" if name in RAW else name, closing, m[3]
            continue
        after = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            found = html.find("-->", start + 2)
            end = found + 3 if found >= 0 else size
        elif after and (after in "!?" or (after == "/" and not html[start + 2 : start + 3].isalpha())):
            found = html.find(">", start)
            end = found + 1 if found >= 0 else size
        elif after == "/" or (after.isascii() and after.isalpha()):
            end = size
        else:
            at = start + 1
            continue
        at = end
        yield start, end, "", False, ""


def attributes(text: str) -> dict[str, str]:
    """Lower-cased names and decoded values of a tag's attributes."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = next((x for x in m.groups()[1:] if x is not None), "")
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out
