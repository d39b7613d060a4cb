"""Lines of text of a page, each with the kind of container it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

#: Names of the HTML standard, and words of class and id names, as they are commonly used (fixed values).
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math textarea".split())
HIDDEN = frozenset("head nav footer aside form button select dialog menu".split())
WHOLE = frozenset("article main".split())
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|widget\w*|footer|masthead|cookies?|consent|notice\w*|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|replies|respond|disqus\w*|login|search|skip-link|copyright)(?:$|[\s_-])", re.I)
#: Elements whose end tag may be left out: an open one ends where another of these starts.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

MAIN, PLAIN, BOILER = 2, 1, 0


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it is an end tag, name, attributes) of each tag; comments and declarations have no name.

    What reads a tag takes each character a bounded number of times: after a tag whose quotes never close, quotes
    are read as other characters, and where no > follows, all that is left is text. send() moves on.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        m = NAME.match(page, start)
        if m:
            end = m.end()
            if page.startswith(">", end):
                end += 1
            else:
                end = page.find(">", end) + 1
                if not end:
                    return
                if quotes:
                    whole = REST.match(page, m.end())
                    quotes = bool(whole)
                    end = whole.end() if whole else end
            at = (yield start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]) or end
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            at = (yield start, end, False, "", "") or end
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start) + 1
            if not end:
                return
            at = (yield start, end, False, "", "") or end
        else:
            at = start + 1


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block with text, in page order: MAIN in an article or main element, BOILER in menus, notices and the like, else PLAIN."""
    page = page or ""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = []
    times: Counter = Counter()  # of names in open_
    kind, at = PLAIN, 0

    def close() -> None:
        if not held:
            return
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, kind))
        held.clear()

    found = tags(page)
    tag = next(found, None)
    while tag:
        start, end, closing, name, rest = tag
        if start > at:
            held.append(page[at:start])
        at = end
        if name in RAW and not closing:
            last = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = last.end() if last else len(page)
        elif closing:
            if name in BLOCKS:
                close()
            if times[name]:
                while True:
                    own, kind = open_.pop()
                    times[own] -= 1
                    if own == name:
                        break
        elif name:
            if name in BLOCKS:
                close()
            while open_ and name in ENDED_BY.get(open_[-1][0], ()):
                own, kind = open_.pop()
                times[own] -= 1
            if name not in VOID:
                open_.append((name, kind))
                times[name] += 1
                if kind != BOILER:
                    marks = " ".join(x or y or z for x, y, z in NAMED.findall(rest)) if rest else ""
                    if name in HIDDEN or name == "header" and kind != MAIN or "hidden" in rest.lower().split() or marks and name not in WHOLE | {"body", "html"} and BOILERPLATE.search(marks):
                        close()
                        kind = BOILER
                    elif name in WHOLE:
                        kind = MAIN
        try:
            tag = found.send(at)
        except StopIteration:
            tag = None
    held.append(page[at:])
    close()
    return out
