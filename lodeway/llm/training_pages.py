"""Labelled pages that the block model of HTML extraction is fitted on, drawn from a few layouts.

A page mixes parts with and without telling markup: semantic elements, named
divisions, bare divisions and layout tables. Prose is made of random words, so
the model learns nothing about any corpus.
"""

from __future__ import annotations

import random

#: Pages that are drawn: one half for the weights, the other for the smoothness.
PAGES = 600
_NAMES = {
    "menu": "navbar menu top-nav breadcrumbs", "side": "sidebar widget related", "notice": "cookie-notice consent popup newsletter",
    "advert": "ad advert sponsored promo", "comments": "comments reply-list discussion", "foot": "footer copyright legal", "content": "content post entry article-text story",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_ROLES = {"menu": "navigation", "side": "complementary", "notice": "dialog", "foot": "contentinfo", "content": "main"}
_WORDING = ("© All rights reserved", "Privacy policy", "Read more", "Subscribe to our newsletter", "Share this", "Log in", "Advertisement", "We use cookies")


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("aeioulnrstmdkp") for _ in range(r.randint(2, 9))) for _ in range(n))


def page(seed: int) -> tuple[str, set[str]]:
    """Html, and the texts of its content blocks."""
    r = random.Random(seed)
    layout, content = r.choice(["semantic", "named", "bare", "table"]), set()

    def prose(low: int, high: int) -> str:
        n = round(low * (high / low) ** r.random())
        said = r.choice(_WORDING) + " " if r.random() < 0.06 else ""  # any text may speak of such things
        return (said + _words(r, n)).capitalize() + "."

    def kept(text: str) -> str:
        content.add(text)
        return text

    def body() -> str:
        out = [f"<h1>{kept(prose(2, 12))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(2, 14)):
            kind = r.random()
            if kind < 0.7:
                text, at = kept(prose(3, 120)), 0
                if r.random() < 0.2:
                    at = text.find(" ", len(text) // 3)
                out.append(f"<p>{text[:at]}<a href=x>{text[at:at + 9]}</a>{text[at + 9:]}</p>" if at > 0 else f"<p>{text}</p>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{kept(prose(1, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<blockquote>{kept(prose(4, 50))}</blockquote>")
            elif kind < 0.92:
                out.append(f"<h2>{kept(prose(1, 8))}</h2>")
            elif kind < 0.96 or layout in ("bare", "table"):
                out.append(f"<div>{kept(prose(1, 60))}</div>")
            else:  # parts that are not the article's stand inside it, too
                name = r.choice(["advert", "notice", "side", "comments"])
                out.append(r.choice([f"<form><label>{_words(r, 1)}</label></form>", f"<aside><p>{prose(1, 20)}</p></aside>", f"<div class='{r.choice(_NAMES[name])}'>{prose(1, 20)}</div>"]))
        return "".join(out)

    def links(n: int) -> str:
        items = [f"<a href='/{i}'>{_words(r, r.randint(1, 3)).title()}</a>" for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else "".join(f"<div>{x}</div>" for x in items)

    def small() -> str:
        return r.choice(_WORDING) + " " + _words(r, r.randint(0, 8)) if r.random() < 0.5 else prose(2, 18)

    def part(kind: str, inner: str) -> str:
        semantic = {"menu": "nav", "side": "aside", "foot": "footer", "content": r.choice(["article", "main"])}
        if layout == "semantic" and kind in semantic:
            return f"<{semantic[kind]}>{inner}</{semantic[kind]}>"
        told = r.random()
        if layout == "named" and told < 0.15 and kind in _ROLES:
            return f"<div role='{_ROLES[kind]}'>{inner}</div>"
        if layout == "named" and told < 0.25 and kind == "content":
            return f"<div itemprop='articleBody'>{inner}</div>"
        if layout in ("semantic", "named") or layout == "table" and told < 0.3:
            return f"<div {r.choice(['class', 'id'])}='{r.choice(_NAMES[kind])}'>{inner}</div>"
        return f"<td>{inner}</td>" if layout == "table" else f"<div>{inner}</div>"

    parts = []
    if r.random() < 0.5:
        parts.append(f"<header><div>{_words(r, 2)}</div></header>" if layout == "semantic" else f"<div><a href=/>{_words(r, 2)}</a></div>")
    parts.append(part("menu", links(r.randint(2, 8))))
    if layout in ("semantic", "named"):  # without any name, prose of others is not told from the page's own
        if r.random() < 0.5:
            parts.append(part("notice", f"<p>{small()}</p>"))
        if r.random() < 0.5:
            parts.append(part("advert", small()))
    if r.random() < 0.15:
        parts.append(f"<div {r.choice(['hidden', 'aria-hidden=true', 'style=display:none'])}><p>{prose(2, 60)}</p></div>")
    parts.append(part("content", body()))
    if r.random() < 0.5:
        parts.append(part("side", f"<h3>{_words(r, 2)}</h3>" + links(r.randint(2, 6))))
    if layout in ("semantic", "named") and r.random() < 0.5:
        parts.append(part("comments", "".join(f"<div><p>{prose(3, 60)}</p></div>" for _ in range(r.randint(1, 6)))))
    if r.random() < 0.3:
        parts.append(f"<form><label>{_words(r, 2)}</label><p>{small()}</p></form>")
    parts.append(part("foot", f"<p>{r.choice(_WORDING)} {_words(r, 3)}</p>" + (links(3) if r.random() < 0.4 else "")))
    inner = "".join(parts)
    return f"<html><body>{'<table><tr>' + inner + '</tr></table>' if layout == 'table' else inner}</body></html>", content
