"""Labelled training pages: layouts written by hand, filled with drawn words.

Elements whose text is main text carry the attribute `data-main`, which the field reads as the label and never as a feature; an
element of that name labels text that has no element of its own.
Layouts cover news, blogs, shops, forums and bare pages (a text and nothing else), with the usual company of an article: menus,
headers, notices, adverts, sidebars, related links, forms, comments and footers, in different tags and classes.
"""

from __future__ import annotations

import random

MARK = "data-main"


def _words(rng: random.Random, low: int, high: int, stop: str = "") -> str:
    words = ["".join(rng.choices("aeinorstlduéß", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
    text = " ".join(w + ("," if rng.random() < 0.08 else "") for w in words)
    return text[:1].upper() + text[1:].rstrip(",") + stop


def _sentences(rng: random.Random, most: int) -> str:
    return " ".join(_words(rng, 3, 18, ".") for _ in range(rng.randint(1, most)))


def _links(rng: random.Random, low: int, high: int) -> list[str]:
    return [f'<a href="/x">{_words(rng, 1, 3)}</a>' for _ in range(rng.randint(low, high))]


def _list(items: list[str]) -> str:
    return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"


def _boilerplate(rng: random.Random, where: str) -> str:
    say = lambda most=2: _sentences(rng, most)
    any_of = lambda text: rng.choice(text.split("|"))
    menu = rng.choice([
        lambda: f'<div class="{any_of("navbar|nav-bar|top-menu|main-nav|topbar|pagination|pager|toc")}">{_list(_links(rng, 3, 8))}</div>',
        lambda: f"<nav>{_list(_links(rng, 3, 8))}</nav>",
        lambda: f'<div class="menu">{_list(_links(rng, 3, 8))}</div>',
        lambda: f'<div id="navigation">{" ".join(_links(rng, 3, 8))}</div>',
        lambda: f'<ul class="breadcrumb">{"".join(f"<li>{x}</li>" for x in _links(rng, 2, 4))}</ul>',
    ])
    head = rng.choice([
        lambda: f"<header><a href='/'>{_words(rng, 1, 3)}</a><p>{_words(rng, 2, 7)}</p></header>",
        lambda: f'<div class="site-header banner"><h2>{_words(rng, 1, 4)}</h2></div>',
        lambda: f'<div class="{any_of("masthead|header|page-header|top-bar|logo")}"><p>{_words(rng, 1, 6)}</p></div>',
    ])
    notice = lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent banner", "cookies", "gdpr", "popup", "modal", "disclaimer", "overlay"])}"><p>{say()}</p><button>{_words(rng, 1, 2)}</button></div>'
    advert = lambda: rng.choice(['<div class="ad">{}</div>', '<div class="ads advert"><p>{}</p></div>', '<aside class="sponsored promo">{}</aside>', '<div id="advertisement">{}</div>', '<div class="adsense"><p>{}</p></div>', '<div class="sponsor-box"><p>{}</p></div>', '<section class="promotion"><p>{}</p></section>']).format(say())  # noqa: E731,E501
    side = rng.choice([
        lambda: f"<aside><h3>{_words(rng, 1, 3)}</h3><p>{say()}</p>{_list(_links(rng, 2, 5))}</aside>",
        lambda: f'<div class="{any_of("rail|right-rail|side-bar|widget-area|secondary|sidebar-box")}"><h4>{_words(rng, 1, 3)}</h4><p>{say()}</p></div>',
        lambda: f'<div class="sidebar widget"><h4>{_words(rng, 1, 3)}</h4>{_list(_links(rng, 2, 6))}<p>{say(1)}</p></div>',
    ])
    related = lambda: f'<div class="{rng.choice(["related", "share", "tags", "recommended", "social", "sharing share-buttons", "more-stories", "read-next", "trending", "popular posts", "author-bio"])}">{_list(_links(rng, 2, 5))}</div>'
    form = lambda: f'<form class="{rng.choice(["newsletter", "subscribe", "search", "login", "signup", "contact"])}"><label>{_words(rng, 1, 4)}</label><p>{say(1)}</p><button>{_words(rng, 1, 1)}</button></form>'  # noqa: E731,E501

    def comments() -> str:
        tag, name = any_of("section|div|ol|ul|aside"), any_of(
            "comments|comment-list|comments-area|replies|responses|discussion|disqus|reader-comments|feedback|reviews|user-comments|thread|conversation"
        )
        item = any_of('div class="comment"|div class="reply"|li|div|div class="response"|article class="comment"|div class="comment-body"|div class="message"')
        who = lambda: rng.choice([f"<b>{_words(rng, 1, 2)}</b>", f"<h4>{_words(rng, 1, 2)}</h4>", ""])
        title = rng.choice(["", f"<h3>{_words(rng, 1, 3)}</h3>"])
        said = "".join(f"<{item}>{who()}<p>{say(4)}</p></{item.split()[0]}>" for _ in range(rng.randint(1, 5)))
        return f'<{tag} {any_of("id|class")}="{name}">{title}{said}</{tag}>'

    foot = rng.choice([
        lambda: f"<footer>&copy; {_words(rng, 1, 3)} &middot; {say(1)}</footer>",
        lambda: f"<footer><p>{say()}</p>{_list(_links(rng, 2, 5))}</footer>",
        lambda: f'<div class="footer" id="foot"><p>&copy; {_words(rng, 2, 8)}</p></div>',
    ])
    before = [(menu, 0.9), (head, 0.5), (notice, 0.3), (advert, 0.5), (form, 0.2), (side, 0.2)]
    after = [(related, 0.4), (comments, 0.4), (form, 0.3), (side, 0.4), (advert, 0.3), (menu, 0.2), (foot, 0.9)]
    inside = [(advert, 0.5), (related, 0.4), (side, 0.2), (comments, 0.15), (form, 0.15)]
    chosen = [make() for make, share in {"before": before, "after": after, "inside": inside}[where] if rng.random() < share]
    if where == "before":
        rng.shuffle(chosen)
    return "".join(chosen)


def _main(rng: random.Random) -> str:
    def mark(tag: str, text: str, close: bool = True) -> str:
        return f"<{tag} {MARK}=1>{text}" + (f"</{tag}>" if close else "")

    parts = [mark("h1", _words(rng, 1, 12, rng.choice(["", "", "."])))] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.62:
            parts.append(mark("p", _sentences(rng, rng.choice([1, 7])), rng.random() < 0.9))
        elif kind < 0.7:
            parts.append(mark("p", f"<b>{_words(rng, 1, 12, rng.choice(['', '.']))}<br>", False))
        elif kind < 0.78:
            parts.append(mark(rng.choice(["h2", "h3"]), _words(rng, 1, 7)))
        elif kind < 0.84:
            parts.append("<ul>" + "".join(mark("li", _words(rng, 2, 14)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.89:
            parts.append(f"<blockquote>{mark('p', _sentences(rng, 3))}</blockquote>")
        elif kind < 0.92:
            parts.append(mark("pre", _words(rng, 4, 20)))
        elif kind < 0.95:
            parts.append("<table><tr>" + "".join(mark("td", _words(rng, 1, 4)) for _ in range(4)) + "</tr></table>")
        else:
            parts.append(mark("p", f'{_words(rng, 3, 9)} <a href="/y">{_words(rng, 1, 3)}</a> {_words(rng, 3, 20, ".")}'))
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), _boilerplate(rng, "inside"))
    return "".join(parts)


def _bare(rng: random.Random) -> str:
    """A page that is its text: in paragraphs, in lines, or as it is."""
    texts = [_sentences(rng, rng.choice([1, 5])) for _ in range(rng.choice([1, 1, 2, 4]))]
    paragraphs = "".join(f"<p {MARK}=1>{t}</p>" for t in texts)
    return rng.choice([
        paragraphs, f"<html><body>{paragraphs}</body></html>", f"<body {MARK}=1>{'<br>'.join(texts)}</body>",
        f"<html><head><title>{_words(rng, 1, 4)}</title></head><body><h1 {MARK}=1>{_words(rng, 1, 5)}</h1>{paragraphs}</body></html>",
        f"<{MARK} {MARK}=1>{texts[0]}</{MARK}>", f"<{MARK} {MARK}=1><b>{texts[0]}</b> {texts[-1]}</{MARK}>", f"<div {MARK}=1>{texts[0]}</div>",
        f"<pre {MARK}=1>{texts[0]}</pre>",
    ])


def labelled_pages(n: int = 480, seed: int = 5) -> list[str]:
    """`n` pages, the same for the same seed."""
    rng, out = random.Random(seed), []
    frames = [
        "<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>',
        '<main id="content">{}</main>', '<div id="main"><div class="entry story">{}</div></div>', '<section class="article-body">{}</section>',
        "<div>{}</div>", '<article class="post">{}</article>',
    ]
    for i in range(n):
        if i % 8 == 0:
            out.append(_bare(rng))
            continue
        body = _boilerplate(rng, "before") + rng.choice(frames).format(_main(rng)) + _boilerplate(rng, "after")
        top = f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 8)}</title><style>p{{}}</style></head><body>"
        out.append(top + body + ("</body></html>" if rng.random() < 0.8 else ""))
    return out
