"""Labelled pages for training the block labeller: random layouts around random prose.

Each page is (html, main text blocks).  Prose is made of random syllables, so
the labeller cannot learn words of the article; it learns paths, the words
that page furniture uses, and how blocks follow each other.
"""

from __future__ import annotations

import random
from collections.abc import Callable

CONSONANTS, VOWELS = "bcdfghjklmnprstvwz", "aeiouéüñö"

#: Words that page furniture uses.
MENU = "Home About Contact News Sports Login Register Search Products Services Blog Archive Help Terms Privacy Jobs Shop".split()
NOTICE = ("We use cookies to improve this site.", "By continuing you accept our cookie policy.", "This site uses cookies. Accept all", "JavaScript is disabled in your browser.", "Please read our updated privacy terms.")
ADVERT = ("Advertisement", "Sponsored", "Buy now and save 50%", "Limited offer: order today", "Click here for the best deals")
FORM = ("Subscribe to our newsletter", "Your email address", "Sign up", "Leave a reply", "Search this site", "Send", "Name", "Password")
SHARE = ("Share this", "Tweet", "Share on social media", "Print", "Email this page", "Follow us")
RELATED = ("Related articles", "You may also like", "Most read", "Recent posts", "Popular", "Tags", "Categories")
REMARK = ("Comments", "3 comments", "Reply", "Report", "says:", "Posted by", "Log in to comment")
LEGAL = ("All rights reserved.", "Terms of use", "Powered by", "Contact us", "Imprint", "&copy; 2024")


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = [self.r.choice(CONSONANTS) + self.r.choice(VOWELS) + self.r.choice(["", "n", "r", "st", "l"]) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.phrase(1, 18)
            out.append(s.replace(" ", ", ", 1) + "." if self.r.random() < 0.3 else s + ".")
        return " ".join(out)

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def name(self, *options: str) -> str:
        """class="..." or id="..." with one of the options, now and then with a meaningless part."""
        value = self.r.choice(options)
        if self.r.random() < 0.3:
            value += self.pick("-wrap", " clearfix", "-1", "_box", " col-md-8", "-container", " section", "-list", " block")
        return f' {self.pick("class", "class", "id")}="{value}"'


def _main(w: Writer, keep: list[str]) -> str:
    """Article body; appends its text blocks to keep."""

    def add(tag: str, text: str) -> str:
        keep.append(text)
        if w.r.random() < 0.15 and " " in text:
            head, _, tail = text.partition(" ")
            shown = f'<a href="/x">{head}</a> {tail}' if w.r.random() < 0.5 else f"<b>{head}</b> {tail}"
        else:
            shown = text
        loose = w.r.random() < 0.1 and tag == "p"
        return f"<{tag}>{shown}" + ("" if loose else f"</{tag}>")

    parts = []
    if w.r.random() < 0.8:
        parts.append(add("h1", w.pick(w.phrase(2, 12), w.prose(1, 1))))
    if w.r.random() < 0.25:
        parts.append(add("p", w.phrase(3, 8)))
    for _ in range(w.r.choice((1, 2, 3, 4, 6, 9, 14, 25))):
        x = w.r.random()
        if x < 0.72:
            parts.append(add("p", w.prose(1, w.pick(1, 3, 7))))
        elif x < 0.80:
            parts.append(add(w.pick("h2", "h3"), w.phrase(1, 7)))
        elif x < 0.86:
            parts.append("<ul>" + "".join(add("li", w.phrase(2, 12)) for _ in range(w.r.randint(2, 5))) + "</ul>")
        elif x < 0.90:
            parts.append(add("blockquote", w.prose(1, 3)))
        elif x < 0.93:
            parts.append("<figure><img src=x>" + add("figcaption", w.phrase(3, 9)) + "</figure>")
        elif x < 0.945:
            parts.append("<table><tr>" + "".join(add("td", w.phrase(1, 3)) for _ in range(3)) + "</tr></table>")
        elif x < 0.955:
            parts.append("<dl>" + "".join(add("dt", w.phrase(1, 3)) + add("dd", w.phrase(2, 12)) for _ in range(w.r.randint(1, 4))) + "</dl>")
        elif x < 0.965:
            parts.append(add("pre", w.prose(1, 2)))
        else:
            parts.append(w.r.choice(FURNITURE_INSIDE)(w))
    return "".join(parts)


def _menu(w: Writer) -> str:
    n = w.r.randint(3, 9)
    items = "".join(f'<li><a href="/{k}">{w.r.choice(MENU) if w.r.random() < 0.5 else w.word()}</a></li>' for k in range(n))
    return w.pick(f"<nav><ul>{items}</ul></nav>", f"<nav{w.name('menu', 'main-nav', 'navbar')}><ul>{items}</ul></nav>", f"<div{w.name('menu', 'nav', 'navigation', 'topbar', 'breadcrumb', 'breadcrumbs')}><ul>{items}</ul></div>", f"<ul{w.name('menu', 'nav', 'nav-links', 'pagination')}>{items}</ul>")


def _header(w: Writer) -> str:
    inner = w.pick(f"<a href='/'>{w.phrase(1, 3)}</a>", f"<p>{w.phrase(2, 6)}</p>", f"<h1>{w.phrase(1, 3)}</h1><p>{w.prose(1, 1)}</p>", f"<div>{w.phrase(1, 4)}</div>")
    return w.pick(f"<header>{inner}</header>", f"<header{w.name('site-header', 'page-header')}>{inner}</header>", f"<div{w.name('header', 'masthead', 'site-header', 'logo', 'topbar')}>{inner}</div>")


def _advert(w: Writer) -> str:
    text = w.pick(w.r.choice(ADVERT), w.prose(1, 2), w.prose(1, 1), w.phrase(3, 9))
    return f"<div{w.name('ad', 'ads', 'advert', 'advertisement', 'ad-banner', 'sponsored', 'promo', 'ad-slot')}>{w.pick(text, f'<p>{text}</p>', f'<a href=x>{text}</a>')}</div>"


def _notice(w: Writer) -> str:
    text = w.pick(w.r.choice(NOTICE), w.prose(1, 2), w.r.choice(NOTICE))
    button = w.pick("", "<button>OK</button>", "<a href=x>More</a>")
    return f"<div{w.name('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr-banner', 'alert', 'cookie-banner', 'popup', 'modal', 'notification')}>{w.pick(text, f'<p>{text}</p>')}{button}</div>"


def _form(w: Writer) -> str:
    inner = w.pick(f"<label>{w.r.choice(FORM)}</label><input><button>{w.r.choice(FORM)}</button>", f"<p>{w.r.choice(FORM)}</p><input type=text><button>{w.phrase(1, 2)}</button>", f"<p>{w.prose(1, 1)}</p><label>{w.phrase(1, 3)}</label><select><option>{w.word()}</option><option>{w.word()}</option></select>")
    form = f"<form{w.pick('', w.name('search', 'newsletter', 'subscribe', 'login', 'signup'))}>{inner}</form>"
    return w.pick(form, form, f"<div{w.name('newsletter', 'subscribe', 'search-form', 'signup')}>{form}</div>")


def _sidebar(w: Writer) -> str:
    items = "".join(f"<li><a href=/{k}>{w.phrase(2, 9)}</a></li>" for k in range(w.r.randint(2, 7)))
    text = f"<p>{w.prose(1, 3)}</p>" if w.r.random() < 0.5 else ""
    inner = w.pick(f"<h3>{w.r.choice(RELATED)}</h3><ul>{items}</ul>{text}", f"<h4>{w.phrase(1, 3)}</h4>{text}<ul>{items}</ul>", f"<ul>{items}</ul>", text or f"<p>{w.prose(1, 2)}</p>")
    return w.pick(f"<aside>{inner}</aside>", f"<aside{w.name('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div{w.name('sidebar', 'side', 'related', 'widget', 'related-posts', 'recommended', 'popular', 'trending', 'tags')}>{inner}</div>")


def _share(w: Writer) -> str:
    items = w.pick("".join(f"<li><a href=x>{w.r.choice(SHARE)}</a></li>" for _ in range(3)), f"<span>{w.r.choice(SHARE)}</span>")
    return f"<div{w.name('share', 'social', 'share-buttons', 'social-links', 'toolbar')}>{items}</div>"


def _comments(w: Writer) -> str:
    one = lambda: f"<{(t := w.pick('li', 'div'))}{w.name('comment', 'comment-body', 'reply')}>" + w.pick("", f"<span>{w.phrase(1, 2)}</span> ", f"<h4>{w.phrase(1, 2)} {w.r.choice(REMARK)}</h4>") + w.pick(f"<p>{w.prose(1, 4)}</p>", w.prose(1, 3), f"<p>{w.prose(1, 2)}</p><p>{w.prose(1, 2)}</p>") + w.pick("", "<a href=x>Reply</a>") + f"</{t}>"
    inner = f"<h3>{w.pick(w.r.choice(REMARK), w.phrase(1, 2))}</h3>" * (w.r.random() < 0.7) + "".join(one() for _ in range(w.r.randint(1, 6)))
    tag = w.pick("div", "section", "ol", "ul")
    return f"<{tag}{w.name('comments', 'comment-list', 'discussion', 'responses', 'disqus', 'user-comments', 'comments-area', 'reader-comments')}>{inner}</{tag}>"


def _footer(w: Writer) -> str:
    text = w.pick(f"{w.r.choice(LEGAL)} {w.prose(1, 2)}", w.r.choice(LEGAL), f"&copy; {w.word()}.example.com &middot; {w.prose(1, 1)}", w.prose(1, 2))
    inner = w.pick(text, f"<p>{text}</p>", f"<ul><li><a href=x>{w.phrase(1, 2)}</a></li><li><a href=y>{w.r.choice(LEGAL)}</a></li></ul><p>{text}</p>")
    return w.pick(f"<footer>{inner}</footer>", f"<footer{w.name('site-footer', 'footer')}>{inner}</footer>", f"<div{w.name('footer', 'bottom', 'copyright', 'colophon', 'legal')}>{inner}</div>")


FURNITURE_INSIDE: list[Callable[[Writer], str]] = [_advert, _notice, _form, _share, _sidebar]


def page(seed: int, layout: str | None = None) -> tuple[str, list[str]]:
    """One random page and its main text blocks in page order; layout 'table' or 'section' asks for that family."""
    w = Writer(seed)
    keep: list[str] = []
    body = _main(w, keep)
    late = _comments(w) if w.r.random() < 0.3 else ""
    inside = w.r.random() < 0.3
    holder = w.pick("article", "article", "article", "main", "div", "section")
    if layout == "section":
        holder = layout
    named = "" if w.r.random() < (0.7 if holder in ("article", "main") else 0.4) else w.name("content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "text", "article", "body-copy")
    core = f"<{holder}{named}>{body}{late if inside else ''}</{holder}>"
    if w.r.random() < 0.3:
        core = f"<main{w.pick('', w.name('main', 'content'))}>{core}</main>"
    before = [f(w) for f in (_menu, _header, _notice, _advert, _form, _sidebar, _share) if w.r.random() < (0.7 if f is _menu else 0.3)]
    after = ["" if inside else late, *[f(w) for f in (_sidebar, _advert, _share, _menu, _form, _notice, _advert) if w.r.random() < 0.25]]
    w.r.shuffle(before)
    w.r.shuffle(after)
    end = _footer(w) if w.r.random() < 0.85 else ""
    wrap = w.pick("", "", f"<div{w.name('wrapper', 'container', 'page', 'site', 'row')}>")
    title = w.phrase(2, 9) if not keep or w.r.random() < 0.5 else keep[0]
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head>"
    if layout == "table" or (layout is None and w.r.random() < 0.08):
        inside = _table_layout(w, core, before, after)
    else:
        inside = f"{''.join(before)}{core}{''.join(after)}"
    doc = f"{head}<body>{wrap}{inside}{end}{'</div>' if wrap else ''}</body></html>"
    return doc, keep


def _table_layout(w: Writer, core: str, before: list[str], after: list[str]) -> str:
    """The page as one table: a row of furniture above, or a column of it beside the article; menus as cells."""
    cells = "".join(f'<td><a href="/{k}">{w.r.choice(MENU + w.word().split())}</a></td>' for k in range(w.r.randint(2, 7)))
    column = "".join(f'<a href="/{k}">{w.r.choice(MENU + w.word().split())}</a><br>' for k in range(w.r.randint(2, 7)))
    menu = w.pick(f"<tr>{cells}</tr>", f"<tr><td>{column}</td></tr>", "")
    side = w.pick(f"<td width=150>{column}</td>", f"<td>{''.join(before)}</td>", "")
    body = f"<tr>{side}<td>{core}</td>" + w.pick("", f"<td>{''.join(after)}</td>") + "</tr>"
    return f"<table width=100%>{menu}{body}</table>"
