"""Labelled pages to train on, composed from parts whose role is known.

Every page is drawn from a seeded generator: a layout, an article with its
container, and menus, headers, footers, sidebars, notices, adverts, forms and
comments around and inside it. Names of elements and classes are those that
pages commonly use; texts are invented words, mixed with the phrases such parts have.
"""

from __future__ import annotations

import random

#: How pages name their parts. Each entry is a tag and the names one of which becomes its class or id.
ARTICLE = [
    ("article", ""),
    ("article", "post hentry"),
    ("article", "entry story"),
    ("main", ""),
    ("main", "content"),
    ("div", "content"),
    ("div", "main-content"),
    ("div", "post-content entry-content"),
    ("div", "article-body"),
    ("div", "story-body"),
    ("div", "page-content"),
    ("section", "article"),
    ("section", "post"),
    ("div", "text body-text"),
    ("td", "content"),
    ("div", ""),
]
PARTS = {
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("div", "branding logo"), ("div", "page-header site-title")],
    "menu": [("nav", ""), ("nav", "navbar"), ("ul", "menu"), ("div", "navigation"), ("div", "nav main-nav"), ("ul", "breadcrumbs"), ("div", "breadcrumb"), ("div", "menu mobile-menu"), ("nav", "toc"), ("div", "pagination pager"), ("ul", "tabs"), ("div", "share social"), ("div", "tags links"), ("div", "skip-link")],
    "sidebar": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related related-posts"), ("div", "recommended"), ("div", "popular trending"), ("div", "side-column rail"), ("section", "related"), ("div", "teaser more-stories")],
    "notice": [("div", "cookie"), ("div", "cookie-banner"), ("div", "cookie-consent notice"), ("div", "notice"), ("div", "alert"), ("div", "gdpr consent"), ("div", "banner message"), ("div", "popup modal"), ("div", "subscribe newsletter"), ("div", "paywall"), ("div", "disclaimer"), ("section", "cookies"), ("dialog", ""), ("noscript", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "ad-slot ad-container"), ("div", "sponsored"), ("div", "sponsor"), ("div", "promo promotion"), ("section", "ads"), ("div", "banner-ad"), ("p", "ad"), ("ins", "adsbygoogle"), ("div", "commercial")],
    "form": [("form", ""), ("form", "search"), ("form", "login"), ("form", "newsletter-form signup"), ("form", "contact"), ("div", "search-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "replies"), ("div", "discussion"), ("div", "disqus thread"), ("div", "respond"), ("div", "reader-comments responses"), ("section", "user-comments")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom legal"), ("div", "page-footer colophon")],
}
WRAPPERS = ["", "container", "wrapper", "row", "col-md-8", "inner", "page", "site", "layout", "block", "box", "section-a"]
PHRASES = {
    "header": ["Welcome", "Daily News", "Your source for news", "Le journal", "Die Zeitung", "Noticias"],
    "menu": ["Home", "About", "Contact", "News", "Sport", "Share", "Next page", "Previous", "Accueil", "Startseite", "Inicio", "Skip to content", "Menu", "Tags", "Facebook"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "Read more", "You may also like", "Archives", "Recommended for you", "Articles liés", "Mehr zum Thema"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies. By continuing you agree to our privacy policy.", "Subscribe to our newsletter", "Please enable JavaScript.", "Nous utilisons des cookies.", "Diese Website verwendet Cookies.", "Usamos cookies."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Anzeige", "Publicité", "Publicidad", "Limited offer", "Click here"],
    "form": ["Search", "Name", "Email", "Password", "Log in", "Sign up", "Submit", "Send", "Leave a comment", "Your message"],
    "comments": ["3 comments", "Reply", "Comments", "Leave a reply", "Great article, thanks!", "Commentaires", "Kommentare", "Comentarios"],
    "footer": ["© 2024 Example Inc. All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Mentions légales", "Contact us", "&copy; example.com"],
}
_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxzçñß", "aeiouyäéèöüó"


class _Page:
    """Collects HTML and the label of every leaf block in it: 1 for the article, else 0."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_CONSONANTS) + self.rng.choice(_VOWELS) for _ in range(self.rng.randint(3, 5)))

    def sentence(self, least: int = 2, most: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(least, most))]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", "", "&hellip;", " &amp; co."])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def inline(self, text: str) -> str:
        """Some words in links, bold or italic print, or spans."""
        if self.rng.random() < 0.3:
            words = text.split(" ")
            at = self.rng.randrange(len(words))
            tag = self.rng.choice(['a href="/x"', "b", "i", "em", "span", 'span class="c1"', "strong"])
            words[at] = f"<{tag}>{words[at]}</{tag.split(' ')[0]}>"
            text = " ".join(words)
        return text

    def add(self, html: str) -> None:
        self.html.append(html)

    def block(self, tag: str, inner: str, label: int, closed: bool = True) -> None:
        self.html.append(f"<{tag}>{inner}" + (f"</{tag.split(' ')[0]}>" if closed else ""))
        self.labels.append(label)

    def open(self, tag: str, names: str) -> str:
        if names:
            key = "id" if self.rng.random() < 0.2 else "class"
            self.html.append(f'<{tag} {key}="{names}">')
        else:
            self.html.append(f"<{tag}>")
        return tag

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")


def _paragraphs(page: _Page, label: int, count: int) -> None:
    rng = page.rng
    for _ in range(count):
        draw = rng.random()
        if draw < 0.62:
            page.block("p", page.inline(page.prose()), label, rng.random() < 0.8)
        elif draw < 0.70:
            page.block("p", "<b>" + page.prose(2) + "<br>", label, False)
        elif draw < 0.76:
            page.block(rng.choice(["h2", "h3", "h4"]), page.sentence(1, 6), label)
        elif draw < 0.83:
            tag = rng.choice(["ul", "ol"])
            page.add(f"<{tag}>")
            for _ in range(rng.randint(1, 5)):
                page.block("li", page.inline(page.sentence(1, 12)), label, rng.random() < 0.8)
            page.close(tag)
        elif draw < 0.87:
            page.add("<blockquote>")
            page.block("p", page.prose(2), label)
            page.close("blockquote")
        elif draw < 0.90:
            page.block("div", page.prose(3), label)
        elif draw < 0.93:
            page.add('<figure><img src="a.png" alt="x">')
            page.block("figcaption", page.sentence(), label)
            page.close("figure")
        elif draw < 0.96:
            page.block("pre", page.sentence() + "\n   " + page.sentence(), label)
        else:
            page.add("<table>")
            for _ in range(rng.randint(1, 3)):
                page.add("<tr>")
                for _ in range(rng.randint(1, 3)):
                    page.block(rng.choice(["td", "th"]), page.sentence(1, 4), label)
                page.close("tr")
            page.close("table")


def _part(page: _Page, role: str) -> None:
    """One part that is not of the article."""
    rng = page.rng
    tag, names = rng.choice(PARTS[role])

    def phrase() -> str:
        return rng.choice(PHRASES[role]) if rng.random() < 0.4 else page.sentence(1, 5)

    page.open(tag, names)
    if role == "menu" or (role in ("sidebar", "footer", "header") and rng.random() < 0.4):
        listed = tag != "ul"
        if listed:
            page.add("<ul>")
        for _ in range(rng.randint(1, 7)):
            page.block("li", f'<a href="/{page.word()}">{phrase()}</a>', 0)
        if listed:
            page.close("ul")
    elif role == "form":
        for _ in range(rng.randint(1, 3)):
            page.block("label", phrase(), 0) if rng.random() < 0.5 else page.block("p", phrase(), 0)
            page.add('<input type="text" name="q"><textarea>not shown</textarea>')
        if rng.random() < 0.5:
            page.add("<select>")
            for _ in range(2):
                page.block("option", page.word(), 0)
            page.close("select")
        page.block("button", phrase(), 0)
    elif role == "comments":
        if rng.random() < 0.6:
            page.block("h3" if tag != "ol" else "li", phrase(), 0)
        for _ in range(rng.randint(1, 5)):
            inner = "li" if tag == "ol" else rng.choice(["div", "article", "p"])
            page.add(f'<{inner} class="comment">' if inner != "p" else "")
            page.block("p", page.prose(3), 0)
            page.add(f"</{inner}>" if inner != "p" else "")
    elif tag in ("p", "ins"):
        text = page.prose(2) if rng.random() < 0.7 else phrase()
        page.add(text)
        page.labels.append(0)
    else:
        for _ in range(rng.randint(1, 3)):
            text = page.prose(4) if rng.random() < 0.5 else phrase()
            if rng.random() < 0.4:
                page.add(text)
                page.labels.append(0)
                break
            page.block(rng.choice(["p", "p", "div", "h3"] if role != "header" else ["p", "h1", "div", "a"]), text, 0)
            page.add("<hr>")
    page.close(tag)
    if tag == "ins":
        # an inline element: the block ends with the next border
        page.add("<hr>")


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks."""
    page = _Page(rng)
    page.add(f"<!DOCTYPE html><html><head><title>{page.sentence()}</title><style>p{{a:b}}</style>")
    page.add(f'<script>var x = "</p>";</script></head><body class="{rng.choice(WRAPPERS)}">')
    wrappers = [rng.choice(WRAPPERS) for _ in range(rng.randint(0, 2))]
    for role in rng.sample(["header", "menu", "notice", "advert", "form", "menu"], rng.randint(0, 5)):
        _part(page, role)
    for names in wrappers:
        page.add(f'<div class="{names}">' if names else "<div>")
    if rng.random() < 0.25:
        _part(page, rng.choice(["sidebar", "advert", "menu"]))
    tag, names = rng.choice(ARTICLE)
    outer = rng.random() < 0.2 and tag not in ("main", "td")
    if outer:
        page.add("<main>")
    if tag == "td":
        page.add("<table><tr>")
        if rng.random() < 0.5:
            page.block("td", f'<a href="/">{page.word()}</a>', 0)
    page.open(tag, names)
    if rng.random() < 0.85:
        if rng.random() < 0.15:
            page.add("<header>")
            page.block("h1", page.sentence(1, 10), 1)
            page.close("header")
        else:
            page.block("h1", page.sentence(1, 10), 1)
        if rng.random() < 0.3:
            page.block(rng.choice(['p class="byline author"', 'p class="lead intro"', "time", 'p class="date meta"']), page.sentence(1, 9), 1)
            page.add("<hr>")
    inside = rng.choice([[], [], ["advert"], ["menu"], ["menu"], ["form"], ["notice"], ["sidebar"], ["advert", "comments"], ["comments"], ["footer"]])
    count = rng.randint(0, 8)
    _paragraphs(page, 1, count // 2)
    for role in inside[:1]:
        if role not in ("comments", "footer"):
            _part(page, role)
    _paragraphs(page, 1, count - count // 2)
    for role in inside:
        if role in ("comments", "footer"):
            _part(page, role)
    page.close(tag)
    if tag == "td":
        page.add("</tr></table>")
    if outer:
        page.add("</main>")
    for role in rng.sample(["comments", "sidebar", "advert", "form", "notice", "menu"], rng.randint(0, 3)):
        _part(page, role)
    for _ in wrappers:
        page.add("</div>")
    if rng.random() < 0.7:
        _part(page, "footer")
    if rng.random() < 0.8:
        page.add("</body></html>")
    return "".join(page.html), page.labels


def labelled_pages(count: int = 500, seed: int = 20) -> list[tuple[str, list[int]]]:
    """``count`` pages with the labels of their leaf blocks, 1 for the article's."""
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]
