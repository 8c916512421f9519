"""Labelled training pages for content extraction, composed from invented words.

A page is put together from parts that pages have (menus, notices, adverts, forms, comments, an
article, ...) with varying elements, class names, order and nesting. ``data-label`` marks
what belongs to the article (main) and what does not (rest). Words are invented anew
for each page, so a model can only learn from structure and the form of the text.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ke lo mi ru ta ve zo ner tis qua ion ent ark ölu ées ça ñor sch wic".split()

#: Names that pages give to parts other than the article.
REST_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav nav-links submenu toc".split(),
    "header": "header site-header masthead branding top topbar page-header banner logo".split(),
    "notice": "cookie cookie-banner cookies consent notice gdpr alert privacy-notice popup modal overlay message newsletter-popup paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-slot adsbygoogle sponsor-box promotion commercial".split(),
    "side": "sidebar side widget related related-posts recommended aside right-column tags teaser more-stories trending popular".split(),
    "form": "form search search-form newsletter signup subscribe login contact-form".split(),
    "comments": "comments comment-list responses discussion disqus comment-section reader-comments replies".split(),
    "share": "share social share-buttons social-links follow-us toolbar".split(),
    "footer": "footer site-footer bottom copyright legal page-footer imprint colophon".split(),
    "pages": "pagination pager page-numbers prev-next".split(),
}
MAIN_NAMES = "content post entry article article-body story post-content main-content entry-content body-text text page-content blog-post story-body prose".split()
ROLES = {"nav": "navigation", "header": "banner", "notice": "alert", "ad": "complementary", "side": "complementary", "form": "search", "footer": "contentinfo"}
ELEMENTS = {"nav": "nav", "header": "header", "side": "aside", "form": "form", "footer": "footer", "comments": "section", "notice": "dialog", "ad": "aside"}


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(150)]
        self.junk = self.rng.random() < 0.15  # pages whose words carry marks or shout

    def sentence(self, low: int = 1, high: int = 25) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(low, high))
        if self.junk:
            words = [w + self.rng.choice(["$$$", "&amp;&amp;", "###", "!!", " |", ""]) for w in words]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def text(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.choice(self.words)}">{" ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))}</a>'

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def rest(self, kind: str, inner: str) -> str:
        """A part that is not the article, as an element of its own name or a div with a name, or with none."""
        element = ELEMENTS.get(kind, "div") if self.chance(0.5) else self.rng.choice(["div", "div", "section"])
        name = self.rng.choice(REST_NAMES[kind])
        names = f' {self.rng.choice(["class", "id"])}="{name}"' if element in ("div", "section") or self.chance(0.4) else ""
        if kind in ROLES and self.chance(0.15):
            names += f' role="{ROLES[kind]}"'
        if self.chance(0.06) and kind in ("nav", "footer", "share", "pages"):
            names = ""  # only the text tells
        return f'<{element}{names} data-label="rest">{inner}</{element}>'

    def link_list(self, low: int, high: int) -> str:
        links = [self.link() for _ in range(self.rng.randint(low, high))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        return self.rng.choice([" | ", " ", " &raquo; "]).join(links)

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind == "nav":
            inner = self.link_list(1, 10)
        elif kind == "header":
            inner = self.link() + (f"<p>{self.sentence(2, 6)}</p>" if self.chance(0.5) else "") + (self.link_list(3, 6) if self.chance(0.3) else "")
        elif kind == "notice":
            inner = f"<p>{self.text(1, 3)}</p>" + (f"<button>{rng.choice(self.words)}</button>" if self.chance(0.7) else "")
        elif kind == "ad":
            inner = self.text(1, 2) if self.chance(0.6) else f"<p>{self.text(1, 2)}</p>{self.link()}"
        elif kind == "side":
            inner = f"<h3>{self.sentence(1, 4)}</h3>" + (self.link_list(1, 6) if self.chance(0.6) else "".join(f"<p>{self.text(1, 2)}</p>" for _ in range(rng.randint(1, 3))))
        elif kind == "form":
            inner = f"<label>{self.sentence(1, 3)}</label><input type=text><button>{rng.choice(self.words)}</button>" + (f"<p>{self.text(1, 2)}</p>" if self.chance(0.5) else "")
            inner = inner if self.chance(0.5) else f"<form>{inner}</form>"
        elif kind == "comments":
            one = lambda: f'<{"li" if listed else "div"} class="comment"><b>{rng.choice(self.words)}</b> <span>{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 25)}</span><p>{self.text(1, 5)}</p></{"li" if listed else "div"}>'
            listed = self.chance(0.5)
            many = "".join(one() for _ in range(rng.randint(1, 6)))
            inner = f"<h3>{rng.randint(1, 40)} {rng.choice(self.words)}</h3>" + (f"<ol>{many}</ol>" if listed else many)
        elif kind == "share":
            inner = " ".join(self.link(1, 1) for _ in range(rng.randint(2, 5)))
        elif kind == "pages":
            inner = " ".join(f'<a href="?p={k}">{k}</a>' for k in range(1, rng.randint(3, 9)))
        else:
            inner = rng.choice(["&copy; ", "&#169; ", "© "]) + f"20{rng.randint(10, 25)} {rng.choice(self.words)}.example &middot; {self.text(1, 2) if self.chance(0.6) else self.link_list(1, 6)}"
            inner = inner if self.chance(0.5) else f"<p>{inner}</p>"
        return self.rest(kind, inner)

    def paragraph(self) -> str:
        rng, kind = self.rng, self.rng.random()
        if kind < 0.62:
            text = self.text(1, 8) if self.chance(0.85) else self.sentence(1, 3)
            if self.chance(0.2):
                text = text.replace(" ", f" {self.link()} ", 1)
            if self.chance(0.2):
                return f"<p><b>{self.sentence(1, 20)}<br><p>{text}</p>"
            return f"<p>{text}</p>" if self.chance(0.85) else f"<div>{text}</div>"
        if kind < 0.74:
            return f"<h{rng.randint(2, 4)}>{self.sentence(1, 8)}</h{rng.randint(2, 4)}>" if self.chance(0.1) else f"<h2>{self.sentence(1, 8)}</h2>"
        if kind < 0.84:
            return f"<{(e := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.sentence(2, 15)}</li>" for _ in range(rng.randint(2, 6))) + f"</{e}>"
        if kind < 0.89:
            return f"<blockquote><p>{self.text(1, 3)}</p></blockquote>"
        if kind < 0.92:
            return f"<pre><code>{self.sentence(2, 12)}\n  {self.sentence(2, 12)}</code></pre>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        return f'<figure><img src="x.png"><figcaption>{self.sentence(2, 12)}</figcaption></figure>'

    def article(self) -> str:
        rng = self.rng
        inner = [self.paragraph() for _ in range(rng.choice([1, 2, 4, 8, 16]))]
        for kind in ("ad", "share", "form", "side"):
            if self.chance(0.12):
                inner.insert(rng.randint(0, len(inner)), self.part(kind))
        for kind in ("comments", "pages", "footer"):
            if self.chance(0.08):
                inner.append(self.part(kind))
        title = f"<h1>{self.sentence(1, 12)}</h1>"
        if self.chance(0.75):
            inner.insert(0, f"<header>{title}</header>" if self.chance(0.15) else title)
        element = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = f' {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}"' if element in ("div", "section") or self.chance(0.3) else ""
        if element == "div" and self.chance(0.2):
            name = ""
        out = f'<{element}{name} data-label="main">{"".join(inner)}</{element}>'
        return f"<main>{out}</main>" if element != "main" and self.chance(0.2) else out

    def page(self) -> str:
        rng = self.rng
        before = [self.part(k) for k, share in (("notice", 0.3), ("header", 0.4), ("nav", 0.75), ("form", 0.1), ("notice", 0.1), ("ad", 0.4), ("side", 0.1)) if self.chance(share)]
        after = [self.part(k) for k, share in (("share", 0.2), ("ad", 0.2), ("pages", 0.15), ("comments", 0.3), ("side", 0.35), ("form", 0.15), ("nav", 0.1), ("footer", 0.8), ("notice", 0.1)) if self.chance(share)]
        rng.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if self.chance(0.4):
            body = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout", "row"])}">{body}</div>'
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(1, 8)}</title><style>p{{}}</style></head>"
        if self.chance(0.06):
            return f'<p data-label="main">{self.text(1, 6)}</p><p data-label="main">{self.text(1, 6)}</p>'
        if self.chance(0.06):
            return f'{head}<body data-label="main">{"".join(self.paragraph() for _ in range(rng.randint(1, 5)))}</body></html>'
        out = f"{head}<body>{body}</body></html>"
        return out[: rng.randint(len(out) * 9 // 10, len(out))] if self.chance(0.1) else out


def pages(number: int, seed: int = 0) -> list[str]:
    return [Writer(seed * 1_000_003 + k).page() for k in range(number)]
