"""Labelled pages for the extractor: layouts drawn at random, with the article's texts marked."""

from __future__ import annotations

import random

# Put before each text that belongs to the article; a private-use character.
MARK = ""

SYLLABLES = "an ti re on th er in ed st ou le de la che ver en mi co pa sa lu no ter ung sch que os ar".split()
# Class and id words of each part of a page, as many sites use them.
NAMES = {
    "menu": "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs site-nav toolbar tabs pagination pager",
    "header": "header site-header masthead top-bar branding banner logo page-header topbar",
    "footer": "footer site-footer page-footer bottom copyright colophon legal credits",
    "sidebar": "sidebar side-bar widget widgets related related-posts recent popular secondary rail trending more-stories",
    "notice": "notice cookie-notice cookie-banner consent gdpr alert message announcement popup modal newsletter overlay",
    "advert": "ad ads advert advertisement sponsored promo promotion banner-ad ad-slot adbox sponsor commercial",
    "form": "form search search-form subscribe signup login contact-form newsletter-form",
    "comments": "comments comment comment-list commentlist comments-area responses discussion replies reply disqus",
    "share": "share social share-buttons social-links follow",
    "content": "content article post post-content entry entry-content article-body story main-content text body "
               "post-body page-content hentry story-body",
}
NOTICES = ["We use cookies to improve your experience.", "Accept all cookies", "Please enable JavaScript to continue.",
           "Subscribe to our newsletter", "This site uses cookies. Learn more", "You are reading a preview."]
FOOTS = ["&copy; 2024 {w}", "All rights reserved.", "Privacy policy", "Terms of use", "&copy; {w}.example.org &middot; {s}",
         "Powered by {w}", "Contact us", "Imprint"]
ADS = ["Advertisement", "Sponsored by {w}", "Buy {w} now!", "{s}", "{s} {s}"]


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, most: int = 20) -> str:
        words = [self.word() for _ in range(self.rng.randint(1, most))]
        return (" ".join(words).capitalize() + self.rng.choice([".", ".", ".", "?", "!", ""])).replace(" and", ", and")

    def text(self) -> str:
        r = self.rng.random()
        if r < 0.15:
            return self.sentence(3)
        if r < 0.22:
            return " | ".join(self.word() for _ in range(self.rng.randint(2, 20)))
        if r < 0.27:
            return " ".join([self.word()] * self.rng.randint(3, 30))
        if r < 0.32:
            return " ".join(self.word() + self.rng.choice(["###", "$$$", "&amp;&amp;", "%%%"]) for _ in range(9))
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 8)))

    def named(self, tag: str, part: str, inner: str, certain: bool = False) -> str:
        """The tag with a class or id of the part; a semantic tag often goes without."""
        if not certain and self.rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        kind = self.rng.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{self.rng.choice(NAMES[part].split())}">{inner}</{tag}>'

    def part(self, tag: str, part: str, inner: str) -> str:
        """As the semantic tag, or as a plain element that only its name tells."""
        if tag in ("div", "p", "ul", "table", "section") or self.rng.random() < 0.35:
            return self.named(self.rng.choice(["div", "div", "section"]), part, inner, certain=True)
        return self.named(tag, part, inner)

    def links(self) -> str:
        n = self.rng.randint(2, 8)
        texts = [self.word() if self.rng.random() < 0.7 else self.sentence(6) for _ in range(n)]
        items = [f'<a href="/{self.word()}">{t}</a>' for t in texts]
        form = self.rng.choice(["li", "li", "br", "p"])
        if form == "li":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if form == "br" else "".join(f"<p>{i}</p>" for i in items)

    def chrome(self, part: str) -> str:
        r, fill = self.rng, lambda s: s.format(w=self.word(), s=self.sentence())
        if part == "menu":
            return self.part("nav", part, self.links())
        if part == "header":
            inner = r.choice([f"<h1>{self.sentence(4)}</h1>", f'<a href="/">{self.word()}</a>', f"<p>{self.sentence(8)}</p>"])
            return self.part("header", part, inner + (self.chrome("menu") if r.random() < 0.4 else ""))
        if part == "footer":
            inner = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "{} "]).format(fill(r.choice(FOOTS)))
                            for _ in range(r.randint(1, 4)))
            return self.part("footer", part, inner + (self.links() if r.random() < 0.4 else ""))
        if part == "sidebar":
            inner = f"<h{r.randint(2, 4)}>{self.sentence(4)}</h3>" + r.choice([self.links(), f"<p>{self.text()}</p>"])
            return self.part("aside", part, inner)
        if part == "notice":
            return self.part("div", part, r.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(
                r.choice([*NOTICES, self.text()])) + r.choice(["", "<button>OK</button>"]))
        if part == "advert":
            return self.part("div", part, r.choice(["{}", "<p>{}</p>", '<a href="//x">{}</a>']).format(fill(r.choice(ADS))))
        if part == "form":
            inner = (f"<label>{self.sentence(3)}</label><input type=text><p>{self.sentence(6)}</p>"
                     f"<select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>")
            return self.named("form", part, inner)
        if part == "share":
            return self.part("div", part, self.links())
        one = lambda: r.choice(["<li>{}</li>", '<div class="comment">{}</div>', "<article>{}</article>", "{}"]).format(
            f"<b>{self.word()}</b>" + "".join(f"<p>{self.text()}</p>" for _ in range(r.randint(1, 2))))
        inner = r.choice(["", f"<h3>{r.randint(1, 40)} comments</h3>"]) + "".join(one() for _ in range(r.randint(1, 5)))
        return self.part("section", "comments", inner)

    def article(self) -> str:
        r, say = self.rng, lambda: MARK + self.text()
        out = []
        if r.random() < 0.85:
            head = f"<h1>{MARK}{self.sentence(12)}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.62:
                out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(say()))
            elif kind < 0.70:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.sentence(6)}</h2>")
            elif kind < 0.78:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{say()}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.83:
                out.append(f"<blockquote><p>{say()}</p></blockquote>")
            elif kind < 0.87:
                rows = "".join(f"<tr><td>{say()}</td><td>{say()}</td></tr>" for _ in range(r.randint(1, 3)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.90:
                out.append(f"<pre>{say()}</pre>")
            elif kind < 0.93:
                out.append(f"<figure><img src=x><figcaption>{say()}</figcaption></figure>")
            else:
                out.append(f'<p>{say()} <a href="/{self.word()}">{self.sentence(4)}</a> {self.word()}.</p>')
        extras = [p for p in ("advert", "share", "comments", "form", "sidebar", "notice") if r.random() < 0.12]
        for p in extras:
            out.insert(len(out) if p == "comments" else r.randint(1, len(out)), self.chrome(p))
        inner = "".join(out)
        shape = r.random()
        if shape < 0.55:
            return self.named("article", "content", inner)
        if shape < 0.7:
            return self.named("main", "content", inner)
        if shape < 0.93:
            return self.named("div", "content", inner, certain=True)
        return f"<table><tr><td>{inner}</td></tr></table>" if shape < 0.96 else f"<div>{inner}</div>"

    def page(self) -> str:
        some = lambda part, p: self.chrome(part) if self.rng.random() < p else ""
        body = (some("notice", 0.2) + some("header", 0.4) + some("menu", 0.6) + some("advert", 0.35)
                + some("form", 0.12) + some("sidebar", 0.15))
        after = (some("share", 0.1) + some("comments", 0.3) + some("sidebar", 0.3) + some("advert", 0.2)
                 + some("form", 0.15) + some("footer", 0.75) + some("notice", 0.1))
        article = self.article()
        if self.rng.random() < 0.2:
            article = f"<main>{article}</main>"
        if self.rng.random() < 0.2:
            body, after = f'<div class="wrapper">{body}', f"{after}</div>"
        page = f"<html><head><title>{self.sentence(6)}</title></head><body>{body}{article}{after}"
        return page + self.rng.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int) -> list[str]:
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
