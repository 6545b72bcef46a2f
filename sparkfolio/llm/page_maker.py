"""Labelled pages to learn from, made by rule: an article among the usual other parts of a page, in many layouts."""

from __future__ import annotations

import numpy as np

MARK = ""  # stands in every text that belongs to the article
ONSETS, VOWELS, CODAS = "b c d f g h j l m n p r s t v w st tr ch sh th".split(), "a e i o u ä é ou ie ó".split(), ["", "", "n", "r", "s", "l", "t", "nd", "ng"]

# How pages name their parts, and what stands in them.
KINDS = {
    "menu": ("nav", "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs", "Home About Contact News Products Blog Login Sign Search Start Kontakt Accueil Inicio Über"),
    "header": ("header", "header masthead top-bar site-header banner branding logo", "Welcome Official Site Daily Magazine Log in"),
    "footer": ("footer", "footer site-footer bottom copyright legal imprint", "© Copyright All rights reserved Privacy Terms Imprint · Alle Rechte vorbehalten"),
    "sidebar": ("aside", "sidebar side widget related most-read trending recommended tags archive", "Related Most read Popular Tags Archive Recent posts See also"),
    "notice": ("div", "cookie consent notice gdpr cookie-banner popup modal overlay alert", "We use cookies Accept Decline Settings consent privacy Cookies akzeptieren"),
    "advert": ("div", "ad ads advert advertisement sponsored promo banner-ad adsbox", "Advertisement Sponsored Buy now Offer Sale Anzeige Werbung Publicité"),
    "form": ("form", "form newsletter subscribe signup search-form login contact-form", "Subscribe Email Name Password Submit Send Newsletter Enter your address"),
    "share": ("div", "share social sharing follow share-buttons", "Share Tweet Follow us Facebook Email Print Teilen"),
    "comments": ("section", "comments comment-list discussion replies disqus responses", "Comments Reply says wrote ago Leave a comment Kommentare Antworten"),
}
ARTICLE = "content article post entry story post-content article-body entry-content main text body-text page-content".split()

UTILITIES = "d flex row col grid md lg sm px py mx my mt mb pt align items justify center between start end gap w full h auto relative absolute text bg border rounded shadow gray white dark leading font bold wrap hover focus hidden block inline max min overflow scroll".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.vocabulary: list[str] = []

    def any(self, *of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.any(*ONSETS) + self.any(*VOWELS) + self.any(*CODAS) for _ in range(int(self.rng.integers(1, 4))))

    def words(self, n: int) -> list[str]:
        return [self.vocabulary[i] for i in self.rng.zipf(1.3, n) % len(self.vocabulary)]

    def prose(self, low: int, high: int) -> str:
        n, out = int(np.exp(self.rng.uniform(np.log(low), np.log(high)))), []
        while n > 0:
            some = self.words(min(n, int(self.rng.integers(3, 18))))
            out.append(" ".join(some).capitalize() + self.any(".", ".", ".", "?", "!", ","))
            n -= len(some)
        text = " ".join(out)
        return text if self.chance(0.9) else self.any(text.replace(" ", " | "), text.upper(), text.replace(" ", "*** "), text.rstrip(".?!,"), " ".join(text.split()[:1] * (text.count(" ") + 1)))

    def inline(self, text: str) -> str:
        words = text.split()
        for _ in range(int(self.rng.integers(0, 3))):
            i, tag = int(self.rng.integers(len(words))), self.any("b", "em", "strong", "a", "i", "span", "code")
            words[i] = f'<{tag} href="/{self.word()}">{words[i]}</{tag}>' if tag == "a" else f"<{tag}>{words[i]}</{tag}>"
        return " ".join(words).replace(" & ", " &amp; ")

    def utility(self) -> str:
        return " ".join("-".join(self.any(*UTILITIES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(2, 8))))

    def nested(self, inner: str) -> str:
        """Within some elements whose classes say how they look, in part of the cases."""
        for _ in range(int(self.rng.integers(1, 7)) if self.chance(0.45) else 0):
            tag = self.any("div", "div", "div", "section", "my-" + self.word().encode("ascii", "ignore").decode())
            inner = f'<{tag} class="{self.utility()}">{inner}</{tag}>'
        return inner

    def styled(self, names: str) -> str:
        """Class words, in part of the cases among such that say how the element looks."""
        return names if self.chance(0.75) else self.any(f"{names} {self.utility()}", f"{self.utility()} {names}")

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.word()}">{" ".join(self.words(int(self.rng.integers(1, 6)))).capitalize()}</a>' for _ in range(int(self.rng.integers(low, high)))]

    def other(self, kind: str) -> str:
        tag, names, phrases = KINDS[kind]
        said = phrases.split()
        phrase = " ".join(said[int(i)] for i in self.rng.integers(len(said), size=int(self.rng.integers(1, 5))))
        if kind in ("menu", "sidebar", "share"):
            items = self.links(2, 9)
            inner = self.any("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "".join(f"<div>{x}</div>" for x in items), " | ".join(items))
            if kind == "sidebar":
                inner = f"<h3>{phrase}</h3>" + inner + (f"<p>{self.prose(5, 40)}</p>" if self.chance(0.4) else "")
        elif kind == "comments":
            inner = self.any(f"<h3>{phrase}</h3>", "") + "".join(
                f'<{t} class="{self.any("comment", "reply", "comment-body", "c")}"><p>{self.word().capitalize()} {self.any("says", "wrote", "")}</p><p>{self.prose(4, 60)}</p></{t}>'
                for t in [self.any("div", "li", "article")] for _ in range(int(self.rng.integers(1, 6))))
        elif kind == "form":
            inner = f'<label>{phrase}</label><input name="q"><p>{self.prose(2, 20)}</p><button>{said[0]}</button>'
        elif kind == "footer":
            inner = self.any(f"&copy; {self.word()}.example.com &middot; {self.prose(2, 30)}", f"<p>{phrase} {self.prose(2, 25)}</p>" + " | ".join(self.links(1, 5)))
        elif kind == "header":
            inner = self.any(f"<h1>{self.prose(2, 6)}</h1>", f"<div>{phrase}</div>", f"<p>{self.prose(2, 8)}</p>") + (" ".join(self.links(1, 4)) if self.chance(0.4) else "")
        else:
            inner = self.any(f"{self.prose(2, 30)}", f"<p>{phrase}</p><p>{self.prose(3, 25)}</p>", f"<p>{phrase} {self.prose(2, 20)}</p>" + " ".join(self.links(0, 3)))
        inner = self.nested(inner)
        if self.chance(0.5):
            tag, named = tag, self.any("", f' class="{self.styled(self.any(*names.split()))}"')
            if tag == "div" and not named:
                named = f' class="{self.styled(self.any(*names.split()))}"'
        else:
            tag, named = self.any("div", "div", "section"), f' {self.any("class", "id")}="{self.styled(self.any(*names.split()) + self.any("", "", " " + self.word(), "-" + self.word()))}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def article(self) -> str:
        say = lambda low, high: MARK + self.inline(self.prose(low, high))
        title = say(2, 14)
        out = [self.any(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", "")]
        for _ in range(int(np.exp(self.rng.uniform(0, 2.8)))):
            kind = self.rng.random()
            if kind < 0.72:
                text = say(1, 160)
                out.append(self.any(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}<br>{self.prose(3, 30)}</p>"))
            elif kind < 0.8:
                out.append(f"<h{(n := self.any(2, 3))}>{say(1, 9)}</h{n}>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{say(2, 25)}</li>" for _ in range(int(self.rng.integers(2, 7)))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{say(5, 60)}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{say(3, 30)}</pre>")
            else:
                out.append(self.other(self.any("advert", "advert", "share", "form", "sidebar", "notice")))
        inner = self.nested("".join(out))
        plain = self.rng.random()
        if plain < 0.5:
            return f"<article>{inner}</article>"
        if plain < 0.62:
            return f"<main>{self.any(inner, f'<article>{inner}</article>')}</main>"
        if plain < 0.94:
            return f'<{(t := self.any("div", "div", "section", "article", "main"))} {self.any("class", "id")}="{self.styled(self.any(*ARTICLE, self.word()))}">{inner}</{t}>'
        return inner

    def page(self) -> str:
        self.vocabulary = [self.word() for _ in range(300)]
        before = [self.other(k) for k in ("header", "menu", "menu", "notice", "advert", "share", "form", "sidebar") if self.chance(0.45)]
        after = [self.other(k) for k in ("share", "comments", "sidebar", "form", "advert", "menu", "footer", "notice") if self.chance(0.4)]
        self.rng.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if self.chance(0.3):
            body = f'<div class="{self.any("page", "wrapper", "container", self.word())}">{body}</div>'
        body = self.nested(body)
        if self.chance(0.1):
            body = body[: int(len(body) * self.rng.uniform(0.6, 1))]
        return f"<html><head><title>{self.prose(2, 8)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
