"""Extraction over generated page layouts: articles of all lengths in several elements, among and around what is not the article."""

import html
import random

import pytest

from sextant.llm import html_extract

LEXICON = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été für añ <tag> & \"q\"".split()
WRAPPERS = ["article", "main", "section", "div id=content", 'div class="post"', "div class=entry-content", "div"]


class Page:
    def __init__(self, seed):
        self.draw = random.Random(seed)

    def text(self, low, high):
        return " ".join(self.draw.choices(LEXICON, k=self.draw.randint(low, high)))

    def shown(self, low, high):
        return html.escape(self.text(low, high))

    def links(self, low, high):
        return "<ul>" + "".join(f'<li><a href="/">{self.shown(low, high)}</a></li>' for _ in range(self.draw.randint(2, 6))) + "</ul>"

    def decoration(self, kind):
        return {
            "nav": lambda: f"<nav>{self.links(1, 2)}</nav>",
            "menu": lambda: f"<div class='main-menu'>{self.links(1, 2)}</div>",
            "header": lambda: f"<header><div class=logo><a href='/'>{self.shown(1, 3)}</a></div><p>{self.shown(3, 9)}</p></header>",
            "footer": lambda: f"<footer>&copy; {self.shown(5, 25)}</footer>",
            "site footer": lambda: f"<div class='site-footer'><p>{self.shown(5, 25)}</p></div>",
            "aside": lambda: f"<aside><h3>{self.shown(1, 3)}</h3><p>{self.shown(5, 30)}</p></aside>",
            "sidebar": lambda: f"<div class='sidebar'><h3>{self.shown(1, 3)}</h3>{self.links(2, 6)}</div>",
            "cookies": lambda: f"<div class='cookie-notice'>{self.shown(6, 25)} <button>OK</button></div>",
            "notice": lambda: f"<div class=notice>{self.shown(6, 25)}</div>",
            "ad": lambda: f"<div class=ad>{self.shown(3, 15)}</div>",
            "advert": lambda: f"<div class=advert><p>{self.shown(3, 25)}</p></div>",
            "sponsored": lambda: f"<section class=sponsored><a href='/x'>{self.shown(3, 15)}</a></section>",
            "form": lambda: f"<form><label>{self.shown(1, 4)}</label><input name=q><button>{self.shown(1, 2)}</button></form>",
            "newsletter": lambda: f"<div class=newsletter><h3>{self.shown(2, 5)}</h3><form><p>{self.shown(4, 14)}</p><input></form></div>",
            "comments": lambda: "<section id=comments><h2>Comments</h2>" + "".join(f"<div class=comment><b>{self.shown(1, 2)}</b><p>{self.shown(4, 60)}</p></div>" for _ in range(self.draw.randint(1, 5))) + "</section>",
            "related": lambda: f"<div class=related><h3>More</h3>{self.links(3, 9)}</div>",
            "script": lambda: "<script>var t='</p><p>';</script><style>p{margin:0}</style><!-- note -->",
        }[kind]()

    def build(self):
        blocks = [self.text(2, 8)]
        parts = [f"<h1>{html.escape(blocks[0])}</h1>"]
        for _ in range(self.draw.choice([1, 2, 3, 5, 8, 15])):
            kind = self.draw.random()
            own = [self.text(1, 10) for _ in range(3)] if kind > 0.85 else [self.text(2, 6)] if kind > 0.75 else [self.text(*self.draw.choice([(1, 4), (5, 20), (20, 60), (60, 150)]))]
            blocks += own
            shown = [html.escape(b) for b in own]
            parts.append("<ul>" + "".join(f"<li>{b}" for b in shown) + "</ul>" if kind > 0.85 else f"<h2>{shown[0]}</h2>" if kind > 0.75 else f"<p>{shown[0]}</p>")
        every = ["nav", "menu", "header", "footer", "site footer", "aside", "sidebar", "cookies", "notice", "ad", "advert", "sponsored", "form", "newsletter", "comments", "related", "script"]
        for kind in ("aside", "ad", "advert", "sponsored", "newsletter", "comments", "related", "script", "form"):
            if self.draw.random() < 0.12:
                parts.insert(self.draw.randint(1, len(parts)), self.decoration(kind))
        before = [self.decoration(k) for k in every if k not in ("footer", "site footer", "comments") and self.draw.random() < 0.25]
        after = [self.decoration(k) for k in every if k not in ("nav", "menu", "header") and self.draw.random() < 0.25]
        self.draw.shuffle(before)
        self.draw.shuffle(after)
        wrapper = self.draw.choice(WRAPPERS)
        inner = f"<{wrapper}>{''.join(parts)}</{wrapper.split()[0]}>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("start", [0, 300])
def test_generated_layouts(start):
    wrong = []
    for seed in range(start, start + 300):
        page, wanted = Page(seed).build()
        if html_extract.extract(page) != wanted:
            wrong.append(seed)
    assert not wrong
