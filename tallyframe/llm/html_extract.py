"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read tag by tag in one forward pass, with HTML's rules for quotes, comments and raw elements. Block
tags cut its text into leaf blocks; head, script, style, comments and other markup that shows no text of its
own are left out. A block is described by the ``AROUND`` nearest tags around it with the words of their class,
id and role, by its own tag, and by its text (length, share of link text, punctuation,
telling words), all hashed to ``FEATURES`` features. Two labels, main text or not, have weights for these and
for following each other; Viterbi decoding gives the labels. The field is trained on labelled pages: pages
built, with their labels, from the layouts of ``labelled_page``. ``SHARDS`` tasks climb the likelihood of
their part from one set of weights, which are then averaged, ``ROUNDS`` times.

The main text is the article's blocks in page order, joined by line feeds, with character references
decoded and white space inside a block turned into single spaces. Null, empty and unfinished pages, and
pages without text, are fine; without a main block the text is empty. Repeated rows repeat, extra columns
aren't read, an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

FEATURES, PAGES, SHARDS, ROUNDS, EPOCHS, RATE, DECAY = 1 << 14, 1000, 4, 3, 4, 0.5, 1e-5

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_attr = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>]*)))?")
_gap = re.compile(r"[\s/]*")
_word = re.compile(r"[a-z]+")

#: Tags inside a line of text; any other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags without an end tag, and tags that end an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
HIDDEN = frozenset("head select button".split())
#: Elements whose content is no markup or no text of the page, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template textarea title svg iframe".split()}
#: Tags around a block that describe it.
AROUND = 64


def tags(page: str) -> Iterator[tuple[str, str, bool, bool, str]]:
    """(text before, tag, is an end tag, is empty, its class, id and role) of each tag; a last one for the rest of the text.

    Each character is looked at a bounded number of times. As in browsers, a quote counts only after an equals
    sign, and a comment or tag that isn't finished takes the rest of the page.
    """
    at, start, n = 0, 0, len(page)
    text: list[str] = []
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[start:])
            yield "".join(text), "", False, False, ""
            return
        mark = page[lt + 1 : lt + 2]
        closing = mark == "/"
        name = _name.match(page, lt + 1 + closing)
        if not name and not (mark and mark in "!?/"):
            at = lt + 1  # a "<" of the text
            continue
        text.append(page[start:lt])
        if not name:
            stop = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(stop, lt + 4 if len(stop) > 1 else lt)
            at = start = end + len(stop) if end >= 0 else n
            continue
        tag, at, names = name[0].lower(), name.end(), []
        while True:
            at = _gap.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            a = _attr.match(page, at)
            at = a.end()
            if a[2] is not None and not a[3] or a[4] is not None and not a[5]:
                at = n  # a quote that isn't closed
            elif a[1].lower() in ("class", "id", "role"):
                names.append((a[2] or a[4] or a[6] or "").lower())
        if at >= n:
            yield "".join(text), "", False, False, ""
            return
        empty, at = page[at - 1] == "/", at + 1
        if tag in RAW and not closing:
            if not (tag == "svg" and empty):
                end = RAW[tag].search(page, at)
                at = (page.find(">", end.end()) + 1 if end else n) or n
            start = at
            continue
        start = at
        yield "".join(text), tag, closing, empty, " ".join(names)
        text = []


def blocks(page: str) -> list[tuple[str, list[str], float]]:
    """(text, descriptions of the nearest tags around, innermost last, share of link text) of each leaf block."""
    out: list[tuple[str, list[str], float]] = []
    stack: list[tuple[str, str]] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    link, linked = False, 0  # inside a link, characters in links

    def end_block() -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        if words and not any(open_[t] for t in HIDDEN):
            out.append((words, [d for _, d in stack[-AROUND:]], min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    for before, tag, closing, empty, names in tags(page):
        text.append(before)
        if link:
            linked += len(before.strip())
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                text.append(" ")
            continue
        end_block()
        if closing:
            while open_[tag]:
                last, _ = stack.pop()
                open_[last] -= 1
                if last == tag:
                    break
        elif tag == "body":
            stack[:] = [s for s in stack if s[0] != "head"]
            open_["head"] = 0
        elif tag and tag not in VOID and not empty:
            if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
                open_[stack.pop()[0]] -= 1
            stack.append((tag, f"{tag} {names}"))
            open_[tag] += 1
    return out


def describe(found: list[tuple[str, list[str], float]]) -> list[np.ndarray]:
    """The hashed features of each block."""
    out = []
    for text, around, links in found:
        names = {"bias", f"links{int(links * 4)}", f"length{min(8, len(text).bit_length())}", f"words{min(6, len(text.split()).bit_length())}"}
        names.add("stop" if text.rstrip("\"')]}”»")[-1:] in ".!?…:" else "nostop")
        names |= {f"has{c}" for c in "©@|•·»→" if c in text}
        for depth, d in enumerate(reversed(around)):
            tag, *rest = d.split(" ", 1)
            near = "own" if not depth else "in"
            names.add(f"{near}:{tag}")
            names |= {f"in.{w}" for w in _word.findall(rest[0])} if rest else set()
        # what stands around counts by itself, together with the block's own tag, and with the kind of text
        own = around[-1].split(" ", 1)[0] if around else ""
        names |= {f"{n}&{own}" for n in list(names) if n.startswith("in")} | {f"{n}&{int(links * 4) > 2}" for n in list(names) if n.startswith("in")}
        names.add(">".join(d.split(" ", 1)[0] for d in around[-3:]))
        low = text.lower()
        names |= {f"says:{w}" for w in ("cookie", "subscribe", "newsletter", "sign in", "log in", "advert", "sponsored", "comment", "reply", "share", "copyright", "rights reserved", "related", "read more", "privacy") if w in low}
        out.append(np.array(sorted({crc32(n.encode()) % FEATURES for n in names})))
    return out


class Field:
    """Weights of a chain of labels 0 (other) and 1 (main): ``w`` for label 1, ``t`` from label to label."""

    def __init__(self, w: np.ndarray | None = None, t: np.ndarray | None = None):
        self.w = np.zeros(FEATURES) if w is None else w.copy()
        self.t = np.zeros((2, 2)) if t is None else t.copy()

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([[0.0, self.w[f].sum()] for f in feats])

    def decode(self, feats: list[np.ndarray]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not feats:
            return []
        s, back = self.scores(feats), []
        best = s[0]
        for row in s[1:]:
            step = best[:, None] + self.t
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]

    def learn(self, feats: list[np.ndarray], labels: list[int], rate: float) -> None:
        """A step up the log likelihood of one page."""
        s = self.scores(feats)
        forward, backward = [s[0]], [np.zeros(2)]
        for row in s[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + self.t, axis=0) + row)
        for row in s[:0:-1]:
            backward.append(np.logaddexp.reduce(self.t + (row + backward[-1])[None, :], axis=1))
        backward.reverse()
        total = np.logaddexp.reduce(forward[-1])
        step = np.zeros((2, 2))
        for i, y in enumerate(labels):
            p = np.exp(forward[i][1] + backward[i][1] - total)
            self.w[feats[i]] += rate * (y - p) / len(labels) ** 0.5
            if i:
                pair = np.exp(forward[i - 1][:, None] + self.t + (s[i] + backward[i])[None, :] - total)
                step -= pair
                step[labels[i - 1], y] += 1
        self.t += rate * step / len(labels)
        self.w *= 1 - rate * DECAY


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks: the training set, one page a seed.

    Layouts vary in tags, class names, order and length; the marks of what isn't main text are those that
    templates in use have.
    """
    r = random.Random(seed)
    pick = r.choice

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("aeiourstnlmdk") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentence(low: int = 1, high: int = 30) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", "&amp;.", ", &eacute;t&#233;."])

    def text() -> str:
        return " ".join(sentence() for _ in range(r.randint(1, 6)))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(r.randint(2, 8)))

    def box(names: str, inner: str, tags: str = "div") -> str:
        tag, name = pick(tags.split()), pick(names.split())
        attr = f" {pick(['class', 'id'])}=\"{pick(['', 'site-', 'page-', 'block '])}{name}\"" if tag == "div" or r.random() < 0.3 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    main: list[str] = []

    def keep(inner: str) -> str:
        main.append(" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", inner))).split()))
        return inner

    def body() -> str:
        out = [f"<h1>{keep(words(1, 10).capitalize())}</h1>"]
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{keep(text())}</p>")
            elif kind < 0.76:
                out.append(f"<p>{keep('<em>' + sentence() + '</em> ' + text() if r.random() < 0.5 else sentence(1, 3))}{pick(['</p>', ''])}")
            elif kind < 0.82:
                out.append(f"<h2>{keep(words(1, 6).capitalize())}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{keep(sentence(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{keep(text())}</p></blockquote>")
            elif kind < 0.96:
                out.append(f'<p>{keep(words(3, 9) + " <a href=x>" + words(1, 4) + "</a> " + sentence())}</p>')
            else:
                out.append(box("ad advert advertisement sponsored promo banner", pick([text(), sentence(2, 8), links("span")]), "div aside"))
        return "".join(out)

    def comments() -> str:
        one = "".join(box("comment comment-body reply", f"<p>{text()}</p>" + pick(["", '<a href="#">reply</a>']), "div li article") for _ in range(r.randint(1, 4)))
        return box("comments comment-list discussion responses", pick(["<h3>Comments</h3>", f"<h3>{words(1, 3)}</h3>", ""]) + one, "div section")

    def form() -> str:
        return f"<form>{pick(['<p>' + text() + '</p>', '<label>' + words(1, 3) + '</label>'])}<input><button>{words(1, 2)}</button></form>"

    top = [
        box("header masthead branding top", pick([f"<p>{words(1, 6)}</p>", text(), f"<h1>{words(1, 4)}</h1>", f"<a href=/>{words(1, 3)}</a>"]), "header div"),
        box("nav menu navigation navbar breadcrumb breadcrumbs", pick([f"<ul>{links()}</ul>", links("span"), text()]), "nav nav div"),
        box("cookie cookie-notice notice consent banner alert", f"<p>{pick([text(), 'We use cookies. ' + sentence()])}</p>"),
        box("ad ads advert advertisement sponsored promo", pick([text(), f"<p>{sentence()}</p>", f"<a href=x>{words(2, 6)}</a>"]), "div div aside"),
    ]
    low = [
        box("footer bottom copyright legal", pick([f"&copy; {words(1, 3)} &middot; {text()}", f"<p>{text()}</p>", links("span")]), "footer div"),
        comments(),
        box("sidebar aside widget related recommended", pick([f"<h3>{words(1, 3)}</h3><ul>{links()}</ul>", f"<p>{text()}</p>", links("p")]), "aside div"),
        box("newsletter signup subscribe login search", form()),
        box("share social tags", links("span")),
        box("ad ads advert advertisement sponsored promo", pick([text(), f"<p>{sentence()}</p>"]), "div div aside"),
    ]
    tops, lows = r.sample(top, r.randint(1, 4)), r.sample(low, r.randint(1, 5))
    article = box("article content post entry story main-content article-body post-content", body(), "article article main div section")
    if r.random() < 0.3:
        article = box("main content wrapper container", article, "main div")
    if r.random() < 0.2:
        lows, tops = lows[1:], [*tops, lows[0]]
    inner = "".join(tops) + "<!-- note -->" + article + "".join(lows)
    page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{inner}</body></html>"
    return page, main


def labels_of(found: list[tuple[str, list[str], float]], main: list[str]) -> list[int]:
    """1 for the blocks that are the next of ``main``, in order."""
    out, k = [], 0
    for text, _, _ in found:
        hit = k < len(main) and text == main[k]
        out.append(int(hit))
        k += hit
    return out


def train(spark: SparkSession, pages: int = PAGES) -> Field:
    seeds = spark.range(0, pages, numPartitions=SHARDS)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                page, main = labelled_page(seed)
                found = blocks(page)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seed]), pa.array([[f.tolist() for f in describe(found)]], pa.list_(pa.list_(pa.int64()))), pa.array([labels_of(found, main)], pa.list_(pa.int64()))],
                    ["seed", "feats", "labels"],
                )

    rows = cut(seeds.mapInArrow(prepare, "seed long, feats array<array<long>>, labels array<long>").withColumn("shard", F.pmod("seed", F.lit(SHARDS))))
    field = Field()
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((field.w, field.t))

        def climb(pdf: pd.DataFrame) -> pd.DataFrame:
            own = Field(*shared.value)
            ready = [([np.asarray(f) for f in r.feats], list(r.labels)) for r in pdf.sort_values("seed").itertuples()]
            for e in range(EPOCHS):
                for feats, labels in ready:
                    own.learn(feats, labels, RATE / (1 + k * EPOCHS + e))
            return pd.DataFrame({"w": [own.w.tobytes()], "t": [own.t.tobytes()]})

        parts = rows.groupBy("shard").applyInPandas(climb, "w binary, t binary").collect()  # SHARDS sets of weights
        field = Field(np.mean([np.frombuffer(p["w"]) for p in parts], axis=0), np.mean([np.frombuffer(p["t"]).reshape(2, 2) for p in parts], axis=0))
    return field


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row a page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(field or train(pages.sparkSession))

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, texts = batch.slice(first, 500), []
                for page in part.column(2).to_pylist():
                    found = blocks(page or "")
                    labels = shared.value.decode(describe(found))
                    texts.append("\n".join(b[0] for b, y in zip(found, labels, strict=True) if y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: src.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return src.mapInArrow(pull, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
