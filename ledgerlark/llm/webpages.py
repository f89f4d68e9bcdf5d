"""The main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two tags that aren't inline. Its features are the tags and the class, id and role words of
its ancestors, and its text: length, share of links, how it ends, signs. The labels of a page's blocks are found by Viterbi.

The field is fitted on labelled pages: at most SAMPLE rows that have an article element, chosen by a hash. Their blocks
are labelled by it, and the texts are also laid out anew by templates (`layouts`) whose labels are known, so that the
field knows pages that name their parts otherwise, or not at all.

Defined cases: a null or empty page, and one without text, gives an empty text; the rows of the table are independent, so null,
repeated and clashing columns change nothing; an empty table gives no rows; without labelled pages, templates are filled
with the texts of any pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, layouts
from .shared import bare, small_batches

#: Labelled pages to fit on, their longest html in characters (longer ones are not picked), and pages laid out anew.
SAMPLE, LONGEST, ANEW = 150, 100_000, 1500
WIDTH = 1 << 14

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template svg math iframe object canvas audio video noscript".split())
#: What a start tag closes, up to the nearest of the tags that bound it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Tags that say what a part of a page is.
TELLING = frozenset("article aside footer form header main nav".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


class Leaves(HTMLParser):
    """blocks: (path, text, characters within links) of the leaf blocks in page order. A path has the tags and names of the ancestors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int]] = []
        self.stack: list[tuple[str, str]] = []
        self.path, self.parts, self.linked = "", [], 0
        self.link = self.unseen = -1  # depth of the stack where a link, or what is not shown, began

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.path, text, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, depth: int) -> None:
        self.flush()
        del self.stack[depth:]
        self.path = self.stack[-1][1] if self.stack else ""
        if self.link > depth:
            self.link = -1
        if self.unseen >= depth:
            self.unseen = -1

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "a":
                self.link = len(self.stack)
            return
        self.flush()
        if tag in VOID or tag in ("html", "body") and any(t == tag for t, _ in self.stack):
            return
        shut, bound = CLOSES.get(tag, ({"p"}, {"button", "td", "th", "li", "article", "section"}))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in shut:
                self.pop(k)
                break
            if self.stack[k][0] in bound:
                break
        names = sorted({w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v)})
        if any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs):
            names.append("unseen")
        self.path = f"{self.path}>{tag}.{'.'.join(names)}" if names else f"{self.path}>{tag}"
        self.stack.append((tag, self.path))
        if tag in UNSEEN and self.unseen < 0:
            self.unseen = len(self.stack) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if tag in INLINE:
            if tag == "a":
                self.link = -1
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag not in ("html", "body"):
                    self.pop(k)
                break
        self.flush()

    def handle_comment(self, data):
        pass

    def handle_data(self, data):
        if self.unseen < 0:
            self.parts.append(data)
            if self.link >= 0:
                self.linked += len(data)


def leaves(html: str | None) -> list[tuple[str, str, int]]:
    parser = Leaves()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def look(text: str, linked: int) -> tuple:
    """What the features of a text depend on: a bounded number of cases."""
    n = text.count(" ") + 1
    end = text[-1]
    return (min(n.bit_length(), 8), min(4, round(4 * linked / len(text))), end if end in ".!?:…»”\"" else "w" if end.isalpha() else "d" if end.isdigit() else "s",
        "©" in text or "(c)" in text, "@" in text or "http" in text, min(text.count(","), 3), text[0].isupper(), text.isupper())


def features(path: str, seen: tuple) -> list[int]:
    """Hashed features of a block."""
    nodes = [x.split(".") for x in path.split(">") if x]
    names = {f"in={n[0]}" for n in nodes} | {f"name={w}" for n in nodes for w in n[1:]} | {f"t{k}={n[0]}" for k, n in enumerate(reversed(nodes[-3:]))}
    near = next((n for n in reversed(nodes) if len(n) > 1 or n[0] in TELLING), ["none"])
    names |= {f"near={x}" for x in near} | {f"near={near[0]}/{nodes[-1][0] if nodes else ''}"}
    names |= {f"x{k}={v}" for k, v in enumerate(seen)} | {f"{nodes[-1][0] if nodes else ''}/{seen[0]}", f"{seen[0]}/{seen[1]}", "any"}
    return sorted({zlib.crc32(x.encode()) % WIDTH for x in names})


#: Tags within an article that hold no part of it, for labels of real pages.
OTHER = re.compile(r">(nav|aside|footer|form|figure|button|select|textarea)\b|\b(ad|ads|advert|comment|comments|related|share)\b")


def labelled(html: str) -> tuple[list, list[int]] | None:
    """Blocks of a page and 1 where they are of its article; None where it has no article element."""
    blocks = leaves(html)
    own = [int(">article" in p and not OTHER.search(p[p.index(">article") :])) for p, _, _ in blocks]
    return (blocks, own) if any(own) else None


def picked(few: DataFrame, order: list, sample: int) -> list[str]:
    """About `sample` pages, first by their hash. A threshold on the hash keeps nearly all others from the driver."""
    share = min(1.0, (2 * sample + 100) / max(few.count(), 1))
    near = few.where(F.pmod(order[0], F.lit(1 << 30)) < int(share * (1 << 30)))
    return [r[0] for r in near.orderBy(*order).limit(sample).collect()]


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE, anew: int = ANEW, seed: int = 7) -> crf.Chain:
    """A field fitted on at most `sample` labelled pages and `anew` pages laid out with their texts."""
    few = bare(pages, html=html).where(F.col("html").isNotNull() & (F.length("html") <= LONGEST))
    order = [F.xxhash64("html", F.lit(seed)), F.col("html")]
    marked = few.where(F.col("html").rlike("(?i)<article[\\s>]"))
    rows = picked(marked, order, sample)
    known = [x for x in map(labelled, rows) if x]
    if not known:
        rows = picked(few, order, sample)
        known = [(b, [int(len(t) > 80) for _, t, _ in b]) for b in map(leaves, rows) if b]
    texts = [t for b, own in known for (_, t, _), y in zip(b, own, strict=True) if y] or list(layouts.PROSE)
    sequences = list(known)
    for k in range(anew):
        blocks = leaves(layouts.page(texts, seed * 1_000_003 + k))
        sequences.append((blocks, [int(layouts.MARK in t) for _, t, _ in blocks]))
    memo: dict = {}
    feature, place, start, label = [], [], [0], []
    for blocks, own in sequences:
        if not blocks:
            continue
        for (path, text, linked), y in zip(blocks, own, strict=True):
            key = (path, look(text.replace(layouts.MARK, "") or "-", linked))
            if key not in memo:
                memo[key] = features(*key)
            ids = memo[key]
            feature += ids
            place += [len(label)] * len(ids)
            label.append(y)
        start.append(len(label))
    return crf.fit(np.array(feature, np.int64), np.array(place, np.int64), np.array(start, np.int64), np.array(label, np.int64), WIDTH)


class Extractor:
    """Labels the blocks of pages by a fitted field."""

    def __init__(self, chain: crf.Chain):
        self.chain, self.memo = chain, {}

    def score(self, path: str, seen: tuple) -> float:
        key = (path, seen)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = float(self.chain.weight[features(path, seen)].sum())
        return self.memo[key]

    def label(self, blocks: list) -> list[int]:
        return crf.viterbi(self.chain, [self.score(p, look(t, n)) for p, t, n in blocks])

    def text(self, html: str | None) -> str:
        blocks = leaves(html)
        return " ".join(t for (_, t, _), y in zip(blocks, self.label(blocks), strict=True) if y)


def extract(pages: DataFrame, chain: crf.Chain, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(shared.value)
        for b in batches:
            yield b.map(extractor.text)

    return pages.withColumn(name, run(F.col(html)))


def blocks(pages: DataFrame, chain: crf.Chain, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, block (from 0), path, text, is_main of every leaf block."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        extractor = Extractor(shared.value)
        for b in batches:
            at, out = [], []
            for k, html_ in enumerate(b.column(1).to_pylist()):
                found = leaves(html_)
                out += [(i, p, t, bool(y)) for i, ((p, t, _), y) in enumerate(zip(found, extractor.label(found), strict=True))]
                at += [k] * len(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.bool_())))], ["id", "block", "path", "text", "is_main"])

    kind = pages.schema[id].dataType.simpleString()
    return bare(pages, id=id, html=html).mapInArrow(run, f"id {kind}, block int, path string, text string, is_main boolean").withColumnRenamed("id", id)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars. The field is fitted on labelled rows of pages."""
    own = bare(pages, id=id, url=url, html=html)
    out = extract(own, fit(own)).select("id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    return out.withColumnsRenamed({"id": id, "url": url})
