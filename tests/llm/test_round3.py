"""Alignment, hard negatives and main texts against plain Python and SQL, odd rows included."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import align, crf, layouts, negatives, quality, queries, toxicity, webpages
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "foo\n bar", "foo\n  \n bar", "x▁ y", "▁", "a ▁b", "tab\t q", "日本 ﬁ 語", "é é", "a\x00b", "<s> hi </s><|endoftext|> x", "　 z", "don't  we'll    x",
    "x" * 5000, "\n" * 300 + " k", "a" + " " * 100 + "b", "😀 😀😀", "\x1c a", "q\x85 r", "1234567 89 ,.;", "a", "a", "word " * 4000]


def aligned(texts):
    """What the query gives, by the libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    rows, held = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        ab = [bytes(letter[c] for c in a_model.id_to_token(x)) for x in a]
        bb = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            rows.append(None)
            continue
        ea, eb = (list(itertools.accumulate(map(len, x))) for x in (ab, bb))
        links = []
        for i in range(len(a)):
            for j in range(len(b)):
                if max(ea[i] - len(ab[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j]):
                    links.append((a[i], b[j]))
        cuts = sorted(set(ea) & set(eb))
        groups = [",".join(str(x) for x, e in zip(a, ea, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb, strict=True) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(links))
    top: dict = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == top[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in rows]


@pytest.mark.parametrize("heads", [1_000_000, 40])
def test_alignment_equals_plain_loops(spark, heads):
    rng = random.Random(3)
    texts = [t if t is None or len(t) < 6000 else "word " * 300 for t in ODD]
    texts += ["".join(rng.choice("ab  \n.é日▁'1") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, pairs int")
    got = align.alignment(docs, A, B, heads=heads)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(aligned(texts))
    assert align.alignment(docs.limit(0), A, B, heads=heads).collect() == []


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_alignment(spark, SF).collect()}
    rows = [r for r in docs.collect() if len(r["text"] or "") < 3000]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=B)
    assert len(got) == docs.count()
    for r in rows[:60]:
        assert got[r["doc_id"]][1] == len(model.encode(r["text"])) and got[r["doc_id"]][3] == sum(got[r["doc_id"]][:2]) - got[r["doc_id"]][2]


def test_long_runs_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "ab" * 300_000), (2, "x " * 200_000), (3, "\n" * 100_000)], "doc_id long, text string")
    got = {r[0]: r for r in align.alignment(docs, A, B).collect()}
    assert got[1]["n_groups"] and got[2]["n_a"] >= 200_000 and got[3]["n_b"] > 0


def mined(rows, k_pos=5, k=5, low=80):
    """rows: (id, label, vector), those that take part."""
    q = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows]
    out = []
    for at, (i, lab, v) in enumerate(q):
        if i % 100:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other, n) for n, (j, other, w) in enumerate(q))
        for score, j, _, _ in [x for x in s if x[2] == lab and x[3] != at][:k_pos]:
            fit = [x for x in s if x[2] != lab and low * -score <= 100 * -x[0] <= 100 * -score][:k]
            out += [(i, j, r, x[1], -score, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_negatives_equal_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "GROUP", 90)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "FEW", 1)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 6)) * scale
    v[200:400] = v[100] * 0.95  # a hot vector: ties by id
    v[5] = 0
    rows = [(k, int(k * 7 % 3), v[k].tolist()) for k in range(700)]
    odd = [(701, None, v[1].tolist()), (702, 1, None), (703, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (704, 1, [float("nan")] * 6), (705, 1, [float("inf")] * 6), (706, 1, []), (None, 1, v[2].tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, q string")
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 100 == 0, F.col("label")).collect()))
    assert got == mined(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0, F.col("label")).collect() == []


def test_negatives_equal_sql(spark):
    assert differences(queries.op12_negatives(spark, SF), connect(SF), queries.SQL["op12_negatives"]) == ""


def test_repeated_rows_are_rows(spark):
    v = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (3, 2, [0.9, 0.1]), (3, 2, [0.9, 0.1])]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<float>")
    got = sorted(tuple(r)[:4] for r in negatives.hard_negatives(df, F.col("id") % 100 == 0, F.col("label")).collect())
    assert got == [(100, 100, 1, 3), (100, 100, 1, 3), (100, 100, 2, 3), (100, 100, 2, 3)]


def article(page: str) -> str:
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", re.search("<article>(.*?)</article>", page, re.S)[1])).split())


@pytest.fixture(scope="module")
def chain(spark):
    return webpages.fit(spark.read.parquet(f"{SF}/pages.parquet"), sample=30, anew=900)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op13_webpages(spark, SF).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_held_out_layouts(chain):
    """Layouts drawn with other seeds and other texts than the fitted ones."""
    e, right, blocks, hit = webpages.Extractor(chain), 0, 0, 0
    for k in range(300):
        found = webpages.leaves(layouts.page(list(layouts.PROSE) * 2, 555_000 + k))
        want = [int(layouts.MARK in t) for _, t, _ in found]
        got = e.label([(p, t.replace(layouts.MARK, "") or "-", n) for p, t, n in found])
        right, blocks, hit = right + (got == want), blocks + len(want), hit + sum(a == b for a, b in zip(got, want, strict=True))
    assert right >= 240 and hit >= 0.98 * blocks


def test_known_pages(spark, chain):
    page = """<div class="cookie-notice">We use cookies. <button>OK</button></div><nav><a href=1>One</a> <a href=2>Two</a></nav><div class="content"><h1>A  title&nbsp;here</h1>
<p>Some <b>te</b>xt of an article with &lt;tags&gt; &amp; &eacute;, it goes on.<script>no()</script><div class="ad">Buy now!</div><p>More text
follows in this one.</div><section class="comments"><p>I liked this very much, thanks.</p></section><footer>&copy; 2020</footer>"""
    df = spark.createDataFrame([(1, "u", page, "x"), (1, None, None, "y"), (None, "v", "", "z"), (2, "w", "<p>" * 2000 + "&am", "q"), (3, "w", "<p>A long page.</p>" * 20_000, "q")], "page_id long, url string, html string, text string")
    out = webpages.extract(df.select("page_id", "html"), chain).collect()
    assert out[0]["text"] == "A title here Some text of an article with <tags> & é, it goes on. More text follows in this one."
    assert [r["text"] for r in out[1:3]] == ["", ""] and len(out[4]["text"]) == 20_000 * 13 - 1
    marked = webpages.blocks(df, chain).where("page_id = 1").orderBy("block").collect()
    assert [r["block"] for r in marked] == list(range(len(marked))) and " ".join(r["text"] for r in marked if r["is_main"]) == out[0]["text"]
    assert webpages.main_text(df).columns == ["page_id", "url", "text", "n_chars"] and webpages.main_text(df.limit(0)).collect() == []


def test_field_against_all_sequences():
    rng = np.random.default_rng(2)
    chain = crf.Chain(rng.normal(size=5), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    feats = [[[0, 1], [2], [], [3, 4]], [[1]], [[2, 3], [0]]]
    gold = [[0, 1, 1, 0], [1], [0, 1]]

    def score(f, y):
        return sum(chain.weight[x].sum() * t for x, t in zip(f, y, strict=True)) + sum(chain.step[a, b] for a, b in itertools.pairwise(y)) + chain.ends[0, y[0]] + chain.ends[1, y[-1]]

    def likelihood():
        return sum(score(f, y) - np.log(sum(np.exp(score(f, z)) for z in itertools.product((0, 1), repeat=len(f)))) for f, y in zip(feats, gold, strict=True))

    flat = [x for f in feats for x in f]
    feature = np.array([i for x in flat for i in x])
    place = np.array([k for k, x in enumerate(flat) for _ in x])
    start, label = np.cumsum([0, *map(len, feats)]), np.array([t for y in gold for t in y])
    value, g = crf.gradients(chain, feature, place, start, label)
    assert value == pytest.approx(likelihood())
    for name in ("weight", "step", "ends"):
        a = getattr(chain, name)
        for i in np.ndindex(a.shape):
            a[i] += 1e-6
            up = likelihood()
            a[i] -= 2e-6
            down = likelihood()
            a[i] += 1e-6
            assert getattr(g, name)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    for f in feats:
        best = max(itertools.product((0, 1), repeat=len(f)), key=lambda y: score(f, y))
        assert tuple(crf.viterbi(chain, [chain.weight[x].sum() for x in f])) == best


def test_other_names_of_id_and_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"]: r["kept"] for r in quality.resample(docs, labels).collect()}
    named = labels.withColumnsRenamed({"doc_id": "x", "quality": "good"})
    got = quality.resample(docs.withColumnsRenamed({"doc_id": "x", "text": "body"}), named, "x", "body", label="good")
    assert got.columns[0] == "x" and {r["x"]: r["kept"] for r in got.collect()} == want
    assert quality.accepted(docs.withColumnRenamed("doc_id", "x"), named, "x", label="good").count() == sum(want.values())


def test_a_hot_labelled_id_does_not_grow_the_sample(spark, monkeypatch):
    seen = []
    fit = toxicity.Machine.fit
    monkeypatch.setattr(toxicity.Machine, "fit", lambda self, term, off, label, *a, **b: (seen.append(len(label)), fit(self, term, off, label, *a, **b)))
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("same id text "), F.col("id") % 900).alias("text"))
    docs = docs.union(spark.range(2, 200).select("id", F.concat(F.lit("word"), F.col("id") % 7, F.when(F.col("id") % 2 == 0, " bad").otherwise(" fine"))))
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2 == 0).cast("int"))
    toxicity.learn(docs, labels, F.lit(True), sample=300)
    assert 100 < seen[0] <= 300


def test_texts_without_id_are_scored_in_all_parts(spark, monkeypatch):
    from ledgerlark.llm import lm

    rows = [(None if i % 3 else 7, f"text {i} of {i % 11} words " + "tail " * (i % 5)) for i in range(300)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for n in (1, 8):
        monkeypatch.setattr(lm, "parts_of", lambda *_, n=n: n)
        got = lm.score_texts(docs, F.lit(True))
        assert n == 1 or got.groupBy(F.spark_partition_id().alias("part")).agg(F.max("score")).count() > 4
        seen.append(sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in got.collect()))
    assert len(seen[0]) == len(rows) and seen[0] == seen[1]
