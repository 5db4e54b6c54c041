"""Hard negatives, url filters and token alignment against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark import cloudpickle
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import alignment, hyperplanes, queries, urls
from llm.common import table

A, B = str(tokenizer_file("byte_bpe_50k.json")), str(tokenizer_file("piece_bpe_32k.model"))


# -- hard negatives ---------------------------------------------------------------------------------------------


def negatives_by_scan(rows, step=50):
    """Every anchor against every row; ``rows`` are (id, label, vector)."""
    known = [
        (k, i, label, [math.floor(256 * float(c)) for c in v])
        for k, (i, label, v) in enumerate(rows)
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    score = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    first = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, i, label, v in known:
        if i is None or i % step:
            continue
        near = sorted(((score(v, y), j) for u, j, m, y in known if u != k and m == label), key=first)[:5]
        far = sorted(((score(v, y), j) for u, j, m, y in known if m != label), key=first)
        for s, j in near:
            fit = [n for n in far if 50 * s <= 100 * n[0] <= 95 * s][:3]
            out += [(i, j, r + 1, n[1], s, n[0]) for r, n in enumerate(fit)]
    return sorted(out, key=str)


def mined(df, step=50):
    rows = hyperplanes.hard_negatives(df, F.col("vec_id") % step == 0).collect()
    return sorted((tuple(r) for r in rows), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, uid string, query string, q int"


def test_hard_negatives_equal_a_scan(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = [(r.vec_id, r.label, r.embedding) for r in table(spark, sf_dir, "embeddings").withColumn("label", label).collect()]
    got = sorted((tuple(r) for r in queries.op11_hard_negatives(spark, sf_dir).collect()), key=str)
    assert got and got == negatives_by_scan(rows)


def test_hard_negatives_of_hostile_rows(spark, monkeypatch):
    monkeypatch.setattr(hyperplanes, "LEAF", 24)
    monkeypatch.setattr(hyperplanes, "BLOCK", 16)
    monkeypatch.setattr(hyperplanes, "SAMPLE", (500, 1 << 20))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    rows = []
    for k in range(900):
        v = centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0, 0.05, 0.4])
        rows.append((k, [float(np.float32(c)) for c in v / np.linalg.norm(v)], int(rng.integers(3))))
    same = rows[5][1]
    rows += [(2000 + k, same, k % 4) for k in range(150)]  # a large group of copies, with ties
    rows += [
        (3000, None, 1), (3050, [], 1), (3100, [0.0] * 6, 1), (3150, [math.nan] * 6, 1), (3200, [math.inf] + [0.0] * 5, 1),
        (3250, [None, 1.0] + [0.0] * 4, 1), (3300, same, None), (3350, [0.5, 0.5], 2), (None, same, 0), (3400, [3.0] * 6, 0),
    ]
    rows += [rows[50], rows[50], rows[60]]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(7)
    padded = [(i, label, v and [*v, *[0.0] * (6 - len(v))] if v is not None else None) for i, v, label in rows]
    assert mined(df) == negatives_by_scan([(i, label, v if v != [] else [0.0] * 6) for i, label, v in padded])


def test_the_tree_leaves_rows_out_and_its_ranges_hold(spark, monkeypatch):
    monkeypatch.setattr(hyperplanes, "LEAF", 32)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 100
    x = np.floor(centres[rng.integers(40, size=2000)] + rng.normal(size=(2000, 8))).astype("<i4")
    tree = hyperplanes.Tree(x, len(x), float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max())))
    leaf = tree.leaf_of(x)
    for k in np.unique(leaf):
        for n, i, j, lo, hi in tree.ranges(int(k), x[leaf == k]):
            tree.nodes[n].low[i, j], tree.nodes[n].high[i, j] = min(lo, tree.nodes[n].low[i, j]), max(hi, tree.nodes[n].high[i, j])
    visited = 0
    for q in x[:40].astype(np.float64):
        scores = x @ q
        lo, hi = np.quantile(scores, 0.97), np.quantile(scores, 0.99)
        reached = tree.reached(q, [(int(lo), int(hi))])
        assert set(leaf[(scores >= int(lo)) & (scores <= int(hi))]) <= set(reached)
        visited += len(reached)
    assert visited < 0.5 * 40 * len(tree.paths)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(50, None, 1, "", "", 0), (100, [1.0], None, "", "", 0)], VECTORS)) == []


def test_components_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="does not fit"):
        mined(spark.createDataFrame([(50, [1e30], 1, "", "", 0)], VECTORS))


# -- url filters ------------------------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules=queries.URL_RULES):
    fit = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(rule), rule, verdict))
    return max(fit, default=(0, None, None))[1:]


URLS = [
    None, "", "no url", "://", "http://", "https://A.Example.COM/En/x", "https://a.example.com/en/x?y#z", "http://www.example.com/en/", "http://x.www.example.com/en/1",
    "http://com/", "http://a.com", "http://xcom/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://a.net?/es/", "HTTP://a.net#/fr/", "x://y://z/a",
    "http://İ.org/É\n/b", "http://u:p@casino-slots.example.org:80/win", "http://" + "a." * 3000 + "org/" + "b/" * 60_000, "http://\u2028x.org/a",
]


def test_urls_by_rule_and_model(spark):
    rows = [(k, u, "h", 1.5) for k, u in enumerate(URLS)] + [(3, URLS[3], "h", 1.5)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, c0 double").repartition(3)
    got = urls.filtered(df, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "c0", "host", "path", "rule", "verdict", "score"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path) == parts(r.url) and 0 <= r.score <= 1 and r.c0 == 1.5
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert {r.verdict for r in rows if r.url in (None, "", "no url", "://")} == {"allow"}


def test_longest_rule_wins_and_blocking_ties():
    rules = urls.Rules([("allow", "a.org"), ("block", "a.org/x/y"), ("allow", "b.a.org/x"), ("allow", "c.org/"), ("block", "c.org/"), ("block", "org/x/y/z")])
    assert rules.fitting("a.org", "") == ("a.org", "allow")
    assert rules.fitting("b.a.org", "/x/y") == ("b.a.org/x", "allow")  # both rules have nine characters, this one the longer host
    assert rules.fitting("c.org", "/") == ("c.org/", "block")
    assert rules.fitting("z.org", "/x/y") is None
    with pytest.raises(ValueError, match="not a verdict"):
        urls.Rules([("maybe", "a.org/")])


def test_model_equals_plain_recount_and_holds_out():
    hosts, paths, y = zip(*[(*parts(u), y) for u, y in urls.labelled_urls()], strict=True)
    model = urls.Model()
    model.fit(list(hosts), list(paths), np.array(y, np.float64))

    def place(gram, salt, n):  # the hash, one code point at a time
        h = salt * 31 + n
        for c in gram:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        return (h >> 20) % urls.BUCKETS

    for host, path in [("a-b.org", "/x"), ("é", ""), ("", "/" + "long/" * 90), ("", "")]:
        z = model.bias
        for salt, text in enumerate((host, path)):
            grams = [(f"\x02{text}\x03"[k : k + n], n) for n in urls.GRAMS for k in range(len(text) + 3 - n)] if text else []
            z += sum(model.weights[place(g, salt, n)] for g, n in grams) * min(urls.SHARE, len(grams) ** -0.5 if grams else 1)
        assert abs(model.logits([host], [path])[0] - z) < 1e-9
    unseen = [(*parts(u), y) for u, y in urls.labelled_urls(seed=77)]
    right = (model.logits([h for h, _, _ in unseen], [p for _, p, _ in unseen]) >= 0) == np.array([y for *_, y in unseen])
    assert right.mean() > 0.98


def test_labelled_tables_of_other_kinds(spark):
    df = spark.createDataFrame([(1, "http://qqq.org/"), (2, "http://zzz.org/")], "page_id long, url string")
    labelled = spark.createDataFrame([("http://qqq.org/a", 1), ("http://zzz.org/b", 0), (None, 1), ("http://x.org", None), ("http://y.org", 7)], "url string, label int")
    assert {r.page_id: r.verdict for r in urls.filtered(df, [], labelled).collect()} == {1: "block", 2: "allow"}
    for rows, verdict in ((labelled.where("label = 1"), "block"), (labelled.where("false"), "allow")):
        assert {r.verdict for r in urls.filtered(df, [], rows).collect()} == {verdict}
    assert urls.filtered(df.where("false"), []).count() == 0


def test_unwanted_hosts_of_the_pages(spark, sf_dir):
    rows = queries.op12_url_filter(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "pages").count()
    unwanted = re.compile(r"(casino|pills|bets|adult|ads|spam)-|-(pills|bets)")
    for r in rows:
        rule, verdict = rule_of(r.host, r.path)
        assert (r.rule, r.verdict) == (rule, verdict or ("block" if unwanted.search(r.host) else "allow"))


# -- token alignment --------------------------------------------------------------------------------------------


def aligned_by_hand(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=B)
    byte_of = {c: b for b, c in alignment._byte_letters().items()}
    docs, counts = [], Counter()
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        of_a = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        of_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(of_a) == b"".join(of_b) == f" {text}".encode():
            continue
        end_a, end_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        links, groups, i, j, x, y = [], [], 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = x + [a[i]] * (not x or i != last_i), y + [b[j]] * (not y or j != last_j)  # noqa: F821
            last_i, last_j = i, j
            ea, eb = end_a[i], end_b[j]
            i, j = i + (ea <= eb), j + (eb <= ea)
            if ea == eb:
                groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                x, y = [], []
        docs[-1] = len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest()
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d[0], d[1], d[2], len(d[3]), sum(counts[k] == best[k[1]] for k in d[3]), sum(counts[k] for k in d[3]), d[4]) if d else (0, 0, 0, 0, 0, 0, "")
        for d in docs
    ]


TEXTS = [
    None, "", " ", "  ", "a ▁ b", "x▁y z", "a  b\tc\n\nd \x00 e <|endoftext|> <s></s><unk> ﬁ é e\u0301 İ \u00a0\u2028 x\u200b 😀 👩\u200d👩\u200d👧", "x" * 70_000, "  lead", "trail  ",
    "it's I'll 'tis don' t", "日本語 テキスト 中文", "\x1c a\x1f b", "a\u00a0b", "1 23 456 7890", "\r\n a\r\nb", "word " * 9000, "<0x41> <s> a", "\ufeff a", "ab" * 9000 + " c",
]


@pytest.mark.parametrize("settings", [{}, {"BATCH": 3000, "PAIRS": 50, "BROADCAST_PAIRS": 0, "_LINE": 2}])
def test_alignment_equals_a_walk_over_both_sides(spark, sf_dir, monkeypatch, request, settings):
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    if settings:
        cloudpickle.register_pickle_by_value(alignment)  # tasks see the settings
        request.addfinalizer(lambda: cloudpickle.unregister_pickle_by_value(alignment))
    rows = [(k, t, 7, "p") for k, t in enumerate(TEXTS)] + [(6, TEXTS[6], 7, "p"), (None, TEXTS[10], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string")
    df = df.unionByName(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(7).alias("n_a"), F.lit("p").alias("pairs")).limit(60)).repartition(4)
    got = alignment.alignments(df, A, B)
    assert got.columns == ["doc_id", "pairs", *alignment.COLUMNS]
    texts = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((i, *w) for (i, _), w in zip(texts, aligned_by_hand([t for _, t in texts]), strict=True)), key=str)
    assert sorted(((r.doc_id, *(r[c] for c in alignment.COLUMNS)) for r in got.collect()), key=str) == want


def test_alignment_of_nothing(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    only = alignment.alignments(spark.createDataFrame([(None,)], "text string"), A, B).collect()
    assert [tuple(r) for r in only] == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_refuses_other_tokenizers():
    with pytest.raises(ValueError, match="not a plain byte-level"):
        alignment.Side(str(tokenizer_file("word_bpe_49k.json")))
