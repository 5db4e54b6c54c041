"""Operators of the llm package against plain Python, the tokenizers' own libraries and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark import cloudpickle
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from llm import classifier, html, minhash, mixing, pieces, pivots, quality, queries, sharding, suffix, tokens
from llm.common import components, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, SP = str(tokenizer_file("word_bpe_49k.json")), str(tokenizer_file("piece_bpe_32k.model"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def made():
    """Rows with NULLs, empty, short and long texts, exact and near copies, repeated rows and shared passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßn") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [None, "", " \n\t", "one", "a b c d", "A B c d", "x" * 900, "ab" * 400, prose(9000), "<|endoftext|> It's\n\nİ ▁ ﬁn"]
    for k in range(90):
        base = prose(rng.randint(15, 250))
        texts.append(base + (f"\n{rng.choice(shared)} " if k % 3 == 0 else ""))
        if k % 6 == 0:
            words = base.split(" ")
            words[len(words) // 2] = "changed"
            texts += [base, base.upper() if base.isascii() else base, " ".join(words)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[30], "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, made):
    return spark.createDataFrame(made, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_of_quality_rules(docs, made):
    got = {(r.doc_id, r.text): r._quality for r in quality.judged(docs).collect()}
    for doc_id, text, *_ in made:
        found, q = WORDS.findall(text or ""), got[doc_id, text]
        grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        want = (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (q.base_failed and q.kept)


def test_fences_equal_exact_quartiles(spark):
    rows = [(i, " ".join(["abcde"] * 3 + [f"w{k}" for k in range(30)] + ["#"] * (i % 7)), "en", "s") for i in range(300)]
    rows.append((999, " ".join(f"x{k}" for k in range(40)) + " ### $$$" * 40, "en", "s"))
    got = {r.doc_id: r._quality for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    rates = sorted(q.symbol_rate for q in got.values())
    q1, q3 = rates[-(-len(rates) // 4) - 1], rates[-(-3 * len(rates) // 4) - 1]
    edge = lambda v: v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7)
    fence = edge(q3) + max(4 * (edge(q3) - edge(q1)), quality.RATES["symbol_rate"][0])
    assert all(q.kept == (not q.base_failed and q.symbol_rate <= fence) for q in got.values() if q.dup_line_rate == 0)
    assert not got[999].kept


def test_repeated_passages(docs, made):
    data = [(t or "").encode() for _, t, *_ in made]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    got = sorted((r.doc_id is None, r.doc_id or 0, r._cut.n_bytes, r._cut.n_removed, r._cut.n_spans, r._cut.kept_sha256) for r in suffix.without_repeats(docs).collect())
    want = []
    for (doc_id, *_), b in zip(made, data, strict=True):
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        rest = bytes(np.frombuffer(b, np.uint8)[gone[: len(b)] == 0])
        want.append((doc_id is None, doc_id or 0, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), sha256(rest).hexdigest()))
    assert got == sorted(want)


def test_repeated_passages_across_segments(docs, made, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 450)
    monkeypatch.setattr(suffix, "_powers", [])
    cloudpickle.register_pickle_by_value(suffix)  # so that tasks see the smaller segments
    try:
        test_repeated_passages(docs, made)
    finally:
        cloudpickle.unregister_pickle_by_value(suffix)


def test_token_counts(docs):
    library, machine = Tokenizer.from_file(BPE), tokens.compiled(BPE)
    for r in tokens.token_counts(docs, BPE).collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
        assert machine.count(text, 7) == n  # chunk maps compose to the same count


@pytest.mark.parametrize("around", ["{}b", "7{}!"])
def test_token_counts_of_every_code_point(around):
    library, machine = Tokenizer.from_file(BPE), tokens.Transducer(BPE)
    texts = [around.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        want = [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
        assert [t for t, n in zip(part, want) if machine.count(t) != n] == []


PAGE = (
    '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div>'
    "<article><h1>Head &amp; line</h1><p>One <b>two</b><br>three&nbsp;four<p>a &lt; b<script>var x='</p>'</script>"
    '<section class="comments"><p>First!</p></section></article><aside>More</aside><form><p>f</p></form><footer>&copy;</footer>'
)
SITE = "<html><body><div><div><p>Our shop since 1990</p></div><div><h1>{0}</h1><p>story {0} tells {0} {0}</p></div></div></body></html>"


def test_main_text(spark):
    rows = [(1, "http://a.example/x", PAGE, "kept"), (2, None, None, None), (3, "no url", "", ""), (4, "http://u@B.example:80/", "plain &#65;  text", "x")]
    rows += [(10 + i, f"https://shop.example/{i}", SITE.format(f"n{i}"), "t") for i in range(12)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "Head & line\nOne two three four\na < b"
    assert [got[2].text, got[3].text, got[4].text] == ["", "", "plain A text"]
    assert got[13].text == "n3\nstory n3 tells n3 n3"  # the line that all pages of the site share is its frame
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_copies(spark):
    page = "<html><body><div><article><h1>News</h1><p>One</p><p>Two</p><h2>More</h2><ul><li>Same</li></ul><p>End</p></article></div></body></html>"
    list_page = "<html><body><div>" + "<p>Same</p>" * 9 + "</div></body></html>"
    rows = [(i, f"http://copies.example/{i}", page) for i in range(1000)] + [(5000 + i, f"http://list.example/{i}", list_page) for i in range(20)]
    rows += [(2000 + i, f"https://shop.example/{i}", SITE.format(f"n{i % 12}")) for i in range(600)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    assert {got[i] for i in range(1000)} == {"News\nOne\nTwo\nMore\nSame\nEnd"}
    assert {got[5000 + i] for i in range(20)} == {"\n".join(["Same"] * 9)}
    assert all(got[2000 + i] == f"n{i % 12}\nstory n{i % 12} tells n{i % 12} n{i % 12}" for i in range(600))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    near = base[rng.integers(0, 40, 260)] + rng.normal(size=(260, 24)) * rng.choice([0.02, 0.06, 0.08], (260, 1))
    x = np.r_[base, near, near[:9], near[:5] * 2].astype(np.float32)
    rows = [(i + 10, [float(c) for c in v]) for i, v in enumerate(x)] + [(1, None), (2, [0.0] * 24), (3, [float("nan")] * 24), (4, [None] * 24), (5, [])]
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (y @ y.T >= pivots.COSINE) & ~np.eye(len(y), dtype=bool)
    top = np.arange(len(y))
    for _ in range(len(y)):
        top = np.minimum(top, np.where(linked, top[None], len(y)).min(axis=1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = sum(got[i + 10][0] for i in range(len(y)))
    assert found >= 0.9 * linked.sum() and all(got[i + 10][0] <= linked[i].sum() for i in range(len(y)))
    assert np.mean([got[i + 10][1] == top[i] + 10 for i in range(len(y))]) > 0.95
    assert all(got[i] == (0, i) for i in range(1, 6))
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sentence_pieces_equal_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(pieces, "DICTIONARY", 100)  # so that both ways are taken
    library = SentencePieceProcessor(model_file=SP)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["  a   b ", "é́ 中日 😀\t\r\n", "aaaa" * 90, "the " * 50])], "doc_id long, text string")
    for r in pieces.encoded(docs.select("doc_id", "text").union(odd), SP).collect():
        assert list(r.ids) == library.encode(r.text or "") and r.n_pieces == len(r.ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    back = pieces.decoded(pieces.encoded(odd, SP), SP)
    assert back.where("decoded <> text").count() == 0


def test_mix(docs, made):
    got = mixing.taken_words(docs.select("doc_id", "text", "source")).collect()
    assert len(got) == len(made)
    sizes = defaultdict(int)
    for _, text, _, source, _ in made:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, total = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in left}
        left -= full or left
    taken, by_size = defaultdict(int), {s: None for s in order}
    for r in got:
        assert r.taken <= 2 * r.size
        source = next(s for s in order if sizes[s] == r.source_size)
        assert r.target == pytest.approx(target[source])
        taken[source] += r.taken
    assert len(set(sizes.values())) == len(by_size)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 4 for s in order)
    again = mixing.taken_words(docs.repartition(3).select("doc_id", "text", "source")).collect()
    assert Counter(got) == Counter(again)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORDS.findall(r.text)) for r in mixed.collect()) == pytest.approx(sum(taken.values()), rel=0.02)


def test_mix_of_tiny_and_huge_sources(spark):
    sizes = {"a": 50_000, "b": 1, "c": 7, "d": 90, "e": 301, "f": 20_000}
    rows = [(10 * i + k, " ".join(["w"] * (n // 5 + (k < n % 5))), s) for i, (s, n) in enumerate(sizes.items()) for k in range(5)]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for slots in (4, 64):
        whole, pieces_of = mixing.mix(given, [F.col("doc_id")], F.size(F.filter(F.split("text", " "), lambda w: w != "")), F.col("source"), slots)
        target = {r.source: r.target for r in whole.collect()}
        taken, by_slot, spans = Counter(), defaultdict(set), defaultdict(list)
        for r in pieces_of.collect():
            taken[r.source] += r.last - r.first
            by_slot[r.slot].add(r.source)
            spans[r.id, r.copy, r["pass"]].append((r.first, r.last))
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes), (taken, target)
        assert len(by_slot) <= slots + len(sizes) and all(len(s) == 1 for s in by_slot.values())
        for parts in spans.values():  # without gaps or overlaps
            parts.sort()
            assert parts[0][0] == 0 and all(a < b for a, b in parts) and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_scores_on_held_out_rows(spark, sf_dir, nothing):
    documents, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = classifier.scores(documents, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unlabelled = classifier.scores(documents.limit(3), none).collect()
    assert [r.score for r in unlabelled] == [0.5] * 3
    assert classifier.scores(nothing, labels).count() == 0


def test_near_duplicates_against_brute_force(docs, made):
    sets = []
    for _, text, *_ in made:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(made)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    groups = defaultdict(list)
    for i, r in enumerate(top):
        groups[r].append(made[i][0])
    want = Counter((made[i][0], len(sets[i]), min((x for x in groups[r] if x is not None), default=None)) for i, r in enumerate(top))
    got = minhash.near_duplicates(docs.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in groups if sets[r]) + sum(not s for s in sets)


def test_shards(docs, made):
    rows = sharding.uniform_shards(docs.withColumn("shard", F.lit("x")), [F.col("doc_id"), F.xxhash64("text")]).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in made)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_matrix_follows_the_hypergeometric_law(spark):
    sizes = spark.createDataFrame([(0, 30), (1, 10), (2, 0), (3, 24)], "part long, rows long")
    cells = []
    for seed in range(25):
        rows = sharding.communication_matrix(sizes, 64, 2, 4, seed).collect()
        m = {r.part: list(r.counts) for r in rows}
        assert [sum(m[p]) for p in range(4)] == [30, 10, 0, 24] and [sum(c) for c in zip(*m.values(), strict=True)] == [16] * 4
        cells += m[0]
    assert np.mean(cells) == 7.5 and 0.8 < np.var(cells) / (30 * 0.25 * 0.75 * 34 / 63) < 1.25


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty_tables(nothing):
    assert quality.judged(nothing).count() == quality.clean_documents(nothing).count() == 0
    assert suffix.without_repeats(nothing).count() == minhash.near_duplicates(nothing).count() == minhash.deduplicated(nothing).count() == 0
    assert tokens.token_counts(nothing, BPE).count() == pieces.encoded(nothing, SP).count() == 0
    assert mixing.taken_words(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    assert sharding.uniform_shards(nothing, [F.col("doc_id")]).count() == 0


def test_clashing_columns(spark, docs):
    """Columns with the operators' own names stay what they were, or are replaced where the docstring says so."""
    own = ["gram", "rid", "data", "cid", "ids", "kept", "n", "key", "row", "size", "target", "score", "n_tokens", "_lang", "c0", "a.b"]
    wide = docs.limit(30).select("*", *[F.lit("mine").alias(c) for c in own])
    for out in (
        quality.clean_documents(wide), minhash.deduplicated(wide), mixing.mixed_documents(wide), suffix.without_repeats(wide),
        tokens.token_counts(wide, BPE), pieces.encoded(wide, SP), sharding.uniform_shards(wide, [F.col("doc_id")]),
    ):
        left = [c for c in own if c in out.columns and c not in ("ids", "n_tokens")]
        assert {"gram", "rid", "key", "a.b"} <= set(left)
        assert all(v == "mine" for r in out.select(*[F.col(f"`{c}`") for c in left]).collect() for v in r)


def test_pipeline_stages(spark, docs, made):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
    assert 0 < len(out) and all(r.n_pieces == len(r.ids) for r in out)
    assert {r.doc_id for r in out} <= {r[0] for r in made}


def test_registered():
    assert {re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES if k != "pipeline"} == set(map(str, range(1, 11)))
