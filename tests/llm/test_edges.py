"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import langid, licenses, mixture, neighbours, ordermin, packing, pages, pii, quality, simhash
from tallyloom.llm.common import components, prepared
from tallyloom.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, fp long, block string, size string"
LONG = "Some words that go on. " * 20_000
ODD = [
    (1, "The same text of a few words, twice.", "en", "a", 0),
    (1, "The same text of a few words, twice.", "en", "a", 0),
    (2, "The same text of a few words, twice.", "en", "b", 0),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \n\t ", None, "b", 3),
    (None, "A text without an id, mail a.b@c.example.org now.", "en", "a", 9),
    (None, "A text without an id, mail a.b@c.example.org now.", "en", "a", 9),
    (6, LONG, "en", "c", len(LONG)),
    (7, "12 34 !!", None, "b", 8),
    (8, "x" * 50_000, "en", "c", 50_000),
    (8, "Le même identifiant, un autre texte.", "fr", "a", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    prepared(spark)
    return spark.createDataFrame([(*row, "k", "r", 1, "b", "s") for row in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in rows) == [(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 103)]


def test_components_need_few_jobs(spark):
    """Jobs and their plans are what the links cost the driver: a hub costs no round, a chain few, without broadcasts."""
    hub = [(0, i) for i in range(1, 300)] + [(500, 501), (501, 500)]
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101)]
    context = spark.sparkContext
    try:
        for name, pairs, most in (("hub", hub, 6), ("chain", chain, 80)):
            edges = spark.createDataFrame(pairs, "a long, b long")
            context.setJobGroup(f"components-{name}", name)
            found = components(edges)
            jobs = context.statusTracker().getJobIdsForGroup(f"components-{name}")
            context.setLocalProperty("spark.jobGroup.id", None)
            assert {r.root for r in found.collect()} == ({0, 500} if name == "hub" else {0, 100})
            assert 0 < len(jobs) <= most, (name, len(jobs))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_any_links(spark):
    for seed, nodes, size in ((1, 60, 40), (2, 200, 190), (3, 40, 300)):
        rng = np.random.default_rng(seed)
        pairs = [(int(a), int(b)) for a, b in rng.integers(-nodes, nodes, (size, 2))]
        root = {x: x for pair in pairs if pair[0] != pair[1] for x in pair}
        for _ in root:
            for a, b in pairs:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        rows = components(spark.createDataFrame([*pairs, *pairs[:5], (None, 1)], "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in rows) == sorted(root.items())


def test_order_minhash(odd, none):
    rows = ordermin.compared(odd).collect()
    assert len(rows) == len(ODD)
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_chars, empty.fingerprint, empty.near_edited) == (0, "", 1.0)
    assert empty.edited_sha256 == hashlib.sha256(b"").hexdigest()
    # The null id comes first; behind id 8 it follows again.
    last = next(r for r in rows if r.doc_id == 8 and r.n_chars == 50_000)
    assert last.edited_sha256 == hashlib.sha256(("x" * 25_000 + ODD[6][1]).encode()).hexdigest()
    assert ordermin.compared(none).collect() == []
    one = ordermin.compared(odd.where("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_order_matters(spark):
    """Blocks of words in another order have the same words, and a lower likeness than equal order."""
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    odd_ones = words[:300] + [f"v{i}" for i in range(100)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(odd_ones))], "doc_id long, text string")
    prints = ordermin.fingerprints(ordermin.keyed(rows).withColumn("copy", F.lit(1)), ["key", "copy"], ["text"])
    by = {r.key: r.fp_text for r in prints.collect()}
    assert 0 < len(set(by[1]) & set(by[2])) < ordermin.BINS * 0.9
    assert set(by[1]) & set(by[3])


def test_neighbours(spark):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(200)]
    vectors += [(300, None, 0), (301, [0.0, 0.0, 0.0], 0), (302, [1.0, None, 0.0], 0), (303, [float("nan"), 1.0, 1.0], 0), (304, [float("inf"), 1.0, 1.0], 0)]
    vectors += [(400 + i, [50.0, 50.0, 50.0], 0) for i in range(40)] + [(400, [50.0, 50.0, 50.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, id int")
    rows = neighbours.search(frame, F.col("vec_id") % 100 == 0, 10).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100, 400)}
    assert {r.query_id for r in rows} == {0, 100, 400}
    assert found[400] == [(401 + i, 0.0) for i in range(10)]
    equal = [i for i in range(200) if i % 7 == 0 and i % 5 == 0 and i != 0]
    assert [i for i, _ in found[0]][: len(equal)] == equal[:10]
    assert neighbours.search(frame.limit(0), F.lit(True), 10).collect() == []
    few = neighbours.search(frame.where("vec_id < 3"), F.lit(True), 10).collect()
    assert Counter(r.query_id for r in few) == {0: 2, 1: 2, 2: 2}


@pytest.mark.parametrize("close, far", [(400, 6), (5, 3), (2, 1)])
def test_neighbours_beyond_the_reach(spark, close, far):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(size=(close, 8)), rng.normal(size=(far, 8)) * 10.0 ** np.arange(2, far + 2)[:, None]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") >= close, 10).collect()
    for query in range(close, close + far):
        distance = np.sqrt(((data - data[query]) ** 2).sum(axis=1))
        wanted = [i for i in np.lexsort((np.arange(len(data)), distance)) if i != query][:10]
        assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == query] == wanted


def test_every_block_is_compared(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 16)
    monkeypatch.setattr(neighbours, "ROUNDS", 0)
    data = np.random.default_rng(6).normal(size=(120, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.lit(True), 7).collect()
    for query in range(120):
        distance = np.sqrt(((data - data[query]) ** 2).sum(axis=1))
        assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == query] == np.argsort(distance)[1:8].tolist()


def test_hot_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 16)
    vectors = [(i, [1.0 + i * 1e-3, 1.0, 1.0]) for i in range(300)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") == 150, 4).collect()
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"])] == [149, 151, 148, 152]


def test_mixture(odd, none):
    rows = mixture.copies(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.copies <= 2 for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert set(targets) == {"Sa", "Sb", "Sc", "T"} and targets["T"] == 0
    assert mixture.copies(none).collect() == [] and mixture.mixed(none).collect() == []
    assert mixture.mixed(odd).columns == odd.columns


def test_targets_share_the_excess(spark):
    totals = spark.createDataFrame([("Sa", 10), ("Sb", 1000), ("Sc", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(totals).collect()}
    assert got["Sa"] == 20 and got["Sb"] == pytest.approx(2995 * 2 / 3) and got["Sc"] == pytest.approx(2995 / 3)
    totals = spark.createDataFrame([("Sa", 100), ("Sb", 300), ("Sc", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(totals).collect()}
    assert got["Sa"] == 200 and got["Sb"] == 600 and got["Sc"] == pytest.approx(2100 - 800)


def test_packing(odd, none):
    rows = packing.packed(odd, tokenizer()).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert all(filled[s] == 2048 for s in range(max(filled)))
    assert packing.packed(none, tokenizer()).collect() == []


def test_words_as_the_tokenizer_sees_them():
    from tokenizers import Tokenizer

    texts = [
        "It's 3rd-rate, don't! <|endoftext|> x<|startoftext|>y", "ÀÉÎ ß İstanbul Σίσυφος ΟΔΟΣ", "é  nbsp em \x1c\x85 sep", "日本語 text 😀 ok",
        "a\tb\nc\r\nd\x0be\x0cf", "² ½ × ÷ x́y", "",
    ]
    with open(tokenizer(), encoding="utf-8") as file:
        spec = file.read()
    words, whole = packing.WordIds(spec), Tokenizer.from_str(spec)
    assert words.pieces is not None
    for text, ids in zip(texts, words.encode(texts), strict=True):
        import numpy as np

        assert np.frombuffer(ids, words.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text


def test_words_are_remembered_by_their_pieces():
    """A word is encoded and remembered once, however it is written and whatever stands beside it."""
    with open(tokenizer(), encoding="utf-8") as file:
        words = packing.WordIds(file.read())
    words.encode(["Word, word. (WORD)! 2024", None, "word\tÉté été, ÉTÉ."])
    assert {word.lower() for word in words.known} == {"word", ",", ".", "(", ")!", "2", "0", "4", "été"}


@pytest.mark.parametrize("cached", [packing.CACHED, 20])
def test_ids_of_texts_cut_as_bytes(monkeypatch, cached):
    """Texts of one array, null, empty, plain and odd, with and without an offset, as the tokenizer alone sees them."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED", cached)
    monkeypatch.setattr(packing, "LEARNT", 7)
    plain = ["a", "S", "t", "ll", "RE", "don", "'", "''", " ", "\n", "\t", ".", ",", "<", "|", "1", "20", "É", "ñ", "ß"]
    odd = [*plain, "×", "÷", "ª", "\xa0", "\r", "\x1c", "\x7f", "\u0301", "\u0338", "“", "’", "İ", "日", "😀", "<|endoftext|>", "<|ENDOFTEXT|>"]
    draw = random.Random(4)
    texts = ["".join(draw.choices(draw.choice([plain, odd]), k=draw.randrange(12))) for _ in range(600)] + [None, ""]
    draw.shuffle(texts)
    with open(tokenizer(), encoding="utf-8") as file:
        spec = file.read()
    words, whole = packing.WordIds(spec), Tokenizer.from_str(spec)
    for start, stop in ((0, 0), (0, 1), (1, 200), (200, 201), (201, 602)):
        got = words.rows(pa.array(texts, pa.string()).slice(start, stop - start)).to_pylist()
        assert len(got) == stop - start
        for text, ids in zip(texts[start:stop], got, strict=True):
            want = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
            assert np.frombuffer(ids, words.dtype).tolist() == want, text


def test_gathered_batches_keep_their_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n] * 3, "n": [n] * 3}) for n in (1, 50, 0, 9, 200, 2)]
    got = list(packing.gathered(iter(batches), "text", 100))
    assert [row for batch in got for row in batch.to_pylist()] == [row for batch in batches for row in batch.to_pylist()]
    assert len(got) < len(batches) and list(packing.gathered(iter([]), "text", 100)) == []


def test_windows_keep_the_proportions(spark):
    """A third of the tokens in one source: every full window has a third of it, give or take a packet."""
    tokens = [(i, i, "Sa" if i % 3 == 0 else f"S{i % 3}", b"", 300 + i % 11) for i in range(3000)]
    frame = spark.createDataFrame(tokens, "row long, doc_id long, source string, ids binary, n long")
    rows = packing.layout(frame).collect()
    share, size = Counter(), Counter()
    for r in rows:
        window = r.sequence_id // 32
        size[window] += r.length
        share[window] += r.length * (r.row % 3 == 0)
    for window in range(max(size)):
        assert share[window] / size[window] == pytest.approx(1 / 3, abs=0.04)


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    network = quality.fit(odd, labels)
    scores = odd.select("doc_id", quality.scored(odd, network).alias("score")).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    unlabelled = quality.fit(odd, labels.limit(0))
    assert none.select(quality.scored(none, unlabelled).alias("score")).collect() == []
    assert odd.select(quality.scored(odd, unlabelled).alias("score")).first().score == pytest.approx(0.5)


def test_every_byte_counts():
    network = quality.Network()
    text = b"abc " * 50_000
    chunks = network.pooled(text)
    assert len(chunks) == -(-(len(text) - quality.WIDTH + 1) // quality.STEP) - 1
    assert (network.pooled(text + b"\xff" * 20).max(axis=0) != chunks.max(axis=0)).any()


def test_main_text(spark):
    page = (
        "<html><head><title>T</title></head><body><div class='cookie-notice'>We use cookies here, agree to all of them or leave</div>"
        "<nav><a href='/'>Home</a></nav><main><header><h1>A &amp; B</h1></header><p class=\"x>y\">First  par<b>agraph</b> with\n some more words in it.<br>"
        "<p>Second &lt;p&gt; with <a href='#'>a link</a> and more words than that."
        "<script>if (a < b) document.write('<p>no</p>')</script><div id=comments><p>A reader says quite a lot of words about the article here.</p></div>"
        "<form>Subscribe now to our letter</form></main><footer>&copy; 2020</footer>"
    )
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, "<p"), (5, "<!-- never closed <p>x"), (6, "a < b"), (7, "<p>" + "many words " * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.text for r in frame.select("page_id", pages.extracted(F.col("html")).alias("text")).collect()}
    assert got[1] == "A & B\nFirst paragraph with some more words in it.\nSecond <p> with a link and more words than that."
    assert got[2] == got[3] == got[5] == ""
    assert got[7] == ("many words " * 100_000).strip()
    assert frame.limit(0).select(pages.extracted(F.col("html"))).collect() == []


def test_main_text_in_wrappers():
    tree = pages.grown(np.array(pages.LABELLED, float))
    body = "<header class='entry-header'><h1>A heading</h1></header><p>" + "some words of the text " * 12 + "</p><p>" + "last words " * 10 + "</p>"
    text = "\n".join(["A heading", ("some words of the text " * 12).strip(), ("last words " * 10).strip()])
    links = "<ul>" + "<li><a href='/'>another page</a></li>" * 4 + "</ul>"
    for page in (
        f"<main><article>{body}</article></main><nav>{links}</nav>",
        f"<div class='layout has-sidebar'><main>{body}</main><aside>{links}</aside></div>",
        f"<div class='layout has-sidebar'><article>{body}</article></div>",
        f"<form id=f><nav>{links}</nav><main>{body}</main><footer>{links}</footer></form>",
        f"<form id=f><div class=page><nav>{links}</nav>{body}</div></form>",
        f"<div class='content-sidebar'><article>{body}</article><div class='site-sidebar'>{links}</div></div>",
    ):
        assert pages.main_text(page, tree) == text, page
    # What only quotes or announces articles stays out.
    teaser = "<article><p>" + "words of a teaser " * 10 + "</p></article>"
    for page in (f"<aside>{teaser}</aside>", f"<main>{body}<div id=comments>{teaser}</div></main>", f"<div class='related-posts'>{teaser}</div>"):
        assert "teaser" not in pages.main_text(page, tree), page


def test_main_text_before_links():
    tree = pages.grown(np.array(pages.LABELLED, float))
    assert all(pages.judged(tree, row[:-1]) >= 0.5 for row in pages.LABELLED if row[-1])
    for words in (1, 4, 8, 9, 15, 20, 27, 32, 80):
        for before in (0, 10, 30, 60):
            assert pages.judged(tree, (words, 0.0, before, 0.0, 4, 1.0, 1, 0)) >= 0.5, (words, before)
            assert pages.judged(tree, (words, 0.0, before, 1.0, 0, 0.0, 1, 0)) >= 0.5, (words, before)
            assert pages.judged(tree, (words, 0.4, before, 0.0, 30, 0.0, 1, 0)) >= 0.5, (words, before)
            assert pages.judged(tree, (words, 0.4, before, 0.0, 4, 1.0, 1, 0)) >= 0.5, (words, before)


def test_language(odd, none):
    models = langid.fit(odd)
    assert set(models) == {"en", "fr"}
    found = {r.doc_id: r.f for r in odd.select("doc_id", langid.identified(models, odd).alias("f")).collect()}
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (3, 4, 5, 7))
    assert found[1].lang_pred == found[6].lang_pred == "en"
    assert langid.fit(none) == {}
    assert odd.select(langid.identified({}, odd).alias("f")).first().f.lang_pred == "und"
    assert langid.keep_identified(odd, models).columns == odd.columns


def test_language_keeps_every_gram(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, 3_000)) for _ in range(80)]
    counts = Counter(gram for text in texts for gram in langid.grams([text])[0].tolist())
    assert len(counts) > 230_000
    model = langid.fit(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string"))["zh"]
    assert model.levels[0][0].tolist() == sorted(counts)
    once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
    context = Counter()
    for gram, n in counts.items():
        context[gram >> 16] += n
    gram = next(iter(counts))
    share = (counts[gram] - once / (once + 2 * twice)) / context[gram >> 16]
    assert model.levels[0][1][model.levels[0][0].searchsorted(np.uint64(gram))] == pytest.approx(share)


def test_language_model_sums_to_one(odd):
    import numpy as np

    model = langid.fit(odd)["en"]
    letters = model.levels[-1][0]
    context = np.uint64(sum(ord(c) << 16 * i for i, c in enumerate(reversed("wor"))))
    codes = (context << np.uint64(16)) | letters
    # What is missing to one is the unseen letter's, handed down through four orders.
    assert 1 - model.uniform <= model.probability(codes).sum() <= 1 + 1e-9
    noise = langid.predict({"en": model}, ["qxzv jkqw zzxq vvkj qqxz wvzk xjqz"], "noise")
    assert noise["rejected"].all()


def test_licenses(spark, odd, none):
    mit = ". ".join(licenses.SENTENCES[i] for i in ("mit-grant", "mit-notice", "mit-warranty")) + "."
    turned = ". ".join(licenses.SENTENCES[i] for i in ("mit-notice", "mit-grant")) + "."
    texts = ["Title\nReleased under the MIT License.\nMore text", mit.replace(" the software", "\nthe software"), turned, None, "", mit + "\n\nLicensed under CC BY 4.0."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scanned(frame).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "", 3: "", 4: "", 5: "MIT,CC-BY-4.0"}
    assert licenses.scanned(odd).count() == len(ODD) and licenses.scanned(none).collect() == []


def test_personal(odd, none):
    rows = pii.personal(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.spans for r in rows if r.doc_id is None] == ["email:27:44"] * 2
    assert all(r.spans == "" for r in rows if r.doc_id is not None)
    assert pii.personal(none).collect() == [] and pii.sanitised(none).collect() == []
    clean = pii.sanitised(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert [r.text for r in clean.where("doc_id is null").collect()] == ["A text without an id, mail [EMAIL] now."] * 2


def test_patterns_at_their_edges():
    cases = ["a@b.c@d.e", "@a.b", "x@y", "a@b..c", "a@@b.c", "%@-.-", "1.2.3.4.5.6.7.8", "1.2.3.256", "01.002.3.4", "4111 1111-1111 1111", "4111  1111", "+1 (2) 3-4567890.", "++12345678901", "9" * 3000]
    from tests.llm.test_queries import spans_by_pattern

    for case in cases:
        assert [f"{k}:{s}:{e}" for s, _, e, k in pii.base_spans(case)] == spans_by_pattern(case), case


def test_a_term_that_gives_an_entity_away(spark):
    rows = [(i, f"note {'abcdefgh'[i]}{'abcdefgh'[i]}{'abcdefgh'[i]} Zorblax wrote from z@x.example.com about the {'klmnopqr'[i] * 4}") for i in range(8)]
    rows += [(100 + i, f"the quiet note number about {chr(97 + i % 26) * 3} and the rest") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal(frame).collect()}
    start = rows[0][1].index("Zorblax")
    assert f"term:{start}:{start + 7}" in found[0].split(",")
    assert all(found[100 + i] == "" for i in range(300))
    text = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert "Zorblax" not in text[0] and "z@x" not in text[0] and text[100] == rows[8][1]
    # Copies of one passage are one piece of evidence.
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(8)] + rows[8:], "doc_id long, text string")
    assert not any("term" in r.spans for r in pii.personal(copies).collect())


def test_simhash(odd, none):
    rows = simhash.groups(odd).collect()
    assert len(rows) == len(ODD)
    group = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {c for (d, _), c in group.items() if d in (1, 2)} == {1}
    assert {c for (d, fp), c in group.items() if fp == 0} == {3}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, None: 1, 6: 1, 7: 1, 8: 2}
    assert simhash.groups(none).collect() == [] and simhash.keep_one(none).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_links_are_complete(spark, bits):
    import random

    draw = random.Random(bits)
    prints = {draw.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(4):
            prints.add(p ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 7))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}


def test_pipeline(spark, odd, none):
    for frame in (odd, none):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()


def test_terms_far_from_their_entity(spark):
    """Names at the other end of a long text, short names, and names that an address spells out; common words stay."""
    filler = [" ".join(f"{chr(97 + (i * j) % 26) * 3}" for j in range(1, 200)) for i in range(1, 40)]
    rows = [(i, f"{w} Quorlin {w} met Li {w} here. {filler[i]} And so on, write to box@x.example.com for more") for i, w in enumerate(["one", "two", "three", "four", "five", "six"])]
    rows += [(50, "Dear reader, Miss Vantongeren lives here. " + filler[7] + " Her address: vantongeren.k@y.example.com, and " + filler[8])]
    rows += [(60, "This is common to many, common and kind. Mail common.kind@y.example.com")]
    rows += [(100 + i, f"{filler[i % 39]} common here, and kind to all; met one two three four five six. This is more, write {filler[(i * 7) % 39]}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("term")} for r in pii.personal(frame).collect()}
    texts = dict(rows)

    def words(doc_id):
        return {texts[doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in found[doc_id]}

    assert all(words(i) == {"Quorlin", "Li"} for i in range(6))
    assert words(50) == {"Vantongeren"} and words(60) == set()
    assert not any(found[100 + i] for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert "Quorlin" not in clean[0] and "Vantongeren" not in clean[50] and clean[100] == texts[100] and clean[60].endswith("Mail [EMAIL]")


def test_every_mention_is_found():
    text = "Ann saw Bob. ann and BOB, Bob mail bob.b@x.org bob"
    spans = pii.base_spans(text)
    found = pii.terms_of(text, spans)
    assert [text[p["start"] : p["stop"]] for p in found["bob"][1]] == ["Bob", "BOB", "Bob", "bob"]
    assert "org" not in found and pii.parts("email:bob.b@x.org") == {"bob"} and pii.parts("ip:1.2.3.4") == set()


def test_every_neighbourhood_is_evidence(spark):
    """Texts that begin alike and differ only where a term stands for the fifth time and later are evidence each."""
    alike = "aa Norvex bb Norvex cc Norvex dd Norvex ee "
    found = pii.terms_of(alike + "Norvex ff Norvex gg", [])
    assert len(found["norvex"][0]) == len(found["norvex"][1]) == 6
    ways = "pqrstuvwxyz"
    rows = [(i, alike + " ".join(f"{w}{ways[i]} Norvex" for w in ways) + " mail zz@yy.org") for i in range(10)]
    frame = spark.createDataFrame([*rows, (90, "other words zz@yy.org")], "doc_id long, text string")
    terms = pii.disclosing(pii.scan(frame), frame).where("term = 'norvex'").collect()
    assert len(terms) == 1 and abs(terms[0].share - 1 / (1 + pii.CONFIDENCE**2 / 10)) < 1e-9


def test_rejection_is_calibrated():
    """Junk goes, however much it looks like words; new text stays, down to single words."""
    import random

    rng = random.Random(4)
    stems = ["ver", "lich", "sch", "und", "ung", "ein", "heit", "ge", "ten", "er"]
    texts = [" ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([1, 3, 30, 300]))) for _ in range(900)]
    learnt, new = texts[:600], texts[600:]
    codes, _ = langid.grams(learnt)
    codes, counts = np.unique(codes, return_counts=True)
    model = langid.Model(codes, counts)
    assert model.slack == langid.SLACK * model.mean
    langid.calibrated(model, codes, counts, learnt[:40])
    assert model.slack == langid.SLACK * model.mean  # too few to tell
    langid.calibrated(model, codes, counts, learnt[:200])
    assert langid.EXTRA <= model.slack < langid.SLACK * model.mean
    found = langid.predict({"de": model}, new, "calibrated")
    assert found.rejected.mean() <= 0.01
    junk = [" ".join("".join(rng.choice("verlichsungtd") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (3, 10, 100, 1000)]
    assert langid.predict({"de": model}, junk, "calibrated").rejected.tolist() == [False, True, True, True] or langid.predict({"de": model}, junk, "calibrated").rejected.all()
    assert langid.predict({"de": model}, ["Привет мир, как дела", "你好世界你好", "12 34", "", None], "calibrated").rejected.all()


def test_calibration_in_the_table(spark):
    rows = [(f"{'abcdefg'[i % 7]} some words of text {i % 11} and more of them", "en") for i in range(80)] + [("x" * 40_000, "en"), (None, "en"), ("no language", None)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert {r.lang for r in langid.held_texts(frame).collect()} == {"en"}
    models = langid.fit(frame)
    assert set(models) == {"en"} and langid.EXTRA <= models["en"].slack != langid.SLACK * models["en"].mean
    assert langid.fit(frame.limit(0)) == {}


def test_every_learning_text_calibrates(spark):
    """Many texts, some of them long: the slack is the quantile over all of them, copies counted once."""
    import random

    rng = random.Random(8)
    stems = ["ver", "lich", "sch", "und", "ung", "ein", "heit", "ge", "ten", "er"]
    texts = [f"{i} " + " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(3 + i % 40)) for i in range(700)]
    texts += [" ".join(rng.choice(["zyx", "qwv", "kkj"]) for _ in range(8_000)) + str(i) for i in range(20)]
    frame = spark.createDataFrame([(t, "de") for t in [*texts, texts[0], texts[1], "12 34"]], "text string, lang string")
    held = langid.held_texts(frame).collect()
    assert {r.text for r in held} == {*texts, "12 34"}
    model = langid.fit(frame)["de"]

    def counted(rows):
        return np.unique(langid.grams([r.text for r in rows])[0], return_counts=True)

    cost = []
    for fold in range(langid.FOLDS):
        others = langid.Model(*counted([r for r in held if r.fold != fold]))
        for text in {r.text for r in held if r.fold == fold} - {"12 34"}:
            found, (size,) = langid.grams([text])
            cost.append(float(-np.log(others.probability(found)).mean()) - model.mean - langid.SIGMAS * model.deviation / size**0.5)
    want = langid.WIDER * max(0.0, sorted(cost)[-(-len(cost) * 99 // 100) - 1]) + langid.EXTRA
    assert len(cost) == 720 and abs(model.slack - want) < 2 * langid.WIDER * langid.BIN


def test_asking_points_are_cut_into_blocks(spark, monkeypatch):
    """Few points filed, many asking the same cells: the answers are those of one block."""
    data = np.random.default_rng(3).normal(size=(150, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.search(frame, F.lit(True), 5).collect()))
    monkeypatch.setattr(neighbours, "ASKED", 7)
    assert sorted(map(tuple, neighbours.search(frame, F.lit(True), 5).collect())) == whole


def test_the_balls_around_fingerprints_are_not_broadcast(spark):
    """Spark sizes the exploded balls like the few fingerprints they come from, which is below its threshold."""
    prints = spark.createDataFrame([(1, 7), (2, 7), (3, 15), (4, 1 << 40)], "doc_id long, fp long")
    found = simhash.links(prints.select("fp").distinct())
    assert {(r.a, r.b) for r in found.collect()} == {(7, 15)}
    groups = simhash.groups(prints.select("doc_id", F.col("fp").cast("string").alias("text")))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, groups)]
    assert "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0]
    assert "Join" in plans[1] and plans[1].index("Join") == plans[1].index("SortMergeJoin") + len("SortMerge")  # the last join of all


def test_the_buckets_that_points_list_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the thousands of buckets a point lists like the point, which is below its threshold."""
    plans, stored = {}, neighbours.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(neighbours, "stored", seen)
    data = np.random.default_rng(5).normal(size=(60, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    assert neighbours.search(frame, F.col("vec_id") < 3, 2).count() == 6
    assert "MapInArrow" in plans["probes"] and "BroadcastHashJoin" not in plans["probes"] and "SortMergeJoin" in plans["probes"]


def test_exploded_terms_are_not_broadcast(odd):
    """Spark sizes terms after an explode like the rows they come from."""
    found = pii.scan(odd.select("doc_id", "text"))
    spans = pii.term_spans(found, pii.disclosing(found, odd))
    held, inside = [], None  # the lines below an exchange are indented further
    for line in spans._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        inside = None if inside is not None and depth <= inside else inside
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        held += [line] if inside is not None else []
    assert held and not [line for line in held if "Generate explode(terms" in line]
