import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitwall.llm import byte_cnn, kneser_ney, style_tree, webp
from tests.conftest import SF
from tests.llm.helpers import awkward, documents, nothing, texts

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ------------------------------------------------------------------------------------------------ language model


def tokens(text):
    return [*text.encode().translate(LOWER).split(), None]


def reference_scores(docs, order):
    """The model by definition, from plain counters."""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = {order: Counter()}
    for d, t in docs.items():
        if not held[d]:
            w = ["<s>"] * (order - 1) + tokens(t)
            counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    plain = Counter()
    for g, n in counts[order].items():
        plain[g[-1]] += n
    discount = {}
    for k, c in counts.items():
        of = Counter(c.values())
        discount[k] = (0.0, *kneser_ney.discounts(of[1], of[2], of[3], of[4]))
    totals, singles = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            totals[k, g[:-1]] += n
            singles[k, g[:-1]] += discount[k][min(n, 3)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(plain) + 1)
        total = totals[k, gram[:-1]]
        lower = p(gram[1:])
        n = counts[k][gram]
        return lower if not total else (max(n - discount[k][min(n, 3)], 0) + singles[k, gram[:-1]] * lower) / total

    n, v = sum(plain.values()), len(plain)
    out = {}
    for d, t in docs.items():
        w = ["<s>"] * (order - 1) + tokens(t)
        own = tokens(t)
        out[d] = (held[d], len(own), sum(x in plain for x in own), n, sum(math.log10((plain[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), sum(math.log10(p(tuple(w[i : i + order]))) for i in range(len(own))))
    return out


@pytest.mark.parametrize(("make", "order"), [(documents, 2), (awkward, 2), (awkward, 3)])
def test_language_model_equals_its_definition(spark, make, order):
    from pyspark.sql import functions as F

    docs = make(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (kneser_ney.remainder("doc_id", 5) == 1).alias("held_out"))
    model = kneser_ney.train(docs.where("NOT held_out"), order)
    got = {r.doc_id: tuple(r)[1:] for r in kneser_ney.score(docs, model).collect()}
    for d, want in reference_scores(texts(docs), order).items():
        assert got[d][:4] == want[:4] and np.allclose(got[d][4:], want[4:], rtol=1e-9)


def test_language_model_without_training_rows(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("held_out"))
    got = kneser_ney.score(docs, kneser_ney.train(docs.where("NOT held_out"))).collect()
    assert len(got) == 9 and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


# ---------------------------------------------------------------------------------------------------- classifier


def test_gradients():
    net = byte_cnn.Network(*(p.astype(np.float64) for p in byte_cnn.Network.fresh(3).parameters()))
    net.bias += np.random.default_rng(1).normal(0, 0.3, net.bias.shape)  # away from the kink of padding at 0
    texts_, labels = [b"hello *** world " * 40, b"plain text here", b""], np.array([0.0, 1, 1])

    def loss():
        p = byte_cnn.scores(net, texts_)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    r = np.random.default_rng(0)
    for part, gradient in zip(net.parameters(), byte_cnn._gradients(net, texts_, labels), strict=True):
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in part.shape)
            if part is net.embed and at[0] == byte_cnn.PAD:
                continue
            kept, h = part[at], 1e-6
            part[at] = kept + h
            up = loss()
            part[at] = kept - h
            slope = (up - loss()) / (2 * h)
            part[at] = kept
            assert abs(slope - gradient[at]) < 1e-5 + 1e-3 * abs(slope)


def test_scores_equal_a_plain_forward_pass(spark):
    """Window by window: each filter's largest value in a chunk, their maximum and mean over the chunks, two layers."""
    r = np.random.default_rng(2)
    net = byte_cnn.Network(*(p.astype(np.float64) for p in byte_cnn.Network.fresh(5).parameters()))
    net.bias += r.normal(0, 0.3, net.bias.shape)
    bodies = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 6, 7, 253, 300, 1500)]
    for body, score in zip(bodies, byte_cnn.scores(net, bodies), strict=True):
        peaks, start = [], 0
        while not peaks or start + byte_cnn.WIDTH - byte_cnn.STRIDE < len(body):
            values = []
            for at in range(start, start + byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
                window = [body[k] if k < len(body) else byte_cnn.PAD for k in range(at, at + byte_cnn.WIDTH)]
                values.append(np.concatenate([net.embed[k] for k in window]) @ net.filters)
            peaks.append(np.maximum(np.max(values, axis=0) + net.bias, 0))
            start += byte_cnn.STEP
        x = np.concatenate([np.max(peaks, axis=0), np.mean(peaks, axis=0)])
        z = np.tanh(x @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_chunks_cover_every_window():
    for n in (0, 1, 5, 6, 255, 256, 257, 1000, 5000):
        chunks, counts = byte_cnn.chunks_of([bytes(i % 251 for i in range(n)), b"x"])
        assert len(chunks) == counts.sum() and counts[0] * byte_cnn.STEP + byte_cnn.WIDTH - byte_cnn.STRIDE >= n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.train(docs, labels)
    rows = byte_cnn.score(docs, net).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    got = {r.doc_id: r for r in byte_cnn.score(awkward(spark), net).collect()}
    assert len(got) == 9 and got[1].score == got[2].score and got[5].score == got[6].score and all(0 <= r.score <= 1 for r in got.values())
    assert byte_cnn.score(nothing(spark), net).count() == 0


def test_without_labels():
    assert np.allclose(byte_cnn.scores(byte_cnn.fit([], np.array([])), [b"a"]), 0.5)
    assert byte_cnn.scores(byte_cnn.fit([b"a", b"b"], np.array([1, 1])), [b"zzz"])[0] > 0.9


# --------------------------------------------------------------------------------------------------------- media

CASES = [((), 0, False, 0), ((0,), 5, False, 0), ((1,), 0, True, 0), ((2,), 3, True, 2), ((0, 1, 2), 4, True, 0), ((3,), 0, False, 0), ((3, 0), 2, True, 2), ((2, 0, 1), 0, False, 3)]


@pytest.mark.parametrize("size", [(1, 1), (7, 5), (33, 13)])
@pytest.mark.parametrize("case", CASES)
def test_webp_round_trip(size, case):
    r = np.random.default_rng(sum(size))
    w, h = size
    few = r.integers(0, 256, (5, 4))
    for k, image in enumerate([few[r.integers(0, 5, (h, w))], few[r.integers(0, 2, (h, w))], np.cumsum(r.integers(0, 3, (h, w, 4)), axis=1) % 40, np.zeros((h, w, 4))]):
        image = image.astype(np.uint8)
        if 3 in case[0] and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
            continue
        assert (webp.decode(webp.encode_with(image, *case, seed=k)) == image).all()
        assert (webp.decode(webp.encode(image)) == image).all()


def test_media_are_written_by_the_method(monkeypatch):
    """Codes of mixed length, references, cache and each transform where it helps, read by the general decoder, alone and side by side."""
    r = np.random.default_rng(8)
    noise = lambda *shape: r.integers(0, 256, shape).astype(np.uint8)
    text = " ".join(f"word{int(x)}" for x in r.zipf(1.5, 4000) % 900).encode()
    grey = np.repeat(noise(40, 16, 1), 4, axis=2)
    slanted = noise(60, 32, 4)
    slanted[..., 0] += (slanted[..., 1].view(np.int8).astype(int) * 20 >> 5).astype(np.uint8) - slanted[..., 0] + slanted[..., 0] % 4
    repeated = np.concatenate([noise(30, 16, 4)] * 3)
    images = {
        "text": webp.image_of(webp.payload_of(text)), "grey": grey, "steps": np.cumsum(r.integers(0, 3, (40, 64, 4)), axis=1).astype(np.uint8), "columns": np.cumsum(r.integers(0, 3, (64, 32, 4)), axis=0).astype(np.uint8),
        "slanted": slanted, "few": noise(7, 4)[r.integers(0, 7, (50, 33))], "repeated": repeated, "blank": np.zeros((1, 16, 4), np.uint8), "lone": noise(1, 1, 4), "wide": noise(2, 300, 4),
    }
    streams = {k: webp.Stream(webp.encode(v)) for k, v in images.items()}
    kinds = {k: [t[0] for t in s.transforms] for k, s in streams.items()}
    assert kinds["few"] == [webp.PALETTE] and webp.SUBTRACT_GREEN in kinds["grey"] and webp.CROSS_COLOUR in kinds["slanted"]
    assert kinds["steps"][0] == kinds["columns"][0] == webp.PREDICTOR
    assert streams["text"].head.cache_bits and all(len(set(c.sizes.tolist())) > 2 for c in streams["text"].head.groups[0][:4])
    assert (streams["repeated"].head.groups[0][0].symbols >= 256).any() and len(webp.encode(repeated)) < len(webp.encode(repeated[:30])) + 100
    assert len(webp.encode(images["text"])) < 0.62 * len(text)
    # Also streams by the other encoder, with code groups, which are read one by one.
    data = [webp.encode(v) for v in images.values()] + [webp.encode_with(v, (2, 0), 4, True, bits) for v in images.values() for bits in (0, 2)]
    expected = [*images.values(), *[v for v in images.values() for _ in (0, 2)]]
    for few in (1, 5, 1000):
        monkeypatch.setattr(webp, "FEW", few)
        got = dict(webp.decode_many(data))
        assert len(got) == len(data) and all((got[i] == v).all() and (webp.decode(data[i]) == v).all() for i, v in enumerate(expected))
    monkeypatch.setattr(webp, "BLOCK", 64)
    for v in images.values():
        assert (webp.decode(webp.encode(v)) == v).all()
    # Code lengths are bounded whatever the counts, and complete.
    for most, counts in ((7, 2 ** np.arange(19)), (12, np.append(np.ones(700, int), 10**9)), (12, np.cumsum(np.arange(1, 300)) ** 3)):
        lengths = webp._limited(counts, most)
        assert lengths.max() <= most and (2.0**-lengths).sum() == 1


def test_a_stream_of_another_encoder():
    """The lossless image of one transparent pixel by which browsers are tested for the format."""
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]


def test_broken_webp():
    data = webp.encode(np.arange(256, dtype=np.uint8).reshape(4, 16, 4))
    for bad in (b"", data[:20], data[:-8], b"JUNK" + data[4:], data[:20] + b"\x00" + data[21:]):
        with pytest.raises(webp.Broken):
            webp.decode(bad)


def test_media_column(spark):
    for docs in (documents(spark).limit(40), awkward(spark)):
        back = webp.read_back(webp.stored(docs))
        bodies = texts(docs)
        for r in back.collect():
            payload = webp.payload_of(bodies[r.doc_id].encode())
            assert len(r.pixels) == 4 * r.width * r.height and bytes(r.pixels)[: len(payload)] == payload and len(payload) % 64 == 0
    assert webp.stored(nothing(spark)).count() == 0


def test_media_query(spark):
    bodies = texts(documents(spark))
    rows = webp.op6(spark, SF).collect()
    assert len(rows) == len(bodies)
    for r in rows:
        payload = webp.payload_of(bodies[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(bodies[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# ---------------------------------------------------------------------------------------------------------- html

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><div class="top-promo">Buy <b>now</b></div><div class="page">{body}</div>
<div class="block">Made with care for you</div><div id="comments"><p>nice!</p></div><footer>&copy; me</footer><script>if(a<b){{"</div>"}}</script></body></html>"""


def test_markup_cases():
    text = lambda html: style_tree.main_text(style_tree.parse(html), frozenset())
    assert text("<article><h1>A &amp; B</h1><p>one<br>two  \n three<p>four <b>bo</b>ld</article><p>after") == "A & B\none two three\nfour bold"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>tail &lt;i&gt; <di") == "a\nb\nc\nd\ntail <i>"
    assert text("plain words") == "plain words" and text("<p title='a>b'>x</p><!-- <p>no</p> --><p>y") == "x\ny"
    assert text("<main><div class='comments'>no</div><aside>no</aside>yes</main>") == "yes" and text("") == "" and text("<" * 50) is not None
    assert text("<div>" * 3000 + "deep") == "deep" and text("<i>" * 100_000 + "x") == "x"
    assert text("<article><p>first</p><p>second</p>" + "<div>" * 3000 + "deep") == "first\nsecond\ndeep"
    for name in ("share-price", "login-flow", "foot-care", "search-and-rescue", "header-files"):
        assert text(f"<main><div class='{name}'>kept</div></main>") == "kept", name
    for name in ("share-buttons", "top-promo", "siteFooter", "related-posts", "ad", "x comments", "cookie-notice"):
        assert text(f"<main><div class='{name}'>gone</div>kept</main>") == "kept", name


def test_entropies_equal_their_definition(spark):
    """Of a small site, by counting texts and children's styles of each path in plain Python."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class='m'>menu <b>{i % 2}</b></div><div><p>a</p>{'<p>b</p>' * (i % 3)}</div><p>text {i}</p></body>") for i in range(7)]
    seen = defaultdict(lambda: (Counter(), Counter()))
    for _, _, html in rows:
        met = set()

        def visit(node, path):
            path += (node.style,)
            words = []
            for x in node.items:
                words += visit(x, path) if isinstance(x, style_tree.Node) else x.split()
            if words and node.parent is not None and node.tag in style_tree.BLOCK:
                met.add((path, tuple(c.style for c in node.children), tuple(words)))  # noqa: B023
            return words

        visit(style_tree.parse(html), ())
        for path, children, words in met:
            seen[path][0][children] += 1
            seen[path][1][words] += 1

    def share(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 0.0

    want = sorted((sum(t.values()), round(share(c), 9), round(share(t), 9)) for c, t in seen.values())
    named = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", style_tree.host())
    got = style_tree.node_importance(named).collect()
    assert sorted((r.pages, round(r.presentation, 9), round(r.content, 9)) for r in got) == want
    assert all(abs(r.importance - (r.pages * (0.1 * r.presentation + 0.9 * r.content) + style_tree.PRIOR) / (r.pages + style_tree.PRIOR)) < 1e-9 for r in got)


def test_the_tree_changes_results(spark):
    rows = [(i, f"http://s.example/{i}", f"<body><article><div class='box'>Written by our team</div><p>Body {i}</p></article></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_tree = {r.text for r in style_tree.extract(pages).collect()}
    without = {r.text for r in style_tree.extract(pages, threshold=0.0).collect()}
    assert with_tree == {f"Body {i}" for i in range(8)} and without == {f"Written by our team\nBody {i}" for i in range(8)}


def test_repeated_branches_go_and_articles_stay(spark):
    rows = [(i, f"http://site.example/{i}", PAGE.format(body=f"<p>Story {i} of its own</p><p>More of {i * 17}</p>")) for i in range(8)]
    rows += [(100 + i, f"http://copy.example/{i}", "<body><article><p>the same</p></article><div>Same menu</div></body>") for i in range(8)]
    rows += [(200, None, None), (201, "http://x.example/", ""), (202, "nonsense", "<p>a</p>"), (203, "http://one.example/", PAGE.format(body="<p>only</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert all(got[i] == f"Story {i} of its own\nMore of {i * 17}" for i in range(8)) and all(got[100 + i] == "the same" for i in range(8))
    assert got[200] == got[201] == "" and got[202] == "a" and got[203] == "only\nMade with care for you"
    assert style_tree.extract(spark.createDataFrame([], pages.schema)).count() == 0


def test_importance_follows_entropy(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class='same'>menu</div><div class='own'>text {i}</div>") for i in range(6)]
    named = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", style_tree.host())
    found = sorted(r.content for r in style_tree.node_importance(named).collect())
    assert found[0] == 0.0 and abs(found[-1] - 1.0) < 1e-9


def test_tree_judges_inside_and_outside_of_articles(spark):
    inside = "<article><h1>Title {i}</h1><div class='box'>Follow our channel</div><p>Body {i} here</p></article><article class='comment'><p>Nice {i}</p></article>"
    outside = "<div class='story'>Main text {i} outside</div><article class='card'><p>Our best offer</p></article>"
    rows = [(i, f"http://in.example/{i}", f"<body>{inside.format(i=i)}</body>") for i in range(8)]
    rows += [(100 + i, f"http://out.example/{i}", f"<body>{outside.format(i=i)}</body>") for i in range(8)]
    rows += [(200 + i, f"http://mixed.example/{i}", f"<body><div class='story'>Main {i}</div><article class='card'><p>Teaser {i}</p></article></body>") for i in range(8)]
    rows += [(300, "http://one.example/", "<body><div>Main text</div><article>Teaser</article></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert all(got[i] == f"Title {i}\nBody {i} here" for i in range(8))
    assert all(f"Main text {i} outside" in got[100 + i] for i in range(8))
    assert all(got[200 + i] == f"Main {i}\nTeaser {i}" for i in range(8)) and got[300] == "Main text\nTeaser"
