"""Token files, packing, SentencePiece and pages."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runnel.llm import lattice, packing, token_files, wrappers
from runnel.llm.common import doc_rows
from runnel.llm.queries import QUERIES, tokenizer_path

TEXTS = ["", None, " a  b\n\n c ", "\n", "   ", "naïve 日本語 𝔘 ░ a\x00b", "a" * 34, "x" * 500 + " " + "ab" * 100, "tab\there  \n  x", " " * 20 + "end", "the same", "the same", "It's 1,000.50 & more: don't!", "w " * 30_000]
SCHEMA = "doc_id long, text string, ids string, word string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "\n", None, None)], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
def test_blocks(ids):
    a = np.array(ids, np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(a)) == a).all()
    b = a % 1000
    assert (token_files.unpack_block(token_files.pack_block(b)) == b).all()


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = sorted(map(tuple, token_files.round_trip(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(3, "\n")]):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(docs.where("false"), tokenizer_path()).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 60), 8)))
        counts = np.array([r.randrange(1, 9) for _ in lengths])
        cuts, cost = packing.boundaries(lengths, counts, 3)
        cost_of = lambda c: sum(n * next(x for x in c if x >= k) for k, n in zip(lengths, counts))
        best = min(cost_of(sorted({*c, lengths[-1]})) for k in range(3) for c in itertools.combinations(lengths, k))
        assert cost == best == cost_of(cuts)


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([1, 1, 5, 9, 700, 90_000, 33, 33, 33])] + [(None, 4)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 3, 100).collect()
    assert len(out) == len(rows) and all(x.padding == x.bucket_len - x.n_tokens >= 0 for x in out)
    places = [(x.bucket, x.batch, x.slot) for x in out]
    assert len(set(places)) == len(out)
    assert all((x.slot + 1) * x.bucket_len <= max(100, x.bucket_len) for x in out)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_lengths(spark, docs):
    a = {(x.doc_id, x.n_tokens) for x in packing.token_lengths(docs, tokenizer_path()).collect()}
    b = {(x.doc_id, x.n_tokens) for x in token_files.round_trip(docs, tokenizer_path()).collect()}
    assert a == b


def test_lengths_keep_numbers_only():
    kept, enc = token_files.Lengths(tokenizer_path()), token_files.Encoder(tokenizer_path())
    texts = [t or "" for t in TEXTS]
    for limit in (500_000, 2):  # what is forgotten is encoded again
        kept.LIMIT = limit
        assert kept.lengths(texts) == kept.lengths(texts) == [len(x) for x in enc.encode(texts)]
    assert len(kept.rest) == 2 and all(isinstance(x, int) for x in kept.rest.values())


def test_sentencepiece(spark, docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for frequent in (100_000, 3):
        out = lattice.decode(lattice.encode(docs, path, frequent), path).collect()
        assert len(out) == len(TEXTS) + 1
        for r in out:
            assert r.ids == sp.encode(TEXTS[r.doc_id] or "") and r.text == (TEXTS[r.doc_id] or "")
    for r in lattice.round_trip(docs, path).collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert lattice.round_trip(docs.where("false"), path).count() == 0


def test_folds_agree(spark):
    model = lattice.load(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(4)
    words = [" " * r.randrange(3) + "".join(r.choice("etaoinshrdlu日ñ,") for _ in range(r.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "word string, n long")
    a, b = ({x.word: x.ids for x in lattice.encode_words(df, model, native).collect()} for native in (True, False))
    assert a == b


def test_viterbi(spark):
    r = random.Random(6)
    pieces = [(p, i, -r.random() * len(p) ** 0.5) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "bb", "abab"])]
    model = lattice.Model(None, "unigram", tuple(pieces), (), 99, ())
    words = ["".join(r.choice("ab") for _ in range(n)) for n in range(1, 9)] + ["acb"]
    got = {x.word: x.ids for x in lattice.encode_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), model).collect()}
    score = {p: (s, i) for p, i, s in pieces}

    def best(w):
        if not w:
            return 0.0
        return max(score[w[:k]][0] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score)

    for w in words[:-1]:
        assert "".join(pieces[i][0] for i in got[w]) == w
        assert sum(pieces[i][2] for i in got[w]) == pytest.approx(best(w))
    assert got["acb"] == [0, 99, 1]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; %s</h1><p>One<br>two&nbsp;three <b>bold</b>.<p>Second &lt;x&gt; %s<aside>Side</aside><div class="comments"><p>Nice!</p></div></article><footer>(c)</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE % (i, "y" * i), "z") for i in range(6)] + [(6, None, None, "z"), (7, "http://h0.example/q", "", "z"), (8, "::bad[", "plain <b>text</b>", "z"), (0, "http://h0.example/0", PAGE % (0, ""), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {x.page_id: x for x in wrappers.extract(df).collect()}
    for i in range(6):
        assert out[i].text == f"Head & {i} One two three bold. Second <x> {'y' * i}".strip() and out[i].n_chars == len(out[i].text)
    assert out[6].text == out[7].text == "" and out[8].text == "plain text"
    assert wrappers.extract(df).count() == len(rows) and wrappers.extract(df.where("false")).count() == 0
    w = {x.host: x.expression for x in wrappers.wrappers(wrappers.parsed(df)).collect()}
    assert "<article> <h1> # </h1> (<p> # </p>)+ <aside!> # </aside>" in w["h0.example"]


def texts(*pages):
    """Main texts of pages of one host, and its expression."""
    slots = [wrappers.Reader(p).slots for p in pages]
    whole = None
    for s in slots:
        whole = wrappers.merge(whole, wrappers.of_page(s)) if whole else wrappers.of_page(s)
    kinds = wrappers.by_path(wrappers.chosen(whole))
    return [wrappers.text_of([p for p, _, _ in s], [t for _, t, _ in s], kinds) for s in slots], wrappers.expression(whole)


def test_wrappers_of_a_host_with_two_templates(spark):
    rows = [(i, u, f"<body><nav>Menu</nav><div>Site</div><article><p>Story {i}</p></article><div>By {i}</div></body>") for i, u in enumerate(["http://h/a", "http://h/b", None])]
    rows += [(i, u, f"<body><nav>Menu</nav><div>Old {i}</div><section>Fixed</section></body>") for i, u in enumerate(["http://h/c", "http://h/d", None, "http://["], 3)]
    out = {x.page_id: x.text for x in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Story {i}" if i < 3 else f"Old {i} Fixed" for i in range(7)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one</p><svg viewBox='0'/><p>two</p></article>", "one two"),
        ("<article><p>one</p><button>x<p>two</p></article>", "one two"),
        ("<div class='has-sidebar'><article><p>a b</p></article></div><div class='sidebar'>no</div>", "a b"),
        ("<div class='no-header'><article><p>a b</p></article></div>", "a b"),
        ("<div class='sidebar-layout'><article>a</article></div>", "a"),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>x</p></article>", "Title x"),
        ("<main><p>x</p><article class='comment'>bad</article></main>", "x"),
        ("<article><p>hi <span class='ad'>BUY <span>q</span> z</span>  there</p></article>", "hi there"),
        ("<article><p>let <math>x</math> be</p></article>", "let x be"),
        ("<body><h1>t</h1><p>const</p></body>", "t const"),
        ("<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "<p>end</article>", "deep end"),
        ("<article><p>" + "long " * 100_000 + "</article><footer>f</footer>", ("long " * 100_000).strip()),
    ],
)
def test_pages_of_a_template(page, text):
    assert texts(page, page, page)[0] == [text] * 3


def test_the_expression_decides_what_is_template():
    page = "<body><article><h1>t%d</h1><div class=xyz>Share this</div><p>text %d</p></article></body>"
    one, _ = texts(page % (1, 1))
    many, e = texts(*[page % (i, i) for i in range(6)])
    assert one == ["t1 Share this text 1"] and many == [f"t{i} text {i}" for i in range(6)]
    assert e == "<body> <article> <h1> # </h1> <div.xyz> # </div> <p> # </p> </article> </body>"
    same, _ = texts(*["<body><article><div><p>all of it</p></div></article></body>"] * 6)
    assert same == ["all of it"] * 6


def test_alignment_and_its_bound():
    e = texts("<p>a<ul><li>b<li>c</ul>", "<p>a<h2>x</h2><p>b")[1]
    assert e == "(<p> # </p>)+ (<ul> (<li> # </li>)+ </ul>)? (<h2> # </h2>)?"
    pages = [f"<body><div class=c{chr(97 + i % 26)}{chr(97 + i // 26)}><p>t{i}</p></div></body>" for i in range(200)]
    got, e = texts(*pages)
    assert got == [f"t{i}" for i in range(200)] and e.count("<div") <= wrappers.MOST + 1


def test_python_gets_texts_in_small_batches(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 5000).alias("text"))
    got = doc_rows(docs).mapInArrow(run, "rows long, bytes long").toPandas()
    assert got["rows"].sum() == 4000 and got["bytes"].max() < 5_000_000  # before: one batch of 20 MB
