"""BPE, chat formatting, HTML extraction, sharding and the pipeline."""

import hashlib
import html
import random
import re
import struct
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheetlake.llm import bpe, chat_format, html_extraction, sharding
from sheetlake.llm.ngram_join import drop_near_duplicates
from sheetlake.llm.queries import QUERIES
from tests.llm.test_text_operators import LONG, brute_components

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBPE(f.read())


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(model, text):
    raw = b"".join(model.encode(text))
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


PARTS = ["the", " ", "\n", "'re", "'", "l", "<|endoftext|>", "é", "日本", "  ", "\t", "x" * 30, "1", "!!", "aaaa",
         "\u00a0", "\u3000", "ing", "'ll", "\x1c", "\x00", "İ", "\U0001f600", "e\u0301"]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_bpe_equals_the_library(ours, theirs, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rng = random.Random(3)
    for _ in range(1000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids(ours, text) == want
        machine = bpe.Decoder(ours)
        assert "".join(machine.feed([t]) for t in want) + machine.finish() == theirs.decode(want, skip_special_tokens=False)


def test_bpe_streams_long_pieces(ours, theirs):
    rng = random.Random(4)
    for text in ("a" * 20_000, "ab" * 9_000, "Ã" * 9_000, "".join(rng.choice("abcdefghinorste") for _ in range(30_000))):
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids
        machine = bpe.Transducer(ours)
        most, out = 0, []
        for at in range(0, len(text), 100):
            out += machine.feed(text[at : at + 100].encode())
            most = max(most, len(machine.kept))
        assert out + list(machine.finish()) == ids(ours, text)
        assert most <= ours.lookahead + 4096 + 200  # constant memory


def test_lookahead_suffices(ours):
    """Tokens that end before the lookahead stay, whatever follows."""
    rng = random.Random(6)
    letters = b"abcdefghiklmnorstuy "
    for _ in range(60):
        shared = bytes(rng.choice(letters) for _ in range(600))
        rows = [ours.merged(shared + bytes(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for _ in range(4)]
        stable = []
        for row in rows:
            end, own = 0, []
            for t in row:
                end += len(ours.bytes_of[t])
                if end > len(shared) - ours.lookahead:
                    break
                own.append(t)
            stable.append(own)
        assert stable[0] and all(s == stable[0] for s in stable)


def test_bad_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": [["ab", "a"], ["a", "b"]]}}')


def test_decoder_replaces_bad_bytes(ours):
    machine = bpe.Decoder(ours)
    half = ours.single["é".encode()[0]]
    assert machine.feed([half]) == "" and machine.finish() == "\ufffd"


def test_bpe_query(spark, theirs):
    texts = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a <|endoftext|> b"), (4, " \n\n x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("own"))
    rows = bpe.digest_tokens(docs, PATH).collect()
    want = []
    for d, t in texts:
        own = theirs.encode(t or "", add_special_tokens=False).ids
        back = theirs.decode(own, skip_special_tokens=False)
        digest = hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        want.append((d, len(own), digest, hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.digest_tokens(docs.limit(0), PATH).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "there <|im_end|>\n"), (1, 3, "assistant", "a\\<|b"),
    (1, 4, "assistant", "\\n"), (2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", None),
    (3, 5, "a\nb\\n<|im_next|>", "x"), (3, 5, "a\nb\\n<|im_next|>", "w"), (None, 1, "user", LONG),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("pieces", F.lit("own"))
    done = chat_format.format_conversations(turns)
    read = done.select("conv_id", "formatted", "pieces", chat_format.read_turns(F.col("formatted")).alias("turns"))
    for r in read.collect():
        own = sorted((t for t in TURNS if t[0] == r.conv_id), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [tuple(t) for t in r.turns] == [(t[2] or "", t[3] or "") for t in own]
        assert "".join(p.text for p in r.pieces) == r.formatted
        heads = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(own, own[1:], strict=False))
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == heads
    digest = {r.conv_id: r for r in chat_format.digest_conversations(turns).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"a\\<|b\\n").hexdigest() and digest[1].loss_chars == 7
    assert digest[2].loss_chars == 0 and digest[2].n_turns == 3
    assert chat_format.digest_conversations(turns.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|>nim_end\n", max_size=30))
def test_escapes_hold_no_control_string(text):
    written = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in written
    assert written.replace("<\\|", "<|").replace("\\\\", "\\") == text


PAGE = """<html><head><title>x y z w</title><script>if (a < b) {"</p>"}</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies for all</div>
<main><h2>Title &amp; more</h2><p title="a > b">First para   with
words &lt;b&gt; and more words here<br>next line.</p><!-- <p>no</p> --><p>Second para is here too with more words.</main>
<aside><p>Related things of great interest</p></aside><section class=comments><p>Great article I liked it so much</p></section>
<footer>&copy; all</footer></body>"""


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_extraction.learn_weights(pages)
    want = "Title & more\n\nFirst para with words <b> and more words here next line.\n\nSecond para is here too with more words."
    for w in (weights, html_extraction.Weights()):
        assert html_extraction.extract(PAGE, w) == want
        assert html_extraction.extract(None, w) == html_extraction.extract("", w) == html_extraction.extract("<p", w) == ""
    for r in html_extraction.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article))
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in parts)
        assert r.text == "\n\n".join(x for x in plain if x) and r.n_chars == len(r.text)


def test_html_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<p>plain"), (3, "u", "<" * 5000), (4, "u", "<p " * 3000),
            (5, "u", "<p>" + "word &amp; " * 20_000), (6, "u", "</div></p>tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    found = html_extraction.extract_pages(pages).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == by_id[2] == by_id[4] == "" and by_id[None] == "plain" and by_id[6] == "tail"
    assert by_id[5] == ("word & " * 20_000).strip()
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


WORDS = "<article><h1>Head words here</h1><p>Some words of the article.</p></article>"


@pytest.mark.parametrize(
    "before",
    ['<svg class="icon"/>', '<svg class="icon">', '<p><svg><g><path d="M0"/>', "<svg><title/><style/></svg>", "<button>Go", "<div><button>Go</div>",
     "<select><option>One", "<noscript>No script", "<template><b>No</b>", "<svg><foreignObject><p>No</p></foreignObject></svg>",
     "<button><div>Go</div></button>", "<template><p>No</p><template><p>No</p></template></template>", "<select><option>One<option>Two</select>",
     "<noscript><p>No script</noscript>", "<svg><title>No</title><style>a{}</style><text>No</text></svg>", "<button>A<button>B</button>",
     "<script>var a = '<p>'</script\n>", "<title>No words</title>"],
)
def test_html_left_out_elements(before):
    want = "Head words here\n\nSome words of the article."
    w = html_extraction.Weights()
    for after in ("", "<svg></svg>", "<button>Go</button><select></select>", "<noscript></noscript><template></template>"):
        assert html_extraction.extract(f"<body>{before}{WORDS}{after}", w) == want
    inner = f"<body><article><p>First words of it.</p>{before}<p>Other words of it.</p></article>"
    assert html_extraction.extract(inner, w) == "First words of it.\n\nOther words of it."


def test_html_kinds_keep_all_words(spark, monkeypatch):
    many = "col-12 col-md-4 d-none d-lg-block p-3"
    assert html_extraction.prior(html_extraction.kind_of("div", f' class="{many} sidebar widget"')) < 0
    assert html_extraction.prior(html_extraction.kind_of("div", f' class="{many} text"')) > 0
    page = f'<body>{WORDS}<div class="{many} sidebar widget">Other things to read</div><p>Last words here.</p>'
    assert "Other" not in html_extraction.extract(page, html_extraction.Weights())
    pages = spark.createDataFrame([(k, "u", page.replace("d-none", f"d-{k}")) for k in range(30)], "page_id long, url string, html string")
    whole = html_extraction.learn_weights(pages)
    monkeypatch.setattr(html_extraction, "LEARNED", 4)
    few = html_extraction.learn_weights(pages)
    assert len(few.words) + len(few.tags) == 4 < len(whole.words) + len(whole.tags)
    assert all(few.words[k] == whole.words[k] for k in few.words)
    assert all("Other" not in html_extraction.extract(page, w) for w in (few, whole))


def test_html_left_out_parts_cut_no_article(spark):
    share = '<div class="share" id="s-8123"><ul><li><a href=x>Post</a></li><li><a href=y>Send</a></li></ul><p>Share this</p></div>'
    nav = "<nav><ul><li><a href=x>Home</a></li></ul></nav>"
    text = "<p>A first paragraph of some more words.</p>"
    want = "Short title\n\nA first paragraph of some more words.\n\nLast words."
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for w in (html_extraction.Weights(), html_extraction.learn_weights(pages)):
        for mark in ("article", "main", 'div class="content"'):
            end = mark.split()[0]
            page = f"<body>{nav}<{mark}><h1>Short title</h1>{share}{text}{share}<p>Last words.</p></{end}><footer>All rights</footer>"
            assert html_extraction.extract(page, w) == want
        assert html_extraction.extract(f"<body><p>Top line</p>{nav * 3}<article>{text}</article>", w) == want.split("\n\n")[1]


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    loads = [list(table).count(i) for i in range(7)]
    assert max(loads) - min(loads) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_shard_columns_with_clashing_names(spark, tmp_path):
    cols = ["a.b", "_slot", "_SHARD", "_at", "_deal", "Slot"]
    rows = spark.createDataFrame([(i, i + 1, f"s{i}", i + 2, i + 3, i % 3) for i in range(50)], ["k", *cols[1:]]).withColumnRenamed("k", "a.b")
    for key, of in (("a.b", 0), ("slot", 5)):
        placed = sharding.assign_shards(rows, key, ["x", "y", "z"], 101)
        assert placed.columns == [*cols[:5], "slot", "shard"]
        table = sharding.lookup_table(["x", "y", "z"], 101)
        got = {r[0]: tuple(r) for r in placed.collect()}
        for i in range(50):
            row = (i, i + 1, f"s{i}", i + 2, i + 3, i % 3)
            slot = int(hashlib.sha256(str(row[of]).encode()).hexdigest()[:15], 16) % 101
            assert got[i] == (*row[:5], slot, "xyz"[table[slot]])
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["_deal"] for r in back.select("_deal").collect()) == list(range(3, 53))


def test_lookup_table_by_whole_permutations():
    names, slots = [f"n{i}" for i in range(7)], 211
    orders = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append([(start + k * step) % slots for k in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = shard
    assert sharding.lookup_table(names, slots).tolist() == [owner[s] for s in range(slots)]


def test_sharding(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, None)], "k long, shard string")
    placed = sharding.assign_shards(rows, "k", ["a", "b"], 101)
    got = placed.collect()
    assert len(got) == 4 and len({r.shard for r in got if r.k == 1}) == 1 and {r.shard for r in got} <= {"a", "b"}
    assert sharding.assign_shards(rows.limit(0), "k", ["a"], 2).count() == 0
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect()
    assert sum(r["count"] for r in back) == 4
    table = sharding.lookup_table([f"shard-{i:03d}" for i in range(sharding.SHARDS)])
    for r in QUERIES["op4_sharding"](spark, SF).collect():
        slot = int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == slot and r.shard == f"shard-{table[slot]:03d}"


def test_pipeline(spark):
    """Stage by stage against brute force; the columns of documents stay until the last one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, state = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    found = corpus_pipeline.run(spark, SF)
    state = {d: r for d, r in state.items() if any(c.isalpha() for c in r.text or "")}
    first = {}
    for d in sorted(state):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", state[d].text), d)
    state = {d: state[d] for d in first.values()}
    rows = [(d, r.text) for d, r in sorted(state.items())]
    state = {d: state[d] for d, _, c in brute_components(rows, 0) if d == c}
    judged = {r.doc_id: r.contaminated for r in QUERIES["op6_benchmark_decontamination"](spark, SF).collect()}
    want = {d for d in state if not judged[d]}
    assert {r.doc_id for r in found.collect()} == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == columns


TALK = "<h1>Head words here</h1><p>Some words of the article, and then some more of them.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar"><article>{TALK}</article>', f'<body class="header-fixed"><article>{TALK}</article>',
        f'<article class="post tags-food">{TALK}</article>', f'<section class="story share-enabled">{TALK}</section>',
        f'<div class="content with-sidebar">{TALK}</div>', f'<form action="x"><article>{TALK}</article></form>',
        f'<article><header>{TALK[:24]}</header>{TALK[24:]}</article>', f'<form>{TALK}</form>', f'<div class="page widget">{TALK}</div>',
        f'<article>{TALK}</article><div class="user-reviews"><p>I liked it</p></div>',
        f'<article>{TALK}</article><aside class="related"><article><p>Teaser words</p></article></aside>',
        f'<article>{TALK}</article><div class="comments"><article class="comment"><p>A comment here</p></article></div>',
    ],
)
def test_html_keeps_the_article(spark, page):
    menu = "<nav><a>Home</a> <a>News</a></nav>"
    pages = spark.createDataFrame([(k, "u", f"{menu}{page}") for k in range(3)], "page_id long, url string, html string")
    for w in (html_extraction.Weights(), html_extraction.learn_weights(pages), html_extraction.learned({})):
        for whole in (page, f"{menu}{page}"):
            assert html_extraction.extract(whole, w) == "Head words here\n\nSome words of the article, and then some more of them."


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</section>" * 50_000, "<article>" * 100_000 + "x"])
def test_html_deep_nesting_is_linear(page):
    start = time.process_time()
    assert html_extraction.extract(page, html_extraction.Weights()) == "x"
    assert time.process_time() - start < 20


def test_html_region_is_the_greatest():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 9))]
        spans = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((x for x, _, _ in spans), default=0)
        a, b = html_extraction.best_span(scores)
        assert sum(scores[a:b]) == max(best, 0)


def test_html_words_of_outside_kinds_weigh_less():
    w = html_extraction.Weights({"div": -0.6, "section": 2.0}, {})
    root = html_extraction.Node(None, "", "")
    div, section = (html_extraction.Node(root, k, k) for k in ("div", "section"))
    w.settle([root, div, section])
    assert 0.25 <= w.word(div) < w.word(section) == w.word(root) == 1.0


def test_bpe_remembers_few_bytes_and_forgets(ours, spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 20)
    small = bpe.ByteBPE(open(PATH, encoding="utf-8").read())
    for k in range(60_000):
        small.piece(f" w{k}")
        assert small.taken <= bpe.REMEMBERED
    assert 0 < len(small.known) < 60_000
    small.forget()
    assert not small.known and not small.taken
    docs = spark.createDataFrame([(1, "the text é"), (2, None), (None, ""), (1, "the text é"), (3, "x" * 100_000)], "doc_id long, text string")
    got = sorted((tuple(r) for r in bpe.digest_tokens(docs, PATH).collect()), key=str)
    two = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()
    assert got == sorted(((r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in two), key=str)


def test_near_copies_of_one_doc_id_are_judged_by_their_text(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, one, 0), (2, one, 1), (2, two, 2), (None, one, 3), (4, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = sorted(r["a.b"] for r in drop_near_duplicates(docs).collect())
    assert kept == [0, 2, 3, 4, 5]
