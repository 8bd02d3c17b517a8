"""Operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factgraph.llm import _spark, chat, html, neardup, packing, pieces, quality, sharding, substring, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, label string"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "x") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 160))] for _ in range(25)]
    shared = [r.choice(vocabulary) for _ in range(55)]
    out = []
    for k, words in enumerate(base):
        out.append(" ".join(words))
        if k % 5 == 0:
            out.append(" ".join(words))  # exact copy
        if k % 3 == 0:
            near = list(words)
            near[len(near) // 2] = "changed"
            out.append("  ".join(near).upper())
        if k % 4 == 0:
            out.append(" ".join(words[:10] + shared + words[10:]))
    return [*out, None, "", " \n", "one", "one", "x " * 3000]


def components(sets, percent):
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("n,hot,block", [(5, 1000, 512), (2, 2, 2)])
def test_near_duplicates_match_brute_force(spark, corpus, monkeypatch, n, hot, block):
    """With hot keys split and families compared bucket by bucket, as on large tables, too."""
    monkeypatch.setattr(_spark, "HOT_ROWS", hot)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = neardup.near_duplicates(docs(spark, corpus), p=neardup.Params(shingle=n)).collect()
    sets = [shingles(t, n) for t in corpus]
    label = components(sets, 80)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_edge_rows(spark):
    got = neardup.near_duplicates(docs(spark, ["a b c", "a b c", "a b c", None], [5, 5, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("5", "5", True), ("None", "None", False), ("None", "None", False)]
    assert neardup.near_duplicates(docs(spark, []).limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(docs(spark, ["a b c", "a b c", "x y", None], [5, 5, 6, 7]))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7]


def removal(texts, n=20):
    seen, out = set(), []
    words = [(t or "").split() for t in texts]
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                gone |= set(range(i, i + n))
            seen.add(g)
        out.append([x for k, x in enumerate(w) if k not in gone])
    return words, out


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_removal_matches_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(_spark, "HOT_ROWS", hot)
    got = {r["doc_id"]: r for r in substring.substring_report(docs(spark, corpus), p=substring.Params(hot=hot)).collect()}
    words, kept = removal(corpus)
    for i, (w, k) in enumerate(zip(words, kept, strict=True)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())


def test_removed_texts_keep_rows_and_columns(spark, corpus):
    d = docs(spark, corpus)
    got = {r["doc_id"]: r for r in substring.remove_repeats(d).collect()}
    words, kept = removal(corpus)
    assert len(got) == len(corpus)
    for i, t in enumerate(corpus):
        want = t if kept[i] == words[i] else " ".join(kept[i])
        assert got[i]["text"] == want and got[i]["label"] == "x" and (want is None or got[i]["n_chars"] == len(want))


def test_quality_filter_keeps_columns(spark, corpus):
    d = docs(spark, corpus)
    kept = quality.filter_quality(d)
    assert kept.columns == d.columns
    verdict = {r["doc_id"] for r in quality.quality_measures(d).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict


def test_packing_places_every_id_once(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(packing.token_pieces(docs(spark, [*corpus, "İ Σ. a\tb, <|endoftext|>x"]))).collect()
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in [*corpus, "İ Σ. a\tb, <|endoftext|>x"]]
    at = dict.fromkeys(range(len(ids)), 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert all(at[i] == len(x) for i, x in enumerate(ids))
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= packing.CAPACITY


def test_shortest_pack_first_places_all_lengths():
    r = random.Random(1)
    for _ in range(30):
        h = {r.randint(1, 64): r.randint(1, 50) for _ in range(20)}
        got = {}
        for pattern, n in packing.shortest_pack_first(h, 64):
            assert sum(pattern) <= 64
            for x in pattern:
                got[x] = got.get(x, 0) + n
        assert got == h


def test_kd_shards_are_near_equal_and_slots_gapless(spark):
    r = random.Random(2)
    texts = ["x" * r.randint(0, 50) for _ in range(3000)]
    d = docs(spark, [None, *texts])
    rows = sharding.shard_documents(d, 7).collect()
    size, slots = {}, {}
    for x in rows:
        size[x["shard"]] = size.get(x["shard"], 0) + x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert len(rows) == 3001 and max(size.values()) - min(size.values()) < 300
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(d.limit(0), 7).count() == 0


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "\\[x", "\\g\\b<", " [/INST]", "[ASST\\] x", "", None, "<s>", "tail </s", " [ROLE 41] "]
    rows = [(c, t, role, x) for c, (role, x) in enumerate((a, b) for a in ("user", "assistant", "system", "tool x", None) for b in texts) for t in (0, 1)]
    rows += [(None, 0, "user", "a"), (7000, 1, "assistant", "b"), (7000, 1, "assistant", "b"), (7000, None, "user", "first")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(d).collect()}
    want: dict = {}
    for c, t, role, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", x or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    r = got[7000]
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["b", "b"]


def test_url_rules(spark):
    rows = [(1, "http://a.EXAMPLE.org/es/x?y"), (2, "https://org/x"), (3, "http://example.org/en/12"), (4, "//example.org/es/"), (5, None), (6, "x://b.com/fr/#/de/"), (7, "x://b.com"), (8, "ftp://notorg/de/")]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), empty).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("org", "/x", "org/", "allow")
    assert got[3][2:] == ("example.org/en/1", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("b.com", "/fr/", "com/fr/", "allow") and got[7] == ("b.com", "", None, "allow") and got[8] == ("notorg", "/de/", None, "allow")


def test_mined_rules_block_what_labels_condemn(spark):
    rows = [(i, f"https://x{i % 37}.net/{'casino/win' if i % 5 == 0 else 'news/win' if i % 5 == 1 else 'casino/tour'}/{i}") for i in range(1000)]
    marks = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), marks).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(1000) if i % 5 == 0}


def test_top_k_matches_brute_force_with_ties_and_odd_vectors(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan"), 0.0, 0.0, 0.0]), (1003, [1.0]), (1004, []), (None, [1.0] * 4)]
    rows += [(2000, [1e6] * 4), (2001, [1e6] * 4)]
    d = spark.createDataFrame([(a, b, "z") for a, b in rows], "vec_id long, embedding array<double>, score string")
    got = topk.nearest(d, d.where(F.col("vec_id") % 50 == 0)).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got} == want
    assert topk.nearest(d.limit(0), d.limit(0)).count() == 0


def test_pieces_match_the_library(corpus):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    r = random.Random(1)
    letters = ["a", "e", "the", " ", "  ", "▁", "\n", "é", "梦", "😀", "<s>", "<0x41>", "ing", "\t", "1"]
    texts = [t or "" for t in corpus] + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(400)] + [" " * 50]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    m = pieces.Pieces(pieces.MODEL)
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)]
    assert got == lib.encode(texts)
    assert [m.decode(x) for x in got] == [lib.decode(x) for x in got]
    # the same pieces as a unigram model, with scores whose sums are exact
    model = proto.ModelProto()
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -3 - (i * 7919 % 1024) / 64
    uni = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    mine = pieces.Pieces.__new__(pieces.Pieces)
    mine.load(model)
    short = [t[:300] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(short)] == uni.encode(short)


def test_pieces_as_tables(spark):
    d = docs(spark, ["Some text,  twice.", None, "", "é\n"])
    encoded = pieces.encode_pieces(d)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded).collect()}
    assert back == {0: "Some text,  twice.", 1: "", 2: "", 3: "é\n"}


def test_extraction_of_held_out_pages():
    m = html.fitted()
    r = random.Random(99)
    wrong = total = 0
    for _ in range(150):
        nodes = html.Nodes()
        html.parse(html.training_page(r)[0], nodes)
        y, keep = html.labels(nodes), html.decode(nodes, m.score(html.features(nodes, m)))
        for i, t in enumerate(nodes.text):
            if t is not None:
                total += 1
                wrong += keep[i] != bool(y[i])
            if nodes.parent[i] >= 0:
                assert keep[nodes.parent[i]] or not keep[i]
    assert wrong / total < 0.03


def test_extraction_cases():
    m = html.fitted()
    page = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>A &amp; B&nbsp;c</h1><p>One <b>two</b>\n three.<p>Four<br>five.</article><section class='comments'><p>I liked it, thanks.</p></section><footer>&copy; me</footer>"
    got = html.extract([None, "", page], m)
    assert got == ["", "", "A & B c One two three. Four five."]


@pytest.mark.parametrize(
    "head,more",
    [
        ("<head><title>t</title></head>", "<script>for(i=0;i<n;i++)a[i]=0;</script>"),
        ("<head><title>t</title></head>", "<script><!-- if (a<b) c = '</p>'; </SCRIPT >"),
        ("<head><title>a <b</title><style>a<b{}</style>", "<textarea>x<y</textarea>"),
        ("<head><title>t</title><meta charset=utf-8><link rel=x href=y>", ""),
        ("<head><title>t</title><noscript><link rel=x>", ""),
        ("<head></head>", "<div><select><option>No<option>No</div>"),
        ("<head></head>", "<div><object data=x><p>No</p><object>No</object></div>"),
        ("<head></head>", "<div><noscript>No<b>No</b></div>"),
        ("<head></head>", "<svg><title>No</title><g><path d='x'/>"),
        ("<head></head>", "<svg><foreignObject><p>No</p></foreignObject><text>No</text></svg>"),
        ("<head></head>", "<math><mi>No</mi>"),
        ("<head></head>", "<select><option>No<select><option>No</select>"),
    ],
)
@pytest.mark.parametrize("body", ["<body>", ""])
def test_extraction_goes_on_after_raw_and_unclosed_elements(head, more, body):
    page = f"<html>{head}{body}<div class=x>{more}<div class=content><h1>Title</h1><p>One two three, four.</p>{more}<p>Five six seven, eight.</p></div></div>"
    nodes = html.Nodes()
    html.parse(page, nodes)
    assert [s for t in nodes.text if t for s in t if s.strip()] == ["Title", "One two three, four.", "Five six seven, eight."]
    assert html.extract([page], html.fitted()) == ["Title One two three, four. Five six seven, eight."]


def test_empty_tables(spark):
    d = docs(spark, []).limit(0)
    assert quality.quality_measures(d).count() == 0 and substring.substring_report(d).count() == 0
    assert packing.pack(packing.token_pieces(d)).count() == 0 and pieces.encode_pieces(d).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_main_text(pages).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("rare", [1, 4, 16, 1000])
def test_block_links_join_what_brute_force_joins(monkeypatch, rare):
    monkeypatch.setattr(neardup, "RARE", rare)
    r = random.Random(3)
    base = [r.getrandbits(62) for _ in range(60)]
    sets = [sorted(r.sample(base, r.randint(48, 60)) + [r.getrandbits(62) for _ in range(r.randint(0, 6))]) for _ in range(60)]
    n = len(sets)
    lists = pa.list_(pa.int64())
    keys = pa.array([[i % 3, 7 + i % 2] if i % 10 else [] for i in range(n)], lists)
    t = pa.table({"id": list(range(n)), "label": list(range(n)), "x": ["p"] * n, "y": ["q"] * n, "own": ["yx"[i % 2 == 0] for i in range(n)], "keys": keys, "shingles": pa.array(sets, lists)})
    common = neardup._common(pa.array(sets, lists), np.arange(n), np.arange(0, n, 2))
    for i in range(n):
        for j in range(0, n, 2):
            assert i == j or common[i, j // 2] == len(set(sets[i]) & set(sets[j]))
    got = neardup._block_links(t, 80)
    near = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])) and a % 10 and b % 10 and (a - b) % 6 in (0, 2, 3, 4)
    links = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert all(near(a, b) for a, b in links)

    def count(pairs):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return len({find(i) for i in range(n)})

    assert count(links) == count([(a, b) for a in range(0, n, 2) for b in range(1, n, 2) if near(a, b)])


@pytest.mark.parametrize(
    "part,text",
    [
        ("<p title=it's>More text, it is here.</p>", "More text, it is here."),
        ('<p><a href="x>More text</a> is here.</p>', "More text is here."),
        ("<p title='it>More text is here.</p>", "More text is here."),
        ('<p data-x="a > b" title=a"b>More text is here.</p>', "More text is here."),
        ('<img alt="x>y"><p>More <a href = "q">text</a> is here.</p>', "More text is here."),
        ('<p =x "y>More text is here.</p>', "More text is here."),
        ("<!--><p>More text is here.</p><!-- a > b --!>", "More text is here."),
        ("<p>More 1 < 2 text &lt;b> is here.</p>", "More 1 < 2 text <b> is here."),
    ],
)
def test_extraction_of_attributes_and_broken_quotes(part, text):
    page = f"<body><article><h1>Title here.</h1><p>One two three, four five six seven.</p>{part}<p>Eight nine, ten eleven twelve.</p></article></body>"
    assert html.extract([page], html.fitted()) == [f"Title here. One two three, four five six seven. {text} Eight nine, ten eleven twelve."]


def article_text(page):
    """The one article of a page of the tables, by regular expressions alone."""
    import html as entities
    import re

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:b|i|em|a)(?: [^>]*)?>", "", inner)
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_extraction_equals_the_articles_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r["page_id"]: (r["url"], article_text(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html.op1_html_extraction(spark, f"/root/testdata/{sf}").collect()}
    assert got == {k: (u, t, len(t)) for k, (u, t) in want.items()}


def test_extraction_of_odd_rows(spark):
    long = "<article><h1>Head</h1>" + "<p>One two three, four five six seven.</p>" * 30_000 + "</article>"
    rows = [(1, "u", long, "t"), (1, "u", long, "t"), (None, None, None, "t"), (2, "u", "", "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], len(r["text"]), r["n_chars"]) for r in html.extract_main_text(d).collect()]
    n = len("Head") + 30_000 * len(" One two three, four five six seven.")
    assert sorted(got, key=str) == sorted([(1, "u", n, n), (1, "u", n, n), (None, None, 0, 0), (2, "u", 0, 0)], key=str)


def test_chat_leaves_no_control_string_in_texts(spark):
    import re

    rows = [(1, 0, "user", "a <s> b"), (1, 1, "assistant", "[INST] hi"), (2, 0, "user", "x[/INST]"), (3, 0, "assistant", "plain \\ [x] <y>"), (4, 0, "system", "[ROLE 41\\] z</s>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(d).collect()}
    control = re.compile(chat._CONTROL)
    assert len(got[1]["formatted"]) == 49 and len(got[2]["formatted"]) == 28 and got[3]["formatted"] == "<s>[ASST] plain \\ [x] <y></s>"
    for c, r in got.items():
        marks = [m.group() for m in control.finditer(r["formatted"])]
        assert len(marks) == 1 + 2 * len(r["turns"])  # <s>, then a head and an end a turn
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, x) for k, _, role, x in rows if k == c]


def test_chat_query_agrees_with_its_sql_on_hostile_texts(spark, tmp_path):
    import duckdb

    r = random.Random(5)
    bits = ["a ", "<s>", "</s>", "[INST] ", "[/INST]", " [/SYS]", "[ASST\\] ", "\\", "[", "<", "[ROLE 4F] ", "\n", "é"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", *["".join(r.choice(bits) for _ in range(r.randint(1, 6))) for _ in range(8)]])) for c in range(150) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.SQL)
    got = {tuple(x) for x in chat.op7_chat_formatting(spark, str(tmp_path)).select(*want.columns).collect()}
    assert got == set(want.fetchall())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, enc, r = Tokenizer.from_file(public_tokenizers.path(name)), packing.Encoder(name), random.Random(3)
    bits = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", " ", "\n", "\t", "Hello", "İ", "Σ", "a.", "'s", "don't", "X,", "<|", "|>", "\u0301", "A", "日本", "\u00a0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [None, "Hello World\nNext, line."]
    assert enc.by_words == (name == packing.TOKENIZER)
    for a in range(0, len(texts), 50):
        ids, at = enc.encode(pa.array(texts[a : a + 50], pa.string()))
        for i, t in enumerate(texts[a : a + 50]):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids
    assert name != packing.TOKENIZER or tok.encode("<|ENDOFTEXT|>", add_special_tokens=False).ids == [27, 347, 40786, 4160, 91, 285]


def test_repeated_query_ids_ask_with_their_least_usable_vector(spark):
    nan = float("nan")
    rows = [(50, [nan, 1.0]), (50, [1.0, 2.0]), (100, [3.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, float("inf")]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.nearest(d, d.where(F.col("vec_id") % 50 == 0), k=9).collect()}
    one = 256 * 256
    assert [got[50, k] for k in range(1, 6)] == [(100, 3 * one), (2, 2 * one), (100, 2 * one), (1, one), (1, one)]
    assert [got[100, k] for k in range(1, 5)] == [(50, 2 * one), (2, one), (1, 0), (1, 0)]
    assert len(got) == 9


def look_alikes(n, seed):
    """Sets of words of which many pairs are a little over or under the limit."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(1, 5)):
            words[r.randrange(60)] = f"x{r.randrange(400)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_do_not_depend_on_block_sizes(spark, monkeypatch):
    """One family of 60 look-alikes, whole and in blocks of six, with tables that miss some pairs."""
    texts, found = look_alikes(60, 8), []
    for block, hot in ((1024, 1000), (6, 7)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(_spark, "HOT_ROWS", hot)
        found.append({r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts), p=neardup.Params(shingle=2, half_keys=3, rows=4)).collect()})
    assert found[0] == found[1]
    assert 1 < len(set(found[0].values())) < 60


def test_components_of_stars_and_chains(spark, monkeypatch):
    from factgraph.llm._graph import components as connected

    monkeypatch.setattr(_spark, "HOT_ROWS", 5)
    edges = [(1000, i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2040)] + [(3000, 3001), (3001, 3000), (3000, 3000), (199, 1500)]
    got = {r["id"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long"), _spark.Scratch(spark)).collect()}
    assert {k: v for k, v in got.items() if k != v} == {**{i: 0 for i in range(1, 200)}, 1000: 0, 1500: 0, **{i: 2000 for i in range(2001, 2041)}, 3001: 3000}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(_spark, "HOT_ROWS", 3)
    r = random.Random(1)
    left = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3, None]), i % 50) for i in range(200)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, y string")
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    assert sorted(map(tuple, _spark.spread_join(left, right, ["k"], _spark.Scratch(spark), how=how).collect()), key=str) == want


def test_substring_rows_of_one_id_and_without(spark):
    """Equal rows of an id keep their words; other texts of one id stand one after the other; null ids come first."""
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    other = " ".join(f"q{i}" for i in range(25))
    rows = [(None, passage), (3, passage), (4, other), (4, other), (5, f"{other} {r.random()}")]
    got = [(x["doc_id"], x["n_words"], x["n_removed"]) for x in substring.substring_report(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sorted(got, key=str) == sorted([(None, 30, 0), (3, 30, 30), (4, 25, 0), (4, 25, 0), (5, 26, 25)], key=str)
    two = [f"{passage} a", f"b {passage}"]
    cut = [x["n_removed"] for x in substring.substring_report(docs(spark, two, [7, 7])).collect()]
    assert sorted(cut) == [0, 30]


def mined_by_brute_force(rows, p):
    """Every set of tokens of a bad URL, counted over all labelled URLs."""
    import itertools
    import re

    def toks(url):
        return frozenset(f"0*{len(x)}" if x.isdigit() else x for x in re.split(r"[^a-z0-9]+", (url or "").lower()) if x)

    own = [(toks(u), bad) for u, bad in rows]
    n, b = len(rows), sum(bad for _, bad in rows)
    least = max(p.min_count, -int(-p.min_support * n // 1))
    sets = {frozenset(c) for t, bad in own if bad for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    good = {}
    for s in sets:
        met = [bad for t, bad in own if s <= t]
        hit = sum(met)
        if hit >= least and hit >= p.min_confidence * len(met) and (len(met) - hit) * n * p.min_conviction <= len(met) * (n - b):
            good[s] = (hit / len(met), hit / n)
    return {"+".join(sorted(s)): v for s, v in good.items() if not any(o < s for o in good)}, toks


@pytest.mark.parametrize("share", [0.25, 0.8])
def test_mined_rules_and_verdicts_match_brute_force(spark, share):
    """Also where most labelled pages are bad; with rules of up to four tokens, nulls and repeated rows."""
    r = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        t = [r.choice("abcd"), r.choice("efg"), r.choice("hij"), r.choice("kl")]
        bad = r.random() < (0.95 if t[0] == "a" and t[1] == "e" or t == ["b", "f", "h", "k"] else share)
        rows.append((i, f"https://{t[0]}.{t[1]}.net/{t[2]}/{t[3]}/{r.randrange(1000)}"))
        marks.append((i, 0 if bad and i % 2 else 1, 1 if bad and not i % 2 else None if i % 3 else 0))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, "https://example.org/es/a/e")]
    marks += [(7, None, None), (7, 0, 0), (2000, 0, 1), (None, 0, 0), (3000, 0, 0)]
    p = urls.Params(min_support=0.0, min_count=12)
    pages = spark.createDataFrame([(*x, "v") for x in rows], "page_id long, url string, verdict string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("rule", F.lit("x"))
    bad = {}
    for d, q, t in marks:
        bad[d] = bad.get(d, False) or q == 0 or t == 1
    known = [(u, bad[i]) for i, u in rows if i is not None and i in bad]
    want, toks = mined_by_brute_force(known, p)
    assert len(want) > 1
    labelled = spark.createDataFrame(known, "url string, bad boolean")
    got = {x["rule"]: (x["confidence"], x["support"]) for x in urls.mine(labelled, "bad", p, _spark.Scratch(spark)).collect()}
    assert got == want
    verdicts = sorted((str(x["page_id"]), x["mined_rule"], x["verdict"]) for x in urls.filter_urls(pages, labels, p=p).collect() if x["rule"] is None)
    first = lambda u: min((k for k in want if u and set(k.split("+")) <= toks(u)), default=None)
    assert verdicts == sorted((str(i), first(u), "block" if first(u) else "allow") for i, u in rows if i != 2001)


def test_url_rules_on_empty_tables(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.filter_urls(pages, labels).count() == 0
    some = spark.createDataFrame([(1, "https://a.com/de/x"), (1, "https://a.com/de/x")], "page_id long, url string")
    assert [r["verdict"] for r in urls.filter_urls(some, labels).collect()] == ["block", "block"]
    assert urls.filter_urls(pages, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_wide_urls_are_mined_by_their_rarest_tokens(spark):
    """Forty tokens in each of many bad URLs: item sets stay bounded, and the rule is found."""
    wide = "/".join(f"t{i}" for i in range(40))
    rows = [(f"https://bad{i}.com/{wide}/casino", True) for i in range(60)] + [(f"https://good{i}.com/{wide}", False) for i in range(200)]
    got = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), "bad", urls.Params(), _spark.Scratch(spark)).collect()
    assert [(r["rule"], r["confidence"]) for r in got] == [("casino", 1.0)]


@pytest.mark.parametrize("width", [1, 3])
def test_rules_of_cut_urls_match_brute_force(spark, monkeypatch, width):
    """URLs with more tokens than FP-growth gets: rules of rare, of common and of both kinds of tokens, copies, narrow URLs."""
    monkeypatch.setattr(urls, "INDEXED", 2)
    monkeypatch.setattr(_spark, "HOT_ROWS", 5)
    r = random.Random(11)
    rows = []
    for i in range(700):
        t = sorted(r.sample("abcdefghij", r.choice([2, 3, 6, 7, 8])))
        bad = r.random() < (0.9 if {"a", "b", "c"} <= set(t) or {"h", "i"} <= set(t) and "a" not in t else 0.3)
        rows.append((f"https://{'/'.join(t)}/{'twin/double/' if i % 3 else ''}{i}", bad))
    rows += [rows[0], rows[0], (None, True), (None, False)]
    p = urls.Params(min_support=0.0, min_count=20, width=width)
    want, _ = mined_by_brute_force(rows, p)
    assert max(k.count("+") for k in want) >= 2
    got = {x["rule"]: (x["confidence"], x["support"]) for x in urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), "bad", p, _spark.Scratch(spark)).collect()}
    assert got == want


@pytest.mark.parametrize("sites", [2, 3])
def test_rules_of_the_commonest_tokens_of_wide_urls_are_found(spark, sites):
    """Two tokens, each common among good URLs, condemn together; rarer ones, which always come together, fill the width of
    every bad URL. Sets of the 30 rare tokens of a site would be 2 ** 30."""
    wide = ["/".join(f"s{k}x{i}y" for i in range(30)) for k in range(sites)]
    rows = [(f"https://h{i}q.com/{wide[i % sites]}/free/pills", True) for i in range(60 * sites)]
    rows += [(f"https://g{i}q.com/{'free' if i % 2 else 'pills'}/{wide[i % sites] if i % 5 else 'x'}", False) for i in range(900 * sites)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages, labels).collect()
    assert {(x["mined_rule"], x["verdict"]) for x in got if rows[x["page_id"]][1]} == {("free+pills", "block")}
    assert {(x["mined_rule"], x["verdict"]) for x in got if not rows[x["page_id"]][1]} == {(None, "allow")}


def kd_by_hand(rows, dims, shards):
    """Splits (dims..., size, tie) at weighted medians of the widest dimension, one node after the other."""
    whole = [max(1, max(x[i] for x in rows) - min(x[i] for x in rows)) for i in range(dims)]
    out = [0] * len(rows)
    todo = [(list(range(len(rows))), 0, shards)]
    while todo:
        node, first, n = todo.pop()
        if n == 1 or not node:
            for i in node:
                out[i] = first
            continue
        width = [(max(rows[i][d] for i in node) - min(rows[i][d] for i in node)) / whole[d] for d in range(dims)]
        d = width.index(max(width))
        want, below, left = sum(rows[i][dims] for i in node) * (n // 2) // n, 0, []
        order = sorted({(rows[i][d], rows[i][dims + 1]) for i in node})
        for key in order:
            group = [i for i in node if (rows[i][d], rows[i][dims + 1]) == key]
            size = sum(rows[i][dims] for i in group)
            if below + size > want:
                if below + size - want < want - below:
                    left += group
                break
            left += group
            below += size
        gone = set(left)
        todo += [(left, first, n // 2), ([i for i in node if i not in gone], first + n // 2, n - n // 2)]
    return out


@pytest.mark.parametrize("shards,bins", [(7, 4096), (40, 4096), (12, 5)])
def test_kd_shards_match_a_tree_by_hand(spark, monkeypatch, shards, bins):
    """With a hot value of a dimension, ties, repeated rows and histograms that need several rounds."""
    monkeypatch.setattr(sharding, "BINS", bins)
    r = random.Random(shards)
    rows = [(r.choice([7, 7, 7, r.randrange(1000)]), r.randrange(40), r.randint(16, 400), r.randrange(2**33)) for _ in range(500)]
    rows += rows[:20]
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "a long, b long, size long, tie long, k long")
    got = {x["k"]: x["shard"] for x in sharding.kd_shards(d, ["a", "b"], "size", "tie", shards, _spark.Scratch(spark)).collect()}
    assert [got[k] for k in range(len(rows))] == kd_by_hand(rows, 2, shards)


def test_kd_shards_of_odd_rows(spark):
    d = docs(spark, ["x", "x", None, "", "é"] * 3, [1, 1, 2, None, 3] * 3).withColumn("shard", F.lit(5)).withColumn("slot", F.lit(5))
    rows = sharding.shard_documents(d, 40).collect()
    assert sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in rows) == sorted([("1", 17, zlib.crc32(b"x")), ("1", 17, zlib.crc32(b"x")), ("2", 16, 0), ("None", 16, 0), ("3", 18, zlib.crc32("é".encode()))] * 3)
    slots = {}
    for x in rows:
        assert 0 <= x["shard"] < 40
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_words_of_letters_and_signs_go_to_the_model_alone():
    """Letters that normalising only lowers, with or without signs after them, take no pass of the whole tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, enc, r = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.Encoder(packing.TOKENIZER), random.Random(5)
    whole = []
    each, enc._each = enc._each, lambda words: whole.extend(words) or each(words)
    texts = ["Thnden$$$ verstte%%% ÜBERGROẞ, lequeéaux*** ciónaße&&& ofan.", "teä### ÀÉÿ,!! ofan Thnden' verstte"]

    def equal(some):
        ids, at = enc.encode(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in some]

    equal(texts)
    assert sorted(w for w in whole if any(c.isalpha() for c in w)) == ["Übergroẞ,"]  # ends in a letter that is none of the fixed ones
    parts = [*"aQéÖß×÷ªµİŉﬁΣ'.,<_-1½\t😀", "́", "̸", "ͅ", " ", "‍", "'s", "’", "$$", "|>", "日本", "<|endoftext|>"]
    for _ in range(30):
        equal([" ".join("".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 40))) for _ in range(20)])


def test_the_keys_of_all_tables_are_counted_without_a_sort(spark, monkeypatch):
    """A class has half_keys**2 keys; only those of several classes reach the aggregates that sort."""
    plans, write = [], _spark.Scratch.write

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(_spark.Scratch, "write", seen)
    r = random.Random(6)
    words = [[r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "x"]) for w in words] + [" ".join([*w[:-1], f"y{i}"]) for i in range(3) for w in words[:2]]
    ids = [*range(len(texts) - 1), 2]  # the last one shares an id with another text
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(spark, texts, ids), p=neardup.Params(shingle=2)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1, 8: 1, 9: 3, 10: 4, 11: 5, 12: 0, 13: 1, 14: 0, 15: 1, 16: 0}
    of_keys = [x for x in plans if x.count("posexplode") >= 2 and "Aggregate" in x]
    assert of_keys and not [x for x in of_keys if "SortAggregate" in x]
