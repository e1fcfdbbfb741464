"""Token counts, packing, language, toxicity, pages and URLs: brute force, round trips, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concordat.llm import language_id, queries, toxicity
from concordat.llm.common import held_out
from concordat.llm.html_text import extract_main_text, main_text
from concordat.llm.packing import RunIds, cut, pack
from concordat.llm.token_counts import counter_of, token_counts
from concordat.llm.url_filter import fit, judge_urls

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  a  b ", "<s>a</s> <|endoftext|><0x41>", "▁x ▁▁", "line\nbreak\t\x00\x1c", "É́ H̱ İ ß ﬁ 日本語 😀", "x" * 3000, "日" * 3000, "don't we'll '' 's1st"]


def odd_texts(n):
    pick, pieces = random.Random(7), list(counter_of(PIECES).machine.scores)
    kinds = [lambda: pick.choice("ab ▁\nthe rin"), lambda: pick.choice(pieces), lambda: chr(pick.choice([pick.randint(0, 300), pick.randint(0x300, 0x3000), pick.randint(0x1F000, 0x1FFFF)]))]
    return ["".join(pick.choice(kinds)() for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*ODD, *odd_texts(3000)]
    want = [len(model.encode(t or "", num_threads=1)) for t in texts]
    got = {r["doc_id"]: r for r in token_counts(docs(list(enumerate(texts))), PIECES).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert got[8]["n_bytes"] == 3000 and got[0]["n_bytes"] == 0 and got[9]["over_limit"] == (want[9] > 4096)
    assert token_counts(docs([]), PIECES).count() == 0


def test_chunk_maps_compose_in_any_cut():
    counter = counter_of(PIECES)
    for text in odd_texts(400):
        assert len({counter.count(text, size) for size in (1, 2, 5, 13, 1 << 16)}) == 1, text


def test_run_ids_are_the_librarys():
    ids, whole = RunIds(WORDS), Tokenizer.from_file(WORDS)
    for text in [t for t in [*ODD, *odd_texts(2000)] if t]:
        assert list(np.frombuffer(ids.encode([text.encode()])[0], "<u4")) == whole.encode(text, add_special_tokens=False).ids, text


def test_runs_of_letters_are_encoded_together():
    ids, whole = RunIds(WORDS), Tokenizer.from_file(WORDS)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    ids.tokenizer = Counted()
    words = [f"wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzäöüß'[i // 100]}" for i in range(1000)]
    odd = ["İstanbul", "ﬁn", "각", "가", "日本語", "x1", "a.b", "'s", "</w>", "ʼn", "<|endoftext|>", "ǅ"]
    got = ids.learn([w.encode() for w in [*words, *odd]])
    assert {r.decode(): np.frombuffer(i, "<u4").tolist() for r, i in got.items() if r.decode() in {*words, *odd}} == {
        w: whole.encode(w, add_special_tokens=False).ids for w in [*words, *odd]}
    assert len(asked) < 20 and len(asked[0].split()) > 1000


def test_packing_round_trip(spark, docs):
    pick = random.Random(1)
    rows = [*enumerate(ODD), (50, " ".join(f"w{pick.randint(0, 99)}" for _ in range(6000))), (51, "twice"), (51, "twice")]
    whole = Tokenizer.from_file(WORDS)
    pieces = pack(docs(rows), WORDS).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and {p["offset"] for p in pieces} == {0}
    for doc, text in rows[:-2]:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
        assert [p["start"] for p in own] == [s for s, _ in cut(len(ids), 2048)] and sum(p["length"] for p in own) == len(ids)
        for p in own:
            assert p["length"] & (p["length"] - 1) == 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert pack(docs([]), WORDS).count() == 0


def test_languages_of_held_out_documents(spark, docs):
    found = queries.op9_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found) and sum(r["rejected"] for r in found) <= 0.01 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edge_cases(spark, docs):
    learn = [(i, "the cat and the dog are in the house with them", "en") for i in range(30)] + [(i, "der hund und die katze sind in dem haus mit ihnen", "de") for i in range(30, 60)]
    learn += [(60, None, "en"), (61, "", "de"), (62, "text without language", None)]
    model = language_id.fit(docs(learn), F.lit(True))
    ask = docs([(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "der hund " * 20000), (5, "der hund"), (6, "ウェブサイト上の文字列")])
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(ask, model).orderBy("doc_id").collect()]
    assert got[:3] == [(i, "und", True) for i in (1, 2, 3)] and got[3:6] == [(4, "en", False), (5, "de", False), (5, "de", False)] and got[6][2]
    assert language_id.keep_identified(ask, model).columns == ask.columns and language_id.keep_identified(ask, model).count() == 3
    nothing = language_id.fit(docs([]), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(ask, nothing).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = queries.op5_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in found if r["toxic"] == 1]
    clean = [r for r in found if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_segments_are_maximal():
    pick = random.Random(2)
    for _ in range(300):
        n = pick.randint(1, 30)
        places = [(i, pick.choice([-2.0, 1.0, 3.0])) for i in sorted(pick.sample(range(n), pick.randint(0, n)))]
        line = [-1.0] * n
        for i, s in places:
            line[i] = s

        def split(a, b):  # the best segment, then the same on both sides of it
            best = max(((sum(line[i : j + 1]), i - j, -i) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*split(a, i), (i, j, best[0]), *split(j + 1, b)]

        got = toxicity.segments(places, 1.0)
        assert [round(s, 9) for *_, s in got] == [round(s, 9) for *_, s in split(0, n)]


def test_toxicity_edge_cases(spark, docs):
    rows = [(i, f"plain words number {i} of text") for i in range(60)] + [(i, f"plain words number {i} you stupid fool") for i in range(60, 90)]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)] + [(1000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels, F.lit(True))
    ask = docs([(1, None), (2, ""), (3, "?!"), (4, "you stupid fool"), (5, "plain words " * 20000), (4, "you stupid fool")])
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score_documents(ask, model).orderBy("doc_id").collect()]
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 0)]
    none = toxicity.fit(docs(rows), labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.score_documents(ask, none).collect()} == {0}


PAGE = """<html><head><title>x</title></head><body><header class="site"><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice"><p>We use cookies, to make it better.</p></div>
<div class="wrap"><div class="sidebar"><p>Some long text in a sidebar, with marks. And more, of them.</p></div><div class="post-body"><h2>Title here</h2><p>First  paragraph, long
enough to be content. It has marks, too; and more.</p><p>Short</p><div class="ad-box">Buy now!</div><blockquote>Quoted &amp; said: &eacute;t&eacute;.</blockquote><ul><li>one item</li><li>two <b>items</b></ul>
<script>if(a<b){x="</div>"}</script><form><p>Your mail, please.</p><input></form></div><section class="comments"><h3>3 comments</h3><p>I think, this is great. Thanks, really!</p></section></div><footer>Copyright.</footer></body></html>"""


def test_main_text(spark):
    want = "Title here\n\nFirst paragraph, long enough to be content. It has marks, too; and more.\n\nShort\n\nQuoted & said: été.\n\none item\n\ntwo items"
    assert main_text(PAGE) == want
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &lt; text"), (5, "u", "<p>a<p>b<br>c"), (6, "u", "<<>>< a"), (7, "u", "<p title='a>b'>" + "long. " * 50000 + "</p>"), (8, "u", "<script>only()")]
    table = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["text"]) for r in extract_main_text(table).orderBy("page_id").collect()]
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, "plain < text"), (5, "a\n\nb c"), (6, "<<>>< a"), (7, "long. " * 49999 + "long."), (8, "")]
    assert extract_main_text(table.limit(0)).count() == 0


def test_path_values_decide_on_pages_with_articles():
    line = "A sentence of the text, long enough to be content; it has marks too. And a second one, which says more."
    linked = "See <a href=/a>the long story of the harbour and of the people in it</a>."
    page = (f'<nav><a href=/>Home</a></nav><article><header class="entry-header"><h1>The title</h1></header><p>{line}</p><p>{linked}</p><p>{line}</p><p class="notice">{line}</p>'
            '<div class="ad">Buy!</div><ul class="related"><li><a href=/b>Another story</a></li></ul></article><footer>Copyright.</footer>')
    assert main_text(page).split("\n\n") == ["The title", line, "See the long story of the harbour and of the people in it.", line, line]
    teaser = f'<div class="text"><h2>Own title</h2>{f"<p>{line}</p>" * 4}</div><article><h3><a href=/d>Elsewhere</a></h3><p>Short teaser</p></article>'
    assert main_text(teaser).split("\n\n") == ["Own title", *[line] * 4]


def test_urls(spark):
    made = [f"https://www.h{i}.example.com/{lang}/{i}?q=1" for i in range(150) for lang in ("en", "de")] + [f"http://spam{i}.example.net/{lang}/{i}" for i in range(150) for lang in ("es", "fr")]
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/1#a", "http://a.example.com/en", "http://com", "x://notexample.com/en/?", "http://É.net/es/\n", "http://spam9.example.net/en/9" + "x" * 5000, "http://com/"]
    table = spark.createDataFrame(list(enumerate([*odd, *made, *made[:3]])), "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(table, queries.URL_RULES).collect()}
    assert len(got) == len(odd) + len(made) + 3
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(odd)) if i != 9] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/x", "www.example.com/en/"), ("example.com", "/en/1", "example.com/en/"), ("a.example.com", "/en", "com/"), ("com", "", None),
        ("notexample.com", "/en/", "com/"), ("É.net", "/es/\n", "net/es/"), ("com", "/", "com/")]
    assert got[4]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[8]["verdict"] == "block"
    assert {r["verdict"] for r in judge_urls(table.limit(2), queries.URL_RULES).collect()} == {"allow"} and judge_urls(table.limit(0), queries.URL_RULES).count() == 0


def test_every_labelled_url_is_counted(spark):
    good, bad = ([f"{host}{i}.example.com/{tag}/{i * 7919}" for i in range(6000)] for host, tag in (("blog", "en"), ("casino", "es")))
    rows = [(t, True) for t in good] + [(t, False) for t in bad] + [(good[0], True), ("x", None)]
    model = fit(spark.createDataFrame(rows, "text string, accepted boolean"))
    for side, texts in ((model.accepted, good), (model.rejected, bad)):
        assert side.totals[0] == sum(len(t) + 1 for t in texts)  # place 0: no context
    assert all(model.ratio(t) >= model.threshold for t in good[::50]) and all(model.ratio(t) < model.threshold for t in bad[::50])
    small = fit(spark.createDataFrame(rows, "text string, accepted boolean"), places=64)
    assert small.accepted.totals.shape == (64,) and small.ratio(good[1]) == small.ratio(good[1])


def test_held_out_rule(spark):
    got = {r[0]: r[1] for r in spark.range(-5, 200).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(-5, 200)}
