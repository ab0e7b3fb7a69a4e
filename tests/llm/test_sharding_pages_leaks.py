import math
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import crf, decontamination, pages, sharding
from tracelode.llm.queries import ORACLE, op8_rendezvous_sharding, op9_html_extraction, op10_decontamination


def test_slots_sizes_and_growth(spark, sf, documents):
    got = op8_rendezvous_sharding(spark, sf).toPandas().set_index("doc_id")
    for r in documents.collect():
        assert got.loc[r["doc_id"], "size"] == len(r["text"].encode()) + 8 and got.loc[r["doc_id"], "text_crc32"] == zlib.crc32(r["text"].encode())
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(got["law"]) == {"key"} and got["shard"].between(0, 23).all()
    assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 24)).all()


def best_shard(key, weights):
    """The shard of a key by plain arithmetic: least -ln(u) / weight, u from XXH64 of key and shard."""
    costs = []
    for shard, weight in enumerate(weights):
        inner = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=inner)
        costs.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, shard))
    return min(costs)[1]


def test_every_row_by_plain_arithmetic(spark, sf):
    rows = op8_rendezvous_sharding(spark, sf).collect()
    assert [(r["shard"], r["grown_shard"]) for r in rows] == [(best_shard(r["doc_id"], [1.0] * 24), best_shard(r["doc_id"], [1.0] * 25)) for r in rows]
    got = spark.range(500).select("id", sharding.rendezvous(F.col("id"), [1.0, 2.5, 0.5]).alias("s")).collect()
    assert [r["s"] for r in got] == [best_shard(r["id"], [1.0, 2.5, 0.5]) for r in got]


def test_weights_and_growth_at_scale(spark):
    keys = spark.range(40_000)
    w = [1.0, 2.0, 4.0]
    rows = keys.select(sharding.rendezvous(F.col("id"), w).alias("s"), sharding.rendezvous(F.col("id"), [*w, 1.0]).alias("g"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 8.0]).alias("h")).toPandas()
    assert np.bincount(rows["s"]) / 40_000 == pytest.approx(np.array(w) / 7, abs=0.01)
    assert ((rows["g"] == rows["s"]) | (rows["g"] == 3)).all() and (rows["g"] == 3).mean() == pytest.approx(1 / 8, abs=0.01)
    assert ((rows["h"] == rows["s"]) | (rows["h"] == 2)).all()  # a heavier shard only gains
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1.0, 0.0])


def test_odd_rows_in_shards(spark, odd, none):
    got = sharding.shard(odd, [1.0] * 4)
    assert got.count() == odd.count() and got.filter("doc_id = 3").first()["size"] == 8
    for r in got.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect():
        assert sorted(r["s"]) == list(range(len(r["s"])))
    assert got.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.shard(none, [1.0]).count() == 0


@pytest.fixture(scope="module")
def model():
    return pages.train()


def test_held_out_pages(model):
    right = total = 0
    for page in pages.labelled_pages(300, seed=12345):
        blocks, labels = pages.labelled_blocks(page)
        if blocks:
            delta = crf.Features.of(pages.feature_numbers(blocks)).sums(model.weights)
            right += int((model.viterbi(delta, crf.Chains(np.array([0]), np.array([len(blocks)]))) == labels).sum())
            total += len(blocks)
    assert right / total > 0.97


def article(html):
    """The blocks of the one article element of the test tables' template."""
    import html as h

    body = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", body.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
    return "\n".join(x for x in (" ".join(h.unescape(p).split()) for p in parts) if x)


def test_pages_against_their_template(spark):
    sf = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op9_html_extraction(spark, sf).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(html)
    assert sum(r["text"] == article(html[r["page_id"]]) for r in got) >= 0.97 * len(got)


def test_every_class_word_and_interface_word_counts():
    names = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    wide = "".join(f'<div class="wrap{c}{c} layout{c}{c}">' for c in names)
    block = pages.blocks_of(f'{wide}<div class="comments zz-reply"><p>{" ".join(sorted(pages.INTERFACE)[:38])}</p>')[0]
    numbers = pages.feature_numbers([block])[0]
    assert {"comments", "reply", "zz", "wrapaa", "layoutzz"} <= block.names
    assert {pages._bucket(f"name={w}") for w in block.names} | {pages._bucket(f"ui={w}") for w in sorted(pages.INTERFACE)[:38]} <= set(numbers)
    assert len(numbers) > 80


def test_parser():
    texts = lambda s: [b.text for b in pages.blocks_of(s)]
    assert texts("<p>a &amp; b\n  c<br>d<p>e<script>no</p></script><b>f</b><!-- g --><div>h<style>i</style></div>") == ["a & b c d", "e f", "h"]
    assert texts('<div title="a>b">x</div></p></div>y<ul><li>1<li>2</ul>') == ["x", "y", "1", "2"]
    assert texts("") == [] and texts("plain &lt;b&gt; &#233;") == ["plain <b> é"] and texts("<div><p>open <span>end") == ["open end"]
    assert texts("a < b and c > d") == ["a < b and c > d"]


def test_odd_pages(spark, model):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some text here.</p></article>"), (3, "u", "<<<>>><p"), (3, "u", "<<<>>><p")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = pages.extract(df, model).collect()
    assert len(got) == 5 and all(r["text"] is not None for r in got)
    assert [r["text"] for r in got if r["page_id"] is None] == ["Some text here."]
    assert pages.extract(df.filter("page_id > 9"), model).count() == 0


def test_leaks_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.execute(ORACLE["op10_decontamination"]).fetchall()}
    assert {tuple(r) for r in op10_decontamination(spark, sf).collect()} == want


def test_leaks_in_long_documents_and_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 3)
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 5, 8, 30, 200, 2000, 4))]
    docs = []
    for i, text in items:
        w = text.split()
        filler = [word() for _ in range(3000)]
        docs.append((i, " ".join([*filler, *(x.upper() + "," for x in w), *filler])))
        cut = w[: max(1, int(len(w) * 0.6))]
        docs.append((100 + i, " ".join([*filler, *cut])))
    docs += [(500, None), (501, ""), (None, docs[0][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, "... !!"), (None, items[3][1])], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))

    def contained(item, doc):
        a, b = decontamination.words_of(item or ""), decontamination.words_of(doc or "")
        n = min(5, len(a))
        s = decontamination.shingles(a, n) if a else set()
        return len(s) > 0 and len(s & decontamination.shingles(b, n)) >= 0.8 * len(s)

    want = sorted((str(d), str(i)) for d, t in docs for i, x in [*items, (None, items[3][1])] if contained(x, t))
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontamination.contained(frame, bench).collect()) == want
    leaky = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in decontamination.clean(frame, bench).collect()) == sorted(str(d) for d, _ in docs if str(d) not in leaky)
    assert decontamination.contained(frame, bench.filter("item_id > 99")).count() == 0
    assert decontamination.contained(frame.filter("doc_id > 999"), bench).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 100, 128, 129, 1500])
def test_no_pair_of_enough_containment_is_lost(n):
    """Whichever shingles an item misses, as long as it keeps the share, its signature meets the text."""
    size = decontamination.signature_length(n, 0.8)
    assert size >= 1 and n - size < math.ceil(0.8 * n)
    words = [f"w{i}" for i in range(n + 4)]
    index = decontamination.ItemIndex.of([(1, " ".join(words), 1)], 5, 0.8)
    text_shingles = [words[i : i + 5] for i in range(n)]
    for seed in range(6):
        keep = np.random.default_rng(seed).permutation(n)[: math.ceil(0.8 * n)]
        text = [w for i in sorted(keep) for w in [*text_shingles[i], f"gap{i}"]]
        assert index.candidates([["other"], text], {}) == [(1, 0)]


def test_repeated_items_each_give_a_row(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six")] * 3 + [(8, "two three")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items).collect()) == [(1, 7)] * 6 + [(1, 8)] * 2
    assert decontamination.clean(docs, items).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        '<div class="a b">x' * 100_000,
        "<b>" * 100_000 + "<hr>x" * 100_000,
        "<div>" * 100_000 + "x</p></q>" * 100_000,
        "".join(f'<div class="n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}">x' for i in range(100_000)),
    ],
    ids=["same names", "inline", "stray ends", "other names"],
)
def test_deep_pages_cost_their_length(model, page):
    began = time.thread_time()
    blocks = pages.blocks_of(page)
    assert len(blocks) in (1, 100_000) and len(pages.main_texts(model, [page])) == 1
    assert time.thread_time() - began < 30


def test_scores_handed_down_are_the_sums_of_all_features(model):
    for page in pages.labelled_pages(40, seed=77):
        blocks = pages.blocks_of("".join(piece for piece, _ in page))
        want = [sum(float(model.weights[f]) for f in row) for row in pages.feature_numbers(blocks)]
        assert pages.block_scores(model.weights, blocks).tolist() == pytest.approx(want)
