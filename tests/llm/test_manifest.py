import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracelode.llm import manifest
from tracelode.llm.queries import op11_merkle_manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    """The levels of a tree over ``nodes``, from the ground up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified), by the plainest way: whole trees in memory."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, leaf_of((r[0], r[1], r[2], r[3], r[4]))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    order = {lang: sorted(by_lang[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for lang in langs}
    trees = {lang: tree_of([x[1] for x in order[lang]]) for lang in langs}
    upper = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (r, leaf) in enumerate(order[lang]):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if altered else r[4]
            node, met = leaf_of((r[0], r[1], r[2], r[3], text)), ""
            for levels, at in ((trees[lang], i), (upper, k)):
                for level in levels[:-1]:
                    run = at // 8 * 8
                    before, after = "".join(level[run:at]), "".join(level[at + 1 : run + 8])
                    met += before + after
                    node = sha(before + node + after)
                    at //= 8
            out.append((r[0], leaf, trees[lang][-1][0], upper[-1][0], sha(met), node, node == upper[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def changed():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def test_every_row_by_plain_trees(spark, sf, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = got(op11_merkle_manifest(spark, sf))
    assert found == plain(rows)
    assert 0 < sum(not r[6] for r in found) < len(found)


@pytest.mark.parametrize("rows", [1, 8, 9, 64, 65, 600])
def test_blocks_of_blocks(spark, rows):
    """Low blocks and a small top, so that several rounds go up and down."""
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("l"), (F.col("id") % 7 % 3).cast("string")).alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text É "), F.col("id").cast("string")).alias("text"))
    want = plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert got(manifest.manifest(docs, changed(), height=1, top=4)) == want
    assert got(manifest.manifest(docs, changed(), height=2, top=20)) == want


def test_more_languages_than_the_driver_holds(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("ü"), (F.col("id") % 97).cast("string")).alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.lit("A b").alias("text"))
    want = plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert got(manifest.manifest(docs, changed(), height=1, top=5)) == want


def test_odd_rows_in_the_manifest(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(manifest.manifest(odd, changed())) == plain(rows)
    assert manifest.manifest(none, changed()).collect() == []
    lone = odd.filter("doc_id = 8")
    row = manifest.manifest(lone, F.lit(False)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha("") and row["verified"]


def test_any_change_is_seen(spark, documents):
    """Lower case that changes nothing verifies; a change anywhere in a row does not."""
    docs = documents.limit(50).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.concat(F.lit("Z"), "text")))
    for r in manifest.manifest(docs, F.lit(True)).collect():
        assert r["verified"] == (r["doc_id"] % 2 == 0)
