"""Operators and the pipeline against plain versions: loops over all rows, without the operators' own methods."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import crf_language, decontamination, lbl_model, licenses, mixing, sharding, token_codec, warc
from millrace.llm.shared import scratch

from test_llm import DOCS, documents, jaccard_components, mixed_rows, prose  # noqa: F401

ROMAN = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


# Decontamination


def edited(rng, words, n, kinds):
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), n), reverse=True):
        kind = rng.choice(kinds)
        if kind == "changed":
            words[at] = f"new{rng.randrange(1 << 30)}"
        elif kind == "left out":
            del words[at]
        else:
            words.insert(at, f"new{rng.randrange(1 << 30)}")
    return words


@pytest.mark.parametrize("kinds", [["changed"], ["left out"], ["put in"], ["changed", "left out", "put in"]], ids=lambda k: " or ".join(k))
def test_decontamination_finds_nine_of_ten_items_at_the_limit_of_edits(kinds):
    rng = random.Random(17)
    common = [f"w{k}" for k in range(3000)]
    some = lambda n: rng.choices(common, [1 / (k + 5) for k in range(3000)], k=n)
    for size in (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 30, 60):
        items = [some(size) for _ in range(120)]
        texts = [" ".join([*some(60), *edited(rng, item, int(size * decontamination.MAX_EDITS), kinds), *some(60)]) for item in items]
        block = decontamination.Items([(k, " ".join(item)) for k, item in enumerate(items)])
        found = {(n, item) for n, item, *_ in decontamination.found_in(block, texts)}
        assert sum((k, k) in found for k in range(len(items))) >= 0.9 * len(items), size


def test_decontamination_against_all_edit_distances(spark):
    """Every pair that is found is within the limit, and nearly every pair within it is found; ids repeat and are null."""
    rng = random.Random(18)
    items = [(k % 25, prose(rng, 4 + k)) for k in range(26)] + [(50, items_text := prose(rng, 30)), (51, items_text)]
    rows = []
    for k in range(90):
        item = rng.choice(items)[1].split()
        rows.append((None if k % 10 == 0 else k % 40, " ".join([*prose(rng, 20).split(), *edited(rng, item, rng.randrange(0, 1 + len(item) // 3), ["changed", "left out", "put in"]), *prose(rng, 20).split()]), None, None))
    docs = documents(spark, [*rows, (7, None, None, None), (8, "", None, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect())
    want = collections.Counter()
    for i, text, *_ in rows:
        for item, words in items:
            words = words.split()
            if decontamination.edit_search([*decontamination.hashed(words)], [*decontamination.hashed(text.split())])[0] <= len(words) * decontamination.MAX_EDITS:
                want[i, item] += 1
    assert not got - want and sum((want - got).values()) <= 0.1 * sum(want.values())


# Licenses


def test_license_scan_against_a_loop(spark):
    rng = random.Random(19)
    phrases = [p for p, _ in licenses.BASE] + ["gnu general", "public license", "cc", "by", "by cc by", "license mit"]
    texts = [" ".join(rng.choice(phrases if rng.random() < 0.5 else ROMAN) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    rows = [(k % 60 if k % 9 else None, t.upper() if k % 4 == 0 else t, None, None) for k, t in enumerate(texts)]
    rows += [(2, "gnu general", None, None), (2, "x general public license", None, None), (3, "mit license", None, None), (3, "mit license", None, None), (4, "é MIT_license " * 20_000, None, None)]
    want = collections.Counter()
    for i, text, *_ in rows:
        words = re.findall(licenses.LICENSE_WORD, text.lower())
        places = [(at, label) for phrase, label in licenses.BASE for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        want[i, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({label for _, label in places}))] += 1
    got = licenses.scan(documents(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert collections.Counter(map(tuple, got.collect())) == want
    assert licenses.scan(documents(spark, rows).limit(0)).count() == 0


def test_whole_license_texts_with_edits(spark):
    from millrace.llm import license_texts

    texts = {"mit": license_texts.MIT, "bsd": license_texts.BSD, "apache": license_texts.APACHE, "gpl": license_texts.GPL}
    rng, rows = random.Random(20), []
    for k, (_, text) in enumerate(texts.items()):
        words = text.split()
        rows.append((k, "Copyright 2020. " + " ".join(edited(rng, words, len(words) // 12, ["changed", "left out", "put in"])), None, None))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(documents(spark, [*rows, (9, "permission is granted to copy the software free of charge", None, None)])).collect()}
    assert all(label in got[k] for k, label in enumerate(texts)) and got[9] == [""]


# Sharding


def test_shards_against_a_plain_tree(spark):
    rng = random.Random(22)
    rows = [(k, prose(rng, 1 + rng.randrange(40)) + "é" * rng.randrange(9), None, None) for k in range(400)]
    docs = documents(spark, rows)
    placed = docs.select("doc_id", *sharding.coordinates("doc_id", "text", sharding.text_dimensions())).collect()
    points = [(r["doc_id"], r["z"], [r["k0"], r["k1"], r["k2"]], (r["d1"], r["d2"])) for r in placed]
    width = [max(1, max(p[2][i] for p in points) - min(p[2][i] for p in points)) for i in range(3)]

    def plain(points, leaves, first):
        if leaves == 1:
            return {p[0]: first for p in points}
        dim = max(range(3), key=lambda i: ((max(p[2][i] for p in points) - min(p[2][i] for p in points)) / width[i], -i))
        points = sorted(points, key=lambda p: (p[2][dim], *p[3]))
        goal, run, best = sum(p[1] for p in points) * (leaves // 2 / leaves), 0, (float("inf"), 0)
        for n, p in enumerate(points):
            best = min(best, (abs(run - goal), n))
            run += p[1]
        cut = best[1]
        return plain(points[:cut], leaves // 2, first) | plain(points[cut:], leaves - leaves // 2, first + leaves // 2)

    for leaves in (1, 2, 7, 32):
        coords = docs.select("doc_id", *sharding.coordinates("doc_id", "text", sharding.text_dimensions()))
        tree = sharding.grow(coords, leaves, 3, tolerance=0)
        assert {r[0]: r[1] for r in coords.select("doc_id", tree.shard(3)).collect()} == plain(points, leaves, 0)


def test_many_shards(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    sizes = sharding.shard_documents(docs, leaves=1000).groupBy("shard_no").count().collect()
    assert len(sizes) == 1000 and max(r["count"] for r in sizes) <= 22


# Mixing


def test_mix_with_columns_of_its_own_names(spark, mixed_rows):  # noqa: F811
    docs = documents(spark, mixed_rows)
    names = ["mix_src", "mix_size", "mix_source_size", "mix_target", "mix_times", "mix_hash", "src", "row", "full", "copy", "threshold"]
    clashing = docs.withColumns({name: F.lit(f"c{k}") for k, name in enumerate(names)})
    plan = mixing.fit_mix(clashing)
    plain = collections.Counter(r["doc_id"] for r in mixing.mixed(docs, mixing.fit_mix(docs)).collect())
    got = mixing.mixed(clashing, plan).collect()
    assert collections.Counter(r["doc_id"] for r in got) == plain and all(r[name] == f"c{k}" for r in got for k, name in enumerate(names))
    taken = mixing.apply_mix(clashing, plan)
    assert sum(r["mix_times"] for r in taken.collect()) == sum(plain.values()) and taken.columns.count("mix_size") == 1


# Captures


def test_captures_through_the_index_are_those_of_a_scan(spark, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_LINES", 7)
    rng = random.Random(23)
    urls = [f"http://h{k % 5}.org/a b/{k % 9} x?q= {k % 3}" for k in range(40)] + [None, "", "no host\nat all", "http://[bad", "http://hot.org/"]
    pages = [(rng.choice([None, *range(50)]), "http://hot.org/" if k % 3 == 0 else rng.choice(urls), rng.choice(["same", "", None, prose(rng, 5)])) for k in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "test-captures")
    warc.archive(df, folder)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    by = lambda rows: collections.Counter(tuple(r[f] for f in fields) for r in rows.collect())
    assert by(warc.look_up(df, folder)) == by(warc.read_archives(spark, folder)) and sum(by(warc.look_up(df, folder)).values()) == 400
    assert warc.look_up(df.limit(0), folder).count() == 0
    assert warc.look_up(spark.createDataFrame([(9999, "http://h0.org/"), (None, "http://nowhere.org")], "page_id long, url string"), folder).count() == 0


# Token files


def test_token_files_of_parts_that_are_read_in_splits(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codec, "BLOCK", 64)
    path, rng = tokenizers.path("word_bpe_49k.json"), random.Random(24)
    rows = [(k, prose(rng, rng.randrange(0, 300) if k != 200 else 9000), None, None) for k in range(400)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "16384")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        folder = scratch(spark, "test-splits")
        files = token_codec.encode_documents(documents(spark, rows).coalesce(1), folder, path, 2)
        assert not all(r["whole"] for r in files.collect())  # some file begins inside a document
        got = sorted(map(tuple, token_codec.read_digests(spark, folder, files).collect()), key=lambda r: r[1])
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = scratch(spark, "test-splits")
    files = token_codec.encode_documents(documents(spark, rows).limit(0).withColumn("part", F.lit(1)).withColumn("doc", F.lit("x")), empty, path, 2)
    assert token_codec.read_digests(spark, empty, files).count() == 0


def test_tokenizers_of_other_kinds_encode_whole_texts():
    tokenizers = pytest.importorskip("public_tokenizers")
    fast, whole = (token_codec.Encoder(tokenizers.path(name), 2) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert not fast.whole and whole.whole
    text = "Two  blanks, and\na line."
    assert np.frombuffer(whole.encode([text])[0], whole.dtype).tolist() == [*whole.tokenizer.encode(text, add_special_tokens=False).ids, 2]


# Language model


def test_scores_against_sums_over_all_outputs(spark):
    rng = random.Random(25)
    rows = [(k % 50, prose(rng, rng.randrange(0, 40)) if k % 7 else None, None, None) for k in range(90)] + [(None, "alpha1 beta2 unseen", None, None), (77, "word " * 3000, None, None)]
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    model = lbl_model.fit(docs, F.col("doc_id") < 40)
    v, p = model.vocabulary, model.parameters
    counts = collections.Counter(w for i, t, *_ in rows if i is not None and i < 40 for w in lbl_model.tokens_of((t or "").encode()))
    reader = lbl_model.Reader(v)

    def plain(text):
        tokens, total = lbl_model.tokens_of((text or "").encode()), 0.0
        places = [reader.places[reader.ids[w]] for w in tokens]
        for n, w in enumerate(tokens):
            before = [places[n - k - 1][0] if n > k else len(p.inputs) - 1 for k in range(lbl_model.CONTEXT)]
            scores = sum(p.inputs[b].astype(float) @ p.moves[k] for k, b in enumerate(before)) @ p.outputs.T + p.bias
            y = places[n][1]
            total += (scores[y] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / np.log(10)
            if y >= v.outputs:
                total += np.log10((counts[w] + 1) / (v.class_total[y - v.outputs] + v.class_words[y - v.outputs] + 1))
        return total

    want = sorted((str(i), round(plain(t), 2)) for i, t, *_ in rows)
    got = sorted((str(r["doc_id"]), round(r["score"], 2)) for r in lbl_model.score(docs, model).collect())
    assert [a[0] for a in got] == [a[0] for a in want]
    assert np.allclose([a[1] for a in got], [a[1] for a in want], atol=0.05, rtol=1e-4)


# Language of texts


def test_language_of_held_out_texts(spark):
    """Texts of words that were not seen in training, made from syllables that each language uses in its own way."""
    rng = random.Random(26)
    syllables = {"en": ["th", "ing", "wh", "ight", "ous"], "de": ["sch", "lich", "ung", "keit", "ber"], "es": ["cion", "illo", "que", "mente", "ado"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 5)))
    rows = [(k, " ".join(word(lang) for _ in range(25)), lang, None) for k in range(400) for lang in [("en", "de", "es")[k % 3]]]
    docs = documents(spark, rows)
    model = crf_language.fit(docs, F.col("doc_id") % 5 != 0)
    held = crf_language.predict(docs.filter("doc_id % 5 = 0"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


# The pipeline


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(27)
    items = [(k, prose(rng, 20)) for k in range(6)]
    base = [prose(rng, 60) for _ in range(30)]
    rows = [(k, t, ("en", "de")[k % 2], "ab"[k % 2]) for k, t in enumerate(base)]
    rows += [(100 + k, t + " more", "en", None) for k, t in enumerate(base[:10])] + [(200, None, "en", "a"), (201, "12 34", "de", "a"), (202, base[3], None, "b"), (202, base[3], None, "b")]
    rows += [(300 + k, f"{prose(rng, 30)} {items[k][1]} {prose(rng, 30)}", "de", "b") for k in range(4)]
    docs = documents(spark, rows).withColumn("mix_size", F.lit("clash")).withColumn("_lang", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    names = {n: r for n, r in enumerate(left)}
    groups = jaccard_components([(n, r[1]) for n, r in names.items()])
    least = {}
    for n, (i, *_) in names.items():
        comp = groups[n][1]
        if comp not in least or i < left[least[comp]][0]:
            least[comp] = n
    left = [left[n] for n in least.values()]
    hashed = lambda t: [*decontamination.hashed(decontamination.words_of(t))]
    left = [r for r in left if all(decontamination.edit_search(hashed(t), hashed(r[1]))[0] > len(t.split()) * decontamination.MAX_EDITS for _, t in items)]
    sizes = collections.Counter()
    for _, t, _, s in left:
        sizes["n" if s is None else "a" + s] += len(t.split())
    plan = {r["src"]: r for r in mixing.fit_mix(documents(spark, left)).collect()}
    assert {s: r["source_size"] for s, r in plan.items()} == sizes
    want = collections.Counter()
    for i, t, _, s in left:
        r = plan["n" if s is None else "a" + s]
        want[i, t] += r["full"] + (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) <= r["threshold"])
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == +want
    assert got and set(json.loads(docs.schema.json())["fields"][k]["name"] for k in range(len(docs.columns))) <= set(got[0].asDict())
    size = collections.Counter()
    for r in got:
        size[r["shard_no"]] += len(r["text"].encode()) + 1
    assert set(size) <= set(range(8))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    documents(spark, [(1, "a", "en", "a")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_special_tokens_in_any_case_are_encoded_as_in_whole_texts():
    import public_tokenizers as tokenizers

    rng = random.Random(23)
    path = tokenizers.path("word_bpe_49k.json")
    fast, whole = token_codec.Encoder(path, 2), token_codec.Encoder(path, 2, whole_texts=True)
    specials = [t.content for t in fast.tokenizer.get_added_tokens_decoder().values()]
    assert not fast.whole and specials
    cased = lambda t: "".join(rng.choice((c.lower(), c.upper(), c)) for c in t)
    names = [*specials, "<|endoftext|", "endoftext|>", "<|>"]
    texts = [" ".join(rng.choice(["", "a", "Word.", ",", "x"]) + cased(rng.choice(names)) + rng.choice(["", ".", ",", "b", "!"]) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    texts += [*specials, *map(str.upper, specials), "<|EndOfText|>", "a <|ENDOFTEXT|> b", "<|endoftext|>.", "<|EndOfText|>,"]
    assert fast.encode(texts) == whole.encode(texts)
