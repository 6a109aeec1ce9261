"""Operators for training data against plain versions, on small cases with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import crf_language, decontamination, exact_dedup, lbl_model, licenses, mixing, ngram_join, sharding, token_codec, warc
from millrace.llm.components import components
from millrace.llm.shared import scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(k, base[k % 12] if k % 3 else prose(rng, rng.randrange(1, 80)), ("en", "de", None)[k % 3], (None, "a", "B", "a")[k % 4]) for k in range(150)]
    return [*rows, (900, None, None, None), (901, "", "en", "a"), (902, " \t\n", "en", "a"), (903, "one two", "en", "b"), (904, "One TWO", "en", "b"), (905, "x " * 3000, "en", "b"), (3, base[3], "en", "a"), (3, "other", "en", "a")]


# Exact deduplication


def ascii_lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.md5(t), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, tmp_path, mixed_rows, digest):
    rows = [*mixed_rows, (None, "one two", None, None), (950, "ÉCOLE", None, None), (951, "école", None, None), (952, "KELVIN K", None, None), (953, "kelvin k", None, None)]
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.deduplicate(spark, str(tmp_path / "d"), digest=digest, files_per_batch=1, state_partitions=2)
    want = collections.Counter()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[ascii_lower(t)].append(i)
    stays = collections.Counter()
    for i, t, *_ in rows:
        g = groups[ascii_lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        sha = hashlib.sha256(ascii_lower(t).encode()).hexdigest()
        stays[keep, sha] = 1  # one row of each group, also where the identifier repeats or is null
        want[i, keep, len(g), sha] += 1
    found = got.collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert collections.Counter((r["doc_id"], r["text_sha256"]) for r in found if r["kept"]) == stays


def test_dedup_state_goes_on(spark, tmp_path):
    where, state = str(tmp_path / "d"), f"file://{tmp_path}/state"
    documents(spark, [(1, "a", None, None), (2, "b", None, None)]).coalesce(1).write.parquet(where)
    exact_dedup.ingest(spark, where, state, state_partitions=2)
    documents(spark, [(3, "A", None, None)]).coalesce(1).write.mode("append").parquet(where)
    held = {r["keep_id"]: r["group_size"] for r in exact_dedup.ingest(spark, where, state, state_partitions=2).collect()}
    assert held == {3: 2, 2: 1}


# Mixing


def test_mix_against_a_loop(spark, mixed_rows):
    docs = documents(spark, mixed_rows).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))
    plan = {r["src"]: r for r in mixing.fit_mix(docs).collect()}
    got = mixing.apply_mix(docs, mixing.fit_mix(docs)).collect()
    sizes = collections.Counter()
    for _, t, _, s in mixed_rows:
        sizes["n" if s is None else "a" + s] += len((t or "").split())
    total, order = sum(sizes.values()), sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        target = 3 * sizes[s] if s in capped else level * weight[s]
        assert abs(plan[s]["target"] - target) < 1e-6 and plan[s]["source_size"] == sizes[s]
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["mix_times"] <= 3
        taken["n" if r["source"] is None else "a" + r["source"]] += r["mix_times"] * r["mix_size"]
    largest = max(len((t or "").split()) for _, t, *_ in mixed_rows)
    assert all(abs(taken[s] - plan[s]["target"]) <= largest for s in order)
    mixed = mixing.mixed(docs, mixing.fit_mix(docs))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["mix_times"] for r in got)
    assert mixing.mixed(docs.limit(0), mixing.fit_mix(docs.limit(0))).count() == 0


# Sharding


def test_shards(spark, mixed_rows):
    docs = documents(spark, mixed_rows).withColumn("k0", F.lit(5)).withColumn("node", F.lit("x"))
    placed = sharding.shard_documents(docs, leaves=8)
    assert placed.columns == [*docs.columns, "shard_no"] and placed.count() == len(mixed_rows)
    size = collections.Counter()
    for r in placed.collect():
        size[r["shard_no"]] += len((r["text"] or "").encode()) + 1
    plain = {k: v for k, v in size.items()}
    assert set(plain) <= set(range(8))
    rows = sharding.numbered(placed.select("doc_id", "shard_no")).collect()
    for shard in plain:
        slots = sorted(r["slot"] for r in rows if r["shard_no"] == shard)
        assert slots == [*range(len(slots))]
    by_bytes = sharding.shard_documents(docs, target_bytes=2000)
    assert by_bytes.select("shard_no").distinct().count() > 2
    assert sharding.shard_documents(docs.limit(0), leaves=8).count() == 0


def test_shards_are_even_and_split_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(k, "same text again" if k % 3 == 0 else prose(rng, 1 + rng.randrange(9)), None, None) for k in range(3000)]
    placed = sharding.shard_documents(documents(spark, rows), leaves=5).collect()
    size = collections.Counter()
    for r in placed:
        size[r["shard_no"]] += len(r["text"].encode()) + 1
    assert max(size.values()) <= 1.05 * min(size.values())


# Language


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 4, 7])
    emit = rng.standard_normal((lengths.sum(), k)).astype(np.float32)
    moves, start = rng.standard_normal((k, k)).astype(np.float32), rng.standard_normal(k).astype(np.float32)
    got, at = crf_language.marginals(emit, lengths, moves, start), 0
    for n in lengths:
        want, total = np.zeros((n, k)), 0.0
        for path in np.ndindex(*[k] * n):
            p = np.exp(start[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[at : at + n], want / total, atol=1e-4)
        at += n
    long = np.tile(emit[1:5], (200, 1))
    assert np.allclose(crf_language.marginals(long, np.array([800]), moves, start), crf_language.pair_sums(long, np.array([800]), moves, start)[0], atol=1e-4)


def test_language_of_words_and_texts(spark):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "being", "nation", "with", "this"], "de": ["der", "schule", "einheit", "und", "lich", "zeitung"]}
    made = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, made(lang := ("en", "de")[k % 2], 40), lang if k % 5 else None, "s") for k in range(120)]
    docs = documents(spark, [*rows, (500, None, "en", None), (501, "12 ½ ...", "de", None), (502, "", None, None)]).withColumn("score", F.lit("clash"))
    model = crf_language.fit(docs, F.lit(True))
    got = {r["doc_id"]: r for r in crf_language.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == ("en", "de")[k % 2] and 0 <= got[k]["score"] <= 1 for k in range(120))
    assert {got[k]["lang_pred"] for k in (500, 501, 502)} == {"und"}
    tags = crf_language.Predictor(model).word_labels(made("en", 15) + " " + made("de", 15))
    assert [t[1] for t in tags] == ["en"] * 15 + ["de"] * 15
    nothing = crf_language.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in crf_language.predict(docs, nothing).collect()} == {"und"}


# Language model


def test_model_probabilities_sum_to_one_and_counts_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 30) if k else None, None, None) for k in range(80)]
    docs = documents(spark, rows)
    model = lbl_model.fit(docs, F.col("doc_id") % 4 != 0)
    v, p = model.vocabulary, model.parameters
    counts = collections.Counter(w for k, t, *_ in rows if k % 4 for w in [*(t or "").encode().lower().split(), b""])
    assert (v.total, v.distinct) == (sum(counts.values()), len(counts))
    ctx = np.array([[0], [1]])
    outputs = np.array([10 ** lbl_model.log_probabilities(p, ctx, np.array([y]))[0] for y in range(len(p.bias))])
    assert abs(outputs.sum() - 1) < 1e-4
    share = collections.Counter()
    for w, c in counts.items():
        y = lbl_model.Reader(v).places[lbl_model.Reader(v).ids[w]][1]
        if y >= v.outputs:
            share[y - v.outputs] += (c + 1) / (v.class_total[y - v.outputs] + v.class_words[y - v.outputs] + 1)
    assert all(s < 1 for s in share.values())  # what is left is for unknown words
    got = {r["doc_id"]: r for r in lbl_model.score(docs, model).collect()}
    for k, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        base = sum(np.log10((counts[w] + 1) / (v.total + v.distinct + 1)) for w in tokens)
        assert got[k]["n_tokens"] == len(tokens) and got[k]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert abs(got[k]["base_score"] - base) < 1e-6 and got[k]["score"] < 0
    assert lbl_model.score(docs.limit(0), lbl_model.fit(docs.limit(0), F.lit(True))).count() == 0


def test_model_classes_of_words_outside_the_head(spark, monkeypatch):
    """Totals of classes are summed by the bytes that scoring looks at, also for letters of several bytes and short words."""
    monkeypatch.setattr(lbl_model, "HEAD", 5)
    rng = random.Random(8)
    endings = ["é", "ü", "ñ", "für", "où", "ß", "a", "ab", "año", "été", "straße", "größe", "中文", "😀", "plain"]
    rows = [(k, " ".join(rng.choice(endings + [f"w{rng.randrange(30)}{rng.choice(endings)}"]) for _ in range(40)), None, None) for k in range(40)]
    v = lbl_model.fit(documents(spark, rows), F.lit(True)).vocabulary
    counts = collections.Counter(w for _, t, *_ in rows for w in [*t.encode().lower().split(), b""])
    total, words = np.zeros(lbl_model.SHAPES, np.int64), np.zeros(lbl_model.SHAPES, np.int64)
    for w, c in counts.items():
        place = lbl_model.Reader(v).places[lbl_model.Reader(v).ids[w]][1] - v.outputs
        if place >= 0:
            total[place] += c
            words[place] += 1
    assert len(v.head) <= 5 and np.array_equal(v.class_total, total) and np.array_equal(v.class_words, words)


# Token files


def test_huffman_code_is_prefix_free_best_and_limited():
    rng = np.random.default_rng(0)
    counts = (rng.pareto(0.7, 400) * 10 + 1).astype(np.int64)
    lengths = token_codec.code_lengths(counts)
    assert abs((0.5 ** lengths[counts > 0].astype(float)).sum() - 1) < 1e-12 and lengths.max() <= token_codec.MAX_BITS
    short = token_codec.code_lengths(2 ** np.arange(14), 5)
    assert short.max() == 5 and abs((0.5 ** short.astype(float)).sum() - 1) < 1e-12
    import heapq

    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((counts * token_codec.code_lengths(counts, 40)).sum()) == total


def test_blocks_decode_and_checkpoints_point_at_tokens():
    rng = np.random.default_rng(1)
    counts = np.zeros(1000, np.int64)
    blocks = [rng.zipf(1.4, n).clip(0, 999) for n in (1, 255, 256, 257, 5000)]
    for b in blocks:
        counts += np.bincount(b, minlength=1000)
    lengths = token_codec.code_lengths(counts)
    codes, table, steps = token_codec.canonical(lengths)
    packs = [(len(b), *token_codec.packed(b, lengths, codes)) for b in blocks]
    for b, got in zip(blocks, token_codec.unpacked(packs, table, steps), strict=True):
        assert np.array_equal(b, got)
    assert np.array_equal(packs[4][1], np.cumsum(np.append(0, lengths[blocks[4]]))[:-1][:: token_codec.STRIDE])


def test_token_files_round_trip(spark, mixed_rows):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    odd = ["İstanbul. ΑΣ Σ.", "''s.", ". ,", "Ⅷ. ²!!", " \tX.\r\n", "<|endoftext|>.", "Éé. ñÑ, ß, ẞ.", "한국어 عرب."]
    rows = [*mixed_rows, *((2000 + k, t, None, None) for k, t in enumerate(odd)), (None, "null id", None, None)]
    folder = scratch(spark, "test-tokens")
    files = token_codec.encode_documents(documents(spark, rows), folder, path, 2)
    got = sorted(map(tuple, token_codec.read_digests(spark, folder, files).collect()), key=lambda r: r[1])
    t, at, want = Tokenizer.from_file(path), 0, collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r[0] for r in got[1:]] == sorted(r[0] for r in got[1:]) and got[0][0] is None
    for r in got:
        assert r[1] == at
        at += r[2]


# Decontamination


def test_edit_search_against_a_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontamination.edit_search(a, b)[0] == min(row)


def test_decontamination_recall_and_clean_texts(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 15 + k)) for k in range(40)]
    clean = [prose(rng, 150) for _ in range(120)]
    texts, planted = [], {}
    for k in range(120):
        words = items[k % 40][1].upper().split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 8)):
            words[at] = "changed"
        host = clean[k].split()
        cut = rng.randrange(len(host))
        planted[k] = k % 40
        texts.append((k, " ".join([*host[:cut], *words, *host[cut:]]), None, None))
    docs = documents(spark, [*texts, *((1000 + k, t, None, None) for k, t in enumerate(clean)), (2000, None, None, None), (2001, "", None, None), (2002, "the " * 5000, None, None)]).withColumn("edits", F.lit("clash"))
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(found & set(planted.items())) >= 0.9 * len(planted)
    assert all(d < 1000 for d, _ in found)
    kept = {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


# Licenses


def test_license_scan(spark):
    mit = dict((label, phrase) for phrase, label in licenses.OWN)["mit"]
    edited = mit.split()
    edited[5:6] = ["really", "and", "truly"]
    rows = [(1, "x the GNU General-Public license, cc by cc by", None, None), (2, None, None, None), (3, "", None, None), (4, " ".join(edited), None, None), (5, "mit Licence", None, None), (6, "apache license " * 3, None, None), (None, "MIT license", None, None), (6, "apache license", None, None)]
    got = [r for r in licenses.scan(documents(spark, rows).withColumn("label", F.lit("c"))).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["last_word"], by[1]["base_labels"], by[1]["n_words"]) == (3, 2, 8, "cc-by,gpl", 10)
    assert (by[2]["n_words"], by[2]["labels"], by[2]["score"], by[2]["first_word"]) == (0, "", 0.0, None)
    assert by[4]["labels"] == "mit" and by[4]["base_labels"] == "" and 0.7 <= by[4]["score"] < 1
    assert by[5]["labels"] == "" and by[None]["base_labels"] == "mit"


# WARC


def test_warc_round_trip_and_lookup(spark):
    rng = random.Random(8)
    bodies = ["<p>same</p>", "", None, "<p>é ünï</p>"]
    pages = [(k, f"https://h{k % 7}.Example.com:8080/p/{k % 20}?q={k}#f" if k % 5 else None, bodies[k % 4] if k % 3 else prose(rng, 30)) for k in range(200)] + [(None, "http://x.org", "<p>null id</p>"), (7, "http://x.org/7", "<p>same</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    folder = scratch(spark, "test-warc")
    warc.archive(df, folder)
    got = collections.Counter(tuple(r)[:5] for r in warc.read_archives(spark, folder).collect())
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        last = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = i is not None and last != i
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert got == want
    index = warc.CaptureIndex(folder)
    for url in {u for _, u, _ in pages if u} | {"http://nowhere.org/"}:
        assert sorted(c["page_id"] or -1 for c in index.captures(url)) == sorted(i or -1 for i, u, _ in pages if u and warc.url_key(u) == warc.url_key(url))
    empty = scratch(spark, "test-warc")
    warc.archive(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


# N-gram join


def jaccard_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("sample", [1, 16], ids=["all frequent", "few frequent"])
def test_ngram_join(spark, monkeypatch, sample):
    """Families of variants of which some link, most don't; a passage that many share; and small cases."""
    monkeypatch.setattr(ngram_join, "SAMPLE", sample)
    monkeypatch.setattr(ngram_join, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    rng = random.Random(9)
    base, passage = prose(rng, 90).split(), prose(rng, 40)
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(90), rng.randrange(0, 6)):
            words[at] = f"v{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randrange(5, 40))} {passage} {prose(rng, 10)}" for _ in range(40)]
    texts += [texts[0], texts[0].upper(), "one two", "One two", "one two three", None, "", "a b c d e", "a b c d e f"]
    rows = [(1000 - k, t, None, None) for k, t in enumerate(texts)]
    docs = documents(spark, rows).withColumn("node", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.NgramJoin(docs).labelled().collect()}
    assert got == jaccard_components(rows)
    kept = ngram_join.one_of_each(docs, ngram_join.NgramJoin(docs).labelled())
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()} and kept.columns == docs.columns
    assert ngram_join.NgramJoin(docs.limit(0)).labelled().count() == 0


def test_ngram_join_of_short_texts_and_half_boilerplate(spark):
    """The bound by the last kept n-grams holds on either side of the middle of the hash range."""
    rng = random.Random(21)
    texts = []
    for _ in range(150):
        words = prose(rng, rng.choice([9, 9, 10])).split()
        texts += [" ".join(words), " ".join(words[:-1])]
    passage = prose(rng, 32)
    for k in range(40):
        own = prose(rng, 52).split()
        texts += [f"{' '.join(own)} {passage}", f"{' '.join(own[: -(k % 5) - 4])} {prose(rng, 3 + k % 5)} {passage}"]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.NgramJoin(documents(spark, rows)).labelled().collect()}
    assert got == jaccard_components(rows)


def test_ngram_join_of_repeated_and_null_identifiers(spark):
    """Each row has its own set; a row without an identifier bridges two; rows that only share an identifier stay."""
    rng = random.Random(33)
    a, b, c, d, bridge = (prose(rng, 40).split() for _ in range(5))
    near = lambda words, k, by: " ".join([*words[:k], *[f"{w}{by}" for w in words[k:]]])
    rows = [(1, near(a, 40, "")), (1, near(b, 40, "")), (7, near(a, 38, "z")), (8, near(b, 38, "z")), (9, near(c, 40, "")), (9, near(d, 40, "")), (9, near(d, 40, ""))]
    # 20 and 30 are each within reach of the row without an identifier, but not of each other.
    rows += [(20, near(bridge, 37, "x")), (None, near(bridge, 40, "")), (30, " ".join([*[f"{w}y" for w in bridge[:3]], *bridge[3:]]))]
    rows += [(40, None), (40, ""), (41, "only once"), (None, "nothing else")]
    docs = spark.createDataFrame([(i, t, None, None, k) for k, (i, t) in enumerate(rows)], DOCS)
    got = collections.Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.NgramJoin(docs).labelled().collect())
    whole = lambda i, comp: (i, 36, comp)
    want = [whole(1, 1), whole(1, 1), whole(7, 1), whole(8, 1), whole(9, 9), whole(9, 9), whole(9, 9), whole(20, 20), whole(None, 20), whole(30, 20)]
    assert got == collections.Counter([*want, (40, 0, 40), (40, 0, 40), (41, 1, 41), (None, 1, None)])
    kept = ngram_join.one_of_each(docs, ngram_join.NgramJoin(docs).labelled())
    left = sorted(r["n_chars"] for r in kept.collect())
    assert kept.columns == docs.columns and left in ([0, 1, 4, x, 7, 8, 10, 11, 12, 13] for x in (5, 6))


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}
